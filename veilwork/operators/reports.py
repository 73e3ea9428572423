"""Reports, checks and history over findings, events and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import text_sha256
from ..sources.tables import VALID
from .history import RANGE, carry, in_order

# Lists a detector depends on; a detector without an entry is always ready.
DETECTOR_LISTS = {"us.phone": ["us.npa"], "us.address": ["usps.suffix", "usps.state"]}

# How an attempt ended and the status it leaves.
COMPLETED = {"Success": "Verified", "NoActionRequired": "Ready", "DecisionPending": "NeedsDecision",
             "DecisionKeptOriginal": "Ready"}
FAILED = {"ProcessingException": "Error", "WriteRejected": "Limited", "WriteSkippedUnreliableSequence": "Limited",
          "ReadRejected": "Limited"}
UNSCANNED = ["UnauthorizedTarget", "NonTextNotification"]
WARNINGS = ["Limited", "Error"]


def detector_readiness(list_states: DataFrame) -> DataFrame:
    """Per US detector: Ready, NotProvided or ValidationFailed.  ``list_states(scope, list_id, state)``."""
    spark = list_states.sparkSession
    needs = spark.createDataFrame(
        [(d, li) for d in dims.US_DETECTORS for li in DETECTOR_LISTS.get(d, [None])], "detector_id string, list_id string"
    )
    scopes = list_states.select("scope").distinct()
    grid = scopes.join(F.broadcast(needs))  # thirteen detectors: a fixed, small side
    joined = grid.join(list_states, ["scope", "list_id"], "left")
    one = (
        F.when(F.col("list_id").isNull() | (F.col("state") == VALID), 0)
        .when(F.col("state").isNull(), 1)
        .otherwise(2)
    )
    worst = F.max(one)
    state = F.when(worst == 0, "Ready").when(worst == 1, "NotProvided").otherwise("ValidationFailed")
    return joined.groupBy("scope", "detector_id").agg(state.alias("state"))


def scan_event_rollup(events: DataFrame) -> DataFrame:
    """Attempts by terminal reason, with duration percentiles."""
    p = lambda q: F.percentile_approx("duration_ms", q, 10000)
    return events.groupBy("terminal").agg(
        F.count("*").alias("n"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"),
        p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"),
    )


def diff_pipelines(a: DataFrame, b: DataFrame) -> DataFrame:
    """Finding rows only one of two runs has, as a multiset difference."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("only_a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_b")))


def verify_rewrite(plan: DataFrame, sink: DataFrame, key: str = "doc_id") -> DataFrame:
    """Compare what was written with the plan: Verified when the hashes agree, else Limited."""
    want = plan.select(key, text_sha256(F.col("redacted")).alias("want"))
    got = sink.select(key, text_sha256(F.col("text")).alias("got"))
    ok = F.coalesce(F.col("want") == F.col("got"), F.lit(False))
    return want.join(got, key, "left").select(key, F.when(ok, "Verified").otherwise("Limited").alias("status"))


def residue(findings: DataFrame, output: DataFrame, text: str, key: str = "doc_id") -> DataFrame:
    """Protected values that still occur in an output text; must be empty.

    Values are folded per document first; the join is on the document key.
    """
    values = findings.where("disposition = 'Protect'").select(key, "surface").distinct()
    return output.select(key, text).join(values, key).where(F.col(text).contains(F.col("surface"))).select(key, "surface")


def changed_revisions(versions: DataFrame, key: str, order: str) -> DataFrame:
    """Number the revisions of each text: a new one whenever the hash differs from the one before.  Texts stay behind."""
    h = versions.withColumn("text_sha256", text_sha256(F.col("text")))
    h = in_order(h.drop("text"), [key], [order])
    h = carry(h, [key], [order], {"_before": ("previous", F.col("text_sha256"))})
    h = h.withColumn("changed", ~F.coalesce(F.col("_before") == F.col("text_sha256"), F.lit(False))).drop("_before")
    return carry(h, [key], [order], {"rev": ("sum", F.col("changed").cast("long"))}).drop(RANGE)


def latest_wins(changes: DataFrame, key: str, order: str) -> DataFrame:
    """Only the newest pending change of each key (pre-aggregated, so a busy key does not gather)."""
    cols = [c for c in changes.columns if c not in (key, order)]
    return changes.groupBy(key).agg(F.max(F.struct(order, *cols)).alias("_m")).select(key, "_m.*")


def self_write_filter(changes: DataFrame, sink: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drop changes that are our own rewrites (same key and hash as the sink)."""
    ours = sink.select(key, "text_sha256").distinct()
    return changes.withColumn("text_sha256", text_sha256(F.col("text"))).join(ours, [key, "text_sha256"], "left_anti")


def status_history(attempts: DataFrame, source: str = "source", order: str = "seq") -> DataFrame:
    """Status after each event of a source.

    ``attempts(source, seq, attempt_id, terminal)``; a null terminal starts a scan.  Events of an older
    attempt and events of an unknown name are dropped; a failure sticks through unscanned events until the next
    completed scan.
    """
    known = F.col("terminal").isNull() | F.col("terminal").isin([*COMPLETED, *FAILED, *UNSCANNED])
    live = in_order(attempts.where(known), [source], [order])
    live = carry(live, [source], [order], {"_newest": ("max_before", F.col("attempt_id"))})
    live = live.where("_newest is null or attempt_id >= _newest").drop("_newest")
    completed = dims.lookup(COMPLETED, F.col("terminal"), "string")
    failed = dims.lookup(FAILED, F.col("terminal"), "string")
    # the standing failure: set by a failure, cleared by a completed scan
    mark = F.when(failed.isNotNull(), failed).when(completed.isNotNull(), F.lit("none"))
    df = carry(live, [source], [order], {"_mark": ("last", mark)})
    standing = F.when(F.coalesce("_mark", F.lit("none")) != "none", F.col("_mark"))
    status = (
        F.when(F.col("terminal").isNull(), "Scanning")
        .when(completed.isNotNull(), completed)
        .when(failed.isNotNull(), failed)
        .otherwise(F.coalesce(standing, F.lit("Ready")))
    )
    return df.withColumn("status", status).drop("_mark", RANGE)


def warning_notify(history: DataFrame, source: str = "source", order: str = "seq") -> DataFrame:
    """Rows where a warning appears, or gets worse from Limited to Error."""
    df = carry(history, [source], [order], {"_before": ("previous", F.col("status"))})
    before = F.col("_before")
    fresh = before.isNull() | ~before.isin(WARNINGS) | ((before == "Limited") & (F.col("status") == "Error"))
    return df.where(F.col("status").isin(WARNINGS) & fresh).drop("_before")


def pii_inventory(findings: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings (with their document's source and language) by source, language and type, with how many sit in good
    or toxic documents."""
    facts = findings.join(labels, key, "left")
    return facts.groupBy("source", "lang", "pii_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("n_good"),
        F.count_if(F.col("toxic") == 1).alias("n_toxic"),
    )
