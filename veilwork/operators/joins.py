"""Pairings between fields, findings, lists and sources, as joins on finding-sized rows.

None of these rows carry texts.  Interval joins are equi-joins on the document plus a bucket of the
position, so that a document with very many spans never meets itself pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import aba_checksum
from ..functions.spans import clean_markers, empty, find_all, run_stages
from .fields import line_breaks, line_numbers
from .history import carry

FINANCIAL = ["bank.routing", "bank.specific", "bank.generic"]


def token_rows(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Matches of a pattern as span rows."""
    spans = F.transform(
        find_all(clean_markers(text), pattern),
        lambda m: F.struct(m["start"].alias("start"), F.length(m["text"]).alias("len"), m["text"].alias("surface")),
    )
    rows = docs.select(key, F.inline_outer(spans))
    return rows.where(F.col("start").isNotNull())


def with_lines(spans: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add the line number of each span: a running count of line breaks over spans and breaks together."""
    breaks = docs.select(key, F.explode_outer(line_breaks(text)).alias("start")).where(F.col("start").isNotNull())
    both = spans.withColumn("_b", F.lit(0)).unionByName(breaks.withColumn("_b", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("start", "_b").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("line", F.sum("_b").over(w).cast("int")).where("_b = 0").drop("_b")


def line_scope_join(spans: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Flag spans whose line is listed."""
    marked = lines.select(key, "line").distinct().withColumn("in_scope", F.lit(True))
    return spans.join(marked, [key, "line"], "left").fillna(False, ["in_scope"])


def financial_fields_per_line(fields: DataFrame, key: str = "doc_id") -> DataFrame:
    return fields.where(F.col("role").isin(FINANCIAL)).groupBy(key, "line").agg(F.count("*").cast("int").alias("n"))


def pair_adjacent_fields(fields: DataFrame, key: str = "doc_id", distance: int = 128) -> DataFrame:
    """Account fields with whether the field before or after is a valid routing number on the same or adjacent line."""
    value = F.when(
        F.col("terminator") == "NextRecognizedLabel", F.regexp_replace(F.rtrim("value"), " *,$", "")
    ).otherwise(F.rtrim("value"))
    end = F.col("val_start") + F.length(F.rtrim("value"))
    ok = (F.col("state") == "FieldAccepted") | (
        (F.col("state") == "FieldRejectedOverMaxLength") & (end - F.col("label_start") <= 96)
    )
    financial = F.col("role").isin(FINANCIAL)
    per_line = Window.partitionBy(key, "line")
    kept = fields.where(~(financial & F.col("in_word"))).select(
        key, "role", "line", "label_start", "val_start", value.alias("value"), (ok & (F.rtrim("value") != "")).alias("ok"),
        F.sum(financial.cast("int")).over(per_line).alias("on_line"),
    )
    w = Window.partitionBy(key).orderBy("label_start")
    this = F.struct("role", "line", "label_start", "value", "ok", "on_line")

    def pairs(o: Column) -> Column:
        near = (F.col("line") == o["line"]) | (
            (F.abs(F.col("line") - o["line"]) == 1) & (F.col("on_line") == 1) & (o["on_line"] == 1)
        )
        hit = (
            (o["role"] == "bank.routing") & o["ok"] & aba_checksum(o["value"])
            & (F.abs(F.col("label_start") - o["label_start"]) <= distance) & near
        )
        return F.coalesce(hit, F.lit(False))

    joined = kept.withColumn("_p", F.lag(this).over(w)).withColumn("_n", F.lead(this).over(w))
    paired = pairs(F.col("_p")) | pairs(F.col("_n"))
    out = joined.where(
        F.col("role").isin("bank.specific", "bank.generic") & F.col("ok") & F.col("value").rlike(r"^[0-9A-Za-z]{4,17}\z")
    ).select(
        key, F.col("val_start").alias("start"), F.length("value").alias("len"), F.upper("value").alias("canonical"),
        paired.alias("paired"), "role",
    )
    return out.where((F.col("role") == "bank.specific") | F.col("paired")).drop("role")


def group_logical_records(fields: DataFrame, docs: DataFrame, role_a: str, role_b: str, distance: int = 128,
                          barrier: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One-to-one pairs of two roles on the same or adjacent lines, earliest pairs first.

    With ``barrier`` no recognised field may start between the two labels, so a field can only pair
    with its neighbour: candidates are neighbours in label order, and choosing greedily from the left
    means alternating along every run of linked neighbours.
    """
    if not barrier:
        return _group_without_barrier(fields, docs, role_a, role_b, distance, key, text)
    w = Window.partitionBy(key).orderBy("label_start")
    nxt = F.lead(F.struct("role", "label_start", "val_start", "val_len", "line")).over(w)
    rows = fields.withColumn("_o", nxt)
    two = ((F.col("role") == role_a) & (F.col("_o.role") == role_b)) | ((F.col("role") == role_b) & (F.col("_o.role") == role_a))
    near = two & (F.col("_o.line") - F.col("line") <= 1) & (F.col("_o.label_start") - F.col("label_start") <= distance)
    same_line = F.col("_o.line") == F.col("line")
    # the gap on one line may hold only separators
    texts = docs.select(key, text).hint("merge")  # never built whole, whatever the planner expects
    pairs = rows.where(near & same_line).join(texts, key).withColumn(
        "_gap",
        F.substring(
            F.col(text), F.col("val_start") + F.col("val_len") + 1,
            F.col("_o.label_start") - F.col("val_start") - F.col("val_len"),
        ),
    ).where(F.col("_gap").rlike("^[ ,;\t|]*$")).drop(text, "_gap")
    links = pairs.unionByName(rows.where(near & ~same_line))
    # runs of links that share a field; take every other link of a run
    v = Window.partitionBy(key).orderBy("label_start")
    joined = F.lag("_o.label_start").over(v) == F.col("label_start")
    runs = links.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    runs = runs.withColumn("_run", F.sum("_new").over(v))
    odd = F.row_number().over(Window.partitionBy(key, "_run").orderBy("label_start")) % 2 == 1
    first_is_a = F.col("role") == role_a
    return (
        runs.withColumn("_take", odd).where("_take")
        .select(
            key,
            F.when(first_is_a, F.col("label_start")).otherwise(F.col("_o.label_start")).alias("a_start"),
            F.when(first_is_a, F.col("_o.label_start")).otherwise(F.col("label_start")).alias("b_start"),
            F.col("label_start").alias("record_start"),
            (F.col("_o.val_start") + F.col("_o.val_len") - F.col("label_start")).alias("record_len"),
            F.col("line").alias("first_line"),
            F.col("_o.line").alias("last_line"),
        )
    )


def _group_without_barrier(fields, docs, role_a, role_b, distance, key, text) -> DataFrame:
    """Pairs within the distance, chosen greedily: each field with those in a window behind it, then a fold per cluster.

    A cluster is a stretch of fields without a gap wider than the distance; pairs never cross clusters.  Pairs come in the
    order of their first field, so one can only share a field with pairs that began within the distance before it: the
    fold looks back over that many, however long the cluster is.

    The fields are dealt and sorted by document once.  They never meet in a join, which the planner would broadcast by the
    size of the files that they were read from.
    """
    f = fields.where(F.col("role").isin(role_a, role_b) & F.col(key).isNotNull()).select(
        key, "role", "line", "label_start", (F.col("val_start") + F.col("val_len")).alias("stop")
    )
    w = Window.partitionBy(key).orderBy("label_start")
    behind = F.collect_list(F.struct(*[F.col(c).alias(f"o_{c}") for c in ("role", "line", "label_start", "stop")]))
    f = f.withColumn("_new", F.when(F.col("label_start") - F.lag("label_start").over(w) <= distance, 0).otherwise(1))
    f = f.withColumn("_cluster", F.sum("_new").over(w)).withColumn("_behind", behind.over(w.rangeBetween(1, distance)))
    pairs = f.select(key, "role", "line", "label_start", "stop", "_cluster", F.explode("_behind").alias("_o")).select(
        "*", "_o.*").drop("_o").where((F.col("role") != F.col("o_role")) & (F.col("o_line") - F.col("line") <= 1))
    # the gap on one line may hold only separators; a pair that meets several texts of its key is the same pair to the fold
    gap = F.substring(F.col(text), F.col("stop") + 1, F.col("o_label_start") - F.col("stop"))
    checked = pairs.join(docs.select(key, text).hint("merge"), key, "left").where(
        (F.col("line") != F.col("o_line")) | gap.rlike("^[ ,;\t|]*$")
    ).drop(text)
    pair = "struct<a:int,b:int,first_role:string,la:int,lb:int,stop:int>"
    arr = f"array<{pair}>"
    recent = lambda acc: F.slice(acc, F.greatest(F.size(acc) - distance, F.lit(1)), F.lit(distance + 1))
    chosen = F.aggregate(
        F.array_sort("ps"),
        empty(arr),
        lambda acc, p: F.when(
            F.exists(recent(acc), lambda q: (q["a"] == p["a"]) | (q["b"] == p["b"]) | (q["a"] == p["b"]) | (q["b"] == p["a"])), acc
        ).otherwise(F.array_append(acc, p)).cast(arr),
    )
    grouped = checked.groupBy(key, "_cluster").agg(
        F.collect_list(
            F.struct("label_start", "o_label_start", "role", "line", "o_line", "o_stop").cast(pair)
        ).alias("ps")
    )
    is_a = F.col("first_role") == role_a
    return grouped.select(key, F.inline(chosen)).select(
        key, F.when(is_a, F.col("a")).otherwise(F.col("b")).alias("a_start"),
        F.when(is_a, F.col("b")).otherwise(F.col("a")).alias("b_start"), F.col("a").alias("record_start"),
        (F.col("stop") - F.col("a")).alias("record_len"), F.col("la").alias("first_line"), F.col("lb").alias("last_line"),
    )


def overlap_anti_join(spans: DataFrame, guards: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans that overlap no guard span of the same document.

    A sweep instead of a pairwise join: over spans and guards in start order, the furthest guard end
    so far and the next guard start decide.  One row per input row, whatever the overlap.
    """
    both = spans.withColumn("_g", F.lit(0)).unionByName(
        guards.select(key, "start", "len").withColumn("_g", F.lit(1)), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy("start", F.col("_g").desc())
    is_guard = F.col("_g") == 1
    reach = F.max(F.when(is_guard, F.col("start") + F.col("len"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # the same order backwards: a frame that only grows is aggregated once, one that shrinks anew for every row
    back = Window.partitionBy(key).orderBy(F.col("start").desc(), "_g")
    following = F.min(F.when(is_guard, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    clear = F.coalesce(reach <= F.col("start"), F.lit(True)) & F.coalesce(
        following >= F.col("start") + F.col("len"), F.lit(True)
    )
    return both.withColumn("_clear", clear).where("_g = 0 and _clear").drop("_g", "_clear")


def rejections_minus_accepted(attempts: DataFrame, key: str = "doc_id") -> DataFrame:
    on = [key, "detector_id", "start", "len"]
    accepted = attempts.where("outcome = 'Accepted'").select(*on)
    return attempts.where("outcome = 'Rejected'").join(accepted, on, "left_anti").distinct()


def ref_list_semi_join(rows: DataFrame, record: str, ref_lists: DataFrame, list_id: str) -> DataFrame:
    """Rows whose code is in a reference list.  The planner broadcasts the list when it is small."""
    codes = ref_lists.where(F.col("list_id") == list_id).select(F.col("record").alias(record)).distinct()
    return rows.join(codes, record, "left_semi")


def cross_doc_value_link(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Values that occur in several documents: how many, how often and where first.

    Documents are counted after a first aggregation per (value, document), so a value that is
    everywhere is already folded before it meets itself; no list of documents is collected.
    """
    per_doc = findings.where(F.col("canonical").isNotNull()).groupBy("pii_type", "canonical", key).agg(
        F.count("*").alias("_n")
    )
    return per_doc.groupBy("pii_type", "canonical").agg(
        F.count("*").alias("n_docs"), F.sum("_n").alias("n"), F.min(key).alias("first_doc")
    )


def link_members(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(value, document)`` membership rows of shared values, with the identity number of the value's hash."""
    return findings.where(F.col("canonical").isNotNull()).select(
        F.sha2(F.concat_ws("|", "pii_type", "canonical"), 256).alias("value_id"), key
    ).distinct()


def asof_source_join(events: DataFrame, changes: DataFrame, by: str, ts: str, source: str) -> DataFrame:
    """For each event the latest source change of its key at or before it (of several at one time, the largest source).

    Events and changes are laid in one order and scanned by ranges, so no task holds the whole history of a key.
    """
    both = events.withColumn("_e", F.lit(1)).unionByName(
        changes.select(by, ts, source).withColumn("_e", F.lit(0)), allowMissingColumns=True)
    change = F.when(F.col("_e") == 0, F.struct(F.col(source).alias("s")))
    found = carry(both, [by], [ts, "_e", source], {"_found": ("last", change)})
    return found.where("_e = 1").withColumn(source, F.col("_found")["s"]).drop("_found", "_e")


def grant_match(findings: DataFrame, grants: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """One-time exemptions: of the rows that match a grant, as many pass as the grant allows, in order.

    Matches are numbered by a scan over ranges, so a grant with very many matches is not ranked in one task.
    """
    allowed = grants.groupBy(*on).agg(F.sum("n").alias("_n"))
    hits = findings.join(allowed, on, "left")
    ranked = carry(hits.where("_n is not null"), on, order, {"_r": ("sum", F.lit(1).cast("long"))})
    granted = ranked.withColumn("granted", F.col("_r") <= F.col("_n")).drop("_r")
    rest = hits.where("_n is null").withColumn("granted", F.lit(False))
    return granted.unionByName(rest).drop("_n")
