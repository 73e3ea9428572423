"""Outputs.  What is written is chosen by DataFrame functions; ``BatchSink`` makes writing repeatable."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_sha256

EVENT_COLUMNS = {"attempt_id", "stage", "terminal", "ts", "source", "doc_id", "rev", "n_candidates", "n_trusted",
                 "n_protect", "n_pending", "n_bypass", "status", "duration_ms", "text_sha256", "n_chars"}


def redacted_rows(redacted: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the sink may hold: rewritten texts with something protected and nothing pending."""
    out = redacted.where("n_protect > 0 and n_pending = 0")
    return out.select(key, F.col("redacted").alias("text"), text_sha256(F.col("redacted")).alias("text_sha256"),
                      "n_protect", "status")


def queue_rows(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """The review queue carries hashes of values, not the values."""
    return items.select(
        key, "pii_type", F.sha2("canonical", 256).alias("canonical_sha256"), "risk", "detector_id", "first_start", "n"
    )


def event_rows(events: DataFrame) -> DataFrame:
    """Metadata-only events; a column outside the closed list (such as a text) is refused."""
    extra = set(events.columns) - EVENT_COLUMNS
    if extra:
        raise ValueError(f"scan events carry metadata only, not: {sorted(extra)}")
    return events


class BatchSink:
    """A table that is written batch by batch, where writing a batch again replaces it.

    ``data/batch=N/attempt=A/bucket=B`` holds what attempt A wrote for batch N, by bucket of the key.
    ``commits/batch=N`` names the attempt that counts and is written last.  What a killed task or an unfinished attempt
    left behind is named nowhere and never read.  Reading the rows of some keys opens their buckets only.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.data, self.commits = f"{path}/data", f"{path}/commits"
        self.schema = f"{schema}, batch long, attempt string, bucket int"
        # the folders exist from the start, so a reader need not tell a missing table from a broken one
        spark.createDataFrame([], self.schema).write.mode("ignore").partitionBy("batch", "attempt", "bucket").parquet(self.data)
        spark.createDataFrame([], "attempt string, batch long").write.mode("ignore").partitionBy("batch").json(self.commits)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def write(self, rows: DataFrame, batch: int) -> None:
        attempt = f"a{uuid.uuid4().hex}"
        self.stage(rows, batch, attempt)
        self.commit(batch, attempt)

    def stage(self, rows: DataFrame, batch: int, attempt: str) -> None:
        """Write the rows of an attempt; nobody sees them yet."""
        placed = rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        placed.write.partitionBy("bucket").parquet(f"{self.data}/batch={batch}/attempt={attempt}")

    def commit(self, batch: int, attempt: str) -> None:
        one = self.spark.createDataFrame([(attempt,)], "attempt string").coalesce(1)
        one.write.mode("overwrite").json(f"{self.commits}/batch={batch}")

    def rows(self, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """Rows of committed batches, of those with a smaller number if one is given; only those in the buckets of some
        keys (which holds all rows of these keys) if there are some."""
        done = self.spark.read.schema("attempt string, batch long").json(self.commits)
        found = self.spark.read.schema(self.schema).parquet(self.data)
        if of is not None:
            wanted = [r.bucket for r in of.select(self.bucket()).distinct().collect()]  # at most ``buckets`` numbers
            found = found.where(F.col("bucket").isin(wanted))
        if before is not None:
            done, found = done.where(F.col("batch") < before), found.where(F.col("batch") < before)
        return found.join(done, ["batch", "attempt"], "left_semi").drop("attempt", "bucket")


REDACTED = "doc_id long, text string, text_sha256 string, n_protect int, status string"
QUEUE = "doc_id long, pii_type string, canonical_sha256 string, risk int, detector_id string, first_start int, n int"


def redacted_sink(spark: SparkSession, path: str, schema: str = REDACTED, key: str = "doc_id") -> BatchSink:
    return BatchSink(spark, path, schema, [key])


def decision_queue_sink(spark: SparkSession, path: str, schema: str = QUEUE, key: str = "doc_id") -> BatchSink:
    return BatchSink(spark, path, schema, [key])


def write_events(df: DataFrame, sink: BatchSink, batch: int) -> None:
    sink.write(event_rows(df), batch)
