"""Structured Streaming jobs: revisions, one-time grants, source status, and the scan of arriving texts.

Keyed state holds a few numbers per key.  Of a key's events in one micro-batch only narrow columns are held, in arrays;
the trigger size of the source bounds them.  Jobs with timers or maps need a state store that has them: ``state_store``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import text_sha256
from ..operators import reports
from ..operators.decide import Policy, redact_corpus
from ..operators.us_rules import RefLists
from ..sources import sinks

SCAN_TIMEOUT_MS = 30_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _sorted_columns(batches: Iterator[pd.DataFrame], order: str, *columns: str) -> list[list]:
    """The named columns of a key's rows in the order of ``order``; only these are kept of each batch."""
    held = [[b[c].to_numpy() for c in (order, *columns)] for b in batches]
    if not held:
        return [[] for _ in (order, *columns)]
    joined = [np.concatenate(x) for x in zip(*held)]
    at = np.argsort(joined[0], kind="stable")
    return [x[at].tolist() for x in joined]


# --- revisions --------------------------------------------------------------------------------


class _Revisions(StatefulProcessor):
    """The last hash and number of a key's text."""

    def __init__(self, key: str, order: str):
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "text_sha256 string, rev long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else ("", 0)
        sha, rev = held[0], held[1]
        seqs, hashes = _sorted_columns(rows, self.order, "text_sha256")
        changed, revs = [], []
        for h in hashes:
            changed.append(rev == 0 or h != sha)
            rev, sha = rev + changed[-1], h
            revs.append(rev)
        self.last.update((sha, rev))
        yield pd.DataFrame({self.key: key[0], self.order: seqs, "text_sha256": hashes, "changed": changed, "rev": revs})

    def close(self) -> None:
        pass


def revision_stream(changes: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """A new revision only when the hash of a key's text changes; texts stay outside the state.  Needs ``state_store``."""
    hashed = changes.select(key, order, text_sha256(F.col("text")).alias("text_sha256"))
    return hashed.groupBy(key).transformWithStateInPandas(
        _Revisions(key, order), f"{key} long, {order} long, text_sha256 string, changed boolean, rev long", "append", "None")


# --- grants -----------------------------------------------------------------------------------


class _Grants(StatefulProcessor):
    """Passes that are left of a document's current revision, by detector and value."""

    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revision = handle.getValueState("revision", "rev long")
        self.left = handle.getMapState("left", "detector_id string, canonical string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        current = self.revision.get()[0] if self.revision.exists() else None
        budgets: dict[tuple, int] = {}  # what this micro-batch touches of the map
        seqs, passed = [], []
        for seq, rev, detector, value, risk, n in zip(*_sorted_columns(rows, self.order, "rev", "detector_id", "canonical", "risk", "n")):
            if current is None or rev > current:
                if current is not None:
                    self.left.clear()  # a grant dies with its revision
                current = rev
                budgets.clear()
            name, granted = (detector, value), False
            if rev == current:
                if name not in budgets:
                    budgets[name] = self.left.getValue(name)[0] if self.left.containsKey(name) else 0
                if n > 0:
                    budgets[name] += n
                elif risk == 1 and budgets[name] > 0:
                    budgets[name] -= 1
                    granted = True
            if not n > 0:
                seqs.append(seq)
                passed.append(granted)
        self.revision.update((current,))
        for name, n in budgets.items():
            if n:
                self.left.updateValue(name, (n,))
            elif self.left.containsKey(name):
                self.left.removeKey(name)
        yield pd.DataFrame({"doc_id": key[0], self.order: seqs, "granted": passed})

    def close(self) -> None:
        pass


def grant_stream(events: DataFrame, order: str = "seq") -> DataFrame:
    """Matches against one-time grants, both in one stream: ``(doc_id, seq, granted)`` of each match.

    ``events(doc_id, seq, rev, detector_id, canonical, risk, n)``: a row with ``n > 0`` mints that many passes for a value in
    a revision of a document, any other is a match.  A match of risk 1 takes a pass if one is left; a pass is taken once,
    ever.  A later revision ends all passes of the one before; rows of an older revision change nothing.  Needs
    ``state_store``.
    """
    rows = events.select("doc_id", order, "rev", "detector_id", "canonical", F.coalesce("risk", F.lit(0)).alias("risk"), F.coalesce("n", F.lit(0)).alias("n"))
    return rows.groupBy("doc_id").transformWithStateInPandas(_Grants(order), f"doc_id long, {order} long, granted boolean", "append", "None")


# --- status -----------------------------------------------------------------------------------


class _Status(StatefulProcessor):
    """Attempt, status, standing failure and the deadline of a running scan."""

    def __init__(self, order: str, timeout_ms: int, event_time: bool):
        self.order, self.timeout_ms, self.event_time = order, timeout_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", "attempt_id long, status string, failure string, deadline long")

    def _load(self) -> list:
        return list(self.state.get()) if self.state.exists() else [-1, "Ready", "", None]

    def _move(self, out: list, source: str, held: list, seq: int, new: str) -> None:
        worse = held[1] not in reports.WARNINGS or (held[1] == "Limited" and new == "Error")
        out.append((source, seq, held[0], new, new in reports.WARNINGS and worse))
        held[1] = new

    def _expire(self, out: list, source: str, held: list) -> None:
        held[2], held[3] = "Limited", None
        self._move(out, source, held, -1, "Limited")

    def _rows(self, out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["source", self.order, "attempt_id", "status", "warn"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        source, held, out = key[0], self._load(), []
        armed = held[3]
        now = 0 if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        for seq, attempt, terminal, at in zip(*_sorted_columns(rows, self.order, "attempt_id", "terminal", "at")):
            if held[3] is not None and held[3] <= (at if self.event_time else now):
                self._expire(out, source, held)  # the deadline passed before this event
            if attempt < held[0]:
                continue
            if terminal is None:
                # only the start of a scan sets its deadline; no other event moves it
                held[0], held[3] = attempt, (at if self.event_time else now) + self.timeout_ms
                self._move(out, source, held, seq, "Scanning")
                continue
            new = reports.COMPLETED.get(terminal) or reports.FAILED.get(terminal)
            if new is None and terminal not in reports.UNSCANNED:
                continue  # any other name leaves the state alone
            held[0], held[3] = attempt, None
            if terminal in reports.COMPLETED:
                held[2] = ""
            elif terminal in reports.FAILED:
                held[2] = new
            self._move(out, source, held, seq, new or held[2] or "Ready")
        if armed != held[3]:
            if armed is not None:
                self.handle.deleteTimer(armed)
            if held[3] is not None:
                self.handle.registerTimer(held[3])
        self.state.update(tuple(held))
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, out = self._load(), []
        if held[3] is not None and held[3] <= expiredTimerInfo.getExpiryTimeInMs():
            self._expire(out, key[0], held)
            self.state.update(tuple(held))
        yield self._rows(out)

    def close(self) -> None:
        pass


def status_stream(events: DataFrame, order: str = "seq", timeout_ms: int = SCAN_TIMEOUT_MS, ts: str | None = None) -> DataFrame:
    """Status per source after every event, and Limited (number -1) when a scan does not end in time.

    ``events(source, seq, attempt_id, terminal)``; a null terminal starts a scan and sets its deadline, which is a timer
    in the state: events of older attempts, of unknown names or of other sources do not move it.  A failure stays until
    the next completed scan.  With ``ts``, a time column that has a watermark, deadlines are times of events; else they
    are times of the clock.  Needs ``state_store``.
    """
    at = (F.unix_millis(F.col(ts).cast("timestamp")) if ts else F.lit(0).cast("long")).alias("at")
    columns = ["source", order, "attempt_id", "terminal", at] + ([ts] if ts else [])
    return events.select(*columns).groupBy("source").transformWithStateInPandas(
        _Status(order, timeout_ms, ts is not None), f"source string, {order} long, attempt_id long, status string, warn boolean", "append",
        "EventTime" if ts else "ProcessingTime")


# --- texts ------------------------------------------------------------------------------------


def scan_batch(changes: DataFrame, policy: Policy | None = None, own_writes: DataFrame | None = None,
               key: str = "doc_id", order: str = "seq", us: RefLists | None = None) -> DataFrame:
    """One micro-batch: newest change per key, without our own rewrites, through the whole chain."""
    newest = reports.latest_wins(changes, key, order)
    if own_writes is not None:
        newest = reports.self_write_filter(newest, own_writes, key)
    return redact_corpus(newest, policy, key=key, us=us)


def scan_sink(spark: SparkSession, out: str, key: str = "doc_id", order: str = "seq") -> sinks.BatchSink:
    return sinks.BatchSink(spark, out, f"{key} long, {order} long, text string, text_sha256 string, n_protect int, status string", [key])


def stream_scan(changes: DataFrame, out: str, checkpoint: str, policy: Policy | None = None, key: str = "doc_id",
                order: str = "seq", once: bool = False, us: RefLists | None = None, written: Callable[[int], None] | None = None):
    """Start the scan of a stream of changes into ``scan_sink(out)``.

    A micro-batch that is run again replaces what it wrote before: it knows our own rewrites of earlier batches only, so
    it sees the same sink each time, and it reads the buckets of its own keys.  ``written`` is told each batch's number
    after its rows are committed.
    """
    sink = scan_sink(changes.sparkSession, out, key, order)

    def write(batch: DataFrame, number: int) -> None:
        own = sink.rows(before=number, of=batch.select(key)).select(key, "text_sha256")
        done = scan_batch(batch, policy, own, key, order, us)
        rows = done.where("status in ('protected', 'partly_kept')").select(
            key, order, F.col("redacted").alias("text"), text_sha256(F.col("redacted")).alias("text_sha256"), "n_protect", "status"
        )
        sink.write(rows, number)
        if written is not None:
            written(number)

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
