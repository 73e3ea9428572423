"""Substring dedup by content-defined chunking.

A gear hash of the last 16 bytes decides where a chunk ends (on average every 24 bytes), so boundaries inside a passage do
not depend on what stands before it: an insertion changes only the chunks it touches.  Chunks are compared by a 64-bit
digest; the first document (and place) with a digest keeps its chunk.  Consecutive repeated chunks of a document form a
run, and runs of at least ``min_words`` words are repeated passages, which a passage of 50 words reaches with
probability 0.997 and longer ones more surely; a run needs several digests in a row, so a chance match does not matter.

Spans count code points, end exclusive.  Defined results: null and empty texts have no chunks; rows that share an id count
as one document; a null id is left out; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_WORDS, BYTE_VALUE, add_columns, bounded_batches, byte_runs, fresh, range_hashes, stored

GEAR = (BYTE_VALUE >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class ChunkRules:
    window: int = 16  # bytes that decide a boundary, a power of two
    mean_bytes: int = 24
    min_words: int = 16


def chunk_rows(column: pa.Array, rules: ChunkRules):
    """Of each row: digests, ends (bytes) and word counts of its chunks, and the row's bytes."""
    limit = np.uint32((1 << 32) // rules.mean_bytes)
    for _, raw, at in byte_runs(column):
        # gear: h(i) = sum over the window of GEAR[byte] << age, by doubling the span that is summed
        h, span = GEAR[raw], 1
        while span < rules.window:
            shifted = np.zeros_like(h)
            shifted[span:] = h[:-span] << np.uint32(span)
            h = h + shifted
            span *= 2
        # the top bits depend on the window's oldest bytes too
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        cut = (h ^ (h >> np.uint32(12))) < limit
        first = np.zeros(len(raw), bool)
        first[at[:-1][at[:-1] < len(raw)]] = True
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        cut &= np.arange(len(raw)) - at[row] >= rules.window - 1  # the window lies inside the row
        ends_row = np.zeros(len(raw), bool)
        ends_row[at[1:][at[1:] > at[:-1]] - 1] = True
        ends = np.flatnonzero(cut | ends_row) + 1
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        digests = range_hashes(raw, starts, ends) if len(ends) else np.zeros(0, np.uint64)
        solid = BLANK_WORDS[raw]
        before = np.zeros(len(raw), bool)
        before[1:] = solid[:-1]
        word_starts = np.concatenate([[0], np.cumsum(solid & ~(before & ~first))])
        words = word_starts[ends] - word_starts[starts]
        place = np.searchsorted(ends, at, "right") if len(ends) else np.zeros(len(at), np.int64)
        for i in range(len(at) - 1):
            part = slice(place[i], place[i + 1])
            yield digests[part].view(np.int64), ends[part] - at[i], words[part], raw[at[i]:at[i + 1]]


def chunks(docs: DataFrame, rules: ChunkRules, key: str, text: str) -> DataFrame:
    """``(digest, id, place)``; a place packs the chunk's number and its words."""
    bounded_batches(docs.sparkSession)
    named = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).filter("id is not null")
    kind = named.schema["id"].dataType.simpleString()

    def make(batches):
        for b in batches:
            digests, places, sizes = [], [], []
            for d, _, words, _ in chunk_rows(b.column(1), rules):
                digests.append(d)
                places.append((np.arange(len(d)) << 20) | np.minimum(words, (1 << 20) - 1))
                sizes.append(len(d))
            if sum(sizes):
                ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), sizes)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(digests)), ids, pa.array(np.concatenate(places).astype(np.int64))],
                                                 names=["digest", "id", "place"])

    return named.mapInArrow(make, f"digest long, id {kind}, place long")


def repeated_runs(docs: DataFrame, rules: ChunkRules, key: str, text: str) -> DataFrame:
    """``(id, first_chunk, last_chunk, n_words, first_ids)`` of each repeated passage."""
    rows = chunks(docs, rules, key, text)
    # one row for each task and digest, so a digest that half the documents share is no hot group
    first = rows.groupBy("digest").agg(F.min(F.struct("id", "place")).alias("first"), F.count("*").alias("n")).filter("n > 1").select(
        "digest", F.col("first.id").alias("first_id"), F.col("first.place").alias("first_place"))
    # from its files, the join shuffles both sides for itself and Spark can split a digest that very many chunks share
    first = stored(first, "first")
    again = rows.join(first, "digest").filter((F.col("id") != F.col("first_id")) | (F.col("place") != F.col("first_place")))
    again = again.select("id", F.shiftright("place", 20).alias("k"), F.col("place").bitwiseAND((1 << 20) - 1).alias("words"), "first_id")
    again = again.dropDuplicates(["id", "k"])  # rows that share an id
    run = F.col("k") - F.row_number().over(Window.partitionBy("id").orderBy("k"))
    return again.withColumn("run", run).groupBy("id", "run").agg(
        F.min("k").alias("first_chunk"), F.max("k").alias("last_chunk"), F.sum("words").alias("n_words"),
        F.array_sort(F.collect_set("first_id")).alias("first_ids")).filter(F.col("n_words") >= rules.min_words).drop("run")


def repeated_passages(docs: DataFrame, rules: ChunkRules = ChunkRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, start, end, n_words, first_ids)``: passages that repeat an earlier one, and the documents that had their
    chunks first.  A document without such a passage has no row."""
    spans = stored(repeated_runs(docs, rules, key, text), "runs")
    runs = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("first_chunk", "last_chunk", "n_words", "first_ids"))).alias("runs"))
    named = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(runs, "id")

    def make(batches):
        for column, lists in batches:
            out = []
            for (_, ends, _, raw), runs_ in zip(chunk_rows(column, rules), lists.to_pylist()):
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                at = points[np.concatenate([[0], ends])]
                out.append([{"start": int(at[min(r["first_chunk"], len(ends))]), "end": int(at[min(r["last_chunk"], len(ends) - 1) + 1])} if len(ends)
                            else {"start": 0, "end": 0} for r in runs_])
            yield [pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]

    placed = add_columns(named, ["text", "runs"], [("at", "array<struct<start:long,end:long>>")], make, ["id", "runs"])
    return placed.select("id", F.explode(F.arrays_zip("at", "runs")).alias("x")).select(
        "id", F.col("x.at.start").alias("start"), F.col("x.at.end").alias("end"), F.col("x.runs.n_words").alias("n_words"),
        F.col("x.runs.first_ids").alias("first_ids")).distinct()


def remove_passages(docs: DataFrame, rules: ChunkRules = ChunkRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same rows and columns, repeated passages cut out of ``text``."""
    cut, new = fresh(docs.columns, "cut", "cleaned")
    spans = repeated_passages(docs, rules, key, text).groupBy(F.col("id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cut))

    def make(batches):
        for column, lists in batches:
            out = []
            for x, spans_ in zip(column.to_pylist(), lists.to_pylist()):
                if x and spans_:
                    ends = [0, *(s["end"] for s in spans_)]
                    x = "".join(x[a:b] for a, b in zip(ends, [*(s["start"] for s in spans_), len(x)]))
                out.append(x)
            yield [pa.array(out, pa.string())]

    out = add_columns(docs.join(spans, key, "left"), [text, cut], [(new, "string")], make)
    return out.select(*(F.col(f"`{new}`" if c == text else f"`{c}`").alias(c) for c in docs.columns))
