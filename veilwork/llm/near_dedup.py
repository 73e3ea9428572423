"""MinHash near-dedup with an LSH forest.

Each document's set is its distinct 5-word shingles (64-bit hashes of the words' bytes).  Equal sets meet by a 128-bit
digest and go on as one.  A forest keeps several sorted orders of MinHash signatures.  Documents that share a prefix
of ``min_depth`` values in an order form a region; neighbours there are candidates, and depth adapts to the region:

* a region of up to ``near`` sets: each set pairs with its neighbours in the region's order, which reaches all of them;
* a larger region is compared inside one task on the full sets, by blocks of a sparse product, and gives links only;
* a region too large for a task goes one value deeper, up to ``max_depth``;
* one that is still too large at full depth is cut into blocks, and every pair of blocks is a task, so nothing is lost.

Fewer pairs share a longer prefix, so the sets of a region that went deeper also stand in further orders, of full depth: as
many as make the chance to miss a pair there no larger than in the first orders at ``min_depth``.  How large a region is
thus changes the way of the search, not its recall: with 24 orders, a pair at 0.85 misses all regions of depth 5 with
probability 8e-7, and all of depth 8 in 24 + 21 orders with 6e-7.

Links are confirmed on full sets: ``100 * intersection >= percent * union``.  No candidate list is capped.

Defined results: null or blank text: no shingles, linked with nothing; a text of fewer than five words is one shingle;
repeated rows are copies of each other; rows that share an id but not the text each take the component of their own
text; a null id never links.  An empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_WORDS, U64, add_columns, byte_runs, fresh, hashed_words, mix, stored
from .components import components

SHINGLE = 5
_STEP = mix(np.arange(11, 11 + SHINGLE, dtype=np.uint64)) | U64(1)


@dataclass(frozen=True)
class Forest:
    percent: int = 85
    orders: int = 24
    min_depth: int = 5
    max_depth: int = 8
    near: int = 16  # sets in a region whose neighbours are paired directly
    task_sets: int = 2048  # sets and shingles that one task compares
    task_shingles: int = 2_000_000
    first_order: int = 0  # number of the first order; every order has its own hash functions

    def multipliers(self) -> np.ndarray:
        first = self.first_order * self.max_depth + 1
        return mix(np.arange(first, first + self.orders * self.max_depth, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)

    def deeper(self) -> "Forest":
        """Further orders of full depth, for sets whose regions are too large at ``min_depth``."""
        s = self.percent / 100
        miss = lambda depth: math.log1p(-s ** depth) if s < 1 else -math.inf
        needed = math.ceil(self.orders * miss(self.min_depth) / miss(self.max_depth)) if s < 1 else 0
        return replace(self, orders=max(0, needed - self.orders), min_depth=self.max_depth, first_order=self.first_order + self.orders)


def shingle_sets(column: pa.Array):
    """Sorted distinct shingle hashes of each row of a batch, in order."""
    for _, raw, at in byte_runs(column):
        _, _, rows, words = hashed_words(raw, at, BLANK_WORDS)
        n = len(words)
        grams = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            grams += words[k:n - SHINGLE + 1 + k] * _STEP[k] if len(grams) else 0
        grams = mix(grams)
        cut = np.searchsorted(rows, np.arange(len(at)))
        for i in range(len(at) - 1):
            a, b = cut[i], cut[i + 1]
            if b - a >= SHINGLE:
                yield np.unique(grams[a:b - SHINGLE + 1])
            elif b > a:
                yield mix((words[a:b] * _STEP[:b - a]).sum(dtype=np.uint64, keepdims=True) + U64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """MinHash values, one for each multiplier; long sets go through in pieces."""
    out = None
    for i in range(0, len(shingles), 4096):
        low = np.multiply.outer(multipliers, shingles[i:i + 4096]).min(axis=1)
        out = low if out is None else np.minimum(out, low)
    return (out >> U64(32)).astype(np.uint32)


def sketches(docs: DataFrame, forest: Forest, key: str, text: str) -> DataFrame:
    """``(id, n_shingles, digest, signature)`` of each row."""
    multipliers = forest.multipliers()

    def make(batches):
        for (column,) in batches:
            sizes, digests, signatures = [], [], []
            for s in shingle_sets(column):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(signature(s, multipliers).tobytes() if len(s) else None)
            yield [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())]

    named = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return add_columns(named, ["text"], [("n_shingles", "long"), ("digest", "binary"), ("signature", "binary")], make, ["id"])


def forest_rows(representatives: DataFrame, forest: Forest) -> DataFrame:
    """One row for each order: ``id, n, k5 .. k8`` (hashes of the order and ever longer prefixes)."""
    depths = range(forest.min_depth, forest.max_depth + 1)

    def make(batches):
        for b in batches:
            ids, n = b.column(0), b.column(1)
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(b.num_rows, forest.orders, forest.max_depth)
            for tree in range(forest.orders):
                h = np.full(b.num_rows, mix(np.array([forest.first_order + tree + 1], np.uint64))[0])
                keys = []
                for d in range(forest.max_depth):
                    h = mix(h * U64(0x9E3779B97F4A7C15) + sig[:, tree, d])
                    if d + 1 >= forest.min_depth:
                        keys.append(pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, n, *keys], names=["id", "n", *(f"k{d}" for d in depths)])

    kind = representatives.schema["id"].dataType.simpleString()
    return representatives.select("id", "n_shingles", "signature").mapInArrow(
        make, f"id {kind}, n long, " + ", ".join(f"k{d} long" for d in depths))


def regions(rows: DataFrame, forest: Forest) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split the forest rows by the size of their region: rows of small ones ``(region, id)``, rows of large ones
    ``(region, id)``, each of a size that one task can compare, and the ids of those too large at ``min_depth``."""
    small, large, deep = None, [], None
    rest = rows
    for d in range(forest.min_depth, forest.max_depth + 1):
        key = f"k{d}"
        # counting needs one row for each task and region, however large the region is
        sizes = rest.groupBy(key).agg(F.count("*").alias("m"), F.sum("n").alias("w")).filter("m > 1")
        sized = rest.join(sizes, key)
        if d == forest.min_depth:
            sized = stored(sized, "regions")
            small = sized.filter(F.col("m") <= forest.near).select(F.col(key).alias("region"), "id", *(f"k{x}" for x in range(d + 1, forest.max_depth + 1)))
            sized = sized.filter(F.col("m") > forest.near)
        fits = (F.col("m") <= forest.task_sets) & (F.col("w") <= forest.task_shingles)
        large.append(sized.filter(fits).select(F.col(key).alias("region"), F.lit(0).alias("i"), F.lit(0).alias("j"), "id"))
        rest = sized.filter(~fits)
        if d == forest.min_depth:
            deep = rest.select("id").distinct()
        if d < forest.max_depth:
            rest = rest.drop("m", "w")
    blocks = F.greatest(F.ceil(F.col("m") / (forest.task_sets // 2)), F.ceil(F.col("w") / (forest.task_shingles // 2))).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    large.append(
        rest.select(F.col(f"k{forest.max_depth}").alias("region"), "id", mine.alias("mine"),
                    F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("region", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "id"))
    out = large[0]
    for x in large[1:]:
        out = out.union(x)
    return small, out, deep


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def links_within(ids: list, sets: list[np.ndarray], percent: int) -> list[tuple]:
    """A spanning forest of the links among the sets of one region: each later member with the first of its class."""
    n = len(sets)
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    shared = np.bincount(where, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    use = shared[where]
    owner, column = owner[use], column[where[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = int(column[-1]) + 1 if len(column) else 0
    common = np.zeros((n, n), np.float32)
    step = max(256, (1 << 22) // n)
    for c in range(0, total, step):
        a, b = np.searchsorted(column, [c, c + step])
        part = np.zeros((n, min(step, total - c)), np.float32)
        part[owner[a:b], column[a:b] - c] = 1
        common += part @ part.T
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    first = np.full(n, -1)
    out = []
    for i in range(n):
        if first[i] >= 0:
            continue
        first[i] = i
        front = [i]
        while front:
            new = np.flatnonzero(linked[front].any(axis=0) & (first < 0))
            first[new] = i
            out += [(ids[i], ids[j]) for j in new]
            front = list(new)
    return out


def neighbours(small: DataFrame, forest: Forest) -> DataFrame:
    """Pairs ``(a, b)`` of sets that stand side by side in a small region, in the order of their longer prefixes."""
    order = Window.partitionBy("region").orderBy(*(f"k{d}" for d in range(forest.min_depth + 1, forest.max_depth + 1)), "id")
    after = F.collect_list("id").over(order.rowsBetween(1, forest.near - 1))
    return small.select("id", after.alias("next")).select("id", F.explode("next").alias("with")).filter(
        F.col("id") != F.col("with")).select(F.least("id", "with").alias("a"), F.greatest("id", "with").alias("b")).distinct()


def links(docs: DataFrame, representatives: DataFrame, forest: Forest, key: str, text: str) -> DataFrame:
    """Confirmed links ``(a, b)`` between different sets, enough of them to keep every class together."""
    kind = representatives.schema["id"].dataType.simpleString()
    key_of_deep, = fresh(docs.columns, "deep")
    small, large, deep = regions(forest_rows(representatives, forest), forest)
    pairs, deeper = neighbours(small, forest), forest.deeper()
    deep = stored(deep, "deep")
    if deeper.orders and deep.take(1):
        again = sketches(docs.join(deep.withColumnRenamed("id", key_of_deep), F.col(f"`{key}`") == F.col(key_of_deep), "left_semi"), deeper, key, text)
        own = representatives.join(deep, "id", "left_semi").select("id", "digest")
        small, more, _ = regions(forest_rows(stored(again.join(own, ["id", "digest"]).dropDuplicates(["id", "digest"]), "deeper"), deeper), deeper)
        pairs, large = pairs.union(neighbours(small, deeper)), large.union(more)
    pairs, large = stored(pairs.distinct(), "pairs"), stored(large, "large")
    wanted = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(large.select("id")).distinct(), "wanted")

    def make(batches):
        for (column,) in batches:
            yield [pa.array([s.tobytes() for s in shingle_sets(column)], pa.binary())]

    named = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    sets = stored(add_columns(named.join(wanted, "id", "left_semi"), ["text"], [("set", "binary")], make, ["id"]), "sets").filter(
        F.length("set") > 0)

    def confirm(batches):
        for b in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), forest.percent)
                  for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    direct = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(confirm, f"a {kind}, b {kind}")

    def compare(group: pa.Table) -> pa.Table:
        found = links_within(group["id"].to_pylist(), [np.frombuffer(x, np.uint64) for x in group["set"].to_pylist()], forest.percent)
        t = group.schema.field("id").type
        return pa.table({"a": pa.array([x for x, _ in found], t), "b": pa.array([y for _, y in found], t)})

    within = large.join(sets, "id").groupBy("region", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}")
    return direct.union(within)


def near_duplicates(docs: DataFrame, forest: Forest = Forest(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id, n_shingles, component_id, kept``; a class is named by its smallest id."""
    base = stored(sketches(docs, forest, key, text), "sketches")
    by_set = base.filter("digest is not null and id is not null").groupBy("digest").agg(
        F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    representatives = stored(by_set, "representatives")
    classes = components(links(docs, representatives, forest, key, text))
    named = representatives.select("digest", F.col("id").alias("first")).join(
        classes.select(F.col("node").alias("first"), "component"), "first", "left"
    ).select("digest", F.coalesce("component", "first").alias("component"))
    out = base.select("id", "n_shingles", "digest").join(named, "digest", "left")
    return out.select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"),
                      F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, forest: Forest = Forest(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that a smaller id stands for; all columns."""
    gone, = fresh(docs.columns, "gone")
    drop = stored(near_duplicates(docs, forest, key, text).filter("not kept").select(F.col("id").alias(gone)).distinct(), "drop")
    return docs.join(drop, F.col(f"`{key}`") == F.col(gone), "left_anti")
