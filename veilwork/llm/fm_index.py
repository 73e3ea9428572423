"""Benchmark decontamination with an FM-index per shard of training documents.

A task gathers documents into shards of about ``shard_words`` words and indexes each: the words that occur in the
benchmark are numbered, every other word (and the gap between documents) is a separator that no phrase contains.  The
suffixes that start with a numbered word are sorted by prefix doubling, their Burrows-Wheeler transform goes into a
wavelet matrix, and all phrases are searched backwards at once through its ranks.  Occurrences are located by walking
to the next sampled suffix position, and the spans of a document are merged.

The benchmark is cut into blocks of at most ``block_words`` words.  One block is a broadcast, whose size that bounds.  More
are built by tasks and written to the shared folder; a shard is then searched for one block after another, so a task
holds one of them, however large the benchmark is.  Words are told apart by 64-bit hashes of their bytes.

Defined results: null texts and texts without words are hit by nothing and have no windows; a benchmark item shorter
than the window is one window; items with equal texts are both named; a null item id is named by the empty string;
repeated documents are each searched; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTER_WORDS, add_columns, byte_runs, fresh, hashed_words, shared_path


@dataclass(frozen=True)
class Contamination:
    window: int = 13
    percent: int = 5  # a document is contaminated when hit words reach this share of its words
    shard_words: int = 1 << 19
    block_words: int = 1 << 20
    sample: int = 16


def word_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each row: hashes, start bytes and end bytes of its words."""
    for _, raw, at in byte_runs(column):
        starts, ends, rows, hashes = hashed_words(raw, at, LETTER_WORDS)
        cut = np.searchsorted(rows, np.arange(len(at)))
        for i in range(len(at) - 1):
            part = slice(cut[i], cut[i + 1])
            yield hashes[part], starts[part] - at[i], ends[part] - at[i]


class WaveletMatrix:
    """Ranks and access over a sequence of small integers, one bit level at a time."""

    def __init__(self, values: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for k in range(self.bits - 1, -1, -1):
            bit = (values >> k) & 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``at``."""
        low, high = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            a, b = ones[low], ones[high]
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before it."""
        symbol, low, here = np.zeros_like(at), np.zeros_like(at), at
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[here + 1] - ones[here]
            symbol = symbol * 2 + bit
            a, b = ones[low], ones[here]
            low, here = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, here - b)
        return symbol, here - low


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` by prefix doubling.  Each 0 counts as a letter of its own, smaller than all others, so a
    comparison ends at the first separator; suffixes that start with one stand in front."""
    n = len(text)
    rank = np.empty(n, np.int64)
    sep = np.flatnonzero(text == 0)
    rank[sep] = np.arange(len(sep))
    rest = np.flatnonzero(text)
    order = rest[np.argsort(text[rest], kind="stable")]
    keys = text[order].astype(np.int64)
    base, step = len(sep), 1
    place = np.arange(len(order)) + base  # where the members of the open groups stand in the suffix array
    out = np.empty(n, np.int64)
    out[:base] = sep
    while len(order):
        new = np.ones(len(order), bool)
        new[1:] = keys[1:] != keys[:-1]
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rank[order] = place[heads][group]
        out[place] = order
        size = np.diff(np.append(heads, len(order)))
        open_ = size[group] > 1
        order, place = order[open_], place[open_]
        if not len(order):
            break
        # members of a group stay on its places; they are ordered by the rank ``step`` further on
        keys = rank[order] * (n + 1) + rank[np.minimum(order + step, n - 1)]
        by = np.argsort(keys, kind="stable")
        order, keys = order[by], keys[by]
        step *= 2
    return out


class FMIndex:
    """FM-index of a text that ends with a separator (0)."""

    def __init__(self, text: np.ndarray, sample: int = 16):
        n, top = len(text), int(text.max(initial=0))
        order = suffix_order(text)
        before = text[order - 1]  # of the first suffix: the last letter, a separator
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.tree = WaveletMatrix(before.astype(np.int64), top)
        # walking back stops at a sample; it must not step over a separator, so places after one are samples too
        kept = (order % sample == 0) | (before == 0)
        self.kept = kept
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept]
        self.n, self.top = n, top

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases (rows of ``phrases``, filled with their last ``lengths`` columns)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        for k in range(width):
            use = np.flatnonzero((lengths > k) & (low < high))
            if not len(use):
                break
            symbol = phrases[use, width - 1 - k]
            known = symbol <= self.top
            low[use[~known]] = high[use[~known]] = 0
            use, symbol = use[known], symbol[known]
            first = self.starts[symbol]
            low[use] = first + self.tree.rank(symbol, low[use])
            high[use] = first + self.tree.rank(symbol, high[use])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out = np.full(len(rows), -1, np.int64)
        at, walked, todo = rows.copy(), 0, np.arange(len(rows))
        while len(todo):
            done = self.kept[at]
            out[todo[done]] = self.positions[self.kept_rank[at[done]]] + walked
            todo, at = todo[~done], at[~done]
            if len(at):
                symbol, n = self.tree.access(at)
                at = self.starts[symbol] + n
            walked += 1
        return out


class Phrases:
    """Windows of one block of the benchmark, each with the items it stands in."""

    ARRAYS = ("vocabulary", "lengths", "symbols", "owners", "owner_at")

    def __init__(self, ids: list[str], column: pa.Array, window: int):
        words = [h for h, _, _ in word_rows(column)]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        found: dict[tuple, list[int]] = {}
        self.ids = ids
        for i, h in enumerate(words):
            s = (np.searchsorted(self.vocabulary, h) + 1).tolist()
            for k in range(max(1, len(s) - window + 1) if s else 0):
                owners = found.setdefault(tuple(s[k:k + window]), [])
                if not owners or owners[-1] != i:
                    owners.append(i)
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.symbols = np.zeros((len(found), window), np.int64)
        for r, p in enumerate(found):
            self.symbols[r, window - len(p):] = p
        self.owners = np.array([i for v in found.values() for i in v], np.int64)
        self.owner_at = np.concatenate([[0], np.cumsum([len(v) for v in found.values()])]).astype(np.int64)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=np.frombuffer(json.dumps(self.ids).encode(), np.uint8), **{n: getattr(self, n) for n in self.ARRAYS})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> "Phrases":
        self, arrays = cls.__new__(cls), np.load(io.BytesIO(raw), allow_pickle=False)
        self.ids = json.loads(arrays["ids"].tobytes())
        for n in cls.ARRAYS:
            setattr(self, n, arrays[n])
        return self

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for a word that the block does not contain."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def search_shard(docs: list[np.ndarray], phrases: Phrases, sample: int) -> list[tuple[np.ndarray, list[str]]]:
    """Of each document (an array of symbols): merged word spans as rows (start, end), and the items found."""
    gap = np.zeros(1, np.int64)
    text = np.concatenate([x for d in docs for x in (d, gap)])
    begins = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])])
    none = np.zeros((0, 2), np.int64)
    out: list[tuple[np.ndarray, list[str]]] = [(none, []) for _ in docs]
    if not len(phrases.lengths) or not text.any():
        return out
    index = FMIndex(text, sample)
    low, high = index.search(phrases.symbols, phrases.lengths)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    if not len(which):
        return out
    rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
    start = index.locate(rows)
    end = start + phrases.lengths[which]
    doc = np.searchsorted(begins, start, "right") - 1
    by = np.lexsort((start, doc))
    start, end, doc, which = start[by], end[by], doc[by], which[by]
    cut = np.searchsorted(doc, np.arange(len(docs) + 1))
    for d in np.unique(doc):
        part = slice(cut[d], cut[d + 1])
        s, e = start[part] - begins[d], np.maximum.accumulate(end[part]) - begins[d]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] > e[:-1]
        last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
        w = np.unique(which[part])
        owners = np.unique(np.concatenate([phrases.owners[phrases.owner_at[x]:phrases.owner_at[x + 1]] for x in w]))
        out[d] = np.stack([s[new], e[last]], 1), [phrases.ids[i] for i in owners]
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def blocks(items: DataFrame, rule: Contamination, key: str, text: str) -> tuple[int, Callable[[int], Phrases]]:
    """The benchmark in blocks of about ``block_words`` words: their number, and a function that gives one in a task.

    Long items are cut into overlapping pieces first, so that no block outgrows its bound.
    """
    spark = items.sparkSession
    named = items.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def cut(batches):
        for b in batches:
            ids, pieces = [], []
            for i, x, (h, s, e) in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), word_rows(b.column(1))):
                raw, step = (x or "").encode(), max(rule.window, rule.block_words // 4)
                for k in range(0, max(1, len(h) - rule.window + 1) if len(h) else 0, step):
                    last = min(len(h), k + step + rule.window - 1) - 1
                    ids.append(i)
                    pieces.append(raw[s[k]:e[last]].decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pieces, pa.string())], names=["id", "text"])

    pieces = named.mapInArrow(cut, "id string, text string")
    size = pieces.agg(F.sum(F.length("text"))).first()[0] or 0
    n = size // (rule.block_words * 4) + 1
    if n == 1:
        rows = pieces.toArrow()  # at most one block
        only = spark.sparkContext.broadcast(Phrases(rows["id"].to_pylist(), rows["text"].combine_chunks(), rule.window))
        return 1, lambda k: only.value

    folder, window = shared_path(spark, "phrases"), rule.window

    def write(group: pa.Table) -> pa.Table:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        block = Phrases(group["id"].to_pylist(), group["text"].combine_chunks().cast(pa.string()), window)
        with system.open_output_stream(f"{path}/{group['b'][0].as_py()}") as out:
            out.write(block.dump())
        return pa.table({"b": group["b"][:1]})

    placed = pieces.withColumn("b", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))
    made = {r.b for r in placed.groupBy("b").applyInArrow(write, "b int").collect()}  # one number a block

    def read(k: int) -> Phrases:
        from pyarrow import fs

        if k not in made:
            return Phrases([], pa.array([], pa.string()), window)
        system, path = fs.FileSystem.from_uri(folder)
        with system.open_input_stream(f"{path}/{k}") as f:
            return Phrases.load(f.read())

    return n, read


def annotate(docs: DataFrame, benchmark: DataFrame, rule: Contamination = Contamination(), text: str = "text",
             item_key: str = "item_id", item_text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with the columns ``n_words``, ``spans`` (merged word spans to remove) and ``items``; their names.

    The documents are not shuffled and nothing is collected; all blocks of the benchmark are searched in one narrow pass.
    """
    names = fresh(docs.columns, "n_words", "spans", "items")
    types = ["long", "array<struct<start:long,end:long>>", "array<string>"]
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    n, block = blocks(benchmark, rule, item_key, item_text)

    def make(batches):
        waiting, shard, size = [], [], 0

        def flush():
            nonlocal shard, size
            spans, items = [[] for _ in shard], [set() for _ in shard]
            for k in range(n if shard else 0):
                phrases = block(k)
                for i, (s, found) in enumerate(search_shard([phrases.number(h) for h in shard], phrases, rule.sample)):
                    spans[i] += [tuple(x) for x in s.tolist()]
                    items[i].update(found)
            first = 0
            for counts in waiting:
                rows = range(first, first + len(counts))
                yield [pa.array(counts, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in merged(spans[i])] for i in rows], span_type),
                       pa.array([sorted(items[i]) for i in rows], pa.list_(pa.string()))]
                first += len(counts)
            waiting.clear()
            shard, size = [], 0

        for (column,) in batches:
            counts = []
            for h, _, _ in word_rows(column):
                counts.append(len(h))
                shard.append(h)
                size += len(h) + 1
            waiting.append(counts)
            if size >= rule.shard_words:
                yield from flush()
        yield from flush()

    return add_columns(docs, [text], list(zip(names, types)), make, docs.columns), names


def hit_words(spans: str) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def verdicts(docs: DataFrame, benchmark: DataFrame, rule: Contamination = Contamination(), **names) -> DataFrame:
    """``docs`` with ``n_words, n_hit, items, spans, contaminated``."""
    out, (n, spans, items) = annotate(docs, benchmark, rule, **names)
    hit, bad = fresh(out.columns, "n_hit", "contaminated")
    return out.withColumn(hit, hit_words(f"`{spans}`")).withColumn(
        bad, (F.col(hit) > 0) & (F.col(hit) * 100 >= F.col(n) * rule.percent))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rule: Contamination = Contamination(), **names) -> DataFrame:
    """The documents that are not contaminated, all columns."""
    out = verdicts(docs, benchmark, rule, **names)
    return out.filter(~F.col(f"`{out.columns[-1]}`")).select(*(f"`{c}`" for c in docs.columns))
