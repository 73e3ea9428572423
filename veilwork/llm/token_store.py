"""Token-id output: documents as ids in a compressed, checksummed block format.

Ids are coded by a static range asymmetric numeral system.  One frequency table, counted over all ids, is shared by all
blocks.  A block holds whole documents and is coded by ``lanes`` interleaved states, so that each step codes one id per
lane; it can be decoded alone, and from each of its checkpoints.  Every block carries a CRC of its ids.

The store is a folder of Parquet tables that Spark writes, so it works on whatever file system Spark works on:
``table`` (token, frequency) and ``blocks`` (in ascending document id: documents, counts, payload, checkpoints, CRC).

Defined results: a null text is empty and has only the end id; a null document id comes first; rows that share an id
follow each other by their ids' bytes; an empty table gives an empty store; other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import add_columns, bounded_batches, byte_runs, stored, vocabulary_file

BITS = 20  # the frequencies of a table sum to 2**BITS
LOW = np.uint64(1 << 31)
_32, _BITS = np.uint64(32), np.uint64(BITS)
RUN_BYTES = 1 << 22
CACHE = 600_000  # pieces a worker remembers before it forgets the rarer half


@dataclass(frozen=True)
class StoreRules:
    tokenizer: str = field(default_factory=lambda: vocabulary_file("byte_bpe_50k.json"))
    end_id: int = 0
    block_ids: int = 1 << 18
    lanes: int = 512
    checkpoint_steps: int = 256


# --- tokenizing -----------------------------------------------------------------------------------------------------

_SOLID = np.zeros(256, bool)  # bytes that start a visible character: ASCII, or two bytes from U+00C0 on
_SOLID[0x21:0x7F] = _SOLID[0xC3:0xE0] = True
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK = _SOLID & ~_LETTER  # ASCII marks but the apostrophe, which may belong to a contraction
_MARK[0x30:0x3A] = _MARK[0x27] = _MARK[0x80:] = False


def piece_starts(raw: np.ndarray, at: np.ndarray, added: list[bytes]) -> np.ndarray:
    """Places where a text may be cut without changing its byte-level ids, because no pre-token goes on across them:
    before a single blank, on both sides of a single line end (each between two visible characters), and between an ASCII
    letter and a mark.  A token ``added`` to the vocabulary is never cut."""
    p = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
    p = p[(p > 1) & (p < len(raw) - 1)]
    before, lead = raw[p - 1], raw[p - 2]
    ok = _SOLID[raw[p + 1]] & ((_SOLID[before] & (before < 0x80)) | (_TAIL[before] & _SOLID[lead] & (lead >= 0x80)))
    p = p[ok]
    row = np.searchsorted(at, p, "right") - 1
    p = p[(p - at[row] >= 2) & (at[row + 1] - p >= 2)]  # both neighbours are in the same row
    first = np.zeros(len(raw), bool)
    first[p] = True
    first[p[raw[p] == 0x0A] + 1] = True
    first[1:] |= _LETTER[raw[:-1]] & _MARK[raw[1:]]  # where a row begins in between, it is a start as well
    joined = raw.tobytes()
    for token in added:
        k = joined.find(token)
        while k >= 0:
            first[k + 1:k + len(token)] = False
            k = joined.find(token, k + 1)
    first[at[:-1][at[1:] > at[:-1]]] = True
    return np.flatnonzero(first)


class PieceIds:
    """Ids of pieces met so far.  New ones go through the tokenizer many at a time: a piece that is one blank and visible
    characters can be joined with others of its kind, and its ids begin where a token with a blank in front stands; a piece
    of visible characters alone is joined with its kind by line ends, whose ids are left out."""

    def __init__(self, tokenizer, end_id: int):
        self.tokenizer, self.end_id = tokenizer, end_id
        self.blank = np.zeros(tokenizer.get_vocab_size(), bool)
        self.blank[[i for t, i in tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True  # how this format writes a blank
        self.added = [x.content.encode() for x in tokenizer.get_added_tokens_decoder().values()]
        self.line_end, = tokenizer.encode("\n", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes, self.flat = np.ones(1, np.int64), np.array([self.end_id], np.uint32)  # number 0: the end id
        self.met = np.zeros(1, np.int32)

    def _encode(self, many: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(many, add_special_tokens=False)]

    def _joined(self, pieces: list[str], mark: str) -> list[tuple[list[str], np.ndarray]]:
        """Groups of 512 pieces, each with the ids of their text with ``mark`` in between."""
        groups = [pieces[k:k + 512] for k in range(0, len(pieces), 512)]
        return [x for k in range(0, len(groups), 8) for x in zip(groups[k:k + 8], self._encode([mark.join(g) for g in groups[k:k + 8]]))]

    def learn(self, new: list[str]) -> None:
        """Add the ids of pieces that are not known yet."""
        kinds: tuple[list[str], ...] = ([], [], [])
        for p in new:
            visible = p[1:] if p[0] == " " else p
            kinds[2 if visible.split() != [visible] else visible is p].append(p)
        led, bare, other = kinds
        sizes, flat = [self.sizes], [self.flat]
        for group, ids in self._joined(led, ""):
            first = np.flatnonzero(self.blank[ids])
            if len(first) != len(group):
                raise ValueError("a blank inside a token")
            sizes.append(np.diff(np.append(first, len(ids))))
            flat.append(ids)
        for group, ids in self._joined(bare, "\n"):
            ends = np.append(np.flatnonzero(ids == self.line_end), len(ids))
            if len(ends) != len(group):
                raise ValueError("a line end inside a token")
            sizes.append(np.diff(ends, prepend=-1) - 1)
            flat.append(ids[ids != self.line_end])
        for k in range(0, len(other), 1024):
            found = self._encode(other[k:k + 1024])
            sizes.append(np.array([len(x) for x in found], np.int64))
            flat += found
        self.known.update(zip(led + bare + other, range(len(self.known) + 1, len(self.known) + len(new) + 1)))
        self.sizes, self.flat = np.concatenate(sizes), np.concatenate(flat)
        self.met = np.append(self.met, np.zeros(len(new), np.int32))

    def forget(self) -> None:
        """Keep the half of the cache that was met in the most runs."""
        keep = np.sort(np.argsort(-self.met[1:], kind="stable")[:CACHE // 2]) + 1
        at, names = np.append(0, keep), list(self.known)
        ends, n = np.cumsum(self.sizes)[at], self.sizes[at]
        self.flat = self.flat[np.repeat(ends - np.cumsum(n), n) + np.arange(n.sum())]
        self.sizes, self.met = n, self.met[at]
        self.known = {names[k - 1]: i for i, k in enumerate(keep.tolist(), 1)}

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The number of each of these different pieces."""
        look = self.known.get
        out = np.array([look(p, -1) for p in pieces], np.int64)
        new = np.flatnonzero(out < 0)
        if len(self.known) + len(new) > CACHE:
            self.forget()
            return self.numbers(pieces) if len(self.known) + len(pieces) <= CACHE else self.afresh(pieces)
        self.learn([pieces[k] for k in new])
        out[new] = [look(pieces[k]) for k in new]
        self.met[out] += 1
        return out

    def afresh(self, pieces: list[str]) -> np.ndarray:
        """A run that alone has more pieces than fit beside the kept half."""
        self.clear()
        self.learn(pieces)
        return np.array([self.known[p] for p in pieces], np.int64)

    def rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each row with the end id."""
        for _, raw, at in byte_runs(column, RUN_BYTES):
            starts = piece_starts(raw, at, self.added)
            offsets = np.append(starts, len(raw)).astype(np.int64)
            coded = pa.Array.from_buffers(pa.large_string(), len(starts), [
                None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
            number = self.numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            row_end = np.searchsorted(starts, at[1:])
            which = np.insert(number[coded.indices.to_numpy()] if len(number) else number, row_end, 0)
            first, n = np.cumsum(self.sizes) - self.sizes, self.sizes[which]
            out = self.flat[np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            yield from np.split(out, np.cumsum(n)[row_end + np.arange(len(row_end))][:-1])


_WORKER: dict[tuple[str, int], PieceIds] = {}


def worker_pieces(model: str, end_id: int) -> PieceIds:
    """The pieces of this Python worker: Spark gives a worker one task after another, so neither the tokenizer nor the
    pieces met so far (at most ``CACHE``) are made anew for each task."""
    if (model, end_id) not in _WORKER:
        from tokenizers import Tokenizer

        _WORKER.clear()
        _WORKER[model, end_id] = PieceIds(Tokenizer.from_str(model), end_id)
    return _WORKER[model, end_id]


def width(rules: StoreRules) -> str:
    """Ids between tokenizing and coding take two bytes if the vocabulary allows it."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(rules.tokenizer).get_vocab_size() - 1, rules.end_id) < 1 << 16 else "<u4"


def tokenize(docs: DataFrame, rules: StoreRules, key: str, text: str) -> DataFrame:
    """``(id, ids)``: little-endian unsigned ids of ``width(rules)`` with the end id."""
    with open(rules.tokenizer, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # a fixed file of about 1.5 MB
    kind = width(rules)

    def make(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pieces = worker_pieces(model.value, rules.end_id)
        for (column,) in batches:
            yield [pa.array([x.astype(kind).tobytes() for x in pieces.rows(column)], pa.binary())]

    named = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return add_columns(named, ["text"], [("ids", "binary")], make, ["id"])


# --- range asymmetric numeral system --------------------------------------------------------------------------------


class Frequencies:
    """A static table: integer frequencies that sum to 2**BITS, and their cumulative sums."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        self.freq = np.zeros(int(tokens.max(initial=0)) + 1, np.int64)
        if len(tokens):
            share = np.maximum(1, counts.astype(np.float64) * ((1 << BITS) - len(tokens)) / counts.sum()).astype(np.int64)
            share[np.argmax(share)] += (1 << BITS) - share.sum()
            self.freq[tokens] = share
        self.freq = self.freq.astype(np.uint64)
        self.first = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, table: Frequencies, lanes: int, every: int) -> tuple[bytes, bytes]:
    """Payload (32-bit words in decoding order) and checkpoints (word offset and lane states, one for each ``every`` steps)."""
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    for t in range(steps - 1, -1, -1):
        symbols = ids[t * lanes:(t + 1) * lanes]
        f, c = table.freq[symbols], table.first[symbols]
        x = state[:len(symbols)]
        full = x >= (f << np.uint64(63 - BITS))
        if full.any():
            out = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
            words.append(out)
            written += len(out)
            x = np.where(full, x >> _32, x)
        q = x // f
        state[:len(symbols)] = (q << _BITS) + (x - q * f) + c
        if t % every == 0:
            marks.append((written, state.copy()))
    payload = b"".join(w.tobytes() for w in reversed(words))
    return payload, b"".join(np.uint64(written - w).tobytes() + s.tobytes() for w, s in reversed(marks))


def decode_block(payload: bytes, checkpoints: bytes, n: int, table: Frequencies, lanes: int, every: int,
                 first_mark: int = 0, last_mark: int | None = None) -> np.ndarray:
    """Ids between two checkpoints (all of them by default)."""
    words = np.frombuffer(payload, "<u4").astype(np.uint64)
    size = 8 * (lanes + 1)
    mark = np.frombuffer(checkpoints[first_mark * size:(first_mark + 1) * size], np.uint64)
    steps = -(-n // lanes)
    stop = steps if last_mark is None else min(steps, last_mark * every)
    begin = first_mark * every
    out = np.empty(max(0, min(n, stop * lanes) - begin * lanes), np.uint32)
    if not len(out):
        return out
    at, state = int(mark[0]), mark[1:].copy()
    low = np.uint64((1 << BITS) - 1)
    for t in range(begin, stop):
        k = min(lanes, n - t * lanes)
        x = state[:k]
        slot = x & low
        symbols = table.slots[slot.astype(np.int64)]
        out[(t - begin) * lanes:(t - begin) * lanes + k] = symbols
        x = table.freq[symbols] * (x >> _BITS) + slot - table.first[symbols]
        short = np.flatnonzero(x < LOW)
        if len(short):
            x[short] = (x[short] << _32) | words[at:at + len(short)]
            at += len(short)
        state[:k] = x
    return out


# --- the store ------------------------------------------------------------------------------------------------------


def _table(rows: pa.Table) -> Frequencies:
    return Frequencies(rows["token"].to_numpy(), rows["n"].to_numpy())


def write_tokens(docs: DataFrame, path: str, rules: StoreRules = StoreRules(), key: str = "doc_id", text: str = "text") -> None:
    """Tokenize and write a store.  Ids are written once in between, because the table needs them all."""
    spark = docs.sparkSession
    ids, kind_of_id = tokenize(docs, rules, key, text), width(rules)
    bounded_batches(spark, 2000)  # enough text for whole runs
    tokens = stored(ids, "ids")

    def count(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column(0):
                n = np.bincount(np.frombuffer(x.as_buffer(), kind_of_id), minlength=len(total))
                n[:len(total)] += total
                total = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["token", "n"])

    tokens.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).coalesce(1).write.parquet(f"{path}/table")
    # at most one row for each entry of the vocabulary
    table = spark.sparkContext.broadcast(_table(spark.read.parquet(f"{path}/table").toArrow()))
    kind = tokens.schema["id"].dataType.simpleString()

    def block_rows(batches):
        part, block, waiting, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal block, waiting, size
            ids = np.concatenate([x for _, x in waiting])
            payload, marks = encode_block(ids, table.value, rules.lanes, rules.checkpoint_steps)
            row = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([zlib.crc32(ids.astype("<u4").tobytes())], pa.int64()),
                pa.array([[i for i, _ in waiting]], pa.list_(key_type)), pa.array([[len(x) for _, x in waiting]], pa.list_(pa.int64())),
                pa.array([payload], pa.binary()), pa.array([marks], pa.binary())],
                names=["part", "block", "n_ids", "crc32", "docs", "counts", "payload", "checkpoints"])
            block, waiting, size = block + 1, [], 0
            return row

        for b in batches:
            key_type = b.column(0).type
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.frombuffer(x.as_buffer(), kind_of_id).astype(np.uint32)
                waiting.append((i, ids))
                size += len(ids)
                if size >= rules.block_ids:
                    yield flush()
        if waiting:
            yield flush()

    ordered = tokens.repartitionByRange(F.asc_nulls_first("id"), F.xxhash64("ids")).sortWithinPartitions(F.asc_nulls_first("id"), "ids")
    ordered.mapInArrow(
        block_rows, f"part long, block long, n_ids long, crc32 long, docs array<{kind}>, counts array<long>, payload binary, checkpoints binary"
    ).write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, rules: StoreRules = StoreRules(), with_ids: bool = True) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32[, ids])`` of each document of a store; a block that fails its CRC is an error."""
    table = spark.sparkContext.broadcast(_table(spark.read.parquet(f"{path}/table").toArrow()))
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    # one sum for each written part, and a part's blocks by their own running sum
    begin, starts = 0, {}
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        starts[r["part"]], begin = begin, begin + r["n"]
    order = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))

    def rows(batches):
        for b in batches:
            d = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for k in range(b.num_rows):
                ids = decode_block(d["payload"][k].as_py(), d["checkpoints"][k].as_py(), d["n_ids"][k].as_py(), table.value, rules.lanes, rules.checkpoint_steps)
                if zlib.crc32(ids.astype("<u4").tobytes()) != d["crc32"][k].as_py():
                    raise ValueError(f"block {d['block'][k]} of part {d['part'][k]} is damaged")
                counts = np.array(d["counts"][k].as_py(), np.int64)
                ends = np.cumsum(counts)
                parts = np.split(ids, ends[:-1])
                raw = [p.astype("<u4").tobytes() for p in parts]
                out = [pa.array(d["docs"][k].as_py(), b.schema.field("docs").type.value_type),
                       pa.array(ends - counts + d["before"][k].as_py() + starts[d["part"][k].as_py()], pa.int64()),
                       pa.array(counts, pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, pa.array(raw, pa.binary())] if with_ids else out,
                                                 names=["id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return blocks.join(earlier, ["part", "block"]).select("part", "block", "n_ids", "crc32", "docs", "counts", "payload", "checkpoints", "before").mapInArrow(
        rows, f"id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
