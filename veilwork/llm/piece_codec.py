"""SentencePiece encoding and decoding by a max-plus parallel scan.

A segmentation's score is the sum of its pieces' scores; the best one is kept.  A giant document is cut into chunks.
Each chunk yields a transfer matrix: entry ``[i, j]`` is the best score from "the piece before reaches ``i`` characters into
this chunk" to "the last piece reaches ``j`` characters into the next".  The matrices of a document are combined in the
(max, +) algebra, which is associative; the states at all borders follow, and every chunk is then backtraced on its own.
Other documents are one chunk, encoded where they stand, without a shuffle.

The model file gives the pieces.  A BPE file's scores are merge priorities, so ``scores="rank"`` takes ``-log(id + 10)``
instead (``"file"``: as they are).  Scores are whole numbers (1/1024), so sums do not depend on how they are grouped, and
chunks change no total.  Among equal totals the longer last piece wins within a chunk.

Decoding joins the pieces; it restores every text, except that U+2581 becomes a blank, as in the format itself.

Defined results: null and empty texts have no ids; repeated rows are encoded each on its own; an empty table gives an
empty result; characters without a piece become byte pieces.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, byte_runs, fresh, stored, texts, vocabulary_file

BLANK = "▁"
SEGMENT = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
_CUT = re.compile(f"(?<=[^{BLANK}]){BLANK}")
NONE = -(1 << 60)
CACHE = 150_000  # segments a task remembers before it forgets the rarer half
RUN_BYTES = 1 << 21  # text that is segmented at once
TOGETHER = 32  # segments of up to so many characters are searched together, if many have their length
_ROLL = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class PieceRules:
    model: str = field(default_factory=lambda: vocabulary_file("piece_bpe_32k.model"))
    scores: str = "rank"
    chunk_chars: int = 1 << 15  # longer than any piece


def _fields(raw: bytes):
    """Fields of one level of a protocol-buffer message: number and value."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else 4 if tag & 7 == 5 else 8
            yield tag >> 3, raw[at:at + size]
            at += size


class Pieces:
    """The pieces of a model file with whole-number scores, and the segmentation of strings."""

    def __init__(self, raw: bytes, scores: str):
        self.text, self.of, self.byte_ids = [], {}, {}
        for field, value in _fields(raw):
            if field != 1:
                continue
            got = dict(_fields(value))
            piece, kind, i = got[1].decode(), got.get(3, 1), len(self.text)
            self.text.append(piece)
            score = -math.log(i + 10) if scores == "rank" else struct.unpack("<f", got[2])[0] if 2 in got else 0.0
            if kind == 6:
                self.byte_ids[int(piece[3:5], 16)] = i
            elif kind in (1, 4):
                self.of[piece] = (i, round(1024 * score))
        self.longest = max(map(len, self.of), default=1)
        self.reach: dict[str, int] = {}  # the longest piece that starts with two given characters
        for p in self.of:
            self.reach[p[:2]] = max(len(p), self.reach.get(p[:2], 0))
        self.unknown = min((s for _, s in self.of.values()), default=0) - 10 * 1024
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        # no piece has a blank after another character: a path cannot cross such a place
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in self.of)
        self.tables: list = []
        # last byte of a character and first byte of the next, side by side within a piece; a blank stands for its mark
        self.inside = np.zeros((256, 256), bool)
        for p in self.of:
            chars = [c.encode() for c in p.replace(BLANK, " ")]
            for a, b in zip(chars, chars[1:]):
                self.inside[a[-1], b[0]] = True

    def forward(self, text: str, start: int, stop: int) -> tuple[list[int], list[int]]:
        """Best scores and piece starts at each end; pieces start in ``[start, stop)`` and may end beyond ``stop``."""
        n, of, reach = len(text), self.of, self.reach
        best, back = [NONE] * (n + 1), [-1] * (n + 1)
        best[start] = 0
        for s in range(start, stop):
            here = best[s]
            if here == NONE:
                continue
            hit = of.get(text[s])
            score = here + (self.unknown if hit is None else hit[1])
            if score > best[s + 1]:
                best[s + 1], back[s + 1] = score, s
            for e in range(s + 2, min(n, s + reach.get(text[s:s + 2], 0)) + 1):
                hit = of.get(text[s:e])
                if hit is not None and here + hit[1] > best[e]:
                    best[e], back[e] = here + hit[1], s
        return best, back

    def trace(self, text: str, back: list[int], start: int, end: int) -> list[int]:
        out = []
        while end > start:
            s = back[end]
            hit = self.of.get(text[s:end])
            out.append([hit[0]] if hit is not None else [self.byte_ids[b] for b in text[s:end].encode("utf-8", "surrogatepass")])
            end = s
        return [i for ids in reversed(out) for i in ids]

    def segment(self, text: str) -> tuple[int, list[int]]:
        """Score and ids of a string on its own."""
        best, back = self.forward(text, 0, len(text))
        return best[-1], self.trace(text, back, 0, len(text))

    def _tables(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length: hashes of the pieces in order, their ids and scores."""
        if not self.tables:
            for n in range(1, self.longest + 1):
                mine = [(p, *v) for p, v in self.of.items() if len(p) == n]
                h = np.zeros(len(mine), np.uint64)
                for k in range(n):
                    h = h * _ROLL + np.array([ord(p[k]) for p, _, _ in mine], np.uint64)
                by = np.argsort(h)
                self.tables.append((h[by], np.array([i for _, i, _ in mine], np.int64)[by], np.array([s for _, _, s in mine], np.int64)[by]))
        return self.tables

    def together(self, group: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``segments`` of many strings of one length, searched side by side."""
        m, n, tables = len(group), len(group[0]), self._tables()
        codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).T.astype(np.uint64)
        best, back, ids = np.full((n + 1, m), NONE, np.int64), np.zeros((n + 1, m), np.int64), np.full((n + 1, m), -1, np.int32)
        best[0] = 0
        for s in range(n):
            h = np.zeros(m, np.uint64)
            for e in range(s + 1, min(n, s + self.longest) + 1):
                h = h * _ROLL + codes[e - 1]
                keys, piece, score = tables[e - s - 1]
                if not len(keys):
                    continue
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                if e > s + 1 and not hit.any():
                    continue
                found = np.where(hit, score[at], self.unknown if e == s + 1 else NONE) + best[s]
                better = np.flatnonzero(found > best[e])
                best[e, better], back[e, better] = found[better], s
                ids[e, better] = np.where(hit[better], piece[at[better]], -1)
        ways, end, all_ = [], np.full(m, n), np.arange(m)
        while end.any():
            ways.append(np.where(end > 0, ids[end, all_], -2))
            end = np.where(end > 0, back[end, all_], 0)
        way = np.array(ways[::-1]).T  # from the first piece to the last; -2: nothing, -1: a character without a piece
        bare = np.flatnonzero((way == -1).any(axis=1))
        if not len(bare):
            return best[n], (way >= 0).sum(axis=1), way[way >= 0]
        rows: list = [w[w >= 0] for w in way]
        for r in bare.tolist():
            rows[r] = np.array(self.segment(group[r])[1], np.int32)
        return best[n], np.array([len(x) for x in rows]), np.concatenate(rows)

    def segments(self, many: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores, numbers of ids and ids of many different strings, in an order that is returned first."""
        by_length: dict[int, list[int]] = {}
        for k, x in enumerate(many):
            by_length.setdefault(len(x), []).append(k)
        order, scores, sizes, flat = [], [], [], []
        for n, at in by_length.items():
            group = [many[k] for k in at]
            order += at
            if 0 < n <= TOGETHER and len(at) >= 16 * min(n, self.longest):
                found = self.together(group)
            else:
                alone = [self.segment(x) for x in group]
                found = (np.array([x for x, _ in alone], np.int64), np.array([len(ids) for _, ids in alone]),
                         np.array([i for _, ids in alone for i in ids], np.int32))
            for values, more in zip((scores, sizes, flat), found):
                values.append(more)
        return np.array(order, np.int64), *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (scores, sizes, flat))

    def split(self, text: str) -> list[str]:
        return SEGMENT.findall(text) if self.cuts else [text] if text else []

    def encode(self, text: str) -> list[int]:
        return [i for x in self.split(normal(text)) for i in self.segment(x)[1]]

    def decode(self, ids) -> str:
        return self.joined(ids)[1:]

    def joined(self, ids) -> str:
        """The pieces' text, blanks for their marks; a whole text has one in front."""
        out, raw = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "surrogatepass"))
                raw.clear()
            out.append(self.text[i])
        if raw:
            out.append(raw.decode("utf-8", "surrogatepass"))
        return "".join(out).replace(BLANK, " ")

    def parts(self, body: str, ahead: str) -> tuple[str, str, str, int]:
        """A chunk up to its first forced cut, from there to the last one, and from there on with what is ahead; last, how
        much of the third part is the chunk's own (-1: no cut, the first part is the chunk, the third what is ahead)."""
        first = _CUT.search(body) if self.cuts else None
        if first is None:
            return body, "", ahead, -1
        last = body.rfind(BLANK)
        while body[last - 1] == BLANK:
            last = body.rfind(BLANK, 0, last)
        return body[:first.start()], body[first.start():last], body[last:] + ahead, len(body) - last

    def matrix(self, head: str, tail: str, size: int, total: int) -> np.ndarray:
        """The chunk's matrix, given its parts and the score of the middle."""
        width = self.longest
        out = np.full((width, width), NONE, np.int64)
        if size < 0:
            whole, reach = head + tail, min(width, len(tail) + 1)
            for i in range(min(width, len(head) + 1)):
                best, _ = self.forward(whole, i, len(head))
                out[i, :reach] = best[len(head):len(head) + reach]
                if i == len(head):
                    out[i, 1:] = NONE
            return out
        best, _ = self.forward(tail, 0, size)
        reach = min(width, len(tail) - size + 1)
        last = np.array(best[size:size + reach], np.int64)
        for i in range(min(width, len(head) + 1)):
            first = self.forward(head, i, len(head))[0][len(head)]
            if first > NONE:
                out[i, :reach] = np.where(last > NONE, last + first + total, NONE)
        return out

    def ways(self, head: str, tail: str, size: int, entry: int, exit_: int) -> tuple[list[int], list[int], bool]:
        """Ids before and after the middle between two given border states, and whether they give their texts again."""
        if size < 0:
            whole, end = head + tail, len(head) + exit_
            ids = self.trace(whole, self.forward(whole, entry, len(head))[1], entry, end)
            return ids, [], self.joined(ids) == whole[entry:end].replace(BLANK, " ")
        first = self.trace(head, self.forward(head, entry, len(head))[1], entry, len(head))
        last = self.trace(tail, self.forward(tail, 0, size)[1], 0, size + exit_)
        same = self.joined(first) == head[entry:].replace(BLANK, " ") and self.joined(last) == tail[:size + exit_].replace(BLANK, " ")
        return first, last, same


class Known:
    """Segmentations met so far in flat arrays, and the segmentation of many texts with them.

    Segments are looked up with blanks for their marks, each different one once a run of text.  That a segment's ids give
    it again is tested once, when it is learned.
    """

    def __init__(self, it: Pieces):
        self.it = it
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes, self.scores, self.fine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.flat, self.met = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def learn(self, new: list[str]) -> None:
        order, scores, sizes, flat = self.it.segments([x.replace(" ", BLANK) for x in new])
        new = [new[k] for k in order.tolist()]
        text, ids = self.it.text, flat.tolist()
        if "".join([text[i] for i in ids]).replace(BLANK, " ") == "".join(new):
            fine = np.ones(len(new), bool)
        else:  # byte pieces among them
            ends = np.cumsum(sizes).tolist()
            fine = np.array([self.it.joined(ids[e - n:e]) == x for x, e, n in zip(new, ends, sizes.tolist())], bool)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.sizes, self.scores = np.append(self.sizes, sizes.astype(np.int64)), np.append(self.scores, scores)
        self.fine, self.flat = np.append(self.fine, fine), np.append(self.flat, flat.astype(np.int32))
        self.met = np.append(self.met, np.zeros(len(new), np.int32))

    def forget(self) -> None:
        keep = np.sort(np.argsort(-self.met, kind="stable")[:CACHE // 2])
        names, n = list(self.known), self.sizes[keep]
        self.flat = self.flat[np.repeat(np.cumsum(self.sizes)[keep] - np.cumsum(n), n) + np.arange(n.sum())]
        self.sizes, self.scores, self.fine, self.met = n, self.scores[keep], self.fine[keep], self.met[keep]
        self.known = {names[k]: i for i, k in enumerate(keep.tolist())}

    def numbers(self, segments: list[str]) -> np.ndarray:
        """The number of each of these different segments."""
        look = self.known.get
        out = np.array([look(x, -1) for x in segments], np.int64)
        new = np.flatnonzero(out < 0)
        if len(self.known) + len(new) > CACHE and self.known:
            if len(self.known) > CACHE // 2:
                self.forget()
            else:
                self.clear()
            return self.numbers(segments)
        self.learn([segments[k] for k in new.tolist()])
        out[new] = [self.known[segments[k]] for k in new.tolist()]
        self.met[out] += 1
        return out

    def rows(self, column: pa.Array, led: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """``(ids, score, fine)`` of each row.  ``led``: rows get the blank in front that a whole text has."""
        column = pc.replace_substring(column.fill_null(""), BLANK, " ")
        flats, counts, scores, fines = [], [], [], []
        for _, raw, at in byte_runs(column, RUN_BYTES):
            filled = np.diff(at) > 0
            if led:
                raw = np.insert(raw, at[:-1][filled], 0x20)
                at = at + np.append(0, np.cumsum(filled))
            # a path cannot go on across two characters that no piece holds side by side
            first = np.ones(len(raw), bool)
            first[1:] = ~self.it.inside[raw[:-1], raw[1:]] & ((raw[1:] & 0xC0) != 0x80)
            first[at[:-1][filled]] = True
            starts = np.flatnonzero(first)
            coded = pa.Array.from_buffers(pa.large_string(), len(starts), [
                None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
            number = self.numbers(coded.dictionary.to_pylist())
            which = number[coded.indices.to_numpy()] if len(number) else number
            n = self.sizes[which]
            flats.append(self.flat[np.repeat((np.cumsum(self.sizes) - self.sizes)[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            border = np.searchsorted(starts, at)
            per_row = lambda values: np.diff(np.append(0, np.cumsum(values))[border])
            counts.append(per_row(n))
            scores.append(per_row(self.scores[which]))
            fines.append(per_row(~self.fine[which]) == 0)
        join = lambda many, kind: np.concatenate(many) if many else np.zeros(0, kind)
        offsets = np.append(0, np.cumsum(join(counts, np.int64))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(join(flats, np.int32), pa.int32()))
        return ids, join(scores, np.int64), join(fines, bool)


def normal(text: str) -> str:
    return BLANK + text.replace(" ", BLANK) if text else ""


@lru_cache(maxsize=2)
def pieces(model: str, scores: str) -> Pieces:
    with open(model, "rb") as f:
        return Pieces(f.read(), scores)


def maxplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in the (max, +) algebra."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NONE)


def border_states(matrices: list[np.ndarray]) -> list[int]:
    """States at the ``n + 1`` borders of a document's chunks on a best path that starts and ends at its ends.

    Products of matrices are built up by halves and the states found down the same tree.
    """
    if len(matrices) == 1:
        return [0, 0]
    levels = [matrices]
    while len(levels[-1]) > 1:
        m = levels[-1]
        levels.append([maxplus(m[k], m[k + 1]) if k + 1 < len(m) else m[k] for k in range(0, len(m), 2)])
    states = [0, 0]
    for m in reversed(levels[:-1]):
        finer = []
        for k in range(0, len(m), 2):
            left, right = states[k // 2], states[k // 2 + 1]
            finer.append(left)
            if k + 1 < len(m):
                finer.append(int(np.argmax(m[k][left] + m[k + 1][:, right])))
        states = [*finer, states[-1]]
    return states


_WORKER: dict[tuple, Known] = {}


def worker_known(raw: bytes, scores: str) -> Known:
    """The model of this Python worker, kept from task to task; the segments of the task before are forgotten."""
    key = (hash(raw), scores)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Known(Pieces(raw, scores))
    _WORKER[key].clear()
    return _WORKER[key]


def encode(docs: DataFrame, rules: PieceRules = PieceRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, ids array<int>, n_tokens, n_chunks, round_trip)`` of each row."""
    # the model file is read where the driver is and sent to the tasks: 0.5 MB, whatever the data
    with open(rules.model, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    def worker() -> Known:
        return worker_known(raw.value, rules.scores)

    named = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))
    whole, giant = named.filter(size <= rules.chunk_chars), named.filter(size > rules.chunk_chars)
    outputs = [("ids", "array<int>"), ("n_tokens", "long"), ("n_chunks", "long"), ("round_trip", "boolean")]

    def encode_rows(batches):
        known = worker()
        for (column,) in batches:
            ids, _, fine = known.rows(column, True)
            yield [ids, pc.cast(pc.list_value_length(ids), pa.int64()), pa.array(np.ones(len(ids), np.int64)), pa.array(fine)]
        known.clear()  # the worker lives on beside those of other stages

    short = add_columns(whole, ["text"], outputs, encode_rows, ["id"])
    kind = named.schema["id"].dataType.simpleString()

    def cut(batches):
        step, reach = rules.chunk_chars, worker().it.longest - 1
        for b in batches:
            for i in range(b.num_rows):
                row, id, x = b.column(0)[i], b.column(1)[i], normal(b.column(2)[i].as_py())
                for first in range(0, len(x), 8 * step):
                    at = range(first, min(len(x), first + 8 * step), step)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row.as_py()] * len(at), pa.int64()), pa.array([id.as_py()] * len(at), b.column(1).type),
                         pa.array([a // step for a in at], pa.int64()), pa.array([x[a:a + step] for a in at], pa.string()),
                         pa.array([x[a + step:a + step + reach] for a in at], pa.string())], names=["row", "id", "k", "body", "ahead"])

    def measure(batches):
        known = worker()
        for bodies, ahead in batches:
            columns: tuple[list, ...] = ([], [], [], [], [], [])
            for at in range(0, len(bodies), 64):
                parts = [known.it.parts(x, y) for x, y in zip(bodies[at:at + 64].to_pylist(), ahead[at:at + 64].to_pylist())]
                middle, scores, fine = known.rows(pa.array([p[1] for p in parts], pa.string()), False)
                tables = [known.it.matrix(head, tail, own, total).tobytes() for (head, _, tail, own), total in zip(parts, scores.tolist())]
                for values, more in zip(columns, (
                        pa.array([p[0] for p in parts], pa.string()), pa.array([p[2] for p in parts], pa.string()),
                        pa.array([p[3] for p in parts], pa.int64()), pa.array(tables, pa.binary()), middle, pa.array(fine))):
                    values.append(more)
            yield [pa.concat_arrays(values) for values in columns]
        known.clear()

    pieces_ = giant.select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(
        cut, f"row long, id {kind}, k long, body string, ahead string").repartition("row", "k")
    chunks = stored(add_columns(pieces_, ["body", "ahead"], [
        ("head", "string"), ("tail", "string"), ("own", "long"), ("matrix", "binary"), ("middle", "array<int>"), ("fine", "boolean")],
        measure, ["row", "id", "k"]), "chunks")

    def states(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        width = worker().it.longest
        s = border_states([np.frombuffer(x, np.int64).reshape(width, width) for x in group["matrix"].to_pylist()])
        return pa.table({"row": group["row"], "k": group["k"], "entry": pa.array(s[:-1], pa.int64()), "exit": pa.array(s[1:], pa.int64())})

    # a document has one matrix of 2 KB for each chunk, so a group is smaller than the row its text came in
    borders = chunks.select("row", "k", "matrix").groupBy("row").applyInArrow(states, "row long, k long, entry long, exit long")

    def paths(batches):
        it = worker().it
        for heads, tails, own, entry, exit_ in batches:
            found = [it.ways(*x) for x in zip(*(c.to_pylist() for c in (heads, tails, own, entry, exit_)))]
            yield [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_()))]

    ends = add_columns(chunks.select("row", "k", "head", "tail", "own").join(borders, ["row", "k"]), ["head", "tail", "own", "entry", "exit"],
                       [("first", "array<int>"), ("last", "array<int>"), ("same", "boolean")], paths, ["row", "k"])
    parts = chunks.select("row", "id", "k", "middle", "fine").join(ends, ["row", "k"])
    long = parts.groupBy("row").agg(
        F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct("k", F.concat("first", "middle", "last").alias("ids")))).alias("parts"),
        F.count("*").alias("n_chunks"), F.bool_and(F.col("same") & F.col("fine")).alias("round_trip")
    ).select("id", F.flatten("parts.ids").alias("ids"), F.lit(0).alias("n_tokens"), "n_chunks", "round_trip").withColumn(
        "n_tokens", F.size("ids").cast("long"))
    return short.unionByName(long)


def decode(encoded: DataFrame, rules: PieceRules = PieceRules(), ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of each row's ids (null ids: empty)."""
    with open(rules.model, "rb") as f:
        raw = encoded.sparkSession.sparkContext.broadcast(f.read())

    def make(batches):
        it = worker_known(raw.value, rules.scores).it
        for (column,) in batches:
            yield [pa.array([it.decode(x or []) for x in column.to_pylist()], pa.string())]

    name, = fresh(encoded.columns, "decoded")
    return add_columns(encoded, [ids], [(name, "string")], make)
