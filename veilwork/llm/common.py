"""Helpers of the training-data operators: shared storage, row-wise Arrow maps, and byte-buffer tokenizing.

All words and chunks are found on UTF-8 bytes: every separator the operators use is ASCII, so a byte scan
finds the same words as a scan of code points, without one Python object per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

U64 = np.uint64
SUB_BATCH_BYTES = 1 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Without that setting only a local session, whose executors are the driver itself, gets a folder of its own; a cluster
    session is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veilwork-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/veilwork-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and go on from the files: what several branches read is computed once,
    lost executors lose nothing, and the optimizer sees the true size of the table."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send rows to Python in batches of a few megabytes, so that a task's memory does not follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def vocabulary_file(name: str) -> str:
    """Where this machine keeps a file of a public tokenizer."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def fresh(columns: Sequence[str], *names: str) -> list[str]:
    """``names`` with a suffix where needed, so that none equals a column (case is ignored) that is there already."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def add_columns(df: DataFrame, inputs: Sequence[str], outputs: Sequence[tuple[str, str]],
                make: Callable[[Iterator[list[pa.Array]]], Iterator[list]], keep: Sequence[str] | None = None,
                where: bool = False) -> DataFrame:
    """Add columns row by row with one function over Arrow batches.

    ``make`` gets the input columns of each batch in turn and yields the output columns of each.  With ``where`` it
    yields one more, a mask of the rows that stay.  ``keep``: the input columns that are passed through (all).
    """
    bounded_batches(df.sparkSession)
    keep = list(df.columns if keep is None else keep)
    made = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in outputs)) if outputs else T.StructType()
    schema = T.StructType([df.schema[c] for c in keep] + list(made.fields))
    extra = [c for c in dict.fromkeys(inputs) if c not in keep]
    n_keep, position = len(keep), {c: i for i, c in enumerate([*keep, *extra])}
    picked, names = [position[c] for c in inputs], [*keep, *(n for n, _ in outputs)]

    def run(batches):
        held = []

        def feed():
            for b in batches:
                held.append(b)
                yield [b.column(i) for i in picked]

        for new in make(feed()):
            b = held.pop(0)
            mask = new.pop() if where else None
            out = pa.RecordBatch.from_arrays([*b.columns[:n_keep], *new], names=names)
            if mask is not None:
                out = out.filter(pa.array(mask))
            if out.num_rows:
                yield out

    return df.select(*(f"`{c}`" for c in keep), *(f"`{c}`" for c in extra)).mapInArrow(run, schema)


def runs_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], outputs: str, work: Callable[..., list[tuple]]) -> DataFrame:
    """``work(*columns)`` for each group of bounded size, its rows in ``order``; it gives output rows.

    The groups of a task come as one sorted stream, so many small ones cost no call into Arrow each.
    """
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, *order)
    schema, n = T._parse_datatype_string(outputs), len(keys)
    bounded_batches(df.sparkSession)

    def run(batches):
        now, held, out = None, [], []

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
            out.clear()
            return made

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        types, names = arrow.types, arrow.names
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:n] != now:
                    if held:
                        out += work(*zip(*held))
                        if len(out) > 10_000:
                            yield batch()
                    now, held = row[:n], []
                held.append(row)
        if held:
            out += work(*zip(*held))
        yield batch()

    return dealt.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Strings of a batch; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def byte_runs(column: pa.Array, limit: int = SUB_BATCH_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive rows of a string column as ``(first row, bytes, row offsets)`` of about ``limit`` bytes each.

    Null rows are empty.  A row longer than ``limit`` comes alone.
    """
    column = column.cast(pa.large_string()).fill_null("") if len(column) else column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, raw[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of a 64-bit hash (bijective)."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_BASE = 0x5851F42D4C957F2D
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) <= n:
        size = max(SUB_BATCH_BYTES + 1, n + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[raw] * up[:len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which ``inside`` (a table of 256 flags) holds, never across rows.

    Returns start and end of each run and the row it is in.
    """
    flags = np.zeros(len(raw) + 1, bool)
    flags[:-1] = inside[raw]
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = flags[:-1]
    before[offsets[:-1]] = False  # a row starts anew
    starts = np.flatnonzero(flags & ~before)
    after = np.zeros(len(raw), bool)
    after[:] = flags[1:]
    inner = offsets[1:-1]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(flags[:-1] & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def hashed_words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``byte_words`` of lower-cased bytes (A-Z only) and the hash of each, in parts that end between words: the memory for
    a giant row is a few bytes for each of its own."""
    found, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + SUB_BATCH_BYTES)
        while end < len(raw) and inside[LOWER[raw[end]]]:  # most often a few bytes; a single run is never cut
            ahead = LOWER[raw[end:end + SUB_BATCH_BYTES]]
            outside = np.flatnonzero(~inside[ahead])
            end += int(outside[0]) if len(outside) else len(ahead)
        part = LOWER[raw[at:end]]
        low, high = np.searchsorted(offsets, [at, end], "right")
        inner = offsets[low:high]
        local = np.concatenate([[0], inner[(inner > at) & (inner < end)] - at, [end - at]])
        starts, ends, _ = byte_words(part, local, inside)
        found.append((starts + at, ends + at, range_hashes(part, starts, ends) if len(starts) else np.zeros(0, np.uint64)))
        at = end
    starts, ends, hashes = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1, hashes


def byte_table(chars: bytes | range, value: bool = True) -> np.ndarray:
    out = np.full(256, not value)
    out[list(chars)] = value
    return out


#: Bytes of words between blanks, and bytes of words of letters, digits and non-ASCII characters.
BLANK_WORDS = byte_table(b" \t\n\v\f\r", False)
LETTER_WORDS = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
