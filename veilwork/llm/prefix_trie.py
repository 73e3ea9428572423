"""The prefix trie of conversations: which openings are shared, by how many, and what sharing them saves.

A turn is named by an id of fixed width: the length of its text in four big-endian bytes and 96 bits of a digest of role
and text.  A conversation is the row of its ids, and adaptive radix trees over these bytes (nodes with room for 4, 16, 48
or 256 children, paths without branches kept as one string) find what conversations share.  Only the byte depths that end
a turn are nodes of the result.

*One order, many trees.*  The rows of ids are laid in one global order by a range sort; each task reads its range as a
stream and builds trees over at most ``chunk_keys`` different keys at a time.  A node can go beyond its tree only on the
paths of the first and the last key.  Those few nodes stay *open*: their parts are summed by name, and what their subtrees
hold is summed along their parents by pointer jumping, in as many rounds as the logarithm of the deepest path.  All other
nodes are finished where they are found.

*Conversations of any length.*  A conversation is cut into layers of ``layer_turns`` turns; a layer hangs below the open
node its beginning ends at.  Open nodes are named by their depth and 128-bit sums of digests of (place, id), which are
added up along a conversation by a scan over ranges.

*Groups of any size.*  Members that end in a node are hashed as a stream in their order.  Where a group is long, or meets
the border of a task, its ids leave as pieces of text, and one stream hashes the pieces.

Texts are hashed in the JVM and never shuffled.

Defined cases.  Turns of one number follow the order of their ids; repeated rows are turns of their own.  Rows without a
conversation id belong to no conversation and are left out.  Texts of any length count whole.  An empty table has no
sequences and gives no rows.  Other columns play no part and may have any name.  Ids divide as in SQL: the base of -3 is 0.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.history import carry
from .common import bounded_batches, stored

WIDTH = 16
EMPTY = hashlib.sha256(b"").hexdigest()
_LANES = [f"_lane{i}" for i in range(4)]
_PIECE_BYTES = 1 << 16


@dataclass(frozen=True)
class TrieRules:
    """``family`` and ``heads``: conversation c begins with the first ``crc32(c) % heads`` turns of ``c - c % family``."""

    family: int = 5
    heads: int = 9
    layer_turns: int = 256
    chunk_keys: int = 20_000
    chunk_bytes: int = 4 << 20


# --- the rebuilt conversations ------------------------------------------------------------------------------------


def turn_id(role, text):
    """Length of the text and digest of role and text, as 32 hexadecimal digits."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.concat(F.lpad(F.hex(F.octet_length(text)), 8, "0"), F.substring(digest, 1, 2 * WIDTH - 8))


def rebuilt(turns: DataFrame, rules: TrieRules, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``(conv, pos, id, size)`` of the rebuilt turns, ``size`` turns in all, and the conversations without any."""
    narrow = turns.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"),
                          turn_id(F.col(f"`{role}`"), F.col(f"`{text}`")).alias("id")).where("conv is not null")
    placed = carry(narrow, ["conv"], ["turn", "id"], {"pos": ("sum", F.lit(1).cast("long"))}, lambda df: stored(df, "turns"))
    placed = stored(placed.select("conv", (F.col("pos") - 1).alias("pos"), "id"), "placed")
    sizes = placed.groupBy("conv").agg(F.count("*").alias("n")).withColumn("base", F.col("conv") - F.col("conv") % rules.family)
    sizes = stored(sizes.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % rules.heads), "sizes")
    bases = sizes.select(F.col("conv").alias("_b"), F.col("n").alias("_n"))
    info = sizes.join(bases, F.col("base") == F.col("_b"), "left").withColumn("k", F.least("h", F.coalesce("_n", F.lit(0))))
    info = stored(info.select("conv", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "info")
    mine = placed.join(info.drop("base"), "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "id", "size")
    lent = placed.where(F.col("pos") < rules.heads - 1).withColumnRenamed("conv", "_from").join(
        info, F.col("_from") == F.col("base")).where("pos < h").select("conv", "pos", "id", "size")
    return mine.unionByName(lent), info.where("size = 0").select("conv")


def lanes(place: int, id: bytes) -> tuple[int, ...]:
    d = hashlib.blake2b(id, digest_size=16, salt=place.to_bytes(16, "big")).digest()
    return tuple(int.from_bytes(d[i:i + 4], "big") for i in (0, 4, 8, 12))


def name_of(depth: int, sums) -> bytes:
    return depth.to_bytes(8, "big") + b"".join((s & 0xFFFFFFFF).to_bytes(4, "big") for s in sums)


def layers(rows: DataFrame, none: DataFrame, rules: TrieRules) -> DataFrame:
    """``(layer, path, key, conv, more)``: a layer of a conversation, the path before it, and whether it goes on."""
    step = rules.layer_turns
    cut = rows.groupBy("conv", F.floor(F.col("pos") / step).alias("layer")).agg(
        F.max("size").alias("size"), F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]), "")).alias("key"))
    cut = stored(cut, "layers")
    start, here = F.unhex(F.lit("00" * 16)), ["layer", "path", "key", "conv", "more"]
    short = cut.where(F.col("size") <= step).withColumn("path", start).withColumn("more", F.lit(False))
    long = cut.where(F.col("size") > step)

    def sums(batches):
        for b in batches:
            found = []
            for layer, key in zip(b.column("layer").to_pylist(), b.column("key").to_pylist()):
                each = [lanes(layer * step + i, key[i * WIDTH:(i + 1) * WIDTH]) for i in range(len(key) // WIDTH)]
                found.append([sum(x) for x in zip(*each)])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[i] for x in found], pa.int64()) for i in range(4))],
                                             names=[*b.schema.names, *_LANES])

    schema = "conv long, layer long, size long, key binary, " + ", ".join(f"{x} long" for x in _LANES)
    summed = long.select("conv", "layer", "size", "key").mapInArrow(sums, schema)
    summed = carry(summed, ["conv"], ["layer"], {f"_sum{i}": ("sum", F.col(x)) for i, x in enumerate(_LANES)}, lambda df: stored(df, "long"))
    before = [F.pmod(F.col(f"_sum{i}") - F.col(x), F.lit(1 << 32)) for i, x in enumerate(_LANES)]
    summed = summed.withColumn("path", F.unhex(F.concat(*(F.lpad(F.hex(x), 8, "0") for x in before))))
    summed = summed.withColumn("more", (F.col("layer") + 1) * step < F.col("size"))
    bare = none.select(F.lit(0).cast("long").alias("layer"), start.alias("path"), F.unhex(F.lit("")).alias("key"), "conv", F.lit(False).alias("more"))
    return short.select(*here).unionByName(summed.select(*here)).unionByName(bare)


# --- adaptive radix trees -----------------------------------------------------------------------------------------


class Node:
    """A node with the bytes that lead to it, the entry that ends in it, and children in a layout of 4, 16, 48 or 256.

    Up to 16 children: sorted bytes beside a list.  48: a table from byte to place in the list.  256: a list by byte.
    """

    __slots__ = ("path", "entry", "room", "keys", "slots")

    def __init__(self, path: bytes, entry=None):
        self.path, self.entry = path, entry
        self.room, self.keys, self.slots = 4, bytearray(), []

    def get(self, byte: int):
        if self.room == 256:
            return self.slots[byte]
        if self.room == 48:
            at = self.keys[byte]
            return self.slots[at - 1] if at else None
        at = bisect_left(self.keys, byte)
        return self.slots[at] if at < len(self.keys) and self.keys[at] == byte else None

    def put(self, byte: int, child: "Node") -> None:
        if self.room < 256 and len(self.slots) == self.room:
            self.grow()
        if self.room == 256:
            self.slots[byte] = child
        elif self.room == 48:
            self.slots.append(child)
            self.keys[byte] = len(self.slots)
        else:
            at = bisect_left(self.keys, byte)
            self.keys.insert(at, byte)
            self.slots.insert(at, child)

    def grow(self) -> None:
        if self.room == 4:
            self.room = 16
        elif self.room == 16:
            table = bytearray(256)
            for at, byte in enumerate(self.keys, 1):
                table[byte] = at
            self.room, self.keys = 48, table
        else:
            slots = [self.slots[at - 1] if at else None for at in self.keys]
            self.room, self.keys, self.slots = 256, bytearray(), slots

    def children(self) -> Iterator["Node"]:
        """In the order of their bytes."""
        if self.room == 48:
            return (self.slots[at - 1] for at in self.keys if at)
        return (c for c in self.slots if c is not None)


def shared(a: bytes, b: bytes) -> int:
    """How many bytes two strings begin with alike."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        half = (low + high) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half
    return low


def insert(root: Node, key: bytes, entry) -> None:
    node, at = root, 0
    while True:
        path = node.path
        same = len(path) if key.startswith(path, at) else shared(path, key[at:at + len(path)])
        if same < len(path):
            low = Node(path[same + 1:], node.entry)
            low.room, low.keys, low.slots = node.room, node.keys, node.slots
            node.path, node.entry, node.room, node.keys, node.slots = path[:same], None, 4, bytearray(), []
            node.put(path[same], low)
        at += same
        if at == len(key):
            node.entry = entry
            return
        child = node.get(key[at])
        if child is None:
            node.put(key[at], Node(key[at + 1:], entry))
            return
        node, at = child, at + 1


class Entry:
    __slots__ = ("key", "n", "conv", "more", "ends")

    def __init__(self, key: bytes, n: int, conv: int, more: bool, ends: str | None):
        self.key, self.n, self.conv, self.more, self.ends = key, n, conv, more, ends


FIELDS = ("open", "name", "up", "depth", "conv", "parent", "n", "size", "kids", "leaves", "saved", "ends", "part", "seq", "ids")
TYPES = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
         pa.string(), pa.int64(), pa.int64(), pa.string())
SCHEMA = ("open int, name binary, up binary, depth long, conv long, parent long, n long, size long, kids long, leaves long, saved long, "
          "ends string, part long, seq long, ids string")
CLOSED, OPEN, PIECE = 0, 1, 2


class Tree:
    """The tree of a run of sorted keys below one path; its nodes at turn borders as rows."""

    def __init__(self, layer: int, path: bytes, begun: bool, rules: TrieRules):
        self.layer, self.path, self.begun, self.rules = layer, path, begun, rules
        self.root, self.first, self.last = None, b"", b""
        self.n_keys = self.n_bytes = 0
        self.sums: tuple = (None, [])

    def add(self, entry: Entry) -> None:
        if self.root is None:
            self.root, self.first = Node(b""), entry.key
        insert(self.root, entry.key, entry)
        self.last = entry.key
        self.n_keys += 1
        self.n_bytes += len(entry.key)

    def name(self, key: bytes, turns: int) -> bytes:
        """Name of the node at a depth (in turns below this tree's path) on the way to a key."""
        known, sums = self.sums
        if known is None or known[:turns * WIDTH] != key[:turns * WIDTH]:
            same = shared(known, key) // WIDTH if known is not None else 0
            known, sums = key, sums[:same + 1] or [tuple(int.from_bytes(self.path[i:i + 4], "big") for i in (0, 4, 8, 12))]
            self.sums = (known, sums)
        while len(sums) <= turns:
            i = len(sums) - 1
            own = lanes(self.layer * self.rules.layer_turns + i, known[i * WIDTH:(i + 1) * WIDTH])
            sums.append(tuple(a + b for a, b in zip(sums[-1], own)))
        return name_of(self.layer * self.rules.layer_turns + turns, sums[turns])

    def rows(self, goes_on: bool) -> Iterator[list]:
        """All nodes, children before their parents.  ``goes_on``: later keys of this path follow elsewhere."""
        found: list[list] = []
        above = self.layer * self.rules.layer_turns

        def node(at: int, acc: list, entry: Entry | None) -> None:
            n, conv, key, pending = acc
            turns = at // WIDTH
            size = int.from_bytes(key[at - WIDTH:at - WIDTH + 4], "big") if at else 0
            is_open = not at or (entry is not None and entry.more) or (self.begun and self.first[:at] == key[:at]) or (
                goes_on and self.last[:at] == key[:at])
            kids = leaves = saved = 0
            for c in pending:
                row = found[c]
                if row[0] == CLOSED:
                    kids, leaves, saved = kids + 1, leaves + row[9], saved + row[10]
                else:
                    is_open = True
            ends = entry.ends if entry is not None else EMPTY
            name = self.name(key, turns) if is_open or ends is None else None
            if is_open:
                if entry is None:
                    ends = None
                if not at and self.layer:
                    n, conv = 0, None  # counted where the layer before ends
                up = self.name(key, turns - 1) if at else None
                row = [OPEN, name, up, above + turns, conv, None, n, size, kids, leaves, saved, ends, None, None, None]
            else:
                row = [CLOSED, name, None, above + turns, conv, None, n, size, kids, leaves or 1, saved + (n - 1) * size, ends, None, None, None]
            for c in pending:
                if found[c][0] == CLOSED:
                    if is_open:
                        found[c][2] = name
                    else:
                        found[c][5] = conv
            acc[3] = [len(found)]
            found.append(row)

        # frames: node, depth of its end, depth of its parent's end, children left, [members, smallest, a key, nodes below]
        todo = [(self.root, 0, -1, self.root.children(), [0, None, b"", []])]
        while todo:
            at, end, above_, left, acc = todo[-1]
            child = next(left, None)
            if child is not None:
                todo.append((child, end + 1 + len(child.path), end, child.children(), [0, None, b"", []]))
                continue
            todo.pop()
            entry = at.entry
            if entry is not None:
                acc[0] += entry.n
                acc[1] = entry.conv if acc[1] is None else min(acc[1], entry.conv)
                acc[2] = acc[2] or entry.key
            depth = end - end % WIDTH
            while depth > above_:
                node(depth, acc, entry if depth == end else None)
                depth -= WIDTH
            if todo:
                up = todo[-1][4]
                up[0] += acc[0]
                up[1] = acc[1] if up[1] is None else min(up[1], acc[1])
                up[2] = up[2] or acc[2]
                up[3] += acc[3]
        return iter(found)


class Run:
    """Members with one key, as they come: their count, and those that end here as a digest or as pieces."""

    def __init__(self, key: bytes, conv: int, first: bool):
        self.key, self.conv, self.first = key, conv, first
        self.n, self.more, self.seq, self.bytes, self.ids = 0, False, 0, 0, []

    def add(self, conv: int, more: bool) -> None:
        self.n += 1
        if more:
            self.more = True
        else:
            self.ids.append(str(conv))
            self.bytes += len(self.ids[-1]) + 1

    def piece(self, name: bytes, part: int) -> list:
        row = [PIECE, name, *[None] * 10, part, self.seq, ",".join(self.ids)]
        self.seq += 1
        self.ids, self.bytes = [], 0
        return row


def build(rules: TrieRules):
    def run(batches):
        from pyspark import TaskContext

        part, out = TaskContext.get().partitionId(), []
        tree, now = None, None

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(TYPES)], names=list(FIELDS))
            out.clear()
            return made

        def close_run(last: bool) -> None:
            if now is None:
                return
            ends = EMPTY
            if now.seq or (now.ids and (now.first or last)):
                if now.ids:
                    out.append(now.piece(tree.name(now.key, len(now.key) // WIDTH), part))
                ends = None
            elif now.ids:
                ends = hashlib.sha256(",".join(now.ids).encode()).hexdigest()
            tree.add(Entry(now.key, now.n, now.conv, now.more, ends))

        for b in batches:
            for layer, path, key, conv, more in zip(*(c.to_pylist() for c in b.columns)):
                new_tree = tree is None or (layer, path) != (tree.layer, tree.path)
                if new_tree or now.key != key:
                    close_run(False)
                    if new_tree:
                        if tree is not None:
                            out.extend(tree.rows(False))
                        tree = Tree(layer, path, tree is None, rules)
                    elif tree.n_keys >= rules.chunk_keys or tree.n_bytes >= rules.chunk_bytes:
                        out.extend(tree.rows(True))
                        tree = Tree(layer, path, True, rules)
                    now = Run(key, conv, now is None)
                    if len(out) > 20_000:
                        yield batch()
                now.add(conv, more)
                if now.bytes > _PIECE_BYTES:
                    out.append(now.piece(tree.name(key, len(key) // WIDTH), part))
        close_run(True)
        if tree is not None:
            out.extend(tree.rows(True))
        yield batch()

    return run


# --- open nodes ---------------------------------------------------------------------------------------------------


def _digests(pieces: DataFrame) -> DataFrame:
    """``(name, ends)``: pieces of a group hashed in their order, as one stream."""
    def run(batches):
        now, digest, names, ends = None, None, [], []
        for b in batches:
            for name, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if name != now:
                    if now is not None:
                        names.append(now)
                        ends.append(digest.hexdigest())
                    now, digest = name, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if len(names) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ends, pa.string())], names=["name", "ends"])
                names, ends = [], []
        if now is not None:
            names.append(now)
            ends.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ends, pa.string())], names=["name", "ends"])

    sent = pieces.select("name", "part", "seq", "ids").repartition("name").sortWithinPartitions("name", "part", "seq")
    return sent.select("name", "ids").mapInArrow(run, "name binary, ends string")


def _totals(nodes: DataFrame) -> DataFrame:
    """``(name, leaves, saved)`` summed over all nodes below, by pointer jumping along ``up``."""
    now = nodes
    while now.where("up is not null").take(1):
        given = now.where("up is not null").groupBy("up").agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s")).withColumnRenamed("up", "_to")
        ahead = now.where("up is not null").select(F.col("name").alias("_at"), F.col("up").alias("_next"))
        summed = now.join(given, F.col("name") == F.col("_to"), "left").join(ahead, F.col("up") == F.col("_at"), "left")
        now = stored(summed.select(
            "name", F.col("_next").alias("up"), (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved")), "open")
    return now.select(F.col("name").alias("_n"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def trie(turns: DataFrame, rules: TrieRules = TrieRules(), conv: str = "conv_id", turn: str = "turn", role: str = "role",
         text: str = "text") -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)`` of each node."""
    bounded_batches(turns.sparkSession)
    rows, none = rebuilt(turns, rules, conv, turn, role, text)
    order = ["layer", "path", "key", "conv"]
    dealt = layers(rows, none, rules).repartitionByRange(*order).sortWithinPartitions(*order)
    made = stored(dealt.select(*order, "more").mapInArrow(build(rules), SCHEMA), "trie")

    parts = made.where(F.col("open") == OPEN).groupBy("name").agg(
        F.max("up").alias("up"), F.max("depth").alias("depth"), F.min("conv").alias("conv"), F.sum("n").alias("n"), F.max("size").alias("size"),
        F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"))
    parts = stored(parts, "parts")
    below = parts.where("up is not null").groupBy("up").agg(F.count("*").alias("_open")).withColumnRenamed("up", "_parent")
    full = parts.join(below, F.col("name") == F.col("_parent"), "left").withColumn("n_children", F.col("kids") + F.coalesce("_open", F.lit(0)))
    full = stored(full.drop("_parent", "_open", "kids"), "full")
    own = full.select("name", "up", (F.col("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"),
                      (F.col("saved") + (F.col("n") - 1) * F.col("size")).alias("saved"))
    known = parts.select(F.col("name").alias("_up"), F.col("conv").alias("_conv"))
    columns = ["name", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    opened = full.join(known, F.col("up") == F.col("_up"), "left").join(_totals(own), F.col("name") == F.col("_n")).select(
        "name", F.col("conv").alias("conv_id"), "depth", F.col("_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        "n_leaves", "saved_tokens", "ends")
    closed = made.where(F.col("open") == CLOSED)
    pick = lambda df, parent: df.select("name", F.col("conv").alias("conv_id"), "depth", F.col(parent).alias("parent_conv_id"), F.col("n").alias("n_convs"),
                                        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends")
    inner = pick(closed.where("up is null"), "parent")
    outer = pick(closed.where("up is not null").join(known, F.col("up") == F.col("_up")), "_conv")
    nodes = opened.select(*columns).unionByName(inner).unionByName(outer)
    digests = _digests(made.where(F.col("open") == PIECE)).withColumnsRenamed({"name": "_piece", "ends": "_ends"})
    found = nodes.where("ends is null").join(digests, F.col("name") == F.col("_piece"), "left")
    found = found.withColumn("ends", F.coalesce("_ends", F.lit(EMPTY))).select(*columns)
    return nodes.where("ends is not null").unionByName(found).drop("name").withColumnRenamed("ends", "ends_sha256")
