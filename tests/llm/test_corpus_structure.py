"""Prefix trie, mixing and spelling variants against brute force, with the awkward cases and every limit made small."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import duckdb
import pytest

from tools.compare import canon
from veilwork.llm import mixing, prefix_trie, queries, spelling


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# --- prefix trie ----------------------------------------------------------------------------------------------------


def brute_trie(rows):
    """Nodes by their sequences; turns of one number must be given in the order of their ids."""
    given = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            given[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda y: y[:2])] for c, v in given.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = Counter(s[:-1] for s in members if s)
    out = []
    for s, m in members.items():
        below = [z for z in members if z[:len(s)] == s]
        ends = sorted(c for c in m if len(whole[c]) == len(s))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], sum(1 for z in below if not kids[z]),
                    sum((len(members[z]) - 1) * len(z[-1][1].encode()) for z in below if z),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n, depth, copies=0):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 4 * n), n):
        for t in range(rng.randrange(1, depth)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", "hé", "hello", None, "x" * 300])))
    for c in range(10_000, 10_000 + copies):
        rows += [(c, t, "user", f"same {t}") for t in range(12)]
    return rows


COLUMNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("rules", [prefix_trie.TrieRules(), prefix_trie.TrieRules(layer_turns=2, chunk_keys=3), prefix_trie.TrieRules(layer_turns=3, chunk_bytes=40)])
def test_trie(spark, many_parts, monkeypatch, rules):
    monkeypatch.setattr(prefix_trie, "_PIECE_BYTES", 30)
    rows = conversations(1, 60, 11, copies=40) + [(None, 0, "user", "nobody's"), (-3, None, "user", "first"), (-3, 0, "user", "second"), (7, 1000, None, None)]
    rows += [(c, t, "user", "deep") for c in (20_000, 20_001, 20_003) for t in range(40)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = prefix_trie.trie(df, rules)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


def test_trie_ties_repeats_empty(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 5, "user", "a"), (2, 5, "user", "a"), (3, 9, "u", "a")]
    df = spark.createDataFrame(rows, COLUMNS)
    assert sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=str) == brute_trie(rows)
    assert prefix_trie.trie(df.where("conv_id > 9")).count() == 0
    other = df.selectExpr("conv_id as c", "turn as pos", "role as path", "text as key", "1 as conv", "2 as id")
    named = prefix_trie.trie(other, conv="c", turn="pos", role="path", text="key")
    assert sorted(map(tuple, named.collect()), key=str) == brute_trie(rows)


def test_radix_tree_layouts():
    rng = random.Random(4)
    keys = sorted({bytes(rng.choices(range(256), k=rng.choice([1, 2, 3]))) for _ in range(4000)} | {bytes([7]) * 40, bytes([7]) * 20})
    root = prefix_trie.Node(b"")
    for k in rng.sample(keys, len(keys)):
        prefix_trie.insert(root, k, k)
    seen, rooms, todo = [], set(), [(root, b"")]
    while todo:
        at, before = todo.pop()
        rooms.add(at.room)
        if at.entry is not None:
            assert at.entry == before + at.path
            seen.append(at.entry)
        bytes_ = [c for c in range(256) if at.get(c) is not None]
        assert [at.get(c) for c in bytes_] == list(at.children())
        todo += [(at.get(c), before + at.path + bytes([c])) for c in reversed(bytes_)]
    assert sorted(seen) == keys and rooms == {4, 16, 48, 256}


# --- mixing ---------------------------------------------------------------------------------------------------------


def brute_mix(rows):
    """Sizes, sources, targets by sharing round after round, and the mix copy by copy."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    total = sum(size)
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    about = {s: sum(n for n, r in zip(size, rows) if r[1] == s) for s in names}
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    full = set()
    while True:
        left = total - sum(3 * about[s] for s in full)
        w = sum(weight[s] for s in names if s not in full) or 1
        more = {s for s in names if s not in full and left * weight[s] / w > 3 * about[s]}
        if not more:
            break
        full |= more
    target = {s: float(3 * about[s]) if s in full else left * weight[s] / w for s in names}
    line, sent = [], defaultdict(int)
    for e in range(3):
        order = sorted(range(len(rows)), key=lambda i: (hashlib.md5(f"mix:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(),
                                                       rows[i][0] is not None, rows[i][0] or 0, size[i]))
        for i in order:
            s = rows[i][1]
            sent[s] += size[i]
            if size[i] and target[s]:
                line.append((sent[s] / target[s], names.index(s), e, sent[s], i))
    taken, room = Counter(), total
    for *_, i in sorted(line):
        n = min(size[i], room)
        taken[i] += n
        room -= n
    return sorted(((r[0], size[i], about[r[1]], target[r[1]], taken[i]) for i, r in enumerate(rows)), key=str)


def mix_rows(seed, n):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot"] * 6 + ["b", "", None, "é", "tiny"]), " ".join("w" for _ in range(rng.randrange(60)))) for i in range(n)]
    return rows + [(n, "big", "word\x1cword " * 400), (n + 1, "void", ""), (n + 2, "void", None), (None, "b", "a b"), (5, "hot", "a b c"), (5, "hot", "a b c")]


@pytest.mark.parametrize("n", [0, 40, 300])
def test_mix(spark, many_parts, n):
    rows = mix_rows(n, n)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = sorted((tuple(r) for r in mixing.mix(df).drop("finish").collect()), key=str)
    want = brute_mix(rows)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    assert sum(g[4] for g in got) == sum(g[1] for g in got) and all(g[4] <= 3 * g[1] for g in got)


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert sorted(map(tuple, mixing.mix(df).drop("finish").collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.mix(df.where("doc_id > 9")).count() == 0
    rules = mixing.MixRules(weights=(1,), max_repeats=2)
    rows = [(i, "ab"[i % 2], "x " * (i + 1), "_size", i) for i in range(40)] + [(99, "a", "y " * 500, "_size", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _place string, finish long")
    mixed = mixing.mixed(docs, rules)
    assert mixed.columns == docs.columns
    taken = {r.id: r.taken for r in mixing.mix(docs, rules).collect()}
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert dict(words) == {d: n for d, n in taken.items() if n}


# --- spelling variants ----------------------------------------------------------------------------------------------


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n), key=str)


def variant_rows(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(4, 9))) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ÀÉÎÕÜ", "Straße", "x" * 3000, "x" * 3001]
    words += ["prefix" + "".join(rng.choice("uvw") for _ in range(4)) for _ in range(60)]
    rows = [(i, " ".join(rng.choice([w, w.upper(), w.title()]) if w.isascii() else w for w in rng.choices(words, weights=[1 / (1 + k % 40) for k in range(len(words))], k=80)))
            for i in range(n)]
    return rows + [(None, "aaaaa aaaaa×aaaab"), (3, None), (3, ""), (4, "漢字aaaaa漢字 naïve÷words")]


@pytest.mark.parametrize("limit", [20_000, 5])
def test_variants(spark, many_parts, monkeypatch, limit):
    monkeypatch.setattr(spelling, "_PIECE", 50)
    rows = variant_rows(8, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = spelling.variants(df, replace(spelling.SpellingRules(), group_words=limit))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_variants(rows)


def test_variants_edges(spark):
    df = spark.createDataFrame([(1, "alpha alpha alpha", 1)], "doc_id long, text string, word long")
    assert [tuple(r) for r in spelling.variants(df).collect()] == [("alpha", 3, 0, None, None, "alpha")]
    assert spelling.variants(df.where("doc_id > 9")).count() == 0
    assert list(spelling.pieces("")) == [""]


def test_acceptor_is_minimal():
    rng = random.Random(2)
    for _ in range(50):
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(5))) for _ in range(rng.randrange(9))})
        machine = spelling.Acceptor()
        root = machine.add(words)
        assert sorted(machine.words(root)) == words
        rights = {tuple(sorted(machine.words(s))) for s in range(len(machine.arcs))}
        assert len(rights) == len(machine.arcs)


# --- the registered queries -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_mix", "op13_spelling"])
def test_sql_on_awkward_tables(spark, tmp_path, name):
    docs = [(i, t, None if i % 7 == 0 else f"s{i % 4}", "en", 1) for i, t in variant_rows(5, 30) if i is not None]
    for table, rows, columns in (("documents", docs, "doc_id long, text string, source string, lang string, n_chars long"),
                                 ("conversations", conversations(7, 50, 12), COLUMNS)):
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, str(tmp_path))
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(names, cur.fetchall())
