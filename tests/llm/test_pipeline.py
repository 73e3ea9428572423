"""The pipeline against stages applied one by one with brute force on the smallest tables, and the registry."""

import hashlib
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tools.compare import canon
from veilwork.llm import piece_codec, queries, secrets
from veilwork.plans.texts import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, con, name):
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, SF)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(names, cur.fetchall())


def test_pipeline(spark, con):
    """Each filtering stage is checked by the SQL of its operator on that stage's own input."""
    columns = "doc_id, text, lang, source, n_chars"
    con.execute(f"create or replace temp table step as select {columns} from documents")

    def apply(sql, where):
        con.execute(f"create or replace temp table verdict as {sql.replace('from documents', 'from step')}")
        con.execute(f"create or replace temp table step as select {columns} from step join verdict using (doc_id) where {where}")

    apply(queries.SQL["op8_quality"], "kept")
    # a stage on shingles takes 0.8 or more; the 85 is the contract of the thin query
    apply(queries.SQL["op10_near_dedup"].replace(">= 85 *", ">= 80 *"), "kept")
    apply(queries.SQL["op1_decontaminate"], "not contaminated")
    it = piece_codec.pieces(piece_codec.PieceRules().model, "rank")
    want = {}
    for d, t in con.execute("select doc_id, text from step").fetchall():
        clean = secrets.redact(t, secrets.scan(t, secrets.SecretRules())[1], "[secret]")
        want[d] = (it.encode(clean) if len(clean) <= 1 << 15 else None)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    assert all(list(got[d].ids) == w for d, w in want.items() if w is not None)
    assert all(r.round_trip for r in got.values())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == corpus_pipeline.COLUMNS


def test_near_copies_of_four_fifths_go(spark):
    words = [f"w{i}" for i in range(204)]
    near = words[:20] + ["x"] + words[21:60] + ["y"] + words[61:100] + ["z"] + words[101:140] + ["v"] + words[141:]  # 180 of 220 shingles
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate([words, near])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()] == [0]


# --- the registered queries that SQL cannot express, over the whole smallest tables ---------------------------------------


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("select doc_id, coalesce(text, '') from documents").fetchall())


def run_query(spark, name):
    return {r[0]: r for r in queries.QUERIES[name](spark, SF).collect()}


def test_op3_as_registered(spark, texts):
    """Against all passages of 50 words that an earlier document has as well."""
    spans = {}
    for r in queries.QUERIES["op3_chunk_dedup"](spark, SF).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
        passage = texts[r.doc_id][r.start:r.end]
        others = [texts[d] for d in r.first_ids]
        pieces = [passage[k:k + 12] for k in range(0, len(passage) - 12, 12)]
        # each chunk of a passage stands in a document named; pieces across two chunks of different ones may not
        assert len(set(passage.split())) < 10 or sum(any(x in t for t in others) for x in pieces) >= 0.5 * len(pieces)
    seen, repeated, caught = {}, 0, 0
    for d in sorted(texts):
        words = [m.span() for m in re.finditer(r"[^ \t\n\v\f\r]+", texts[d])]
        for i in range(len(words) - 49):
            a, b = words[i][0], words[i + 49][1]
            window = texts[d][a:b]
            if seen.setdefault(window, d) != d:
                repeated += 1
                caught += any(s <= (a + b) // 2 < e for s, e in spans.get(d, []))
    assert repeated > 100 and caught >= 0.97 * repeated


def test_op4_as_registered(spark, con):
    got = queries.QUERIES["op4_chat"](spark, SF)
    turns = con.execute("select conv_id, turn from conversations").fetchall()
    rows = got.collect()
    assert sorted((r.conv_id, r.turn) for r in rows) == sorted(turns)
    shown = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        shown[r.conv_id] = shown.get(r.conv_id, "") + r.fragment
    legal = re.compile(r"(<\|system\|>)?(<\|user\|><\|assistant\|>)+")
    assert all(legal.fullmatch("".join(re.findall(r"<\|(?:system|user|assistant)\|>", x))) for x in shown.values())


def test_op5_as_registered(spark, texts):
    it = piece_codec.pieces(piece_codec.PieceRules().model, "rank")
    got = run_query(spark, "op5_pieces")
    assert set(got) == set(texts)
    for d, r in got.items():
        assert r.round_trip and it.decode(r.ids) == texts[d].replace("▁", " ")
        assert r.n_chunks > 1 or list(r.ids) == it.encode(texts[d])


def test_op6_as_registered(spark, texts):
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
             ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)]
    got = run_query(spark, "op6_secrets")
    assert set(got) == set(texts)
    for d, r in got.items():
        spans = sorted((m.start(), i, m.end()) for i, (_, p, ok) in enumerate(kinds) for m in p.finditer(texts[d]) if ok(m))
        base = [f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(","))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]


def test_op7_as_registered(spark, texts):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got, start = run_query(spark, "op7_token_store"), 0
    assert set(got) == set(texts)
    for d in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[d], add_special_tokens=False).ids, 0], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op9_as_registered(spark, texts):
    def luhn(n):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(n))) % 10 == 0

    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 14 <= len(digits(x)) <= 19 and luhn(digits(x))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 10 <= len(digits(x)) <= 15)]
    got = run_query(spark, "op9_sanitize")
    assert set(got) == set(texts)
    for d, r in got.items():
        spans = sorted((m.start(), i, m.end()) for i, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, texts[d]) if ok(m[0]))
        base = [f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]


def test_stages_on_awkward_rows(spark):
    """Nulls in any column, empty and repeated rows, an empty table."""
    words = " ".join(f"word{i} of the text" for i in range(40))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, words, "en", "a", len(words)), (3, words, "en", "a", len(words)), (None, words + " more", None, None, 9),
            (4, " \n\t ", "de", None, 4), (5, "漢字 " * 30, None, "b", 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, start, SF)
            assert out.columns == corpus_pipeline.COLUMNS and out.count() <= start.count()
        assert corpus_pipeline.STAGES[-1][1](spark, start, SF).count() == start.count()
