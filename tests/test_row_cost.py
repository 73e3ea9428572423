"""What each row costs in resolution and numbering: no lambda for a comparison, no column computed again in a lambda, one shuffle."""

from pyspark.sql import functions as F

from veilwork.functions.spans import FINDING, run_stages
from veilwork.operators import decide
from veilwork.operators import resolve as R
from veilwork.operators.decide import DECIDED, number_in_row
from veilwork.operators.us_rules import RefLists

COLS = "doc_id long, start int, len int, type_ord int, pii_type string, detector_id string, canonical string, surface string, risk int, conf int, rank int, evidence int, owner_claim boolean"


def _found(*spans, doc=1, detector="kr.phone"):
    return [(doc, a, n, 1, "Phone", detector, v, "x", risk, 3, 1, 1, None) for a, n, v, risk in spans]


def _arrays(spark, rows, text="t"):
    df = spark.createDataFrame(rows, COLS)
    return df.groupBy("doc_id").agg(F.collect_list(F.struct(*df.columns[1:]).cast(FINDING)).alias("c")).withColumn("text", F.lit(text))


def _plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_resolution_in_the_row(spark, capsys):
    rows = _found((0, 5, "a", 2), (3, 4, "b", 3), (9, 2, "c", 1)) + _found((7, 2, "e", 1), (5, 2, "d", 1), doc=2)
    df = run_stages(_arrays(spark, rows), [R.resolve_overlaps_in_row("o", F.col("c"))], ["doc_id"], ["o"])
    assert {r.doc_id: [f.canonical for f in r.o] for r in df.collect()} == {1: ["b", "c"], 2: ["d", "e"]}
    assert "array_sort(" not in _plan(df, capsys)


def test_numbers_in_the_row(spark, capsys):
    df = _arrays(spark, _found((0, 1, "a", 2), (2, 1, "b", 2), (4, 1, "a", 2), (6, 1, "c", 2)))
    decided = F.transform("c", lambda f: F.struct(*[f[c] for c in R.FINDING_COLS], F.lit(False), F.lit("Protect")).cast(DECIDED))
    df = run_stages(df.withColumn("d", decided), [number_in_row("e", "d")], ["doc_id"], ["e"])
    assert [e.token[-2] for e in df.first().e] == ["1", "2", "1", "3"]
    assert "array_sort(" not in _plan(df, capsys)


def test_few_and_many_markers_agree(spark, capsys):
    words = "test " * (R.FEW_MARKERS + 3)
    for text, far in (("." * 60 + "test", 80), ("." * 60 + words, 60 + len(words) + 20)):
        rows = _found((30, 5, "clear", 2), (32, 5, "near", 2), (33, 5, "high", 3), (far, 2, "after", 2), (far + 9, 2, "past", 2))
        df = run_stages(_arrays(spark, rows, text), [R.adjust_context("o", "text", "c")], ["doc_id"], ["o"])
        assert [(f.canonical, f.conf) for f in df.first().o] == [("clear", 3), ("near", 2), ("high", 3), ("after", 2), ("past", 3)]
        assert "array_sort(" not in _plan(df, capsys)


def test_rows_are_dealt_once(spark, capsys):
    rows = _found((0, 5, "a", 2), (0, 5, "a", 2), (3, 4, "b", 3), (9, 2, "c", 1)) + _found((0, 5, "a", 2), doc=2) + _found((0, 5, "a", 1), doc=None)
    df = R.resolve_candidates(spark.createDataFrame(rows, COLS))
    plan = _plan(df, capsys)
    assert sorted((str(r.doc_id), r.canonical) for r in df.collect()) == [("1", "b"), ("1", "c"), ("2", "a"), ("None", "a")]
    assert plan.count("Exchange hashpartitioning") == 1


def test_texts_of_tenants_are_not_dealt_by_tenant(spark, capsys, monkeypatch):
    us, kr = "SSN: 321-54-9876", "연락처 010-1234-5678 SSN: 321-54-9876"
    off = "_us_on boolean, _us_missing array<string>"
    masks = spark.createDataFrame([(1, True, []), (2, False, []), (2, False, []), (3, True, ["us.phone"]), (4, None, None)], f"tenant long, {off}")
    rows = [(i, t, x) for i, (t, x) in enumerate((t, x) for t in (1, 2, 3, 4, 5, None) for x in (us, kr, None))]
    docs = spark.createDataFrame(rows, "doc_id long, tenant long, text string")
    got = []
    for most in (decide.MOST_SENT, 0):
        monkeypatch.setattr(decide, "MOST_SENT", most)
        out = decide.redact_tenants(docs, masks, us=RefLists.stand_in())
        out.explain()
        plan = capsys.readouterr().out
        assert ("_salt" in plan, "SortMergeJoin" in plan) == (most == 0, most == 0)
        # the pack reads the texts of the first tenant only
        assert "_us_text" in plan
        got.append(sorted((r.doc_id, r.redacted or "", r.status) for r in out.collect()))
    assert got[0] == got[1]
    hidden = "연락처 [전화번호1] SSN: 321-54-9876"
    assert [r[1:] for r in got[0][:3]] == [(us, "needs_decision"), (kr, "needs_decision"), ("", "no_findings")]
    plain = [(us, "no_findings"), (hidden, "protected"), ("", "no_findings")]
    assert [r[1:] for r in got[0][3:9]] == [x for x in plain for _ in range(2)]  # its rules came twice
    assert [r[1] for r in got[0][9:11]] == [us, kr] and {r[2] for r in got[0][9:12]} == {"not_scanned"}
    assert [r[1:] for r in got[0][12:]] == plain * 3
