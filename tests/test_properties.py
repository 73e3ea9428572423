"""Properties that hold on any text, on seeded random fragments and on one very dense text."""

import random
import re

from pyspark.sql import functions as F

from veilwork.functions.spans import find_all, rewrite, running_max, running_sum
from veilwork.operators import resolve as R
from veilwork.operators.base_rules import explode_findings, scan_arrays
from veilwork.operators.decide import Policy, assign_aliases, decide_rows, redact_corpus, redact_rows, scan_resolved
from veilwork.operators.fields import field_pattern, label_pattern
from veilwork.operators.us_rules import RefLists
from veilwork.functions import dims
from veilwork.plans import flagship

PIECES = [
    "010-1234-5678", "user@example.com", "900101-1234568", "4111-1111-1111-1111", "계좌 110-123-456789", "10.0.0.1",
    "00:1A:2B:3C:4D:5E", "37.5665,126.9780", "lat=1.5 lon=2.5", "api_key=sk_live_abcdef123456", "test", "샘플", "SSN: 321-54-9876",
    "Phone: 212-555-1212", "State: NY", "P12345678", "Bank Account: AB12CD34", "Routing Number: 120000003", "\n", "１２３",
    "​", "\U0001F600", "가나", "abc", "12", "--", "MBI: 1A23C45DE67", "Mr. John Smith,", "12 Oak St, Reno, NV 89501",
]


def fragments(n, seed=7):
    rnd = random.Random(seed)
    return [rnd.choice([" ", "", ", ", "; "]).join(rnd.choices(PIECES, k=rnd.randint(0, 12))) for _ in range(n)]


def test_spans_are_inside_and_winners_do_not_overlap(docs):
    texts = fragments(300)
    for df in (scan_resolved(docs(texts)), flagship.scan_resolved_us(docs(texts), RefLists.stand_in())):
        for r in df.collect():
            at = 0
            for f in r.findings:
                assert texts[r.doc_id][f.start:f.start + f.len] == f.surface
                assert f.start >= at and f.len > 0
                at = f.start + f.len


def test_row_form_equals_column_form(docs):
    df = docs(fragments(200, 11))
    cand = explode_findings(scan_arrays(df), "candidates", "doc_id")
    cols = ["doc_id", "start", "len", "detector_id", "canonical"]
    by_rows = R.resolve_overlaps(cand).select(*cols)
    by_columns = explode_findings(scan_resolved(df), "findings", "doc_id").select(*cols)
    assert by_rows.exceptAll(by_columns).count() == 0 and by_columns.exceptAll(by_rows).count() == 0
    us = flagship.us_candidate_rows(df, RefLists.stand_in())
    rows = R.resolve_candidates(us).select(*cols)
    columns = flagship.scan_findings_us(df, RefLists.stand_in()).select(*cols)
    assert rows.exceptAll(columns).count() == 0 and columns.exceptAll(rows).count() == 0


def test_joined_policy_equals_inlined_policy(spark, docs):
    df = docs(fragments(200, 13))
    few = spark.createDataFrame([("Phone", "01012345678"), ("Email", "x@y.z")], "pii_type string, value string")
    many = few.unionByName(spark.range(1200).selectExpr("'Phone' as pii_type", "cast(id as string) as value"))
    cols = ["doc_id", "redacted", "status", "n_protect"]
    a = redact_corpus(df, Policy(trusted=few)).select(*cols)
    b = redact_corpus(df, Policy(trusted=many)).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_numbers_have_no_gaps_and_nothing_protected_is_left(docs):
    df = docs(fragments(200, 17))
    rows = assign_aliases(decide_rows(flagship.scan_findings(df), Policy()))
    per = rows.where("alias_no is not null").groupBy("doc_id", "pii_type").agg(
        F.max("alias_no").alias("m"), F.count_distinct("alias_no").alias("n"), F.count_distinct("canonical").alias("v"))
    assert per.where("m <> n or n <> v").count() == 0
    out = redact_rows(df, rows, ["doc_id"]).where("n_protect > 0 and n_pending = 0")
    left = out.join(rows.where("disposition = 'Protect'").select("doc_id", "surface"), "doc_id")
    assert left.where(~F.col("redacted").contains("[")).count() == 0


def test_a_dense_text_goes_through_the_block_paths(docs):
    text = " ".join(f"u{i % 500}@ex{i % 7}.com" for i in range(3000)) + " end"
    numbers, want = {}, []
    for word in text.split(" "):
        want.append(word if word == "end" else f"[이메일{numbers.setdefault(word, len(numbers) + 1)}]")
    assert redact_corpus(docs([text])).first().redacted == " ".join(want)


def test_prefix_scans_against_python(spark):
    rnd = random.Random(3)
    arrays = [[rnd.randint(0, 50) for _ in range(n)] for n in (0, 1, 127, 128, 129, 300, 1000)]
    df = spark.createDataFrame([(a,) for a in arrays], "a array<int>").select(
        "a", running_sum(F.col("a")).alias("s"), running_max(F.col("a")).alias("m"))
    for r in df.collect():
        assert r.s == [sum(r.a[:i]) for i in range(len(r.a))]
        assert r.m == [max([-1] + r.a[:i]) for i in range(len(r.a))]


def test_find_all_against_python(docs):
    texts = fragments(100, 5)
    got = docs(texts).select("doc_id", find_all("text", "([0-9]+)[-.]", (1,), 4, 2).alias("m")).collect()
    for r in got:
        want = list(re.finditer("([0-9]+)[-.]", texts[r.doc_id]))
        assert [(m.start, m.text, m.groups) for m in r.m] == [(w.start(), w.group(), [w.group(1)]) for w in want]


def test_rewrite_against_python(spark):
    text = "0123456789" * 80
    edits = [(i * 2, 1, f"<{i}>") for i in range(300)]
    row = spark.createDataFrame([(text, edits)], "t string, e array<struct<start:int,len:int,token:string>>")
    want = "".join(f"<{i}>" + text[i * 2 + 1] for i in range(300)) + text[600:]
    assert row.select(rewrite(F.col("t"), F.col("e"))).first()[0] == want


def test_label_pattern_takes_the_longest_label():
    p = re.compile(label_pattern(dims.ALL_LABELS), re.I)
    for label in dims.ALL_LABELS:
        assert p.match(label).group() == label
    assert "Passport" in field_pattern(["Passport"])
