"""Fields are bound with one look at the text's capitals and one evaluation of each label."""

from pyspark.sql import functions as F

from veilwork.functions import dims
from veilwork.operators import fields, joins


def test_capitals_and_labels_are_made_once(spark, capsys):
    docs = spark.createDataFrame([(1, "SSN: 1 | Email: e"), (2, "none"), (3, None)], "doc_id long, text string")
    bound = docs.select("doc_id", fields.bind_fields("text", dims.ALL_LABELS).alias("f"))
    bound.explain()
    assert capsys.readouterr().out.count("upper(") <= 8
    rows = {r.doc_id: [(f.label, f.role) for f in r.f] for r in bound.collect()}
    assert rows == {1: [("SSN", "us.ssn"), ("Email", "email")], 2: [], 3: []}


def test_lookup_of_unknown_and_null_keys(spark):
    df = spark.createDataFrame([("a",), ("x",), (None,)], "k string")
    assert [r[0] for r in df.select(dims.lookup({"a": 1, "b": None}, F.col("k"), "int")).collect()] == [1, None, None]


def test_texts_of_grouped_fields_are_never_broadcast(spark, capsys):
    docs = spark.createDataFrame([(1, "Routing Number: 1 | Account Number: 2")], "doc_id long, text string")
    for barrier in (True, False):
        out = joins.group_logical_records(fields.field_rows(docs, dims.ALL_LABELS), docs, "bank.routing", "bank.generic", barrier=barrier)
        out.explain()
        assert "Broadcast" not in capsys.readouterr().out


def test_fields_read_from_small_files_never_meet_in_a_broadcast(spark, capsys, tmp_path):
    a, b = "Routing Number: 1", "Account Number: 2"
    texts = [(1, f"{a} | {b}"), (2, f"{a}\nEmail: e | {b}"), (2, f"{a}\nEmail: e | {b}"), (3, f"{a} | Email: e | {b}"), (4, f"{a}\n{a} ; {b}\n{b}"),
             (5, f"{a} | {b}"), (5, f"{a} or {b}"), (6, f"{a}{' ' * 200}\n{b}"), (7, None), (None, f"{a} | {b}")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    out = joins.group_logical_records(fields.field_rows(docs, dims.ALL_LABELS), docs, "bank.routing", "bank.generic", barrier=False)
    out.explain()
    assert "Broadcast" not in capsys.readouterr().out
    got = sorted((r.doc_id, r.a_start, r.b_start, r.first_line, r.last_line) for r in out.collect())
    # of two texts of one key a pair is taken once; one text without anything else between the labels is enough
    assert got == [(1, 0, 20, 0, 0), (2, 0, 29, 0, 1), (4, 0, 38, 0, 1), (4, 18, 56, 1, 2), (5, 0, 20, 0, 0)]
