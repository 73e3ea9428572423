"""Texts that repeat one thing very often: no pattern may recurse or go quadratic on them."""

import pytest
from pyspark.sql import functions as F

from veilwork.operators.base_rules import email
from veilwork.plans import flagship

TEXTS = {
    "digits": "7" * 200_000, "spaced digits": "12 34 " * 50_000, "dotted host": "a@b" + ".c" * 100_000, "long name": "x" * 500_000 + "@example.com",
    "long host": "a@" + "b-" * 200_000, "spelled dots": "a@" + "b (dot) " * 50_000 + "com", "at signs": "@" * 100_000,
    "spelled ats": "user (at) " * 20_000, "blanks": "a (at)" + " " * 200_000 + "b.com", "brackets": "(" * 50_000 + "at)", "dots": "a." * 100_000 + "b@c.com",
}


def test_scan_of_long_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS.values())], "doc_id long, text string").repartition(4)
    found = flagship.scan_findings(df).where("pii_type = 'Email'").groupBy("doc_id").count().collect()
    names = list(TEXTS)
    assert {names[r.doc_id]: r["count"] for r in found} == {"long name": 1, "spelled dots": 1, "blanks": 1, "dots": 1}


def test_many_addresses(spark):
    df = spark.createDataFrame([("a@b.com, " * 20_000,)], "t string").withColumn("e", email("t"))
    assert df.select(F.size("e").alias("n"), F.element_at("e", -1)["start"].alias("last")).first() == (20_000, 9 * 19_999)


@pytest.mark.parametrize("text, want", [
    ("x a@b.com y", [(2, "a@b.com", 3)]), ("..a@b.com a.@b.com a..b@c.com", []), ("a@b.com@c.com", []), ("a@b.com9 a@b.com- a@-b.com a@b-.com", []),
    ("a@b.c.com.d", [(0, "a@b.c.com", 3)]), ("a [ AT ] b (dot) com", [(0, "a@b.com", 2)]), ("a@b.com (dot) kr", [(0, "a@b.com", 3), (0, "a@b.com.kr", 2)]),
    ("(a@b.com)", [(1, "a@b.com", 3)]), ("a (at) b . com", [(0, "a@b.com", 2)]), ("\U0001f600A+b_c@B.Com", [(1, "a+b_c@b.com", 3)]), ("", []), (None, []),
])
def test_addresses(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").withColumn("e", email("t"))
    assert [(x.start, x.canonical, x.conf) for x in df.first().e or []] == want
