"""The prefix scan against loops, with one key that holds most rows and the order of microseconds."""

import random

import pytest
from pyspark.sql import functions as F

from veilwork.operators import joins
from veilwork.operators.history import RANGE, carry, in_order


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scan_of_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(None if i % 17 == 0 else "hot" if i % 3 else f"k{i % 5}", i * 1_000_003, rng.choice([None, i])) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(5)
    ordered = in_order(df, ["k"], ["at"])
    assert ordered.where("k = 'hot'").select(RANGE).distinct().count() > 1
    got = carry(ordered, ["k"], ["at"], {
        "s": ("sum", F.col("v")), "l": ("last", F.col("v")), "p": ("previous", F.col("v")), "m": ("max_before", F.col("v"))})
    got = {(r.k, r["at"]): (r.s, r.l, r.p, r.m) for r in got.collect()}
    want, state = {}, {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        s, l, p, m = state.get(k, (0, None, None, None))
        now = (s + (v or 0), l if v is None else v, p, m)
        want[k, at] = now
        state[k] = (now[0], now[1], v, m if v is None else v if m is None else max(m, v))
    assert got == want


def test_scan_without_key_and_empty(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    total = carry(df, [], ["id"], {"s": ("sum", F.col("v"))})
    assert total.columns == ["id", "v", "s"]
    run = 0
    for r in sorted(total.collect()):
        run += r.v
        assert r.s == run
    assert carry(df.where("id < 0"), [], ["id"], {"s": ("sum", F.col("v"))}).count() == 0


def test_asof_ties_and_nulls(spark):
    events = spark.createDataFrame([(1, "a", 5), (2, "a", 4), (3, None, 9), (4, "b", 1)], "e long, k string, ts long")
    changes = spark.createDataFrame([("a", 5, "y"), ("a", 5, "x"), ("a", 1, None), (None, 2, "n"), ("b", 2, "late")], "k string, ts long, s string")
    got = {r.e: r.s for r in joins.asof_source_join(events, changes, "k", "ts", "s").collect()}
    assert got == {1: "y", 2: None, 3: "n", 4: None}


def test_records_of_a_long_cluster(spark):
    """Greedy pairs by first and second field, against the plain loop over 4000 linked fields."""
    rng = random.Random(6)
    at, rows = 0, []
    for _ in range(4000):
        at += rng.randrange(1, 40)
        rows.append((rng.choice("AB"), at))
    pairs = sorted((a, b) for i, (r, a) in enumerate(rows) for s, b in rows[i + 1:i + 60] if r != s and b - a <= 64)
    used, want = set(), []
    for a, b in pairs:
        if not {a, b} & used:
            used |= {a, b}
            want.append((a, b))
    fields = spark.createDataFrame([(1, r, a, a, 0, 0) for r, a in rows], "doc_id long, role string, label_start int, val_start int, val_len int, line int")
    docs = spark.createDataFrame([(1, " " * (at + 1))], "doc_id long, text string")
    got = joins.group_logical_records(fields, docs, "A", "B", distance=64, barrier=False).collect()
    assert sorted((min(r.a_start, r.b_start), max(r.a_start, r.b_start)) for r in got) == want
