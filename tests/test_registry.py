"""The registry is consistent and a few queries agree with their comparison SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import canon
from veilwork.plans.texts import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = ["scan_kr_phone", "split_lines", "line_jurisdiction", "group_logical_records", "decide", "assign_aliases",
          "asof_source_join", "changed_revisions", "status_stream", "redact_conversations"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    df = entry.queries()[name](spark, SF)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(names, cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "start", "len", "canonical", "risk", "pii_type", "conf"]
