"""Texts derived from the given tables, for operators whose input the tables do not contain.

Each text is a SQL expression over a table's keys that both Spark and another SQL engine can
evaluate, so that positions and values of what it contains are known by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shape import spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_over(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*columns)


def pad(expr: str, n: int) -> str:
    return f"lpad(cast({expr} as string), {n}, '0')"


def case(key: str, forms: list[str], default: str | None = None) -> str:
    """CASE over ``key % len(forms)``."""
    body = " ".join(f"when {key} % {len(forms)} = {i} then {f}" for i, f in enumerate(forms))
    return f"case {body} {'else ' + default if default else ''} end"


# Fixed letters for building codes from keys.
LETTERS20 = "ACDEFGHJKMNPQRTUVWXY"


def letter(expr: str) -> str:
    return f"substr('{LETTERS20}', cast(({expr}) % 20 as int) + 1, 1)"


def text_rows(spark: SparkSession, sf_dir: str, name: str, key: str, text: str) -> DataFrame:
    """``(doc_id, text)`` from one SQL expression over a table."""
    rows = spread(table(spark, sf_dir, name))
    return rows.selectExpr(f"cast({key} as bigint) as doc_id", f"{text} as text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")
