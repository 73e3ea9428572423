"""The registered queries of this subpackage: each operator over its whole table, and comparison SQL where it can be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_repair, chunk_dedup, fm_index, mixing, near_dedup, piece_codec, prefix_trie, quality, sanitize, secrets, spelling, token_store,
    warc,
)
from .common import shared_path
from .oracles import SQL  # noqa: F401  re-exported for the registry


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fm_index.verdicts(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), "contaminated",
        F.concat_ws(",", F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"]))).alias("removal"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_dedup.repeated_passages(docs).withColumnRenamed("id", "doc_id")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_codec.encode(docs).withColumnRenamed("id", "doc_id")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan_secrets(docs, keep=["doc_id"])


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = shared_path(spark, "tokens")
    token_store.write_tokens(docs, path)
    return token_store.read_tokens(spark, path, with_ids=False).withColumnRenamed("id", "doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    scored = quality.score(docs, keep=["doc_id"])
    # distances are sums of many terms; their last digits depend on the order of summing
    return scored.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op9_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sanitize.report(docs).withColumnRenamed("id", "doc_id")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs).withColumnRenamed("id", "doc_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).drop("finish").withColumnRenamed("id", "doc_id")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_warc, op3_chunk_dedup, op4_chat, op5_pieces, op6_secrets, op7_token_store, op8_quality, op9_sanitize,
    op10_near_dedup, op11_prefix_trie, op12_mix, op13_spelling)}
