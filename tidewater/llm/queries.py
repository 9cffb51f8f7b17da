"""The queries of the corpus operators: each takes (spark, sf_dir) and applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, minhash, mixing, packing, pii, quality, simhash, suffixes, topk, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = quality.held_out("doc_id", 3, 1)
    model = language.train(docs.where(~held & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), "text", "lang"))
    return language.identify(docs, model, spans=False).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = quality.held_out("doc_id", 4, 2)
    forest = quality.train(docs, _table(spark, sf_dir, "labels").where(~held))
    return quality.score(docs, forest).select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_language": op2_language,
    "op3_topk": op3_topk,
    "op4_packing": op4_packing,
    "op5_urls": op5_urls,
    "op6_suffixes": op6_suffixes,
    "op7_mixing": op7_mixing,
    "op8_minhash": op8_minhash,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
}

ORACLE: dict[str, str] = {
    "op3_topk": topk.TOP_K_SQL,
}
