"""The queries of this package by name, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import (
    decontamination, divergence, embedding_join, language_id, license_scan, ngram_join, packing, quality, secret_scan, sql,
    token_counts, url_rules, vector_codes, warc,
)

TOKENIZER = "byte_bpe_50k.json"


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.scan(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(_read(spark, folder, "documents")).drop("row")


def op3_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_join.join(_read(spark, folder, "embeddings"))


#: Host, path and verdict of the rules that op4 applies.
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return url_rules.judge(_read(spark, folder, "pages"), rules)


def op5_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(_read(spark, folder, "documents"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_read(spark, folder, "pages"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count(_read(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    found = language_id.predict(docs, language_id.learn(docs), keep=("doc_id",)).select("kept.doc_id", "lang_pred", "score")
    held = language_id.held_out("doc_id", language_id.FOLDS, language_id.HELD_OUT)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_read(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def op11_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(_read(spark, folder, "documents"))


def op12_vector_code_compression(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(_read(spark, folder, "embeddings"))


def op13_source_divergence_audit(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(_read(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(sql.QUERIES)
