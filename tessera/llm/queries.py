"""The registered queries of the operators: thin projections over each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, katz, licenses, neardup, quality, secret_scan, shared, substring, token_store, toxicity
from tessera.llm.oracle import ORACLE_SQL

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a token store of all documents, looks every key up in its index and reads the payload back."""
    docs = documents(spark, sf_dir)
    store = token_store.write_store(docs, WORD_BPE, shared.new_dir(spark, "tokens"), end_id=2)
    entries = token_store.lookup(docs, store)
    return token_store.read_docs(entries, store).withColumnRenamed("key", "doc_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir), BYTE_BPE)


def op2_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    crf = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, crf).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op3_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir)).drop("removed")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.findings(documents(spark, sf_dir), secret_scan.train(spark))
    return found.select("doc_id", "start_char", "end_char", F.sha2("secret", 256).alias("secret_sha256"), "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_toxic_spans": op2_toxic_spans,
    "op3_katz_backoff": op3_katz_backoff,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_rules": op6_quality_rules,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_license_scan": op10_license_scan,
    "op7_decontamination": op7_decontamination,
    "op8_bpe_roundtrip": op8_bpe_roundtrip,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
