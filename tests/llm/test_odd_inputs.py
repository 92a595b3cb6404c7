"""Null ids, ids with several texts, repeated rows and texts of megabytes, through every query and every stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm import queries

#: Rows of the result of each query that returns one row for each row of the table; op1 finds documents by their ids.
PER_ROW = ("op2_toxic_spans", "op3_katz_backoff", "op4_substring_dedup", "op6_quality_rules", "op8_bpe_roundtrip", "op9_near_duplicates", "op10_license_scan")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(400_000)]
    rows = [
        (None, "some words with a null id", None, None, None),
        (None, None, "en", "s", 0),
        (5, "one id and its first text, of some length", "en", "s", 41),
        (5, "the same id with another text, that is longer than the first", "en", None, 60),
        (6, " ".join(words), "en", "s", None),
        (7, "x1" * 1_000_000, "en", "s", 2_000_000),
        (8, "mit license, " * 40_000 + 'token = "0123456789abcdef0123456789abcdef01234567" ' * 2_000, "en", "s", 1),
        (9, "", "en", "s", 0),
        (9, "", "en", "s", 0),
        (10, "a b c d e\n" * 30_000, "de", "s", 1),
    ]
    at = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({"score": F.lit("x"), "rep": F.lit(1), "_row": F.lit(2), "held_out": F.lit("y")}).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, "some item of the benchmark that nothing holds"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(5, 1, 0), (None, 0, 1), (6, None, None), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_on_odd_tables(spark, folder, name):
    got = queries.QUERIES[name](spark, folder).collect()
    if name in PER_ROW:
        assert sorted(r.doc_id or 0 for r in got) == [0, 0, 5, 5, 6, 7, 8, 9, 9, 10]
    if name == "op1_token_store":
        assert sorted(r.doc_id for r in got) == [5, 5, 6, 7, 8, 9, 9, 10]
    if name == "op5_secret_scan":
        assert sum(r.doc_id == 8 for r in got) == 2000 and all(r.end_char - r.start_char == 40 for r in got if r.doc_id == 8)
    if name == "op10_license_scan":
        assert {r.doc_id: r.n_base for r in got}[8] == 40_000


def test_stages_on_odd_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        assert sorted(r.doc_id or 0 for r in out.select("doc_id").collect()) == [0, 0, 5, 5, 6, 7, 8, 9, 9, 10], name
        assert name == "bpe" or out.columns == docs.columns


def test_stages_with_empty_benchmark_and_labels(spark, folder, tmp_path):
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id = 5 or doc_id is null")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 4
