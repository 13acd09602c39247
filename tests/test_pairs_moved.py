"""Searches shuffle a few passages of each question, never a row per question and passage."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarrystone import storage
from quarrystone.operators import metrics

N_DOCS, N_ASKED = 6000, 80


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Every passage holds words of every question, and belongs to its company and to one of its years."""
    d = str(tmp_path_factory.mktemp("hot"))
    rare = F.when(F.col("id") % 3 == 0, "margin").when(F.col("id") % 3 == 1, "backlog").otherwise("dividend")
    docs = spark.range(N_DOCS).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("what was the"), rare, F.col("id") % 7).alias("text"), F.lit("aaa").alias("ticker"),
        (2020 + F.col("id") % 2).cast("int").alias("fiscal_year"), F.lit("7").alias("item"), F.lit("prose").alias("content_type"),
    )
    docs.write.parquet(f"{d}/documents.parquet")
    asked = spark.range(N_ASKED).select(
        (F.col("id") * 50).alias("question_id"), F.lit("What was the margin and the backlog and the dividend?").alias("question"), F.lit("AAA").alias("ticker"),
        F.lit(2021).alias("fiscal_year"), F.when(F.col("id") % 2 == 0, "Item 7 - Discussion").alias("item"), F.lit(False).alias("paraphrase"), F.lit("xbrl").alias("source"),
    )
    asked.write.parquet(f"{d}/test_questions.parquet")
    return d


def moved(spark) -> int:
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


#: Bytes shuffled at most; a row of six bytes for each question and passage would be 2.9 MB.
MOST = {
    "decomposed_topk": 1_000_000,
    "evidence_by_part": 1_000_000,
    "rrf_fusion": 1_000_000,
    "round_robin_merge": 1_000_000,
    "rerank_pool": 1_000_000,
    "retrieval_metrics": 1_000_000,
    "metric_means": 1_000_000,
    "saved_benchmark_metrics": 1_000_000,
    "contingency_2x2": 1_000_000,
    "paired_comparison": 1_000_000,
    "comparison_overlap": 1_000_000,
    "ranking_prefixes": 1_000_000,
}


@pytest.mark.parametrize("name", MOST)
def test_pairs_are_not_moved(spark, folder, name):
    storage.drop_written(spark)
    before = moved(spark)
    entry.queries()[name](spark, folder).collect()
    assert moved(spark) - before < MOST[name]


def test_relevance_by_a_column_equals_listed_pairs(spark, rows):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (3, 12, 1), (5, 10, 3)], "qid long, chunk_id long, rank long")
    q = spark.createDataFrame([(1, "A"), (2, "B"), (3, None), (4, "A"), (5, "A")], "qid long, ticker string")
    p = spark.createDataFrame([(10, "A"), (10, "A"), (11, "B"), (12, None), (13, "A"), (None, "A")], "chunk_id long, ticker string")
    listed = metrics.question_metrics(hits, q.join(p, "ticker"), 2)
    assert rows(metrics.question_metrics_by(hits, q, p, "ticker", 2)) == rows(listed)
