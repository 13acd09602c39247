import json

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import evaluation as ev


def test_kinds_and_ranks(spark):
    d = spark.createDataFrame([("xbrl-1", None, None, 0.5), ("a", "XBRL", None, 0.0), ("b", None, "Mechanical", 0.3333), ("c", "team", "hard", None)], "q string, s string, d string, r double")
    got = d.select(ev.benchmark_kind(F.col("q"), F.col("s"), F.col("d")).alias("k"), ev.rank_from_reciprocal(F.col("r")).alias("n")).collect()
    assert [(r.k, r.n) for r in got] == [("mechanical", 2), ("mechanical", None), ("mechanical", 3), ("handwritten", None)]


def test_generated_questions(spark):
    kind = "accession string, ticker string, fiscal_year int, label string, concept string, unit string, raw_value string, value double, is_current_year boolean"
    facts = spark.createDataFrame(
        [("f1", "abc", 2021, " Net  sales. ", "Rev", "USD", "1,234,000", 1234000.0, True), ("f1", "abc", 2021, None, "Cost", "USD", "77", 77.0, True), ("f1", "abc", 2020, "Net sales", "Rev", "USD", "5,000", 5000.0, False),
         (None, "abc", 2021, "x", "x", "USD", "5,000", 5000.0, True), ("f2", "abc", 2021, "x", "x", "USD", None, None, True)], kind,
    )
    pages = spark.createDataFrame([(3, "f1", "sales 1,234 thousand"), (1, "f1", "in all 1,234,000"), (2, "f1", "none"), (4, "f2", "1,234"), (5, "f1", None)], "chunk_id long, accession string, text string")
    got = ev.generated_questions(facts, pages).collect()
    assert [(r.question_id, r.question, r.expected_answer, r.supporting, r.repeated) for r in got] == [("xbrl-abc-2021-net-sales-usd-f1", "What was Net sales for ABC in FY2021?", "1,234,000 USD", [1, 3], False)]
    assert ev.generated_questions(facts.limit(0), pages).count() == 0


def test_expected_answers(spark):
    d = spark.createDataFrame([("12 ", 1.0, " USD"), ("", 2.5, None), (None, float("nan"), "USD"), (None, None, None)], "r string, v double, u string")
    assert [r.a for r in d.select(ev.expected_answer(F.col("r"), F.col("v"), F.col("u")).alias("a")).collect()] == ["12 USD", "2.5", "unknown", "unknown"]


def test_supporting_passages_prefer_tables(spark, rows):
    f = spark.createDataFrame([(1, "f1", 1234000.0), (2, "f1", 5.0)], "qid long, accession string, exact double").withColumn("exact", F.col("exact").cast("decimal(38,10)"))
    h = spark.createDataFrame([(1, 10, 1, "f1", "prose", "it was 1,234,000"), (1, 11, 2, "f1", "table", "| 1,234 |"), (1, 12, 3, "f2", "table", "1,234"), (2, 10, 1, "f1", "prose", "none")], "qid long, chunk_id long, rank long, accession string, content_type string, text string")
    assert rows(ev.supporting_passage(f, h)) == [(1, 11)]


def test_saved_metrics_leave_out_what_is_no_score(spark, rows):
    d = spark.createDataFrame([("t", 1.0, 1.0, 1.0), ("t", 0.5, 0.5, 0.25), ("t", 2.0, 0.5, 0.5), ("t", None, 0.0, 0.0), ("t", float("nan"), 1.0, 1.0)], "k string, recall double, ndcg double, mrr double")
    r = ev.saved_metrics(d, ["k"]).first()
    assert (r.n, r.recall_mean, r.recall_scored, r.ndcg_scored, r.mrr_scored, r.median_rank) == (5, 0.75, 2, 3, 3, 4.0)


def test_breakdown_and_record(spark, rows):
    d = spark.createDataFrame([("c", "a", "x", 1.0), ("c", "b", "x", 0.0), ("c", "a", "x", None), ("c", None, "x", 1.0), ("c", "b", "x", float("inf"))], "config string, g string, h string, m double")
    got = rows(ev.breakdown(d, ["config"], ["g", "h"], ["m"]))
    assert got == [("c", "m", "g", "a", 2, 1, 1.0), ("c", "m", "g", "b", 2, 1, 0.0)]
    assert rows(ev.track_record(d, ["config"], "g", "m", 1)) == [("c", "a", 2, 1, 1.0), ("c", "b", 2, 1, 0.0)] and ev.track_record(d, ["config"], "g", "m", 2).count() == 0


@pytest.mark.parametrize(("a", "b", "want"), [(0.96, None, "9 in 10"), (1.0, None, "10 in 10"), (0.04, None, "fewer than 1 in 10"), (0.84, 0.81, "84%"), (0.84, 0.5, "8 in 10")])
def test_wording(spark, a, b, want):
    d = spark.createDataFrame([(a, b)], "a double, b double")
    assert d.select(ev.worded(F.col("a"), None if b is None else F.col("b")).alias("w")).first().w == want


def test_incomplete_runs(spark, rows):
    runs = spark.createDataFrame([("a", 3, None, False), ("b", 1, None, False), ("c", 5, "q7", True), ("d", 5, None, False)], "run string, expected int, stopped_at string, stopped boolean")
    data = spark.createDataFrame([("a",), ("a",), ("b",)], "run string")
    assert rows(ev.incomplete(runs, data)) == [("a", "2 of 3 question rows could be read"), ("c", "stopped at q7")]


def test_rankings_come_back(spark, rows):
    p = spark.createDataFrame([("x", "tx"), ("y", "ty")], "chunk_id string, text string")
    r = spark.createDataFrame([(1, ["x", "y"]), (2, ["x", "x", "z"])], "qid long, chunk_ids array<string>")
    got = ev.restored(r, p).select("qid", "chunk_id", "rank", "text", "problem")
    assert [tuple(x) for x in got.where("qid = 1").orderBy("rank").collect()] == [(1, "x", 1, "tx", None), (1, "y", 2, "ty", None)]
    assert {x.problem for x in got.where("qid = 2").collect()} == {"given twice", "no such passage"}
    q = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "qid long, text string, k int")
    kept = spark.createDataFrame([("a", None, "x", 1), ("b", 6, "y", 1)], "text string, k int, chunk_id string, rank int")
    same, missing = ev.replayed(q, kept, ["text", "k"])
    assert rows(same) == [(1, "x", 1)] and [r.qid for r in missing.collect()] == [2]


def test_records_and_rows(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "b", 3)], "id long, t string, n int")
    one, other = ev.records_sha256(d, "id").first(), ev.records_sha256(d.orderBy(F.desc("id")), "id").first()
    assert one == other and one.n == 2 and one != ev.records_sha256(d.withColumn("t", F.lit("a")), "id").first()
    assert json.loads(ev.answer_records(d, "id").where("id = 2").first().record) == {"n": 3, "t": "b"}
    r = spark.createDataFrame([(["a", "c"], ["a", "b", "c"]), (["c", "a"], ["a", "b", "c"]), ([], ["a"]), (["a", "a"], ["a"])], "r array<string>, s array<string>")
    assert [x.v for x in r.select(ev.row_in(F.col("r"), F.col("s")).alias("v")).collect()] == [True, False, True, False]
    assert d.select(ev.markdown_table(["id", "n"]).alias("m")).first().m == "| 1 | — |"
    assert spark.createDataFrame([("0000000001-20-000001_7_0",), ("x",)], "c string").select(ev.filing_of(F.col("c")).alias("f")).collect()[0].f == "0000000001-20-000001"


def test_gold_scope_overrides(spark):
    p = spark.createDataFrame([(1, ["A"], [2020]), (2, ["A"], [2020])], "qid long, tickers array<string>, years array<int>")
    g = spark.createDataFrame([(1, "b", None)], "qid long, ticker string, fiscal_year int")
    got = {r.qid: (r.tickers, r.years) for r in ev.benchmark_queries(p, g).collect()}
    assert got == {1: (["B"], [2020]), 2: (["A"], [2020])}
