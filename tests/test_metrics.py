import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.operators import metrics
from quarrystone.operators.components import connected_components
from quarrystone.operators.ranking import numbered_within


def test_question_metrics_by_hand(spark):
    hits = spark.createDataFrame([(1, c, r) for r, c in enumerate("xyz", 1)] + [(2, "a", 1), (2, "a", 1)], "qid long, chunk_id string, rank long")
    rel = spark.createDataFrame([(1, "z"), (1, "z"), (3, "q"), (4, "a"), (4, "b")], "qid long, chunk_id string")
    neg = spark.createDataFrame([(1, "x"), (1, "w")], "qid long, chunk_id string")
    got = {r.qid: r for r in metrics.question_metrics(hits, rel, 3, neg).collect()}
    assert (got[1].recall, got[1].ndcg, got[1].mrr, got[1].first_rank, got[1].hard_negative_accuracy) == (1.0, 0.5, round(1 / 3, 6), 3, 0.5)
    assert got[2].recall is None and got[2].ndcg is None and got[2].mrr is None
    assert (got[3].recall, got[3].ndcg, got[3].mrr, got[3].first_rank) == (0.0, 0.0, 0.0, None)
    m = metrics.means(metrics.question_metrics(hits, rel, 3), ["recall", "mrr"]).first()
    assert (m.n, m.recall_scored, m.recall_mean) == (4, 3, round(1 / 3, 6))


def test_means_of_nothing(spark):
    empty = spark.createDataFrame([], "qid long, recall double")
    r = metrics.means(empty, ["recall"]).first()
    assert r.n == 0 and r.recall_mean is None and r.recall_scored == 0


def test_median_and_nearest_rank(spark):
    d = spark.createDataFrame([("a", 1), ("a", 3), ("a", None), ("b", None), ("c", 2), ("c", 4)], "g string, first_rank long")
    got = {r.g: r.median_rank for r in metrics.median_rank(d, ["g"]).collect()}
    assert got == {"a": 3.0, "b": None, "c": 3.0}
    n = spark.range(1, 5).agg(metrics.nearest_rank("id", 0.95).alias("x"), metrics.nearest_rank("id", 0.5).alias("y")).first()
    assert (n.x, n.y) == (4, 2)


def test_paired_and_contingency(spark):
    l = spark.createDataFrame([(1, 1.0, 1, 1), (2, 0.5, 0, 2), (3, None, 0, 0), (4, 0.2, 0, 1)], "qid long, m double, found long, n_relevant long")
    r = spark.createDataFrame([(1, 0.5, 0, 1), (2, 0.5, 0, 2), (3, 1.0, 0, 0), (4, 0.4, 1, 1)], "qid long, m double, found long, n_relevant long")
    p = metrics.paired(l, r, "m").first()
    assert (p.n, p.wins, p.losses, p.ties) == (3, 1, 1, 1) and p.difference == pytest.approx(0.1)
    assert tuple(metrics.contingency(l, r).first()) == (0, 1, 1, 1)


def test_grouped_means_and_worst(spark, rows):
    d = spark.createDataFrame([("a", "x", 1.0), ("a", None, 3.0), ("b", "x", None)], "g string, h string, v double")
    got = {(r.g, r.h): (r.n, r.v_mean, r.v_scored) for r in metrics.grouped_means(d, ["v"], [["g", "h"], ["g"], []]).collect()}
    assert got[("all", "all")] == (3, 2.0, 2) and got[("b", "all")] == (1, None, 0) and got[("a", "none")] == (1, 3.0, 1)
    checks = spark.createDataFrame([(1, 0, "5", "unverified"), (1, 0, "5", "supported"), (1, 1, "6", "unverified"), (2, 0, "7", "mismatch"), (2, 0, "7", "supported"), (3, 0, "8", "odd")], "answer_id long, sentence int, figure string, status string")
    assert rows(metrics.worst_check(checks)) == [(1, "unverified", 3), (2, "mismatch", 2), (3, "unchecked", 1)]


def test_bootstrap_repeats(spark):
    d = spark.createDataFrame([(i % 5, float(i % 3)) for i in range(40)] + [(9, None)], "c long, v double")
    a, b = (metrics.bootstrap_interval(d, "c", "v", draws=200).first() for _ in range(2))
    assert a == b and a.n_clusters == 5 and a.n == 40 and a.low <= a["mean"] <= a.high


def test_even_sample_keeps_both_ends(spark, rows):
    d = spark.range(10)
    assert [r.id for r in metrics.even_sample(d, "id", 4).orderBy("id").collect()] == [0, 3, 6, 9]
    assert [r.id for r in metrics.even_sample(d, "id", 1).collect()] == [5]
    assert metrics.even_sample(d, "id", 20).count() == 10


def test_even_sample_of_many_with_ties(spark):
    d = spark.range(5000).select((F.col("id") % 700).alias("id"), F.col("id").alias("n"))
    got = [r.id for r in metrics.even_sample(d, "id", 11).orderBy("id").collect()]
    want = sorted(i % 700 for i in range(5000))
    assert got == [want[i * 4999 // 10] for i in range(11)]


def test_extremes_name_all_ties(spark, rows):
    g = spark.createDataFrame([("a", 0.501), ("b", 0.499), ("c", 0.1), ("d", None)], "g string, m double")
    assert rows(metrics.extremes(g, "g", "m")) == [("a", "strongest", 0.5), ("b", "strongest", 0.5), ("c", "weakest", 0.1)]
    assert metrics.extremes(g.where("g = 'a'"), "g", "m").count() == 0


def test_costs_without_prices_are_null(spark):
    d = spark.createDataFrame([("m", 10, 5), ("m", None, 5)], "model string, i int, o int")
    r = metrics.costs(d, "i", "o", None, 1.0, ["model"]).first()
    assert (r.n_known, r.n_unknown, r.tokens_in, r.cost_usd) == (1, 1, 10, None)
    assert metrics.costs(d, "i", "o", 1.0, 1.0, ["model"]).first().cost_usd == pytest.approx(15e-6)


def test_components_against_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, size=(80, 2))] + [(500, 501), (501, 502), (502, 503), (7, 7)] + [(i, i + 1) for i in range(600, 640)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    want = {x: root(x) for x in parent}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + [(None, 1)], "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbers_within_skewed_groups(spark):
    data = [("hot", i % 4, i) for i in range(300)] + [("b", 1, 1000), (None, None, 1001), (None, 2, 1002)]
    d = spark.createDataFrame(data, "g string, o int, id long")
    got = numbered_within(d, ["g"], ["o"], "id", "n", salts=8).toPandas()
    assert len(got) == len(data)
    for _, part in got.groupby("g", dropna=False):
        assert sorted(part.n) == list(range(len(part)))
        ordered = part.sort_values("n")
        assert list(ordered.o.fillna(-1)) == sorted(part.o.fillna(-1))
