"""Retrieval and answer metrics, paired comparisons and resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ("recall", "ndcg", "mrr", "hard_negative_accuracy")


def question_metrics(hits: DataFrame, relevant: DataFrame, k: int, negatives: DataFrame | None = None) -> DataFrame:
    """(qid, n_relevant, found, recall, ndcg, mrr, first_rank, hard_negative_accuracy) at cutoff k for every question with hits or relevant passages.

    hits(qid, chunk_id, rank), relevant(qid, chunk_id), negatives(qid, chunk_id). Recall divides by all relevant passages, the ideal of ndcg is cut at k, mrr is 0
    without a hit, and whatever has an empty denominator is null. Repeated rows count once.
    """
    top = _top(hits, k)
    rel = relevant.select("qid", "chunk_id").distinct()
    size = rel.groupBy("qid").agg(F.count(F.lit(1)).alias("n_relevant"))
    out = _measured(hits, top.join(rel, ["qid", "chunk_id"]), size, k)
    if negatives is None:
        return out
    neg = negatives.select("qid", "chunk_id").distinct()
    kept = neg.join(top, ["qid", "chunk_id"], "left").groupBy("qid").agg(
        F.round(F.count_if(F.col("rank").isNull()) / F.count(F.lit(1)), 6).alias("hard_negative_accuracy")
    )
    return out.join(kept, "qid", "left")


def question_metrics_by(hits: DataFrame, questions: DataFrame, passages: DataFrame, key: str, k: int) -> DataFrame:
    """question_metrics where the relevant passages of a question are those with its ``key``: counted per value and looked up for the hits, never listed per question.

    questions(qid, key), passages(chunk_id, key).
    """
    q = questions.where(F.col(key).isNotNull()).select("qid", key).distinct()
    p = passages.where(F.col(key).isNotNull()).select("chunk_id", key).distinct()
    size = q.join(p.groupBy(key).agg(F.count(F.lit(1)).alias("n_relevant")), key).select("qid", "n_relevant")
    return _measured(hits, _top(hits, k).join(q, "qid").join(p, ["chunk_id", key]).drop(key), size, k)


def _top(hits: DataFrame, k: int) -> DataFrame:
    return hits.where(F.col("rank") <= k).groupBy("qid", "chunk_id").agg(F.min("rank").alias("rank"))


def _measured(hits: DataFrame, found: DataFrame, size: DataFrame, k: int) -> DataFrame:
    """Measures from the relevant hits (qid, chunk_id, rank) and the number of relevant passages (qid, n_relevant)."""
    good = found.groupBy("qid").agg(
        F.count(F.lit(1)).alias("found"), F.min("rank").alias("first_rank"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    out = hits.select("qid").union(size.select("qid")).distinct().join(size, "qid", "left").join(good, "qid", "left")
    has = F.col("n_relevant").isNotNull()
    return out.select(
        "qid",
        F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"),
        F.coalesce("found", F.lit(0)).alias("found"),
        F.when(has, F.round(F.coalesce("found", F.lit(0)) / F.col("n_relevant"), 6)).alias("recall"),
        F.when(has, F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6)).alias("ndcg"),
        F.when(has, F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6)).alias("mrr"),
        F.col("first_rank").cast("long").alias("first_rank"),
    )


def means(rows: DataFrame, measures: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean and denominator of each measure, nulls left out; null where nothing is scored."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in measures:
        aggs += [F.round(F.avg(m), 6).alias(f"{m}_mean"), F.count(m).alias(f"{m}_scored")]
    return rows.groupBy(*(by or [])).agg(*aggs)


def grouped_means(rows: DataFrame, measures: list[str], sets: list[list[str]]) -> DataFrame:
    """means over several groupings of one pass; a column outside a grouping is 'all'."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    filled = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in columns], *measures)
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in measures:
        aggs += [F.round(F.avg(m), 6).alias(f"{m}_mean"), F.count(m).alias(f"{m}_scored")]
    grouped = filled.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(*aggs)
    return grouped.select(*[F.coalesce(F.col(c), F.lit("all")).alias(c) for c in columns], *[c for c in grouped.columns if c not in columns])


def median_rank(rows: DataFrame, by: list[str]) -> DataFrame:
    """Exact median of first_rank, a miss counting as infinite; null where the median is infinite."""
    rank = F.coalesce(F.col("first_rank").cast("double"), F.lit(float("inf")))
    m = F.median(rank)
    return rows.groupBy(*by).agg(F.when(m < float("inf"), m).alias("median_rank"), F.count(F.lit(1)).alias("n"))


def nearest_rank(value: str, share: float) -> Column:
    """The value at rank ceil(share x n)."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})")


def paired(left: DataFrame, right: DataFrame, measure: str, key: str = "qid", by: list[str] | None = None) -> DataFrame:
    """Questions scored on both sides: means, mean difference, wins, losses and ties of the left side, equal within 1e-12."""
    by = by or []
    both = left.select(key, *by, F.col(measure).alias("x")).join(right.select(key, F.col(measure).alias("y")), key).where("x is not null and y is not null")
    d = F.col("x") - F.col("y")
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("x"), 6).alias("left_mean"),
        F.round(F.avg("y"), 6).alias("right_mean"),
        F.round(F.avg(d), 6).alias("difference"),
        F.count_if(d > 1e-12).alias("wins"),
        F.count_if(d < -1e-12).alias("losses"),
        F.count_if(F.abs(d) <= 1e-12).alias("ties"),
    )


def contingency(left: DataFrame, right: DataFrame, key: str = "qid") -> DataFrame:
    """Questions with a relevant passage: found by both, by one only, by neither."""
    l = left.where("n_relevant > 0").select(key, (F.col("found") > 0).alias("l"))
    r = right.where("n_relevant > 0").select(key, (F.col("found") > 0).alias("r"))
    return l.join(r, key).agg(
        F.count_if(F.col("l") & F.col("r")).alias("both"),
        F.count_if(F.col("l") & ~F.col("r")).alias("only_left"),
        F.count_if(~F.col("l") & F.col("r")).alias("only_right"),
        F.count_if(~F.col("l") & ~F.col("r")).alias("neither"),
    )


def bootstrap_interval(differences: DataFrame, cluster: str, value: str, draws: int = 2000, seed: int = 154) -> DataFrame:
    """(n_clusters, n, mean, low, high): percentile interval of the mean difference when whole clusters are drawn.

    Only the sums and counts of the clusters go into the one resampling task.
    """
    sums = differences.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values(cluster)
        s, n = order["s"].to_numpy(), order["n"].to_numpy()
        rng = np.random.default_rng(seed)
        m = np.empty(draws)
        for i in range(draws):
            pick = rng.integers(0, len(s), len(s))
            m[i] = s[pick].sum() / n[pick].sum()
        low, high = np.percentile(m, [2.5, 97.5])
        return pd.DataFrame([(len(s), int(n.sum()), round(float(s.sum() / n.sum()), 6), round(float(low), 6), round(float(high), 6))], columns=["n_clusters", "n", "mean", "low", "high"])

    return sums.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "n_clusters long, n long, mean double, low double, high double")


def worst_check(checks: DataFrame) -> DataFrame:
    """(answer_id, worst, n_checks) from checks(answer_id, sentence, figure, status).

    One figure is as bad as its worst check only if none supports it: mismatch over supported over unverified; an answer then takes mismatch over
    unverified over supported.
    """
    per_figure = {"mismatch": 3, "supported": 2, "unverified": 1}
    per_answer = {"mismatch": 3, "unverified": 2, "supported": 1}
    level = lambda c, order: F.coalesce(*[F.when(F.col(c) == k, v) for k, v in order.items()], F.lit(0))
    name = lambda c, order: F.coalesce(*[F.when(F.col(c) == v, F.lit(k)) for k, v in order.items()], F.lit("unchecked"))
    figures = checks.groupBy("answer_id", "sentence", "figure").agg(F.max(level("status", per_figure)).alias("v"), F.count(F.lit(1)).alias("n"))
    figures = figures.withColumn("status", name("v", per_figure))
    answers = figures.groupBy("answer_id").agg(F.max(level("status", per_answer)).alias("v"), F.sum("n").alias("n_checks"))
    return answers.select("answer_id", name("v", per_answer).alias("worst"), F.col("n_checks").cast("long").alias("n_checks"))


def even_sample(rows: DataFrame, order: str, most: int) -> DataFrame:
    """``most`` rows spaced evenly over the order, both ends included; all rows where there are no more; the middle one for most = 1.

    ``order`` is a number. Positions come from cells between approximate quantiles of it: the cells are counted, and rows are numbered inside their cell only.
    """
    n = rows.count()
    if most >= n:
        return rows
    wanted = [n // 2] if most == 1 else sorted({i * (n - 1) // (most - 1) for i in range(most)})
    picks = rows.sparkSession.createDataFrame([(p,) for p in wanted], "position long")
    return _positions(rows, order, max(1, min(1000, n // 1000))).join(F.broadcast(picks), "position", "left_semi").drop("position")


def _positions(rows: DataFrame, order: str, cells: int) -> DataFrame:
    """rows with ``position``, from 0, by ``order`` and then by an arbitrary but fixed order."""
    cuts = rows.agg(F.percentile_approx(order, [i / cells for i in range(1, cells)] or [0.5], 10_000).alias("c")).first()["c"] or []
    cell = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    placed = rows.withColumn("__cell", F.coalesce(cell, F.lit(-1)))
    counts = {r["__cell"]: r["n"] for r in placed.groupBy("__cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most a thousand cells
    before, start = {}, 0
    for c in sorted(counts):
        before[c], start = start, start + counts[c]
    offsets = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    inside = F.row_number().over(W.partitionBy("__cell").orderBy(F.col(order).asc_nulls_first(), F.xxhash64(*rows.columns))) - 1
    return placed.withColumn("position", (offsets[F.col("__cell")] + inside).cast("long")).drop("__cell")


def group_scores(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Group, its size, its finite scores and their mean; the largest first, then by name."""
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(finite).alias("n_scored"), F.round(F.avg(F.when(finite, F.col(value))), 6).alias("mean")
    ).orderBy(F.col("n").desc(), group)


def extremes(groups: DataFrame, group: str, value: str) -> DataFrame:
    """All groups that are strongest or weakest after rounding to two places; none where there are fewer than two groups.

    groups is one row per group, a report's size.
    """
    v = F.round(value, 2)
    w = W.partitionBy(F.lit(0))
    marked = groups.where(F.col(value).isNotNull()).withColumn("v", v).withColumn("top", F.max("v").over(w)).withColumn("low", F.min("v").over(w)).withColumn("k", F.count(F.lit(1)).over(w))
    side = F.when(F.col("v") == F.col("top"), "strongest").when(F.col("v") == F.col("low"), "weakest")
    return marked.where("k >= 2").withColumn("side", side).where("side is not null").select(group, "side", F.col("v").alias("score"))


def costs(rows: DataFrame, tokens_in: str, tokens_out: str, price_in: float | None, price_out: float | None, by: list[str]) -> DataFrame:
    """Known and unknown usage, token totals and cost by group; the cost is null where nothing is known or prices are not."""
    known = F.col(tokens_in).isNotNull() & F.col(tokens_out).isNotNull()
    usd = F.lit(None).cast("double") if price_in is None or price_out is None else F.round(
        F.sum(F.when(known, (F.col(tokens_in) * price_in + F.col(tokens_out) * price_out) / 1_000_000)), 6
    )
    return rows.groupBy(*by).agg(
        F.count_if(known).alias("n_known"), F.count_if(~known).alias("n_unknown"), F.sum(F.when(known, F.col(tokens_in))).cast("long").alias("tokens_in"),
        F.sum(F.when(known, F.col(tokens_out))).cast("long").alias("tokens_out"), usd.alias("cost_usd"),
    )
