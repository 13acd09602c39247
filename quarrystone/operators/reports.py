"""Saved runs: outcomes of questions, changes between runs, tiles, samples, pages and checks of stored rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The order of items in an annual report.
ITEM_ORDER = ("1", "1A", "1B", "1C", "2", "3", "4", "5", "6", "7", "7A", "8", "9", "9A", "9B", "9C", "10", "11", "12", "13", "14", "15", "16")


def item_order(item: Column) -> Column:
    """Place of an item in the report; unknown ones come last."""
    at = F.array_position(F.array(*[F.lit(i) for i in ITEM_ORDER]), F.upper(F.coalesce(item, F.lit(""))))
    return F.when(at > 0, at).otherwise(len(ITEM_ORDER) + 1)


def pickers(passages: DataFrame) -> DataFrame:
    """(ticker, fiscal_year, item, place): what can be chosen in turn: companies by name, their years from the newest, their items in the order of the report."""
    d = passages.select("ticker", "fiscal_year", "item").distinct()
    w = W.partitionBy("ticker", "fiscal_year").orderBy(item_order(F.col("item")), F.col("item").asc_nulls_last())
    return d.withColumn("place", F.row_number().over(w).cast("long"))


def page(rows: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """One page of ordered rows, the first is 0."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def outcomes(retrieval: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions of both (question_id, question, first_rank, scored) and (question_id, question, correctness, abstained, latency_ms); the text is that of the retrieval rows if they have one.

    found: rank within ten, null where the question was not scored.
    """
    r = retrieval.select("question_id", F.col("question").alias("q1"), "first_rank", "scored")
    a = answers.select("question_id", F.col("question").alias("q2"), "correctness", "abstained", "latency_ms")
    found = F.when(F.col("scored"), F.coalesce(F.col("first_rank") <= 10, F.lit(False)))
    return r.join(a, "question_id", "full_outer").select(
        "question_id", F.coalesce(F.nullif("q1", F.lit("")), "q2").alias("question"), "first_rank", found.alias("found"), score(F.col("correctness")).alias("correctness"), "abstained", "latency_ms"
    )


def score(value: Column) -> Column:
    """A finite number from 0 to 1, else null."""
    return F.when(value.between(0, 1) & ~F.isnan(value), value)


def changes(before: DataFrame, after: DataFrame, measures: list[str]) -> DataFrame:
    """(question_id, measure, before, after, change): better, worse or same; questions that only one side scored are left out."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])).alias("x")
    b = before.select("question_id", rows).select("question_id", "x.measure", F.col("x.value").alias("before"))
    a = after.select("question_id", rows).select("question_id", "x.measure", F.col("x.value").alias("after"))
    met = b.join(a, ["question_id", "measure"]).where("before is not null and after is not null")
    d = F.col("after") - F.col("before")
    return met.withColumn("change", F.when(d > 1e-12, "better").when(d < -1e-12, "worse").otherwise("same"))


def tiles(runs: DataFrame, current: str, earlier: str, measure: str) -> DataFrame:
    """(n, mean, median, delta) of the current run; the delta to the earlier one only if exactly the same questions are scored in both."""
    m = F.col(measure)
    side = lambda name: runs.where((F.col("run") == name) & m.isNotNull() & ~F.isnan(m))
    c = side(current).agg(F.count(F.lit(1)).alias("n"), F.avg(m).alias("mean"), F.median(m).alias("median")).withColumn("one", F.lit(1))
    both = side(current).select("question_id", m.alias("c")).join(side(earlier).select("question_id", m.alias("e")), "question_id", "full_outer")
    same = both.agg(F.count_if(F.col("c").isNull() | F.col("e").isNull()).alias("odd"), F.avg("e").alias("then")).withColumn("one", F.lit(1))
    return c.join(same, "one").select("n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.when((F.col("odd") == 0) & (F.col("n") > 0), F.round(F.col("mean") - F.col("then"), 6)).alias("delta"))


def sampled(builds: list[DataFrame], filing: str, per_filing: int, seed: int) -> DataFrame:
    """Questions that every build (question_id, filing) has, at most ``per_filing`` of a filing, chosen by a seeded hash."""
    common = builds[0].select("question_id", filing).distinct()
    for b in builds[1:]:
        common = common.join(b.select("question_id").distinct(), "question_id", "left_semi")
    w = W.partitionBy(filing).orderBy(F.xxhash64("question_id", F.lit(seed)), "question_id")
    return common.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_filing).drop("k")


def prefix_breaks(short: DataFrame, long: DataFrame) -> DataFrame:
    """Ranks (qid, rank) of the shorter run at which the longer run has another passage: a cut of a ranking must be its beginning."""
    s, l = short.select("qid", "rank", F.col("chunk_id").alias("s")), long.select("qid", "rank", F.col("chunk_id").alias("l"))
    return s.join(l, ["qid", "rank"], "left").where(~F.col("s").eqNullSafe(F.col("l"))).select("qid", "rank")


def ranking_differences(stored: DataFrame, again: DataFrame) -> DataFrame:
    """Rows that a stored ranking and its repetition do not share: (qid, chunk_id, rank, side)."""
    names = ["qid", "chunk_id", "rank"]
    a, b = stored.select(*names), again.select(*names)
    return a.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("side", F.lit("again")))


def gold_filings(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """(question_id, filings): the distinct 'ticker year' of the supporting passages, sorted."""
    e = questions.select("question_id", F.explode("supporting_chunk_ids").alias("chunk_id"))
    met = e.join(passages.select("chunk_id", F.concat_ws(" ", "ticker", F.col("fiscal_year").cast("string")).alias("f")), "chunk_id")
    return met.groupBy("question_id").agg(F.array_sort(F.collect_set("f")).alias("filings"))


def gold_content(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """(question_id, content): kinds of the supporting passages joined by +, 'none' without any."""
    e = questions.select("question_id", F.explode_outer("supporting_chunk_ids").alias("chunk_id"))
    met = e.join(passages.select("chunk_id", "content_type"), "chunk_id", "left")
    return met.groupBy("question_id").agg(F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set("content_type")), "+"), F.lit("")), F.lit("none")).alias("content"))


def content_of(questions: DataFrame, passages: DataFrame, on: list[str]) -> DataFrame:
    """gold_content for questions whose supporting passages are all of a company and year: the kinds of each such group meet the questions, not its passages."""
    kinds = passages.select(*on, "content_type").distinct().groupBy(*on).agg(F.array_join(F.array_sort(F.collect_list("content_type")), "+").alias("kinds"))
    return questions.join(kinds, on, "left").select("question_id", F.coalesce(F.nullif("kinds", F.lit("")), F.lit("none")).alias("content"))


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(qid, shared, only_left, only_right) distinct passages of two rankings."""
    l = left.select("qid", "chunk_id").distinct().withColumn("l", F.lit(True))
    r = right.select("qid", "chunk_id").distinct().withColumn("r", F.lit(True))
    return l.join(r, ["qid", "chunk_id"], "full_outer").groupBy("qid").agg(
        F.count_if(F.col("l") & F.col("r")).alias("shared"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right")
    )


def pivoted(rows: DataFrame, measure: str, column: str, value: str, columns: list) -> DataFrame:
    """One row per measure, one column per setting."""
    return rows.groupBy(measure).pivot(column, columns).agg(F.first(value))


def kept_columns(rows: DataFrame, always: list[str]) -> DataFrame:
    """Without columns that are null in every row, but for those always kept."""
    counts = rows.agg(*[F.count(c).alias(c) for c in rows.columns]).first()
    return rows.select(*[c for c in rows.columns if c in always or counts[c]])
