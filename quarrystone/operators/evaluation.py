"""Question sets made from facts, saved scores by benchmark, group and configuration, replayed rankings, and records of questions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.functions import numeric, text
from quarrystone.operators import facts as figures
from quarrystone.operators import metrics

#: Names of the benchmarks, the measures that only count together, the rank within which a passage is found, and how few scores say nothing.
TEAM, MECHANICAL = "handwritten", "mechanical"
RELEVANCE = ("recall", "ndcg", "mrr")
FOUND_WITHIN, READABLE = 10, 10


def benchmark_kind(question_id: Column, source: Column, difficulty: Column) -> Column:
    """Mechanical by its difficulty, its source or the beginning of its id; handwritten otherwise."""
    low = lambda c: F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return F.when((low(difficulty) == MECHANICAL) | (low(source) == "xbrl") | F.startswith(low(question_id), F.lit("xbrl-")), MECHANICAL).otherwise(TEAM)


def rank_from_reciprocal(value: Column) -> Column:
    """The rank of a reciprocal rank, null for a miss."""
    return F.when(value > 0, F.bround(1 / value).cast("long"))


def expected_answer(raw: Column, value: Column, unit: Column) -> Column:
    """A fact as an answer: the printed value, else the stored one, and its unit; 'unknown' without either."""
    said = F.coalesce(F.nullif(raw, F.lit("")), F.when(~F.isnan(value), value.cast("string")))
    return F.when(said.isNull(), "unknown").otherwise(F.trim(F.concat(F.trim(said), F.lit(" "), F.trim(F.coalesce(unit, F.lit(""))))))


def whole_forms(exact: Column) -> Column:
    """How an amount is printed without decimals, in ones, thousands and millions, with and without separators; fewer than three digits say too little."""
    forms = []
    for scale in (1, 1_000, 1_000_000):
        at = F.abs(exact) / F.lit(scale)
        plain = at.cast("decimal(38,0)")
        keep = (at == F.floor(at)) & (F.length(plain.cast("string")) >= 3)
        forms += [F.when(keep, plain.cast("string")), F.when(keep, F.format_number(plain, 0))]
    return F.array_distinct(F.array_compact(F.array(*forms)))


def generated_questions(facts: DataFrame, passages: DataFrame, most: int = 3) -> DataFrame:
    """(question_id, question, expected_answer, supporting, ticker, fiscal_year, repeated): a question for each current fact that up to ``most`` passages of its own filing print.

    facts as stored, with is_current_year; passages(chunk_id, accession, text). Facts and passages meet on the filing only, and of a passage only its runs of digits and commas are looked at. ``repeated`` marks
    ids given twice, which a question set refuses. Facts without an accession, a value or a printing passage give no question.
    """
    slug = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    label = text.fact_label(F.coalesce(F.nullif(F.trim("label"), F.lit("")), "concept", F.lit("figure")))
    f = facts.where("is_current_year and trim(accession) <> ''").select(
        "accession", F.upper(F.trim(F.coalesce("ticker", F.lit("")))).alias("ticker"), "fiscal_year", label.alias("label"), "unit", expected_answer(F.col("raw_value"), F.col("value"), F.col("unit")).alias("expected_answer"),
        whole_forms(numeric.exact(F.col("raw_value"), F.col("value"))).alias("forms"), F.monotonically_increasing_id().alias("fact"),
    ).where("size(forms) > 0")
    printed = passages.select("chunk_id", "accession", F.array_join(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\d[\d,]*)"), F.lit(1))), " ").alias("digits"))
    met = f.join(printed, "accession").where(F.exists("forms", lambda n: F.contains("digits", n)))
    w = W.partitionBy("fact").orderBy("chunk_id")
    kept = met.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    per = kept.groupBy("fact", "accession", "ticker", "fiscal_year", "label", "unit", "expected_answer").agg(F.array_sort(F.collect_list("chunk_id")).alias("supporting"))
    year = F.col("fiscal_year").cast("string")
    out = per.select(
        F.concat(F.lit("xbrl-"), F.lower("ticker"), F.lit("-"), year, F.lit("-"), slug(F.col("label")), F.lit("-"), slug(F.trim(F.coalesce("unit", F.lit("")))), F.lit("-"), "accession").alias("question_id"),
        F.concat(F.lit("What was "), "label", F.lit(" for "), "ticker", F.lit(" in FY"), year, F.lit("?")).alias("question"), "expected_answer", "supporting", "ticker", "fiscal_year",
    )
    return out.withColumn("repeated", F.count(F.lit(1)).over(W.partitionBy("question_id")) > 1)


def supporting_passage(found: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, chunk_id): of each found fact(qid, accession, exact) the best hit(qid, chunk_id, rank, accession, content_type, text) of its filing that prints it, tables first."""
    met = found.join(hits, ["qid", "accession"]).where(figures.prints_figure(F.col("text"), numeric.printed_forms(F.col("exact"))))
    return met.groupBy("qid").agg(F.min_by("chunk_id", F.struct((F.col("content_type") != "table").cast("int"), "rank")).alias("chunk_id"))


def benchmark_queries(parsed: DataFrame, gold: DataFrame) -> DataFrame:
    """Parsed questions searched in the company and year that the question set states (qid, ticker, fiscal_year), where it does."""
    g = gold.select("qid", F.when(F.col("ticker").isNotNull(), F.array(F.upper("ticker"))).alias("gt"), F.when(F.col("fiscal_year").isNotNull(), F.array("fiscal_year")).alias("gy"))
    return parsed.join(g, "qid", "left").withColumn("tickers", F.coalesce("gt", "tickers")).withColumn("years", F.coalesce("gy", "years")).drop("gt", "gy")


def saved_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Questions, means, denominators and median rank of saved rows (recall, ndcg, mrr, hard_negative_accuracy) by group.

    A score counts if it is a number from 0 to 1; a row of which any of recall, ndcg and mrr is something else takes no part in those three.
    """
    ok = lambda m: (F.col(m) >= 0) & (F.col(m) <= 1) & ~F.isnan(m)
    sound = F.lit(True)
    for m in RELEVANCE:
        sound = sound & (F.col(m).isNull() | ok(m))
    measures = [m for m in metrics.METRICS if m in rows.columns]
    s = rows.withColumn("__sound", sound)
    s = s.select(*by, *[F.when(ok(m) & (F.col("__sound") if m in RELEVANCE else F.lit(True)), F.col(m)).alias(m) for m in measures])
    rank = F.when(F.col("mrr") > 0, F.bround(1 / F.col("mrr")).cast("double")).when(F.col("mrr").isNotNull(), float("inf"))
    middle = F.median(rank)
    aggs = [a for m in measures for a in (F.round(F.avg(m), 6).alias(f"{m}_mean"), F.count(m).alias(f"{m}_scored"))]
    return s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs, F.when(middle < float("inf"), middle).alias("median_rank"))


def breakdown(rows: DataFrame, by: list[str], groupings: list[str], measures: list[str]) -> DataFrame:
    """(by, measure, grouping, name, n, n_scored, mean): each measure by the groups of each grouping, in one pass.

    Rows without a group are left out of that grouping, nulls and infinite scores count as questions only. A split with one group, or with nothing scored, has no strong or weak side and is left out.
    """
    groups = F.explode(F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("name")) for g in groupings])).alias("g")
    finite = lambda m: F.when(~F.isnan(m) & (F.abs(m) < float("inf")), m)
    long_ = rows.select(*by, groups, *[finite(F.col(m).cast("double")).alias(m) for m in measures]).select(*by, "g.*", *measures).where("name is not null")
    per = long_.groupBy(*by, "grouping", "name").agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.count(m).alias("n_scored"), F.round(F.avg(m), 6).alias("mean")).alias(m) for m in measures])
    tall = per.select(*by, "grouping", "name", "n", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}.n_scored").alias("n_scored"), F.col(f"{m}.mean").alias("mean")) for m in measures])).alias("x"))
    tall = tall.select(*by, "x.measure", "grouping", "name", "n", "x.n_scored", "x.mean")
    split = W.partitionBy(*by, "measure", "grouping")  # a report's groups
    return tall.withColumn("k", F.count(F.lit(1)).over(split)).withColumn("s", F.sum("n_scored").over(split)).where("k > 1 and s > 0").drop("k", "s")


def track_record(rows: DataFrame, by: list[str], group: str, measure: str, least: int = READABLE) -> DataFrame:
    """(by, group, n, n_scored, mean) of the groups with at least ``least`` scores."""
    value = F.when(~F.isnan(measure) & (F.abs(F.col(measure)) < float("inf")), F.col(measure))
    per = rows.where(F.col(group).isNotNull()).groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("n_scored"), F.round(F.avg(value), 6).alias("mean"))
    return per.where(F.col("n_scored") >= least)


def worded(score: Column, other: Column | None = None) -> Column:
    """A score as "8 in 10", never "10 in 10" short of all and "fewer than 1 in 10" for hardly any; as a percentage where the other score would read the same."""

    def tenths(c: Column) -> Column:
        n = F.least(F.bround(c * 10), F.lit(9)).cast("int")
        return F.when(c >= 1, "10 in 10").when(n >= 1, F.concat(n.cast("string"), F.lit(" in 10"))).otherwise("fewer than 1 in 10")

    if other is None:
        return tenths(score)
    return F.when(tenths(score) == tenths(other), F.concat(F.bround(score * 100).cast("int").cast("string"), F.lit("%"))).otherwise(tenths(score))


def incomplete(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """(run, problem): runs(run, expected, stopped_at, stopped) that were stopped or of which fewer rows can be read than they declare; none without rows."""
    have = rows.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    met = runs.join(have, "run", "left")
    problem = F.when(F.col("stopped"), F.when(F.col("stopped_at").isNotNull(), F.concat(F.lit("stopped at "), F.col("stopped_at").cast("string"))).otherwise("stopped part-way")).when(
        F.col("n") < F.col("expected"), F.concat(F.col("n").cast("string"), F.lit(" of "), F.col("expected").cast("string"), F.lit(" question rows could be read"))
    )
    return met.select("run", problem.alias("problem")).where("problem is not null")


def restored(rankings: DataFrame, passages: DataFrame, ids: str = "chunk_ids", scores: str | None = None) -> DataFrame:
    """(qid, chunk_id, rank, score, other columns of the passages) of stored lists of ids in order; ids given twice, or without a passage, are an error of the ranking and come out with ``problem``."""
    pairs = F.posexplode(F.arrays_zip(F.col(ids).alias("chunk_id"), (F.col(scores) if scores else F.transform(ids, lambda x: F.lit(None).cast("double"))).alias("score"))).alias("at", "x")
    listed = rankings.select("qid", pairs).select("qid", "x.chunk_id", (F.col("at") + 1).cast("long").alias("rank"), "x.score")
    twice = F.count(F.lit(1)).over(W.partitionBy("qid", "chunk_id")) > 1
    met = listed.withColumn("twice", twice).join(passages.withColumn("__known", F.lit(True)), "chunk_id", "left")
    return met.withColumn("problem", F.when(F.col("twice"), "given twice").when(F.col("__known").isNull(), "no such passage")).drop("twice", "__known")


def replayed(queries: DataFrame, recorded: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rankings recorded for exactly the queries asked, nulls equal, and the queries of which none is recorded."""
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"q.{c}").eqNullSafe(F.col(f"r.{c}"))
    q, r = queries.alias("q"), recorded.alias("r")
    rest = [F.col(f"r.{c}") for c in recorded.columns if c not in on and c != "qid"]
    return q.join(r, same).select("q.qid", *rest), q.join(r, same, "left_anti")


def records_sha256(rows: DataFrame, key: str) -> DataFrame:
    """(n, sha256) of rows as canonical JSON in order of their key; hashes of the rows are folded by their first two digits, so no task holds them all."""
    one = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    h = rows.select(F.sha2(F.concat_ws("\u0000", F.col(key).cast("string"), one), 256).alias("h"))
    fold = lambda d, by: d.groupBy(F.substring("h", 1, by).alias("p")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("v"))
    first = fold(h.withColumn("n", F.lit(1)), 4).select(F.concat("p", "v").alias("h"), "n")
    second = fold(first, 2).select(F.concat("p", "v").alias("h"), "n")
    return second.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("sha256"))


def row_in(cells: Column, source: Column) -> Column:
    """The cells stand in the source row in this order, other cells between them allowed."""
    walk = F.aggregate(source, F.lit(0), lambda at, c: F.when((at < F.size(cells)) & F.get(cells, at).eqNullSafe(c), at + 1).otherwise(at))
    return walk == F.size(cells)


def traced_rows(pieces: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """Rows of table pieces (key, row) that no row of their source table (key, rows) holds in order."""
    have = sources.select(*key, F.transform("rows", lambda r: F.transform(r, text.clean_cell)).alias("__rows"))
    met = pieces.join(have, key, "left")
    cells = F.transform("row", text.clean_cell)
    return met.where(~F.coalesce(F.exists("__rows", lambda r: row_in(cells, r)), F.lit(False))).select(*key, "row")


def merged_cost(before: Column, after: Column) -> Column:
    """The sum of two costs, unknown as soon as one is."""
    return before + after


def usage(rows: DataFrame, by: list[str]) -> DataFrame:
    """Calls, tokens in and out of the calls that tell them, and the calls that do not."""
    known = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    total = lambda c: F.sum(F.when(known, F.col(c))).cast("long")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.count_if(known).alias("known"), F.count_if(~known).alias("unknown"), total("input_tokens").alias("tokens_in"), total("output_tokens").alias("tokens_out"))


def answer_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Answers, abstentions, mean correctness with its denominator, latency quantiles and the share of unreadable outputs, by configuration."""
    gone = ~F.coalesce(F.col("answerable"), F.lit(False))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(gone).alias("abstained"), F.round(F.avg(F.when(~gone, F.col("correctness"))), 6).alias("correctness_mean"), F.count(F.when(~gone, F.col("correctness"))).alias("correctness_scored"),
        metrics.nearest_rank("latency_ms", 0.5).alias("p50"), metrics.nearest_rank("latency_ms", 0.95).alias("p95"), F.round(F.count_if(F.col("answerable").isNull()) / F.count(F.lit(1)), 6).alias("unreadable_share"),
    )


def answer_records(rows: DataFrame, key: str) -> DataFrame:
    """(key, record): every answer as one JSON object with its columns in alphabetical order, nulls left out."""
    return rows.select(key, F.to_json(F.struct(*sorted(c for c in rows.columns if c != key))).alias("record"))


def markdown_table(columns: list[str]) -> Column:
    """A row of the columns as a line of a pipe table, nulls as a dash."""
    return text.pipe_row(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns]))


def filing_of(chunk_id: Column) -> Column:
    """The accession number that a passage's id begins with, null without one."""
    return F.nullif(F.regexp_extract(chunk_id.cast("string"), r"^(\d{10}-\d{2}-\d{6})", 1), F.lit(""))
