"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.llm.mixing import Mixture, mix_sources
from quarrystone.llm.neardup import NearDuplicates, near_duplicates
from quarrystone.llm.packing import fill_report, pack
from quarrystone.llm.pairs import broken_pairs, generation_pairs, question_pairs
from quarrystone.llm.quality import text_verdicts
from quarrystone.llm.spans import maximal_spans, shared_share
from quarrystone.llm.splitting import split_oversized
from quarrystone.llm.tokens import token_sizes
from quarrystone.llm.truncation import prefix_values, truncated_values, truncation_rates
from quarrystone.storage import table, written

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = table(spark, sf_dir, "sections").where(F.length("text") > 1800)
    passages = split_oversized(sections, "section_key", "text", 1800, 300)
    hard = F.max((F.col("boundary") == "hard").cast("int")) == 1
    return passages.groupBy(F.col("id").alias("section_key")).agg(F.when(hard, "hard").otherwise("boundary").alias("cut"))


def p1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "sections"), "section_key", "text", 1800, 300).withColumnRenamed("id", "section_key")


def p1_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text over the budget: whether its passages tile it, each within the budget and with an overlap within the bound."""
    p = p1_passages(spark, sf_dir)
    before = F.lag("end").over(W.partitionBy("section_key").orderBy("start"))
    p = p.withColumn("overlap", before - F.col("start"))
    texts = table(spark, sf_dir, "sections").where(F.length("text") > 1800).select("section_key", F.col("text").alias("whole"))
    met = p.join(texts, "section_key").withColumn("same", F.expr("substring(whole, start + 1, end - start)") == F.col("text"))
    # what lies between two passages, at the beginning and at the end is white space at most
    gap = F.when(F.col("overlap").isNull(), F.expr("substring(whole, 1, start)")).when(F.col("overlap") < 0, F.expr("substring(whole, start + overlap + 1, -overlap)")).otherwise("")
    blank = lambda c: ~c.rlike(r"(?U)\S")
    ends = met.groupBy("section_key").agg(
        F.max(F.length("text")).alias("longest"), F.max("overlap").alias("most"), F.min("same").alias("same"), F.min(blank(gap)).alias("closed"),
        F.max("end").alias("last"), F.first("whole").alias("whole"),
    )
    rest = blank(F.expr("substring(whole, last + 1, length(whole))"))
    return ends.select("section_key", (F.col("longest") <= 1800).alias("within_budget"), (F.coalesce("most", F.lit(0)) <= 300).alias("within_overlap"), (F.col("same") & F.col("closed") & rest).alias("tiled"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = text_verdicts(table(spark, sf_dir, "sections"), "section_key", "text", statistics=False)
    return verdicts.where("n_chars >= 200 and verdict <> 'prose'").select("section_key", F.col("verdict").alias("text_class"))


def p2_text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_verdicts(table(spark, sf_dir, "sections"), "section_key", "text")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, generations = table(spark, sf_dir, "test_questions"), table(spark, sf_dir, "generations")
    return broken_pairs(question_pairs(questions).unionByName(generation_pairs(generations, questions)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).where("defect is not null").select("pair_table", "pair_id", "defect")


def p3_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every triggered defect of every pair."""
    return _pairs(spark, sf_dir).select("pair_table", "pair_id", F.explode("defects").alias("defect"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated_values(table(spark, sf_dir, "generations")).where("truncated").select("generation_id", "field")


def p4_truncation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_rates(truncated_values(table(spark, sf_dir, "generations")))


def p4_longer_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix search by itself: values that are a strict prefix of another one."""
    return prefix_values(table(spark, sf_dir, "generations"))


def _similar_sections(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return near_duplicates(table(spark, sf_dir, "sections"), "section_key", "text", words=3, threshold=0.6, least_words=60)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _similar_sections(spark, sf_dir).pairs()
    return pairs.select(F.col("a").alias("section_key_a"), F.col("b").alias("section_key_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar_sections(spark, sf_dir).groups().withColumnRenamed("id", "section_key")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text", ["source"]), "sizes")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_sizes(spark, sf_dir), table(spark, sf_dir, "pack_containers")).withColumnRenamed("id", "doc_id")


def p6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind of container: documents placed, containers over their capacity, and documents cut though they fit."""
    containers = table(spark, sf_dir, "pack_containers")
    kinds = F.broadcast(containers.select("container_id", "capacity_tokens", "separator_tokens"))
    packed = written(pack(_sizes(spark, sf_dir), containers), "packed")
    bins = packed.groupBy("container_id", "bin").agg((F.sum("n_tokens")).alias("t"), F.count(F.lit(1)).alias("n")).join(kinds, "container_id")
    over = F.count_if(F.col("t") + (F.col("n") - 1) * F.col("separator_tokens") > F.col("capacity_tokens")).alias("n_over")
    docs = packed.groupBy("container_id", "id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).join(kinds, "container_id")
    cut = docs.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("capacity_tokens"))).alias("n_cut"))
    return cut.join(bins.groupBy("container_id").agg(over), "container_id").select("container_id", "n_docs", "n_over", "n_cut")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers = table(spark, sf_dir, "pack_containers")
    return fill_report(pack(_sizes(spark, sf_dir), containers), containers)


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    return mix_sources(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).selection.withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).report


def p7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix: whether no document is repeated too often, and whether the tokens of every source are within its largest document of the target."""
    m = _mixture(spark, sf_dir)
    r = m.report.where("source is not null")
    return r.groupBy("mix").agg(
        F.min((F.col("most_copies") <= F.col("max_repeats")).cast("int")).cast("boolean").alias("within_repeats"),
        F.min((F.abs(F.col("tokens") - F.col("wanted_share") * F.col("mix_tokens")) <= F.col("largest_doc") + 1).cast("int")).cast("boolean").alias("shares_met"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = maximal_spans(table(spark, sf_dir, "documents"), "doc_id", "text")
    return spans.select(F.col("id").alias("doc_id")).distinct()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal repeats, each looked up once more in the other document that is named as holding it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = written(maximal_spans(docs, "doc_id", "text"), "spans")
    held = spans.join(docs.select(F.col("doc_id").alias("id"), "text"), "id").join(docs.select(F.col("doc_id").alias("other_id"), F.col("text").alias("other")), "other_id")
    return held.select(F.col("id").alias("doc_id"), "start", "end", "n_chars", F.contains("other", F.expr("substring(text, start + 1, end - start)")).alias("other_holds_it"))


def p8_shared_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_share(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_passages": p1_passages, "p1_tiling": p1_tiling, "p2_found": p2_found, "p2_text_statistics": p2_text_statistics, "p3_found": p3_found, "p3_defects": p3_defects, "p4_found": p4_found, "p4_truncation_rates": p4_truncation_rates, "p4_longer_copies": p4_longer_copies, "p5_found": p5_found, "p5_groups": p5_groups, "p6_packed": p6_packed, "p6_fill": p6_fill, "p6_rules": p6_rules, "p7_selection": p7_selection, "p7_shares": p7_shares, "p7_rules": p7_rules, "p8_found": p8_found, "p8_spans": p8_spans, "p8_shared_share": p8_shared_share}
SQL: dict[str, str] = {
    "p1_found": (
        "SELECT section_key, CASE WHEN list_max(list_transform(regexp_split_to_array(text, "
        "'[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: length(x))) > 1800 THEN 'hard' ELSE 'boundary' END AS cut "
        "FROM sections WHERE length(text) > 1800"
    ),
    "p4_longer_copies": (
        "WITH v AS (SELECT generation_id, 'raw' AS field, raw AS value FROM generations UNION ALL SELECT generation_id, 'text', text FROM generations), u AS (SELECT DISTINCT value, length(value) AS n FROM v WHERE value <> ''), "
        "c AS (SELECT DISTINCT a.value FROM u a JOIN u b ON substr(a.value, 1, 1) = substr(b.value, 1, 1) AND b.n > a.n AND starts_with(b.value, a.value)) SELECT generation_id, field FROM v JOIN c USING (value)"
    ),
    "p5_found": (
        "WITH w AS (SELECT section_key, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM sections), "
        "s AS (SELECT DISTINCT section_key, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 60), "
        "n AS (SELECT section_key, count(*) AS n FROM s GROUP BY 1), "
        "c AS (SELECT a.section_key AS a, b.section_key AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.section_key < b.section_key GROUP BY ALL) "
        "SELECT a AS section_key_a, b AS section_key_b FROM c JOIN n x ON x.section_key = a JOIN n y ON y.section_key = b WHERE k >= 0.6 * (x.n + y.n - k)"
    ),
    "p1_tiling": "SELECT section_key, true AS within_budget, true AS within_overlap, true AS tiled FROM sections WHERE length(text) > 1800",
    "p6_rules": "SELECT container_id, (SELECT count(*) FROM documents) AS n_docs, 0 AS n_over, 0 AS n_cut FROM pack_containers",
    "p7_rules": "SELECT DISTINCT mix, true AS within_repeats, true AS shares_met FROM mix_targets",
    "p8_spans": (
        "WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 240), "
        "w AS (SELECT doc_id, n, i, md5(substr(text, i + 1, 240)) AS h FROM (SELECT *, unnest(range(0, n - 239)) AS i FROM d)), "
        "s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), k AS (SELECT w.* FROM w JOIN s USING (h)), "
        "m AS (SELECT a.doc_id, b.doc_id AS o, a.n, a.i, a.i - b.i AS g FROM k a JOIN k b ON a.h = b.h AND a.doc_id <> b.doc_id), "
        "r AS (SELECT doc_id, n, min(i) AS s, max(i) + 240 AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, o, g ORDER BY i) AS isle FROM m) GROUP BY doc_id, n, o, g, isle), "
        "u AS (SELECT doc_id, n, s, max(e) AS e FROM r GROUP BY doc_id, n, s), "
        "x AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM u) "
        'SELECT doc_id, s::INT AS "start", e::INT AS "end", n::INT AS n_chars, true AS other_holds_it FROM x WHERE earlier IS NULL OR e > earlier'
    ),
    "p8_found": (
        "WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 240), "
        "p AS (SELECT doc_id, text, unnest(range(1, n - 238)) AS i FROM d), w AS (SELECT doc_id, md5(substr(text, i, 240)) AS h FROM p), "
        "s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)) SELECT DISTINCT doc_id FROM w JOIN s USING (h)"
    ),
}
