"""Checks of a corpus: each gives rows (check, subject, problem), none where all is well."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import numeric, text
from quarrystone.operators import chunking

#: Sections that an annual report must have.
KEY_ITEMS = ("1", "1A", "7", "7A", "8")


def _rows(check: str, found: DataFrame, subject, problem) -> DataFrame:
    return found.select(F.lit(check).alias("check"), subject.cast("string").alias("subject"), problem.alias("problem"))


def coverage(filings: DataFrame, tickers: DataFrame, years: list[int]) -> DataFrame:
    """Every ticker needs one filing per year: missing, filed twice, or outside the scope."""
    # the years are a short list of the caller
    wanted = tickers.select(F.upper("ticker").alias("ticker")).distinct().withColumn("fiscal_year", F.explode(F.array(*[F.lit(y) for y in years])))
    held = filings.select(F.upper("ticker").alias("ticker"), "fiscal_year", "accession_no").distinct()
    per = held.groupBy("ticker", "fiscal_year").agg(F.count(F.lit(1)).alias("n"))
    met = wanted.withColumn("wanted", F.lit(True)).join(per, ["ticker", "fiscal_year"], "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "out of scope").when(F.col("n") > 1, "filed more than once")
    bad = met.withColumn("p", problem).where("p is not null")
    return _rows("coverage", bad, F.concat_ws(" ", "ticker", F.coalesce(F.col("fiscal_year").cast("string"), F.lit("no year"))), F.col("p"))


def stage_parity(earlier: DataFrame, later: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Keys of one stage that the other lacks, both ways."""
    a, b = earlier.select(key).distinct(), later.select(key).distinct()
    lost = _rows("stage_parity", a.join(b, key, "left_anti"), F.col(key), F.lit(f"in {names[0]} but not in {names[1]}"))
    extra = _rows("stage_parity", b.join(a, key, "left_anti"), F.col(key), F.lit(f"in {names[1]} but not in {names[0]}"))
    return lost.unionByName(extra)


def key_items(sections: DataFrame, required: tuple[str, ...] = KEY_ITEMS) -> DataFrame:
    """Required sections that a filing does not have."""
    have = sections.groupBy("accession_no").agg(F.collect_set(F.upper(F.coalesce("item", F.lit("")))).alias("have"))
    lacking = have.withColumn("item", F.explode(F.array_except(F.array(*[F.lit(i) for i in required]), "have")))
    return _rows("key_items", lacking, F.col("accession_no"), F.concat(F.lit("no item "), F.col("item")))


def integrity(sections: DataFrame) -> DataFrame:
    """Repeated keys and positions, missing texts, lengths that do not agree with the text, tables whose rows do not agree with their counts."""
    keys = sections.groupBy("section_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    places = sections.groupBy("accession_no", "section_pos").agg(F.countDistinct("section_id").alias("n")).where("n > 1")
    empty = sections.where(F.trim(F.coalesce("text", F.lit(""))) == "")
    length = sections.where(F.col("text").isNotNull() & ~F.col("n_chars").eqNullSafe(F.length("text")))
    tables = sections.select("section_key", F.explode("tables").alias("t")).where(~F.size("t.rows").eqNullSafe(F.col("t.n_rows")))
    return (
        _rows("integrity", keys, F.col("section_key"), F.lit("repeated key"))
        .unionByName(_rows("integrity", places, F.concat_ws(" ", "accession_no", "section_pos"), F.lit("two sections at one position")))
        .unionByName(_rows("integrity", empty, F.col("section_key"), F.lit("no text")))
        .unionByName(_rows("integrity", length, F.col("section_key"), F.lit("n_chars is not the length")))
        .unionByName(_rows("integrity", tables, F.concat_ws(" ", "section_key", "t.table_index"), F.lit("n_rows is not the number of rows")))
    )


def passage_sizes(passages: DataFrame, kind: str, size: str, limit: int, tolerance: dict[str, float]) -> DataFrame:
    """Kinds of passage of which a larger share than tolerated is over the limit."""
    per = passages.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(size) > limit).alias("over"), F.max(size).alias("most"))
    allowed = F.coalesce(*[F.when(F.col(kind) == k, F.lit(v)) for k, v in tolerance.items()], F.lit(0.0))
    return _rows("passage_sizes", per.where(F.col("over") / F.col("n") > allowed), F.col(kind), F.concat(F.col("over").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" over the limit")))


def _cut(budget: int):
    """Pieces that cut_paragraph makes of a long paragraph; the paragraph itself is one more piece where they do not hold all of its characters."""
    bare = lambda t: "".join(t.split())

    @F.pandas_udf("array<string>")
    def run(blocks: pd.Series) -> pd.Series:
        def one(block):
            if block is None:
                return None
            made = chunking.cut_paragraph(block, budget)
            return made if bare("".join(made)) == bare(block) else [*made, block]

        return blocks.map(one)

    return run


def prose_kept(blocks: DataFrame, passages: DataFrame, key: str, budget: int = numeric.BUDGET) -> DataFrame:
    """Paragraphs of which no passage of their section holds the text, white space aside.

    A paragraph over the budget stands in several passages: each piece that cut_paragraph makes of it is looked for.
    """
    whole = passages.groupBy(key).agg(F.array_join(F.collect_list(text.squash(F.col("text"))), "\u0000").alias("all"))
    # what may be cut: dense paragraphs are at fewer characters
    long_ = F.length("block") >= F.floor(budget * numeric.chars_per_token(F.col("block")) / numeric.PROSE_PER_TOKEN) - 1
    cut = blocks.select(key, "position", "block", _cut(budget)(F.when(long_, F.col("block"))).alias("cut"))
    pieces = F.transform(F.when(long_, F.col("cut")).otherwise(F.array("block")), text.squash)
    met = cut.select(key, "position", pieces.alias("pieces")).join(whole, key, "left")
    gone = F.size(F.filter("pieces", lambda p: ~F.coalesce(F.contains(F.col("all"), p), F.lit(False))))
    lost = met.select(key, "position", F.size("pieces").alias("n"), gone.alias("gone")).where("gone > 0")
    problem = F.when(F.col("n") == 1, "paragraph in no passage").otherwise(F.concat(F.col("gone").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" pieces of a paragraph in no passage")))
    return _rows("prose_kept", lost, F.concat_ws(" ", key, "position"), problem)


def figures_kept(sections: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """Figures of a section's text that neither a passage nor a table cell shows."""
    want = sections.select(key, F.explode(text.figures(F.col("text"))).alias("figure"))
    shown = passages.select(key, F.explode(text.figures(F.col("text"))).alias("figure"))
    cells = sections.select(key, F.explode(F.flatten(F.transform("tables", lambda t: F.flatten(t["rows"])))).alias("cell")).select(key, F.explode(text.figures(F.col("cell"))).alias("figure"))
    lost = want.join(shown.union(cells).distinct(), [key, "figure"], "left_anti")
    return _rows("figures_kept", lost, F.col(key), F.concat(F.lit("lost "), F.col("figure")))


def statement_titles(sections: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Reported when a larger share of filings than tolerated shows no titled statement."""
    per = sections.groupBy("accession_no").agg(F.max(F.coalesce(F.exists("tables", lambda t: F.coalesce(t["statement_title"], F.lit("")) != ""), F.lit(False)).cast("int")).alias("has"))
    total = per.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("has") == 0).alias("without")).where(F.col("without") > tolerance * F.col("n"))
    return _rows("statement_titles", total, F.lit("corpus"), F.concat(F.col("without").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" filings have none")))


def gate(checks: dict[str, DataFrame], needs: dict[str, str] | None = None) -> DataFrame:
    """(check, n_problems, passed) of checks in order; one whose needed check failed is skipped: n_problems null, passed null."""
    counted = None
    for i, (name, rows) in enumerate(checks.items()):
        one = rows.agg(F.count(F.lit(1)).alias("n_problems")).select(F.lit(i).alias("i"), F.lit(name).alias("check"), "n_problems")
        counted = one if counted is None else counted.unionByName(one)
    needs = needs or {}
    needed = counted.select(F.col("check").alias("needed"), (F.col("n_problems") > 0).alias("failed"))
    wants = F.coalesce(*[F.when(F.col("check") == k, F.lit(v)) for k, v in needs.items()], F.lit(None).cast("string"))
    met = counted.withColumn("needed", wants).join(needed, "needed", "left")
    skip = F.coalesce("failed", F.lit(False))
    return met.select(
        "check", F.when(~skip, F.col("n_problems")).alias("n_problems"), F.when(~skip, F.col("n_problems") == 0).alias("passed")
    )
