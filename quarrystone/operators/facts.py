"""Structured figures: repeats, current year, upsert, point lookup and the passages that print a figure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.functions import numeric

#: The columns that make two rows the same fact.
FACT_KEY = ("accession", "concept", "period_start", "period_end", "unit", "value", "fiscal_period")


def first_of_each(facts: DataFrame, key: tuple[str, ...] = FACT_KEY, order: str = "loaded_at") -> DataFrame:
    """One row per key, the one loaded first; nulls of a key are equal."""
    others = [F.col(c).asc_nulls_last() for c in facts.columns if c not in key and c != order]
    w = W.partitionBy(*key).orderBy(F.col(order).asc_nulls_last(), *others)
    return facts.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def is_current_year(start: Column, end: Column, report: Column) -> Column:
    """Ends on the report date and is an instant or lasts 350 to 380 days; null dates are no match."""
    day = lambda c: F.substring(c, 1, 10).try_cast("date")
    days = F.datediff(day(end), day(start))
    low, high = numeric.YEAR_DAYS
    ends = F.substring(end, 1, 10) == F.substring(report, 1, 10)
    return F.coalesce(ends & (start.isNull() | (start == "") | days.between(low, high)), F.lit(False))


def mark_current_year(facts: DataFrame) -> DataFrame:
    return facts.withColumn("is_current_year", is_current_year(F.col("period_start"), F.col("period_end"), F.col("period_of_report")))


def upsert(stored: DataFrame, pulled: DataFrame, filings: DataFrame, key: tuple[str, ...] = FACT_KEY) -> DataFrame:
    """Rows of companies that were pulled again replace the stored ones; facts of unknown accessions go; repeats go; the flag is computed anew."""
    kept = stored.join(pulled.select("ticker").distinct(), "ticker", "left_anti").select(*stored.columns)
    known = filings.select(F.col("accession_no").alias("accession")).distinct()
    both = kept.unionByName(pulled).join(known, "accession", "left_semi").select(*stored.columns)
    return mark_current_year(first_of_each(both, key))


def lookup(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """(qid, value, unit, n_rows, n_values): the one value of each request(qid, ticker, fiscal_year, concept); null where rows disagree or none has a value."""
    asked = requests.select("qid", F.upper("ticker").alias("ticker"), "fiscal_year", "concept")
    have = facts.where("is_current_year").select(F.upper("ticker").alias("ticker"), "fiscal_year", "concept", "unit", numeric.exact(F.col("raw_value"), F.col("value")).alias("exact"))
    met = asked.join(have, ["ticker", "fiscal_year", "concept"], "left")
    return met.groupBy("qid").agg(
        F.count("exact").alias("n_rows"),
        F.countDistinct("exact").alias("n_values"),
        F.when((F.countDistinct("exact") == 1) & (F.countDistinct("unit") <= 1), F.min("exact")).cast("double").alias("value"),
        F.when(F.countDistinct("unit") == 1, F.min("unit")).alias("unit"),
    )


#: Other spellings of a unit.
UNITS = {"pure": "ratio", "usd": "USD", "usd/shares": "USD/shares", "usd per share": "USD/shares"}


def unit_name(unit: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(F.trim(unit)) == k, F.lit(v)) for k, v in UNITS.items()], unit)


def lookup_any(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """(qid, value, unit, n_values): the one value that all current rows under any concept of a line item, in its unit, agree on; null where they disagree or none is there.

    requests(qid, ticker, fiscal_year, concept, unit), a row per concept that the line item may be tagged with; a taxonomy before the concept does not count.
    """
    asked = requests.select("qid", F.upper("ticker").alias("ticker"), "fiscal_year", "concept", "unit")
    have = facts.where("is_current_year").select(
        F.upper("ticker").alias("ticker"), "fiscal_year", F.regexp_replace("concept", "^[^:]*:", "").alias("concept"), unit_name(F.col("unit")).alias("unit"), numeric.exact(F.col("raw_value"), F.col("value")).alias("exact")
    )
    met = asked.join(have.where("exact is not null"), ["ticker", "fiscal_year", "concept", "unit"], "left")
    n = F.countDistinct("exact")
    return met.groupBy("qid").agg(F.when(n == 1, F.min("exact")).cast("double").alias("value"), F.first("unit").alias("unit"), n.alias("n_values"))


def prints_figure(text: Column, forms: Column) -> Column:
    """Any printed form stands in the text with no digit, separator or decimal point joined to it."""
    padded = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    one = lambda f: F.contains(padded, f) & F.rlike(padded, F.concat(F.lit(r"(?<![\d.,])\Q"), f, F.lit(r"\E(?![\d]|[.,]\d)")))
    return F.exists(forms, one)


def supporting_passages(facts: DataFrame, passages: DataFrame, most: int = 3) -> DataFrame:
    """(fact_id, passages): up to ``most`` passages of the fact's own filing that print its figure, in order of the corpus.

    facts(fact_id, accession, exact), passages(chunk_id, accession, text). Both meet on the accession only; the figures of a passage are compared as
    tokens first, so a filing's facts and passages are not paired off by text search.
    """
    forms = facts.select("fact_id", "accession", F.explode(numeric.printed_forms(F.col("exact"))).alias("form"))
    printed = passages.select(
        "chunk_id", "accession", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?<![\d.,])(\d[\d,]*(?:\.\d+)?)(?!\d|[.,]\d)"), F.lit(1)))).alias("form")
    )
    met = forms.join(printed, ["accession", "form"]).select("fact_id", "chunk_id").distinct()
    w = W.partitionBy("fact_id").orderBy("chunk_id")
    return met.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).groupBy("fact_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk_id"))), lambda x: x["chunk_id"]).alias("passages")
    )
