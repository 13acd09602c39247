"""Prompts, citations, rendered answers and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.question import MAGNITUDES, either

#: The text shown instead of an answer, and the parts of a prompt.
ABSTAIN = "The filings do not answer this question."
SEPARATOR = "\n\n\n"


def prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, n_sources, prompt): hits(qid, rank, chunk_id, company, ticker, fiscal_year, item, title, content_type, text) as numbered sources in order of rank.

    Questions without hits get a prompt without sources; a passage given twice counts once.
    """
    h = F.struct("company", "ticker", "fiscal_year", "item", "title", "content_type", "text").alias("h")
    every = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", h))).alias("every"))
    ids = F.transform("every", lambda x: x["chunk_id"])
    listed = every.select("qid", F.filter("every", lambda x, i: F.array_position(ids, x["chunk_id"]) == i + 1).alias("s"))
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))

    def source(x: Column, i: Column) -> Column:
        h = x["h"]
        section = F.when(h["item"].isNotNull(), F.concat(F.lit("Item "), h["item"], F.lit(": "), s(h["title"]))).otherwise(s(h["title"]))
        tag = F.when(h["content_type"] == "table", " (table)").otherwise("")
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s(h["company"]), F.lit(" ("), s(h["ticker"]), F.lit("), fiscal year "), s(h["fiscal_year"]), F.lit(", "), section, tag, F.lit("\n"), s(h["text"]))

    met = questions.select("qid", "text").join(listed, "qid", "left")
    body = F.array_join(F.transform(F.coalesce("s", F.array()), source), SEPARATOR)
    question = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    return met.select(
        "qid", F.coalesce(F.size("s"), F.lit(0)).cast("long").alias("n_sources"), F.concat(F.lit("Sources:\n\n"), F.coalesce(body, F.lit("")), F.lit("\n\nQuestion: "), question).alias("prompt")
    )


def citations(answers: DataFrame, answer_id: str, text: str) -> DataFrame:
    """(answer_id, place, marker): every [n] of an answer's text in order."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\[(\d{1,6})\]"), F.lit(1))
    return answers.select(F.col(answer_id).alias("answer_id"), F.posexplode(found).alias("place", "m")).select("answer_id", F.col("place").cast("long").alias("place"), F.col("m").cast("long").alias("marker"))


def resolve(cited: DataFrame, sources: DataFrame) -> DataFrame:
    """Markers with the passage they number in sources(answer_id, marker, chunk_id); unknown and zero markers stay, unresolved."""
    return cited.join(sources, ["answer_id", "marker"], "left").withColumn("resolved", F.col("chunk_id").isNotNull())


def citation_scores(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """(answer_id, n_cited, n_gold, precision, recall) over distinct resolved passages; null on an empty denominator."""
    c = cited.where("chunk_id is not null").select("answer_id", "chunk_id").distinct()
    g = gold.select("answer_id", "chunk_id").distinct()
    both = c.join(g, ["answer_id", "chunk_id"]).groupBy("answer_id").agg(F.count(F.lit(1)).alias("hit"))
    per = lambda d, n: d.groupBy("answer_id").agg(F.count(F.lit(1)).alias(n))
    out = cited.select("answer_id").union(g.select("answer_id")).distinct().join(per(c, "n_cited"), "answer_id", "left").join(per(g, "n_gold"), "answer_id", "left").join(both, "answer_id", "left")
    hit = F.coalesce("hit", F.lit(0))
    return out.select(
        "answer_id", F.coalesce("n_cited", F.lit(0)).alias("n_cited"), F.coalesce("n_gold", F.lit(0)).alias("n_gold"),
        F.round(hit / F.col("n_cited"), 6).alias("precision"), F.round(hit / F.col("n_gold"), 6).alias("recall"),
    )


def render_answer(answerable: Column, sentences: Column) -> Column:
    """Sentences with their markers; the abstaining phrase where nothing is answered or all is blank."""
    one = lambda s: F.concat(F.trim(s["text"]), F.when(F.size(s["sources"]) > 0, F.concat(F.lit(" "), F.array_join(F.transform(s["sources"], lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ""))).otherwise(""))
    kept = F.filter(F.coalesce(sentences, F.array()), lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != "")
    return F.when(F.coalesce(answerable, F.lit(False)) & (F.size(kept) > 0), F.array_join(F.transform(kept, one), " ")).otherwise(ABSTAIN)


def sources_in_range(sentences: Column, n: Column) -> Column:
    return F.forall(F.coalesce(sentences, F.array()), lambda s: F.forall(F.coalesce(s["sources"], F.array()), lambda m: (m >= 1) & (m <= n)))


def figures_in(text: Column) -> Column:
    """array<struct<figure, value decimal(38,10), unit, quantum>>: amounts with currency, sign, scale word and percent; bare years, notes and items are none."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\b(?:item|note|form|page|exhibit)\s+\d[\dA-Za-z.-]*", " ")
    pattern = rf"(?i)((?:[(\-−]\s?)?[$€£]?\s?(?<![\d.,])\d[\d,]*(?:\.\d+)?\)?(?:\s?{either(MAGNITUDES)}(?![A-Za-z]))?)"
    raw = F.regexp_extract_all(t, F.lit(pattern), F.lit(1))

    def read(f: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(f, r"(\d[\d,]*(?:\.\d+)?)", 1), ",", "")
        low = F.lower(f)
        scale = (
            F.when(low.rlike("trillion"), F.lit("1000000000000")).when(low.rlike(r"billion|\bbn\b|\dbn"), F.lit("1000000000")).when(low.rlike(r"million|\bmn\b|\dmn"), F.lit("1000000")).when(low.rlike("thousand"), F.lit("1000")).otherwise(F.lit("1"))
        ).cast("decimal(13,0)")
        places = F.length(F.regexp_extract(digits, r"\.(\d+)$", 1))
        minus = f.rlike(r"^\s*[(\-−]")
        number = digits.try_cast("decimal(24,6)")
        value = (F.when(minus, -number).otherwise(number) * scale).cast("decimal(38,10)")
        quantum = (scale * F.pow(F.lit(10.0), -places)).cast("decimal(38,10)")
        unit = F.when(low.rlike("percent|per cent|%"), "percent").when(f.rlike(r"[$]"), "USD").when(f.rlike("[€]"), "EUR").when(f.rlike("[£]"), "GBP").otherwise("number")
        return F.struct(F.trim(f).alias("figure"), value.alias("value"), unit.alias("unit"), quantum.alias("quantum"))

    read_all = F.transform(raw, read)
    return F.filter(read_all, lambda x: x["value"].isNotNull() & ~((x["unit"] == "number") & x["figure"].rlike(r"^(?:19|20)\d{2}$")))


def verify(sentences: DataFrame, passages: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(answer_id, sentence, figure, kind, status) for each figure of sentences(answer_id, sentence, text) against what the sentence cites.

    'passage' checks look for the figure, at its precision and with its unit, in passages(answer_id, sentence, text): supported, else unverified. 'fact' checks
    compare it with facts(answer_id, value, unit) of the answer: supported if one agrees, mismatch if those of its unit do not, none where no fact has the unit.
    """
    claims = sentences.select("answer_id", "sentence", F.explode(figures_in(F.col("text"))).alias("f")).select("answer_id", "sentence", "f.*")
    seen = passages.select("answer_id", "sentence", F.explode(figures_in(F.col("text"))).alias("p")).select("answer_id", "sentence", F.col("p.value").alias("pv"), F.col("p.unit").alias("unit"))
    agrees = F.abs(F.col("pv") - F.col("value")) * 2 <= F.col("quantum")
    hit = claims.join(seen, ["answer_id", "sentence", "unit"]).where(agrees).select("answer_id", "sentence", "figure").distinct().withColumn("hit", F.lit(True))
    out = claims.select("answer_id", "sentence", "figure").distinct().join(hit, ["answer_id", "sentence", "figure"], "left").select(
        "answer_id", "sentence", "figure", F.lit("passage").alias("kind"), F.when(F.col("hit"), "supported").otherwise("unverified").alias("status")
    )
    if facts is None:
        return out
    met = claims.join(facts.select("answer_id", F.col("value").cast("decimal(38,10)").alias("fv"), "unit"), ["answer_id", "unit"])
    per = met.groupBy("answer_id", "sentence", "figure").agg(F.max((F.abs(F.col("fv") - F.col("value")) * 2 <= F.col("quantum")).cast("int")).alias("ok"))
    return out.unionByName(per.select("answer_id", "sentence", "figure", F.lit("fact").alias("kind"), F.when(F.col("ok") == 1, "supported").otherwise("mismatch").alias("status")))


def abstention(answers: DataFrame, by: list[str]) -> DataFrame:
    """Answers, abstained ones and their rate by group."""
    gone = ~F.coalesce(F.col("answerable"), F.lit(False))
    return answers.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(gone).alias("abstained"), F.round(F.count_if(gone) / F.count(F.lit(1)), 6).alias("rate"))
