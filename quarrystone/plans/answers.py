"""From questions to verified answers in one plan per batch, and the comparison of configurations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.operators import answering, facts, metrics, question, retrieval
from quarrystone.storage import written

#: (qid, n_sources, prompt) -> (qid, answerable, sentences array<struct<text, sources array<int>>>)
Generator = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Configuration:
    """What a run of the matrix uses; each later one adds a part."""

    name: str
    sections: bool = True
    dense: bool = False
    sparse: bool = True
    filters: bool = False
    rerank: bool = False
    decompose: bool = False
    k: int = retrieval.FINAL


MATRIX = (
    Configuration("C0", sections=False),
    Configuration("C1"),
    Configuration("C2", dense=True, sparse=False),
    Configuration("C3", dense=True),
    Configuration("C4", dense=True, filters=True),
    Configuration("C5", dense=True, filters=True, rerank=True),
    Configuration("C6", dense=True, filters=True, decompose=True),
)


FILTERS = {"ticker": "tickers", "fiscal_year": "years"}
#: What a figure's own answer says; a fixed value.
FACT_SENTENCE = "{company} reported {label} of {figure} for {period}."


def fact_requests(parsed: DataFrame) -> DataFrame:
    """(qid, ticker, fiscal_year, metric, concept, unit): numeric questions that ask one company and year for one line item and nothing narrower, a row per concept of it."""
    one = parsed.where("question_type = 'numeric' and size(tickers) = 1 and size(years) = 1 and asked_metric is not null").select(
        "qid", F.col("tickers")[0].alias("ticker"), F.col("years")[0].alias("fiscal_year"), F.col("asked_metric").alias("metric")
    )
    concept = F.coalesce(*[F.when(F.col("metric") == m, F.array(*[F.lit(c) for c in concepts])) for m, (_, concepts, _) in question.METRICS.items()])
    unit = F.coalesce(*[F.when(F.col("metric") == m, F.lit(u)) for m, (_, _, u) in question.METRICS.items()])
    return one.select("*", F.explode(concept).alias("concept"), unit.alias("unit"))


def routes(parsed: DataFrame, have_facts: DataFrame) -> DataFrame:
    """(qid, route, reason): refused, facts where one agreed value answers the question, else search."""
    refused = question.refusal(parsed).where("reason is not null")
    value = have_facts.where("value is not null").select("qid", F.lit(True).alias("exact"))
    out = parsed.select("qid").join(refused, "qid", "left").join(value, "qid", "left")
    route = F.when(F.col("reason").isNotNull(), "refused").when(F.coalesce("exact", F.lit(False)), "facts").otherwise("search")
    return out.select("qid", route.alias("route"), "reason")


#: (qid, text, wants_figures, tickers, years) and k -> ranked hits (qid, chunk_id, score, rank)
Search = Callable[[DataFrame, int], DataFrame]


def hybrid(index: retrieval.SparseIndex, vectors: DataFrame | None, encode: Callable[[DataFrame], DataFrame] | None, on: dict[str, str] | None = None, figure_weights: dict[str, float] | None = None) -> Search:
    """Sparse and dense lists of 50, each filtered and with tables boosted for questions that want figures, fused by reciprocal ranks; sparse alone without vectors.

    vectors(chunk_id, embedding, content_type, filter columns); encode(queries) adds the embedding of ``dense_text`` (the question as asked; keyword search has ``text``).
    """
    on = FILTERS if on is None else on

    def search(queries: DataFrame, k: int) -> DataFrame:
        depth = max(retrieval.CANDIDATES, k)
        sparse = retrieval.search_sparse(index, queries, depth, on, boost_tables=True)
        if vectors is None or encode is None:
            return sparse.where(F.col("rank") <= k)
        dense = retrieval.search_dense(
            vectors.withColumn("class", F.col("content_type")), written(encode(queries), "encoded"), depth, boost_class="table", on=on, itself=True, boost_when="wants_figures"
        )
        return retrieval.fuse({"bm25": sparse, "dense": dense}, k, figure_weights=figure_weights, figures=queries if figure_weights else None)

    return search


def search_parts(search: Search, queries: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, rank, label): questions of several companies or years are searched once per part, each for the whole budget, and the parts interleaved; the others are searched as they are.

    queries(qid, text, wants_figures, tickers, years, other columns). ``label`` names the part that found a passage, null where the question was not split.
    """
    parts = written(retrieval.sub_questions(queries, k).withColumn("part", F.concat_ws("#", "qid", "sub")), "parts")
    rest = [c for c in queries.columns if c not in ("qid", "tickers", "years")]
    asked = queries.select("qid", *rest).join(parts.select("qid", "part", "tickers", "years"), "qid").drop("qid").withColumnRenamed("part", "qid")
    whole = queries.join(parts.select("qid").distinct(), "qid", "left_anti").withColumn("qid", F.col("qid").cast("string")).select("qid", *rest, "tickers", "years")
    hits = written(search(whole.unionByName(asked.select(whole.columns)), k).select(F.col("qid").alias("part"), "chunk_id", "rank"), "part-hits")
    split = retrieval.interleave(hits.join(parts.select("qid", "sub", "part"), "part").drop("part"), k)
    kind = dict(queries.dtypes)["qid"]
    single = hits.join(parts.select("part"), "part", "left_anti").select(F.col("part").cast(kind).alias("qid"), "chunk_id", "rank", F.lit(None).cast("string").alias("label"))
    return split.join(parts.select("qid", "sub", "label"), ["qid", "sub"]).select("qid", "chunk_id", "rank", "label").unionByName(single)


def answer_questions(
    questions: DataFrame, aliases: DataFrame, corpus: DataFrame, fact_rows: DataFrame, generate: Generator, years: tuple[int, int], k: int = retrieval.FINAL,
    encode: Callable[[DataFrame], DataFrame] | None = None, vectors: DataFrame | Callable[[retrieval.SparseIndex], DataFrame] | None = None, use_facts: bool = True, use_parts: bool = True, use_refusal: bool = True,
) -> DataFrame:
    """(qid, route, reason, answer, n_sources, parts, worst, n_checks) for questions(qid, text).

    corpus(chunk_id, text, ticker, fiscal_year, item, content_type, company, title); fact_rows as for lookup; vectors may be made from the index of the corpus. Refused questions (advice, predictions, figures of companies outside the corpus) are
    not searched; figures that the facts agree on are not generated; every other question is searched within its companies and years, split into parts where it names several, and answered
    by ``generate`` from its sources. Generated answers are verified against the sources that each sentence cites. ``reason`` says why nothing was answered: no_evidence, filters_excluded_all, or why it was refused.
    """
    parsed = written(question.parse_questions(questions, aliases, *years).join(questions.select("qid", F.col("text").alias("question")), "qid"), "parsed")
    figures = facts.lookup_any(fact_rows, fact_requests(parsed)) if use_facts else parsed.select("qid", F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit")).limit(0)
    figures = written(figures, "figures")
    way = routes(parsed, figures)
    way = written(way if use_refusal else way.withColumn("route", F.when(F.col("route") == "refused", "search").otherwise(F.col("route"))).withColumn("reason", F.lit(None).cast("string")), "routes")
    asked = way.where("route = 'search'").join(parsed, "qid").select("qid", F.col("search_text").alias("text"), F.col("question").alias("dense_text"), "wants_figures", "tickers", "years")
    asked = written(asked, "searched")
    index = retrieval.fit(corpus, ["ticker", "fiscal_year", "content_type"], near=list(FILTERS))
    search = hybrid(index, vectors(index) if callable(vectors) else vectors, encode)
    hits = search_parts(search, asked, k) if use_parts else search(asked, k).select("qid", "chunk_id", "rank", F.lit(None).cast("string").alias("label"))
    sources = written(hits.join(corpus.where("trim(text) <> ''").select("chunk_id"), "chunk_id", "left_semi"), "sources")
    made = _generated(generate, asked.select("qid", F.col("dense_text").alias("text")), sources, corpus, index.n)
    said = made.select("qid", answering.render_answer(F.col("answerable"), F.col("sentences")).alias("generated"))
    worst = metrics.worst_check(_checked(made, sources, corpus)).withColumnsRenamed({"answer_id": "qid"})
    stated = figures.join(parsed, "qid").select("qid", answering_figure(F.col("value"), F.col("unit")).alias("stated"))
    parts = sources.where("label is not null").groupBy("qid").agg(F.array_sort(F.collect_set("label")).alias("parts"))
    sizes = sources.groupBy("qid").agg(F.count(F.lit(1)).alias("n_sources"))
    out = way.join(stated, "qid", "left").join(said, "qid", "left").join(sizes, "qid", "left").join(parts, "qid", "left").join(worst, "qid", "left")
    out = out.join(asked.select("qid", (F.size("tickers") + F.size("years") > 0).alias("filtered")), "qid", "left")
    n = F.coalesce("n_sources", F.lit(0))
    answer = F.when(F.col("route") == "facts", F.col("stated")).when(F.col("route") == "search", F.coalesce("generated", F.lit(answering.ABSTAIN))).otherwise(answering.ABSTAIN)
    reason = F.coalesce("reason", F.when((F.col("route") == "search") & (n == 0), F.when(F.col("filtered"), "filters_excluded_all").otherwise("no_evidence")))
    return out.select("qid", "route", reason.alias("reason"), answer.alias("answer"), n.alias("n_sources"), F.coalesce("parts", F.array().cast("array<string>")).alias("parts"), "worst", F.coalesce("n_checks", F.lit(0)).alias("n_checks"))


#: Names of sources that are sent to every worker at once; more of them meet the texts in a shuffle.
MOST_SENT = 500_000


def _generated(generate: Generator, asked: DataFrame, sources: DataFrame, corpus: DataFrame, n_passages: int) -> DataFrame:
    """What ``generate`` makes of every question with sources(qid, chunk_id, rank).

    Prompts repeat a text for every question that has it as a source, so questions take turns: a turn moves about as many texts as the corpus holds, and its shuffle is gone before the next.
    """
    n = sources.count()
    turns = max(1, -(-n // max(n_passages, 1)))
    met = corpus.where("trim(text) <> ''").select("chunk_id", "company", "ticker", "fiscal_year", "item", "title", "content_type", "text")
    out = None
    for i in range(turns):
        mine = F.pmod(F.xxhash64("qid"), F.lit(turns)) == i
        named = sources.where(mine).select("qid", "rank", "chunk_id")
        full = met.join(F.broadcast(named) if n <= MOST_SENT * turns else named, "chunk_id")
        prompts = answering.prompts(asked.where(mine).join(named.select("qid"), "qid", "left_semi"), full.repartition("qid"))
        part = written(generate(prompts.where("n_sources > 0")), "generated")
        out = part if out is None else out.unionByName(part)
    return out


def _checked(made: DataFrame, sources: DataFrame, corpus: DataFrame) -> DataFrame:
    """Checks of the figures of generated sentences against the passages that each cites by rank."""
    s = made.where("answerable").select(F.col("qid").alias("answer_id"), F.posexplode("sentences").alias("sentence", "s"))
    s = s.where(F.size(answering.figures_in(F.col("s.text"))) > 0)  # no others have checks
    cited = s.select("answer_id", "sentence", F.explode("s.sources").alias("marker"))
    w = W.partitionBy("qid").orderBy("rank")
    numbered = sources.select("qid", "rank", "chunk_id").withColumn("marker", F.row_number().over(w))
    passages = cited.join(numbered.select(F.col("qid").alias("answer_id"), "marker", "chunk_id"), ["answer_id", "marker"]).join(corpus.select("chunk_id", "text"), "chunk_id")
    return answering.verify(s.select("answer_id", "sentence", F.col("s.text").alias("text")), passages.select("answer_id", "sentence", "text"))


def answering_figure(value, unit):
    from quarrystone.functions.numeric import format_amount

    return F.concat(F.lit("Reported: "), format_amount(value, unit), F.lit("."))


def extractive(prompts: DataFrame) -> DataFrame:
    """A generator without a model: the first sentence of the first source, cited."""
    first = F.regexp_extract("prompt", r"(?s)\[1\] [^\n]*\n(.+?[.!?])(?:\s|$)", 1)
    empty = F.array().cast("array<struct<text:string,sources:array<int>>>")
    one = F.array(F.struct(first.alias("text"), F.array(F.lit(1)).alias("sources")))
    return prompts.select("qid", (first != "").alias("answerable"), F.when(first != "", one).otherwise(empty).alias("sentences"))


def run_matrix(
    configurations: list[Configuration], lists: dict[str, DataFrame], filtered: dict[str, DataFrame], relevant: DataFrame, rerank: Callable[[DataFrame], DataFrame] | None = None, parts: DataFrame | None = None
) -> DataFrame:
    """One row of means per configuration over shared component rankings.

    lists and filtered: 'windows', 'sparse' and 'dense' rankings (qid, chunk_id, rank) with and without filters, computed once; ``rerank`` gives new scores (qid, chunk_id, score) of a
    pool, ``parts`` the rankings of sub-questions (qid, sub, chunk_id, rank).
    """
    out = None
    for c in configurations:
        have = filtered if c.filters else lists
        chosen = {n: have[n] for n in (["sparse"] if c.sparse and c.sections else ["windows"] if c.sparse else []) + (["dense"] if c.dense else []) if n in have}
        if not chosen:
            continue
        hits = next(iter(chosen.values())).where(F.col("rank") <= c.k) if len(chosen) == 1 else retrieval.fuse(chosen, retrieval.CANDIDATES if c.rerank else c.k)
        if c.rerank and rerank is not None:
            hits = retrieval.reorder(hits, rerank(hits), c.k)
        if c.decompose and parts is not None:
            split = parts.select("qid").distinct()
            hits = hits.select("qid", "chunk_id", "rank").join(split, "qid", "left_anti").unionByName(retrieval.interleave(parts, c.k).select("qid", "chunk_id", "rank"))
        row = metrics.means(metrics.question_metrics(hits, relevant, c.k), ["recall", "ndcg", "mrr"]).withColumn("configuration", F.lit(c.name))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no configuration has the rankings it needs")
    return out
