import pytest
from pyspark.sql import functions as F

from quarrystone.operators import answering, metrics, question
from quarrystone.plans import answers

ALIASES = [("Alpha Systems Inc.", "ALP"), ("alpha", "ALP"), ("Beta", "BET"), ("Beta Gamma", "BGM")]


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame(ALIASES, "alias string, ticker string")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("revenue in 2021 and fiscal 2022", [2021, 2022]), ("from 2019 to 2021", [2019, 2020, 2021]), ("FY21 vs '22", [2021, 2022]), ("more than 2021 employees", []), ("$2,021 or 2021 million", []),
        ("2010-2030", [2010, 2030]), ("2045", []), (None, []), ("in 2021.5 or 20215", []),
    ],
)
def test_years(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(question.years_in(F.col("t"), 2010, 2030).alias("y")).first().y == want


@pytest.mark.parametrize(
    ("text", "n", "want"),
    [
        ("Should I buy Alpha?", 1, "unanswerable"), ("What will revenue be next year?", 1, "unanswerable"), ("Alpha and Beta revenue", 2, "comparative"), ("How did margins change?", 1, "temporal"),
        ("compare risks", 0, "comparative"), ("How much was goodwill?", 1, "numeric"), ("Who audits?", 1, "factual"), (None, 0, "factual"), ("exchanged chargebacks", 0, "factual"),
    ],
)
def test_types(spark, text, n, want):
    df = spark.createDataFrame([(text, n, 0)], "t string, n int, y int")
    assert df.select(question.question_type(F.col("t"), F.col("n"), F.col("y")).alias("k")).first().k == want


def test_parsed_questions(spark, aliases):
    q = spark.createDataFrame([(1, "What was Beta's total revenue and ALPHA's in fiscal 2021?"), (2, "Alphabet soup"), (3, None), (4, "Beta Gamma net income in 2020")], "qid long, text string")
    got = {r.qid: r for r in question.parse_questions(q, aliases, 2015, 2025).collect()}
    assert got[1].tickers == ["BET", "ALP"] and got[1].years == [2021] and got[1].metric == "revenue" and got[1].question_type == "comparative"
    assert got[1].search_text == "What was total revenue and?" and got[1].asked_metric is None and got[4].asked_metric == "net_income"
    assert got[2].tickers == [] and got[3].tickers == [] and got[3].question_type == "factual"
    assert set(got[4].tickers) == {"BET", "BGM"} and got[4].metric == "net_income"


def test_figures(spark):
    text = "Item 7 says 2021 sales of $1,234.5 million, (12.5)% and 7 thousand in Note 3; 2020 and £5."
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(answering.figures_in(F.col("t"))).alias("f")).select("f.*").collect()
    assert [(float(r.value), r.unit) for r in got] == [(1234500000.0, "USD"), (-12.5, "percent"), (7000.0, "number"), (5.0, "GBP")]
    assert float(got[0].quantum) == 100000.0


def test_verification(spark, rows):
    s = spark.createDataFrame([(1, 0, "Sales were $1.2 billion."), (1, 1, "It was 5%."), (2, 0, "No figure.")], "answer_id long, sentence int, text string")
    p = spark.createDataFrame([(1, 0, "sales $1,234 million"), (1, 1, "6%"), (1, 1, None)], "answer_id long, sentence int, text string")
    f = spark.createDataFrame([(1, 9e9, "USD")], "answer_id long, value double, unit string")
    checks = answering.verify(s, p, f)
    assert rows(checks.select("sentence", "kind", "status")) == [(0, "fact", "mismatch"), (0, "passage", "supported"), (1, "passage", "unverified")]
    assert rows(metrics.worst_check(checks)) == [(1, "mismatch", 3)]


def test_citations(spark, rows):
    a = spark.createDataFrame([(1, "One [2] two [0][9]."), (2, None)], "id long, text string")
    cited = answering.citations(a, "id", "text")
    assert rows(cited) == [(1, 0, 2), (1, 1, 0), (1, 2, 9)]
    src = spark.createDataFrame([(1, 2, "c2")], "answer_id long, marker long, chunk_id string")
    done = answering.resolve(cited, src)
    assert done.where("resolved").count() == 1
    gold = spark.createDataFrame([(1, "c2"), (1, "c5"), (3, "x")], "answer_id long, chunk_id string")
    assert rows(answering.citation_scores(done, gold)) == [(1, 1, 2, 1.0, 0.5), (3, 0, 1, None, 0.0)]


def test_rendering(spark):
    kind = "a boolean, s array<struct<text:string,sources:array<int>>>"
    df = spark.createDataFrame([(True, [(" Yes. ", [1, 2]), ("", [3])]), (True, [("  ", [])]), (False, [("x", [])]), (None, None)], kind)
    got = [r.t for r in df.select(answering.render_answer(F.col("a"), F.col("s")).alias("t")).collect()]
    assert got == ["Yes. [1][2]"] + [answering.ABSTAIN] * 3
    ok = [r.t for r in df.select(answering.sources_in_range(F.col("s"), F.lit(2)).alias("t")).collect()]
    assert ok == [False, True, True, True]


def test_prompts(spark):
    q = spark.createDataFrame([(1, " What \n now? "), (2, "b")], "qid long, text string")
    h = spark.createDataFrame([(1, 2, 20, None, "A", 2020, None, "Exhibits", "table", "t2"), (1, 1, 10, "Co", "A", 2020, "7", "MD", "prose", "t1"), (1, 3, 10, "Co", "A", 2020, "7", "MD", "prose", "t1")], "qid long, rank long, chunk_id long, company string, ticker string, fiscal_year int, item string, title string, content_type string, text string")
    got = {r.qid: r for r in answering.prompts(q, h).collect()}
    assert got[1].prompt == "Sources:\n\n[1] Co (A), fiscal year 2020, Item 7: MD\nt1\n\n\n[2]  (A), fiscal year 2020, Exhibits (table)\nt2\n\nQuestion: What now?"
    assert got[2].n_sources == 0


def test_from_question_to_answer(spark, aliases):
    corpus = spark.createDataFrame(
        [(1, "Alpha sells pumps. More.", "ALP", 2021, "1", "prose", "Alpha", "Business"), (2, "Beta sells pipes.", "BET", 2021, "1", "prose", "Beta", "Business"), (3, "Alpha was small.", "ALP", 2020, "1", "prose", "Alpha", "Business")],
        "chunk_id long, text string, ticker string, fiscal_year int, item string, content_type string, company string, title string",
    )
    facts = spark.createDataFrame([("ALP", 2021, "Revenues", "USD", "1,500", 1500.0, True)], "ticker string, fiscal_year int, concept string, unit string, raw_value string, value double, is_current_year boolean")
    q = spark.createDataFrame([(1, "What does Alpha sell in 2021?"), (2, "What was Alpha's total revenue in 2021?"), (3, "Should I buy Alpha?"), (4, "Who sells pumps?"), (5, "What does Beta sell in 2019?")], "qid long, text string")
    got = {r.qid: r for r in answers.answer_questions(q, aliases, corpus, facts, answers.extractive, (2015, 2025)).collect()}
    assert got[1].route == "search" and got[1].answer == "Alpha sells pumps. [1]"
    assert got[2].route == "facts" and got[2].answer == "Reported: $1,500."
    assert (got[3].route, got[3].reason, got[3].answer) == ("refused", "request", answering.ABSTAIN)
    # a question without a company is searched over all of them, one about a year that is not there finds nothing
    assert got[4].route == "search" and got[4].n_sources == 3
    assert (got[5].route, got[5].reason, got[5].answer) == ("search", "filters_excluded_all", answering.ABSTAIN)


READINGS = [
    ("What did Apple say about its share price?", "factual", None), ("Predict Apple's revenue.", "unanswerable", "request"), ("Should I buy Apple?", "unanswerable", "request"),
    ("What is Apple's stock price?", "unanswerable", "topic"), ("What will Apple report next year?", "unanswerable", "topic"), ("What did Apple say it expects next year?", "factual", None),
    ("What was Intel's total revenue?", "unanswerable", "company"), ("How many employees did NVIDIA have?", "unanswerable", "company"), ("Which companies named NVIDIA as a competitor?", "unanswerable", "topic"),
    ("What was the total revenue of Intel in FY2024?", "unanswerable", "company"), ("Who are customers of Intel by revenue?", "unanswerable", "topic"), ("What was Apple's revenue in FY15?", "unanswerable", "year"),
    ("Loss Contingency, Estimate of Possible Loss for Apple", "factual", None), ("Based on what Apple disclosed, predict margins", "unanswerable", "request"), ("what did Apple Inc. estimate for 2023", "factual", None),
    ("How does Apple account for inventories?", "factual", None), ("What were Apple's inventories in 2023?", "numeric", None), ("What was Apple's total value in 2023?", "numeric", None),
    ("Apple's commercial outlook between 2021 and 2023", "temporal", None), ("What was Apple's accounts receivable in fiscal year 2024?", "numeric", None), ("How does Apple manage accounts receivable risk?", "factual", None),
]


def test_readings(spark):
    companies = spark.createDataFrame([("Apple", "AAPL"), ("Apple Inc", "AAPL"), ("NVIDIA", None), ("Intel", None)], "alias string, ticker string")
    q = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(READINGS)], "qid long, text string")
    got = {r.qid: r for r in question.parse_questions(q, companies, 2021, 2025).collect()}
    wrong = [(t, got[i].question_type, got[i].because) for i, (t, k, b) in enumerate(READINGS) if (got[i].question_type, got[i].because) != (k, b)]
    assert not wrong
    assert got[11].unresolved == ["FY15"] and got[6].unresolved == ["intel"] and got[18].years == [2021, 2022, 2023]
    assert got[11].described[:2] == ["Question type: unanswerable, searched in case a filing answers it", "Companies: AAPL"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("the CHIPS Act of 2022", []), ("Meta's 2023 headcount", [2023]), ("2000 employees in 2024", [2024]), ("more than 2023 suppliers", []), ("was revenue in 2024 more than 2023?", [2023, 2024]),
        ("FY22-24", [2022, 2023, 2024]), ("between FY2025 and FY2023", [2023, 2024, 2025]), ("2022 and 2024", [2022, 2024]), ("$2024 million to 2023", [2023]), ("the '10-K of 2021", [2021]),
    ],
)
def test_numbers_that_are_no_years(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(question.years_in(F.col("t"), 2021, 2025).alias("y")).first().y == want


@pytest.mark.parametrize(
    ("text", "named", "asked"),
    [
        ("What was total revenue?", "revenue", "revenue"), ("What were Services net sales?", "revenue", None), ("diluted net income per share in 2021", "diluted_eps", "diluted_eps"), ("net income per share", None, None),
        ("cost of revenue", "revenue", None), ("how does it recognise revenue", "revenue", None), ("revenue and net income", None, None), ("the company's total assets in FY24", "assets", "assets"),
    ],
)
def test_line_items(spark, text, named, asked):
    r = spark.createDataFrame([(text,)], "t string").select(question.metric_in(F.col("t")).alias("m"), question.asked_metric(F.col("t")).alias("a")).first()
    assert (r.m, r.a) == (named, asked)


def test_what_search_leaves_out(spark):
    companies = spark.createDataFrame([("Google", "GOOGL"), ("AWS", "AMZN"), ("Amazon", "AMZN"), ("Apple", "AAPL")], "alias string, ticker string")
    texts = ["What was Google Cloud revenue in FY2024?", "Apple's revenue from 2022 to 2024", "What did AWS earn?", "assets at December 31, 2024 for AAPL", "Apple 2024", "Amazon"]
    q = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    got = {r.qid: r.search_text for r in question.parse_questions(q, companies, 2021, 2025).collect()}
    assert [got[i] for i in range(6)] == ["What was Google Cloud revenue?", "revenue", "What did AWS earn?", "assets at December 31, 2024 for", "Apple 2024", "Amazon"]


def test_parts_of_a_question(spark, rows):
    from quarrystone.operators import retrieval

    q = spark.createDataFrame([(1, ["A", "B"], [2020, 2021]), (2, ["A", "B"], [2019, 2020, 2021]), (3, ["A"], [2020, 2021]), (4, [], [2020, 2021]), (5, ["A"], [2020]), (6, None, None)], "qid long, tickers array<string>, years array<int>")
    got = retrieval.sub_questions(q, 16).select("qid", "label").collect()
    assert sorted((r.qid, r.label) for r in got) == [
        (1, "A FY2020"), (1, "A FY2021"), (1, "B FY2020"), (1, "B FY2021"), (2, "A FY2019 FY2020 FY2021"), (2, "B FY2019 FY2020 FY2021"), (3, "A FY2020"), (3, "A FY2021"), (4, "FY2020"), (4, "FY2021"),
    ]
    assert retrieval.sub_questions(q, 1).count() == 0


def test_matrix(spark):
    hits = lambda ids: spark.createDataFrame([(1, i, r) for r, i in enumerate(ids, 1)], "qid long, chunk_id long, rank long")
    lists = {"windows": hits([9]), "sparse": hits([1, 2]), "dense": hits([3, 1])}
    filtered = {"sparse": hits([3, 2]), "dense": hits([3, 1])}
    rel = spark.createDataFrame([(1, 3)], "qid long, chunk_id long")
    rerank = lambda h: h.select("qid", "chunk_id", (-F.col("chunk_id")).cast("double").alias("score"))
    parts = spark.createDataFrame([(1, 0, 5, 1), (1, 1, 3, 1)], "qid long, sub long, chunk_id long, rank long")
    got = {r.configuration: r.mrr_mean for r in answers.run_matrix(list(answers.MATRIX), lists, filtered, rel, rerank, parts).collect()}
    assert got == {"C0": 0.0, "C1": 0.0, "C2": 1.0, "C3": 0.5, "C4": 1.0, "C5": 0.333333, "C6": 0.5}


def test_citations_beyond_the_sixth_resolve(spark, rows, tmp_path):
    from quarrystone.plans import queries

    d = str(tmp_path)
    docs = [(i * 5000, "x", "alp" if i % 2 else "ALP", 2021, "1", "prose") for i in range(9)]  # several cells
    spark.createDataFrame(docs, "doc_id long, text string, ticker string, fiscal_year int, item string, content_type string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "alp")], "question_id long, ticker string").write.parquet(f"{d}/test_questions.parquet")
    spark.createDataFrame([(7, 1, "One [1] two [7][8] three [9][10].")], "generation_id long, question_id long, text string").write.parquet(f"{d}/generations.parquet")
    assert rows(queries.citation_resolution_whole(spark, d)) == [(1, 1, 1), (10, 1, 0), (7, 1, 1), (8, 1, 1), (9, 1, 1)]
    sources = queries._cited_sources(spark, d, queries.citation_markers(spark, d))
    assert rows(sources) == [(7, 1, 0), (7, 7, 30000), (7, 8, 35000), (7, 9, 40000)]
