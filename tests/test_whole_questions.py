"""Queries over whole answers take every question, whatever its id."""

import pytest

import __spark_entry__ as entry

QUESTIONS = [(7, "What does Alpha sell in 2021?"), (50, "What does Beta sell in 2021?"), (51, "Should I buy Alpha?"), (52, "What was Alpha's total revenue in 2021?"), (99, "Compare Alpha and Beta in 2021"), (101, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("asked"))
    tables = {
        "companies": ([("ALP", "Alpha"), ("BET", "Beta")], "ticker string, company string"),
        "documents": (
            [(1, "Alpha sells pumps. More.", "alp", 2021, "1", "prose"), (2, "Beta sells pipes.", "BET", 2021, "1", "prose"), (3, " ", "BET", 2021, "1", "prose"), (4, "Alpha was small.", "ALP", 2020, "1", "prose")],
            "doc_id long, text string, ticker string, fiscal_year int, item string, content_type string",
        ),
        "facts": (
            [("ALP", 2021, "Revenues", "USD", "1,500", 1500.0, "2021-01-01", "2021-12-31", "2021-12-31")],
            "ticker string, fiscal_year int, concept string, unit string, raw_value string, value double, period_start string, period_end string, period_of_report string",
        ),
        "test_questions": (QUESTIONS, "question_id long, question string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def test_routes_count_every_question(spark, folder):
    got = {(r.route, r.reason): (r.n, r.n_split) for r in entry.queries()["answer_routes"](spark, folder).collect()}
    assert got == {("search", None): (4, 1), ("refused", "request"): (1, 0), ("facts", None): (1, 0)}


def test_every_question_is_answered(spark, folder, monkeypatch):
    monkeypatch.setattr("quarrystone.plans.answers.MOST_SENT", 1)  # texts are shuffled, not met where they lie
    got = {r.qid: r for r in entry.queries()["answered_questions"](spark, folder).collect()}
    assert sorted(got) == [7, 50, 51, 52, 99, 101]
    assert got[7].answer == "Alpha sells pumps. [1]" and got[50].answer == "Beta sells pipes. [1]" and got[50].n_sources == 1
    assert got[52].answer == "Reported: $1,500." and got[99].parts == ["ALP FY2021", "BET FY2021"] and got[101].n_sources == 3
