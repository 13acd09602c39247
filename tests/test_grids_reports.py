import pytest
from pyspark.sql import functions as F

from quarrystone.operators import grids, reports

ROWS = "array<array<string>>"


def test_headers_and_years(spark):
    df = spark.createDataFrame(
        [(1, ["0", "1"], [["Year", "2020"], ["a", "5"]]), (2, ["0", "1"], [["Year", "5"], ["a", "6"]]), (3, ["Name", "1"], [["Year", "2020"]]), (4, ["0"], []), (5, None, None)],
        f"id int, h array<string>, r {ROWS}",
    )
    got = {r.id: r.p for r in df.select("id", grids.promoted(F.col("h"), F.col("r")).alias("p")).collect()}
    assert got[1].headers == ["Year", "2020"] and got[1].rows == [["a", "5"]]
    assert got[2].headers == ["0", "1"] and got[3].headers == ["Name", "1"] and got[4].rows == []
    rows = [["x", "2,024", "2,024"], ["y", "2,025", "2,030"], ["z", "2,026", "2,031"], ["n"], ["t", "", "total"]]
    y = spark.createDataFrame([(rows,), ([],), (None,)], f"r {ROWS}").select(grids.years_without_commas(F.col("r")).alias("r")).collect()
    assert y[0].r == [["x", "2024", "2,024"], ["y", "2025", "2,030"], ["z", "2026", "2,031"], ["n"], ["t", "", "total"]] and y[1].r == [] and y[2].r is None
    l = spark.createDataFrame([(["Exhibit", "", None, "Exhibit", "No"],)], "l array<string>").select(grids.joined_levels(F.col("l")).alias("x")).first().x
    assert l == "Exhibit No"


def test_wide_and_long_tables():
    widths = [[5, 10, 10, 10, 10]] * 3
    groups = grids.column_groups(widths, 40)
    assert groups == [[0, 1, 2], [0, 3, 4]] and grids.column_groups(widths, 500) == [[0, 1, 2, 3, 4]] and grids.column_groups([[5, 900]], 40) == [[0, 1]]
    assert grids.column_groups([[90, 1, 1]], 40) == [[0, 1], [0, 2]]
    assert grids.row_slices([10] * 7, 20, 3, 1000) == [(0, 3), (3, 6), (6, 7)] and grids.row_slices([10, 500, 10], 20, 9, 60) == [(0, 1), (1, 2), (2, 3)] and grids.row_slices([], 5, 3, 9) == []


def test_table_parts_keep_every_cell(spark):
    t = [(0, "", ["Item", "2020", "2019", "2018"], [[f"Row {i}", "1,234,567", "2,345,678", None] for i in range(9)], 9, 4, "")]
    kind = "section_key long, tables array<struct<table_index:int,caption:string,headers:array<string>,rows:array<array<string>>,n_rows:int,n_cols:int,statement_title:string>>"
    got = grids.table_parts(spark.createDataFrame([(1, t), (2, None)], kind), "section_key", budget=80, most_rows=4).orderBy("part").collect()
    assert [r.part for r in got] == list(range(len(got))) and all(r.headers[0] == "Item" and (r.n_chars <= 80 or len(r.rows) == 1) for r in got)
    cells = {(h, row[0], c) for r in got for row in r.rows for h, c in list(zip(r.headers, row))[1:]}
    assert len(cells) == 27 and ("2019", "Row 8", "2,345,678") in cells


@pytest.mark.parametrize(
    ("block", "cells", "want"),
    [
        ("Americas$167,045 3 %$162,560", ["167,045", "162,560"], True), ("Americas$167,045 3 %$162,561", ["167,045", "162,560"], False), ("Sales were 167,045.", ["167,045"], False),
        ("Balance -- July 31, 20200.4", ["Balance -- July 31, 2020", "0.4"], True), ("Cost $14,879 in all", ["Cost", "$14", "879", "in all"], False), ("Americas", ["Americas"], False), ("", [], False),
        ("$124 $176 $152 $553", ["124", "176", "152", "553", "$12", "$17", "$55"], True),
    ],
)
def test_debris(block, cells, want):
    assert grids.is_debris(block, cells) is want


def test_debris_needs_a_table(spark):
    kind = "k long, tables array<struct<table_index:int,caption:string,headers:array<string>,rows:array<array<string>>,n_rows:int,n_cols:int,statement_title:string>>"
    s = spark.createDataFrame([(1, [(0, "", ["", "a"], [["x", "167,045"]], 1, 2, "")]), (2, []), (3, None)], kind)
    b = spark.createDataFrame([(k, 0, "Americas$167,045 3 %") for k in (1, 2, 3)], "k long, position int, block string")
    assert {r.k: r.debris for r in grids.marked_debris(s, b, "k").collect()} == {1: True, 2: False, 3: False}


def test_titles_go_to_the_tables_whose_labels_they_head(spark):
    text = ["**Consolidated Balance Sheets**", "", "(in millions)", "| | 2020 |", "| --- | --- |", "| Cash | 1 |", "| Debt | 2 |", "words", "Consolidated Statements of Cash Flows", "| Net income | 5 |", "| Taxes | 5 |", *["far"] * 9, "| Lease | 4 |"]
    lines = spark.createDataFrame([(1, i, l) for i, l in enumerate(text)], "k long, position int, line string")
    tables = spark.createDataFrame([(1, 0, ["Net income", "Taxes", "Other"]), (1, 1, ["cash", "debt"]), (1, 2, ["Lease"]), (1, 3, ["unknown"])], "k long, table_index int, labels array<string>")
    got = {r.table_index: r.title for r in grids.statement_titles(lines, tables, "k").collect()}
    assert got == {0: "Consolidated Statements of Cash Flows", 1: "Consolidated Balance Sheets"}


def test_outcomes_and_changes(spark, rows):
    r = spark.createDataFrame([("a", "Why?", 3, True), ("b", "", None, True), ("c", "x", 1, False)], "question_id string, question string, first_rank int, scored boolean")
    a = spark.createDataFrame([("b", "Text", 0.5, False, 1.0), ("d", "Only", 7.0, True, None)], "question_id string, question string, correctness double, abstained boolean, latency_ms double")
    got = {x.question_id: x for x in reports.outcomes(r, a).collect()}
    assert (got["a"].found, got["b"].found, got["c"].found, got["d"].found) == (True, False, None, None)
    assert got["b"].question == "Text" and got["b"].correctness == 0.5 and got["d"].correctness is None
    before = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 1.0)], "question_id string, m double, n double")
    after = spark.createDataFrame([("a", 2.0, 1.0), ("b", 2.0, 0.5)], "question_id string, m double, n double")
    assert rows(reports.changes(before, after, ["m", "n"]).select("question_id", "measure", "change")) == [("a", "m", "better"), ("b", "m", "same"), ("b", "n", "worse")]


def test_tiles_compare_equal_cohorts_only(spark):
    d = spark.createDataFrame([("new", "a", 1.0), ("new", "b", 0.0), ("old", "a", 0.5), ("old", "b", 0.0), ("odd", "a", 1.0)], "run string, question_id string, m double")
    assert tuple(reports.tiles(d, "new", "old", "m").first()) == (2, 0.5, 0.5, 0.25)
    assert reports.tiles(d, "new", "odd", "m").first().delta is None and reports.tiles(d, "none", "old", "m").first().n == 0


def test_samples_pages_and_orders(spark, rows):
    b = spark.createDataFrame([(f"q{i}", f"f{i % 2}") for i in range(20)], "question_id string, filing string")
    s = reports.sampled([b, b.where("question_id <> 'q1'")], "filing", 3, 7)
    assert s.count() == 6 and rows(s) == rows(reports.sampled([b, b.where("question_id <> 'q1'")], "filing", 3, 7)) and not s.where("question_id = 'q1'").count()
    assert [r.id for r in reports.page(spark.range(10), ["id"], 1, 4).collect()] == [4, 5, 6, 7]
    p = spark.createDataFrame([("A", 2020, i) for i in ("10", "1A", "1", None, "zz")], "ticker string, fiscal_year int, item string")
    assert [r.item for r in reports.pickers(p).orderBy("place").collect()] == ["1", "1A", "10", "zz", None]


def test_ranking_checks(spark, rows):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid long, chunk_id long, rank long")
    b = spark.createDataFrame([(1, 10, 1), (1, 12, 2), (1, 11, 3)], "qid long, chunk_id long, rank long")
    assert rows(reports.prefix_breaks(a, b)) == [(1, 2)]
    assert reports.ranking_differences(a, a).count() == 0 and reports.ranking_differences(a, b).count() == 3
    assert rows(reports.overlap(a, b)) == [(1, 2, 0, 1)]
    q = spark.createDataFrame([("x", [10, 11]), ("y", None), ("z", [])], "question_id string, supporting_chunk_ids array<long>")
    p = spark.createDataFrame([(10, "A", 2020, "prose"), (11, "A", 2021, "table")], "chunk_id long, ticker string, fiscal_year int, content_type string")
    assert rows(reports.gold_filings(q, p)) == [("x", ["A 2020", "A 2021"])]
    assert rows(reports.gold_content(q, p)) == [("x", "prose+table"), ("y", "none"), ("z", "none")]
    assert reports.kept_columns(spark.createDataFrame([(1, None)], "a int, b int"), ["a"]).columns == ["a"]


def test_headings_of_statements(spark):
    cases = {
        "CONSOLIDATED BALANCE SHEETS": "CONSOLIDATED BALANCE SHEETS", "**Statements of Operations and Comprehensive Income (Loss)**": "Statements of Operations and Comprehensive Income (Loss)",
        "Acme, Inc. Consolidated Statements of Cash Flows (in millions)": "Consolidated Statements of Cash Flows (in millions)", "Balance sheets as of December 31, 2024 and 2023": "Balance sheets as of December 31, 2024 and 2023",
        "CASH FLOWS S TATEMENTS": "CASH FLOWS STATEMENTS", "Amounts recognized on our Consolidated Balance Sheets as of May are:": None, "| Part II | Acme, Inc. | Income Statements |": "Income Statements", "Statement of throughput": None,
    }
    d = spark.createDataFrame([(k,) for k in cases], "line string").withColumn("tail", grids.statement_tail(grids.title_candidate(F.col("line"))))
    got = {r.line: r.title for r in d.withColumn("title", grids.clean_title(F.col("tail"))).collect()}
    assert got == cases


def test_an_index_of_statements_heads_no_table(spark):
    text = ["List of statements:", "• Balance sheets", "• Notes", "• Schedule", "We comment.", "| Cash | 1 |", "| Debt | 2 |"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)] + [(2, i, t) for i, t in enumerate(["• Balance sheets", "| Cash | 1 |", "continued", "| Debt | 2 |"])], "k long, position int, line string")
    tables = spark.createDataFrame([(1, 0, ["Cash", "Debt"]), (2, 0, ["Cash", "Debt"])], "k long, table_index int, labels array<string>")
    assert [(r.k, r.title) for r in grids.statement_titles(lines, tables, "k").collect()] == [(2, "Balance sheets")]


def test_columns_and_cells_of_a_grid():
    assert grids.without_repeated_columns(["a", "a", "b", ""], [["1", "1", "2", ""], ["3", "", "4", "4"]]) == (["a", "b"], [["1", "2"], ["3", "4"]])
    assert grids.without_repeated_columns([], []) == ([], [])
    assert grids.split_values("$1,234 $5,678") == ["$1,234", "$5,678"] and grids.split_values("Note 12 of 3") == ["Note 12 of 3"] and grids.split_values("(1.5)%") == ["(1.5)%"]
