from quarrystone.llm.truncation import longer_copies, truncated_values, truncation_rates

SCHEMA = "generation_id long, provider string, model string, raw string, text string, sentences array<struct<text:string,sources:array<int>>>, value string"


def test_longer_copies_against_brute_force(spark):
    base = ["a", "ab", "abc", "abd", "b", "", None, "abc", "zz", "zzz1", "é", "éa", "ab\n"] + [f"hot prefix {i:04d} tail" for i in range(300)] + ["hot prefix", "hot prefix 01"]
    got = {r.value for r in longer_copies(spark.createDataFrame([(x,) for x in base], "v string").repartition(7), "v").collect()}
    values = {x for x in base if x}
    assert got == {x for x in values if any(y != x and y.startswith(x) for y in values)}


def test_values(spark):
    whole = '{"answerable": true, "sentences": [{"text": "It is {so} \\"now\\".", "sources": [1]}]}'
    rows = [
        (1, whole, "It is so. [1]"), (2, whole[:40], "It is"), (3, "```json\n" + whole + "\n```", "9.1% [1]"), (4, whole[:60] + "...[truncated]", "Names, Others [2]"), (5, whole[:-1] + "   ", ""),
        (6, whole.replace("true", "True") + "  ", "It stops her [2]"), (7, "Plain output that ends. [3]", "Plain output that ends. [3]"), (8, "Plain output that en", "Plain output that en"),
        (9, None, None), (10, whole[:50] + "\n```", "It is so. ["), (11, "   ", "N/A"), (12, "{'answerable': false,}", "The passages given do not answer this question."),
    ]
    df = spark.createDataFrame([(i, "P", "m", r, t, None, "clash") for i, r, t in rows], SCHEMA)
    got = truncated_values(df)
    found = {(r.generation_id, r.field) for r in got.where("truncated").collect()}
    assert found == {(2, "raw"), (2, "text"), (4, "raw"), (5, "raw"), (6, "text"), (8, "raw"), (8, "text"), (10, "raw"), (10, "text")}
    rates = {r.field: (r.n_values, r.n_truncated) for r in truncation_rates(got).collect()}
    assert rates == {"raw": (12, 5), "text": (12, 4)}


def test_a_longer_copy_shows_a_cut_figure(spark):
    df = spark.createDataFrame([(1, None, None, None, "It amounted to $3,445.", None, ""), (2, None, None, None, "It amounted to $3,445.3 million.", None, ""), (3, None, None, None, "Nolgar hel", [("Nolgar held more.", [1])], "")], SCHEMA)
    got = {(r.generation_id, r.reason) for r in truncated_values(df).where("truncated").collect()}
    assert got == {(1, "longer_copy"), (3, "longer_copy")}


def test_no_rows(spark):
    assert truncated_values(spark.createDataFrame([], SCHEMA)).count() == 0
