import pytest
from pyspark.sql import functions as F

from quarrystone.functions import numeric, text
from quarrystone.operators import chunking, facts, index, quality_gate

BODY = "The body of the section goes on for a while and says what it has to say about it. " * 3


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, text.tokens, "Ab é-12 c") == ["ab", "12", "c"] and one(spark, text.tokens, None) == []
    assert one(spark, text.figures, "1,234 and 12 and 1,234 and 9999") == ["1,234", "9999"]
    assert one(spark, text.is_stub, "short") and one(spark, text.is_stub, "x " * 120 + "incorporated by reference")
    assert not one(spark, text.is_stub, "x " * 120)
    assert one(spark, text.fiscal_year, "2021-09-30") == 2021 and one(spark, text.fiscal_year, "") is None and one(spark, text.fiscal_year, None) is None
    assert [str(one(spark, text.filing_date, d)) for d in ("2021-02-03", "2021/02/03", "02/03/2021", "20210203", "soon", None)] == ["2021-02-03"] * 4 + ["None"] * 2
    assert one(spark, text.clean_cell, " a \n b|c ") == "a b\\|c"
    assert one(spark, text.fact_label, " .Net  sales. ") == "Net sales" and one(spark, text.fact_label, " . ") == "figure"
    assert one(spark, text.is_run_id, "C4.run-1") and not one(spark, text.is_run_id, "../x")


def test_number_functions(spark):
    d = spark.createDataFrame([(1.0,), (-1.0,)], "s double").select(numeric.boosted(F.col("s"), F.lit(2.0)).alias("b"))
    assert [r.b for r in d.collect()] == [2.0, -0.5]
    n = spark.createDataFrame([(1800,), (1200,), (2401,)], "b int").select(numeric.table_budget(F.col("b")), numeric.overlap_budget(F.col("b"))).collect()
    assert [tuple(r) for r in n] == [(720, 300), (480, 200), (960, 400)]
    for block in ("plain words of prose only here", "1,234 5,678 | 9,999 (12)", "", "ab 12 cd 3,4"):
        assert one(spark, numeric.block_cost, block) == chunking.cost_of(block)
    assert [str(one(spark, numeric.exact, v)) for v in ("(1,234.5)", "$2", "x", None, "9007199254740993")] == ["-1234.5000000000", "2.0000000000", "None", "None", "9007199254740993.0000000000"]
    assert one(spark, lambda c: numeric.printed_forms(numeric.exact(c)), "1234500000") == ["1,234,500", "1,234,500,000", "1,234.5", "1234500", "1234500000"]
    assert one(spark, lambda c: numeric.printed_forms(numeric.exact(c)), "12") == []
    assert one(spark, lambda c: numeric.format_amount(numeric.exact(c), F.lit("USD")), "-1234") == "-$1,234"
    assert one(spark, lambda c: numeric.format_amount(numeric.exact(c), F.lit("USD/shares")), "1.5") == "$1.50 per share"


def test_page_breaks_and_headings(spark):
    rows = [(1, 0, "Risk Factors"), (1, 1, BODY + "and it continues without"), (1, 2, "a stop here."), (1, 3, "Not a heading."), (1, 4, "END"), (2, 0, "lower start")]
    b = spark.createDataFrame(rows, "k long, position int, block string")
    joined = chunking.rejoined(b, "k").orderBy("k", "position").collect()
    assert [(r.k, r.position, r.n_blocks) for r in joined] == [(1, 0, 1), (1, 1, 2), (1, 3, 1), (1, 4, 1), (2, 0, 1)]
    assert joined[1].block.endswith("without a stop here.")
    h = chunking.headings(chunking.rejoined(b, "k"), "k").orderBy("k", "position").collect()
    assert [(r.is_heading, r.heading) for r in h] == [(True, "Risk Factors"), (False, "Risk Factors"), (False, "Risk Factors"), (False, "Risk Factors"), (False, None)]


@pytest.mark.parametrize("budget", [300, 500])
def test_packing_keeps_every_paragraph_in_order(budget):
    costs = [10, 250, 90, 400, 5, 60, 120, 700, 3]
    out = chunking.fill_passages(costs, budget, 100)
    assert sorted({i for p in out for i in p}) == list(range(len(costs)))
    assert all(p == sorted(p) for p in out)
    for a, b in zip(out, out[1:]):
        carried = [i for i in b if i in a]
        assert sum(costs[i] for i in carried) <= 100 and carried == a[len(a) - len(carried) :]
    assert chunking.fill_passages([], 100, 10) == [] and chunking.fill_passages([5], 100, 10) == [[0]]


def test_long_blocks_are_cut_at_sentences():
    block = "One two three. Four five six; seven eight nine ten. " + "word " * 30
    parts = chunking.cut_block(block.strip(), 40)
    assert all(len(p) <= 40 for p in parts) and " ".join(parts).split() == block.split() and parts[0] == "One two three."


def test_prose_passages(spark):
    body = "\n\n".join(["Table of Contents", "A Heading", BODY, BODY, "12", BODY * 8])
    df = spark.createDataFrame([(1, body, 0), (2, None, 0), (3, "", None), (4, "tiny", 1)], "section_key long, text string, n_tables int")
    got = chunking.prose_passages(df, "section_key", 600).orderBy("section_key", "passage").collect()
    assert {r.section_key for r in got} == {1, 4}
    assert all(r.heading == "A Heading" for r in got if r.section_key == 1) and "Table of Contents" not in " ".join(r.text for r in got)
    assert [r.passage for r in got if r.section_key == 1] == list(range(sum(r.section_key == 1 for r in got)))
    assert chunking.prose_passages(df.limit(0), "section_key").count() == 0


def test_tables(spark, rows):
    t = [(0, "Cap", ["", "2020"], [["Sales", "1,234"], ["Cost", "5|6"], ["Gain", "7"]], 3, 2, ""), (1, None, ["a"], [["x"]], 1, 1, ""), (2, "Cap", ["", "2020"], [["Sales", "1,234"], ["Cost", "5|6"], ["Gain", "7"]], 3, 2, "")]
    kind = "section_key long, tables array<struct<table_index:int,caption:string,headers:array<string>,rows:array<array<string>>,n_rows:int,n_cols:int,statement_title:string>>"
    df = spark.createDataFrame([(1, t), (2, []), (3, None)], kind)
    got = chunking.table_pieces(df, "section_key", 2)
    assert got.count() == 4
    kept = chunking.distinct_tables(got, "section_key").orderBy("piece").collect()
    assert [(r.table_index, r.piece, r.n_pieces, r.n_rows) for r in kept] == [(0, 0, 2, 2), (0, 1, 2, 1)]
    assert kept[0].text == "Cap\n\n|  | 2020 |\n| --- | --- |\n| Sales | 1,234 |\n| Cost | 5\\|6 |"


def test_fixed_windows_against_all_pairs(spark):
    src = [("f", i, n) for i, n in enumerate([10, 0, 35, 4, 60])] + [("g", 0, 3), ("h", 0, 0)]
    df = spark.createDataFrame([(f, i, "x" * n) for f, i, n in src], "f string, k long, text string")
    got = {tuple(r) for r in chunking.fixed_windows(df, "f", "k", "k", 20, 15).collect()}
    want = set()
    for f in "fg":
        at, spans = 0, []
        for g, k, n in src:
            if g == f:
                spans.append((k, at, at + n))
                at += n + 1
        total = spans[-1][2]
        w = 0
        while True:
            first, last = w * 15, min(w * 15 + 20, total)
            want |= {(f, w, first, last, k) for k, s, e in spans if e > s and first < e and last > s}
            if last >= total:
                break
            w += 1
    assert got == want


def test_corpus_relation(spark):
    f = spark.createDataFrame(
        [("a1", "A", 1, "Co", "10-K", "2021-02-01", "2020-12-31", "2021-02-02"), ("a1", "A", 1, "CO", "10-K", "2021-02-01", "2020-12-31", "2021-03-02"), ("a2", "a", 1, "Co", "10-K/A", "2022/02/01", "", None)],
        "accession_no string, ticker string, cik long, company string, form string, filing_date string, period_of_report string, loaded_at string",
    )
    s = spark.createDataFrame([(1, "a1", "a", True), (2, "a2", "A", False), (3, "zz", "A", True)], "section_key long, accession_no string, ticker string, is_key_section boolean")
    got = {r.section_key: (r.company, r.fiscal_year) for r in chunking.corpus(f, s).collect()}
    assert got == {1: ("Co", 2020), 2: ("Co", None)}
    assert chunking.corpus(f, s, [2020], ["A"], True).count() == 1


FACT = "ticker string, accession string, concept string, period_start string, period_end string, period_of_report string, unit string, value double, raw_value string, fiscal_period string, fiscal_year int, loaded_at string, is_current_year boolean"


def fact(ticker="A", accession="a1", start="2020-01-01", end="2020-12-31", value=5.0, raw="5", concept="Revenue", unit="USD", loaded="1"):
    return (ticker, accession, concept, start, end, "2020-12-31", unit, value, raw, "FY", 2020, loaded, None)


def test_facts(spark):
    rows = [fact(), fact(loaded="2"), fact(start=None), fact(start="2020-10-01", value=1.0, raw="1"), fact(end="2019-12-31", start="2019-01-01", value=4.0, raw="4"), fact("B", "b1", raw="(7)", value=None), fact("B", "b9", loaded=None), fact("C", "a1", raw=None, value=None)]
    df = spark.createDataFrame(rows, FACT)
    assert facts.first_of_each(df).count() == 7
    flagged = facts.mark_current_year(df)
    assert sorted((r.ticker, r.period_start, r.is_current_year) for r in flagged.where("ticker = 'A'").select("ticker", F.coalesce("period_start", F.lit("-")).alias("period_start"), "is_current_year").collect()) == [
        ("A", "-", True), ("A", "2019-01-01", False), ("A", "2020-01-01", True), ("A", "2020-01-01", True), ("A", "2020-10-01", False)]
    asked = spark.createDataFrame([(1, "a", 2020, "Revenue"), (2, "B", 2020, "Revenue"), (3, "Z", 2020, "Revenue"), (4, "C", 2020, "Revenue")], "qid long, ticker string, fiscal_year int, concept string")
    got = {r.qid: (r.n_values, r.value) for r in facts.lookup(flagged, asked).collect()}
    assert got == {1: (1, 5.0), 2: (2, None), 3: (0, None), 4: (0, None)}
    filings = spark.createDataFrame([("a1",), ("b1",)], "accession_no string")
    merged = facts.upsert(df, df.where("ticker = 'B'"), filings)
    assert sorted(r.ticker for r in merged.collect()) == ["A"] * 4 + ["B", "C"]


def test_figures_in_passages(spark):
    f = spark.createDataFrame([(1, "a", "1234500000"), (2, "a", "77"), (3, "b", "1234500000")], "fact_id long, accession string, v string").withColumn("exact", numeric.exact(F.col("v")))
    p = spark.createDataFrame([(i, "a", t) for i, t in enumerate(["sales of 1,234.5 million", "1,234.56", "21,234.5", "in thousands 1,234,500.", "x", None, "1,234,500,000", "1234500"])], "chunk_id long, accession string, text string")
    assert {r.fact_id: r.passages for r in facts.supporting_passages(f, p).collect()} == {1: [0, 3, 6]}


def test_fingerprint_and_difference(spark, rows):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "chunk_id long, text string")
    same = index.corpus_fingerprint(a.orderBy(F.desc("chunk_id")).repartition(3)).first()
    assert same == index.corpus_fingerprint(a).first() and same.n == 3
    assert index.corpus_fingerprint(a.withColumn("text", F.lit("x"))).first().fingerprint != same.fingerprint
    assert index.corpus_fingerprint(a.limit(0)).first().n == 0
    old = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "id long, digest string")
    new = spark.createDataFrame([(1, "a", "t"), (2, "c", "t"), (3, "e", "t")], "id long, digest string, text string")
    assert rows(index.index_difference(old, new)) == [("current", 1), ("missing", 1), ("orphaned", 1), ("stale", 1)]
    stored = old.withColumn("vector", F.lit("old"))
    encode = lambda d: d.select("id", "digest", F.lit("new").alias("vector"))
    assert rows(index.refreshed(stored, new, encode)) == [(1, "a", "old"), (2, "c", "new"), (3, "e", "new")]
    assert rows(index.refreshed(stored, new, encode, whole=False))[-1] == (4, "d", "old")
    donors = spark.createDataFrame([(1, "a", "p", 2), (1, "a", "q", 1), (2, "x", "r", 1)], "id long, digest string, vector string, priority int")
    assert rows(index.reusable(new.select("id", "digest"), donors)) == [(1, "a", "q")]
    manifest = index.corpus_fingerprint(a).withColumn("model", F.lit("m"))
    assert index.refusals(manifest, index.corpus_fingerprint(a), {"model": "m"}).count() == 0
    assert index.refusals(manifest, index.corpus_fingerprint(a.limit(1)), {"model": "n"}).count() == 3
    assert rows(index.refusals(manifest.limit(0), index.corpus_fingerprint(a), {}))[0] == ("no manifest",)


def test_settings_and_truncation(spark):
    p = spark.createDataFrame([(1800, 300), (1800, 300)], "chunk_budget int, chunk_overlap int")
    assert tuple(index.chunk_settings(p).first()) == (1800, 300, "recorded")
    assert index.chunk_settings(p.union(spark.createDataFrame([(1200, 200)], p.schema))).first().note == "mixed"
    assert index.chunk_settings(p.select(F.lit(None).cast("int").alias("chunk_budget"), F.lit(None).cast("int").alias("chunk_overlap"))).first().note == "assumed"
    over, summary = index.truncation_report(spark.createDataFrame([(1, "t", 9), (2, "t", 3), (3, "p", 5)], "id long, kind string, n int"), "id", "n", "kind", 4)
    assert [r.id for r in over.collect()] == [1, 3] and {r.kind: r.share_over for r in summary.collect()} == {"t": 0.5, "p": 1.0}


def test_each_fault_fails_its_check(spark):
    table = "array<struct<table_index:int,caption:string,headers:array<string>,rows:array<array<string>>,n_rows:int,n_cols:int,statement_title:string>>"
    kind = f"section_key long, accession_no string, section_pos int, section_id string, item string, text string, n_chars int, tables {table}"
    good = [(i, "a", i, f"s{i}", it, "text 1,234", 10, [(0, "", ["a"], [["5,678"]], 1, 1, "Balance")]) for i, it in enumerate(quality_gate.KEY_ITEMS)]
    clean = spark.createDataFrame(good, kind)
    assert quality_gate.integrity(clean).count() == 0 and quality_gate.key_items(clean).count() == 0 and quality_gate.statement_titles(clean).count() == 0
    bad = spark.createDataFrame(good[1:] + [(1, "a", 2, "other", "2", "", 3, [(0, "", ["a"], [], 4, 1, "")])], kind)
    problems = {r.problem for r in quality_gate.integrity(bad).collect()}
    assert problems == {"repeated key", "two sections at one position", "no text", "n_chars is not the length", "n_rows is not the number of rows"}
    assert [r.problem for r in quality_gate.key_items(bad).collect()] == ["no item 1"]
    passages = spark.createDataFrame([(i, "text  1,234") for i in range(5)], "section_key long, text string")
    assert quality_gate.figures_kept(clean, passages, "section_key").count() == 0
    lost = clean.withColumn("text", F.lit("text 1,234 and 9,999"))
    assert quality_gate.figures_kept(lost, passages, "section_key").count() == 5
    blocks = spark.createDataFrame([(0, 0, "text\n1,234"), (1, 0, "gone")], "section_key long, position int, block string")
    assert [r.subject for r in quality_gate.prose_kept(blocks, passages, "section_key").collect()] == ["1 0"]
    filings = spark.createDataFrame([("A", 2020, "x"), ("A", 2020, "y"), ("Z", 2020, "z")], "ticker string, fiscal_year int, accession_no string")
    tickers = spark.createDataFrame([("a",)], "ticker string")
    assert sorted(r.problem for r in quality_gate.coverage(filings, tickers, [2020, 2021]).collect()) == ["filed more than once", "missing", "out of scope"]
    gate = {r.check: (r.n_problems, r.passed) for r in quality_gate.gate({"integrity": quality_gate.integrity(bad), "key_items": quality_gate.key_items(clean)}, {"key_items": "integrity"}).collect()}
    assert gate["integrity"][1] is False and gate["key_items"] == (None, None)
    sizes = spark.createDataFrame([("prose", 9), ("prose", 2), ("table", 9)], "kind string, n int")
    assert [r.subject for r in quality_gate.passage_sizes(sizes, "kind", "n", 5, {"prose": 0.5}).collect()] == ["table"]


def test_prose_kept_sees_long_paragraphs(spark, rows):
    long_ = " ".join(f"Sentence number {i} of a long paragraph ends here." for i in range(120))
    sections = spark.createDataFrame([(1, f"Short one.\n\n{long_}\n\n{'x' * 5000}", 0)], "section_key long, text string, n_tables int")
    blocks = chunking.rejoined(chunking.paragraphs(sections, "section_key"), "section_key")
    kept = chunking.prose_passages(sections, "section_key")
    assert quality_gate.prose_kept(blocks, kept, "section_key").count() == 0
    without = kept.withColumn("text", F.replace("text", F.lit("Sentence number 70 of"), F.lit("")))
    got = quality_gate.prose_kept(blocks, without, "section_key").collect()
    assert [(r.subject, r.problem) for r in got] == [("1 1", "1 of 4 pieces of a paragraph in no passage")]


def test_prose_kept_does_not_trust_the_cut(spark):
    from quarrystone.operators.quality_gate import _cut

    import pandas as pd

    cut = _cut(20).func
    block = "One sentence here. Another sentence here."
    assert list(cut(pd.Series([block, None]))) == [chunking.cut_block(block, 20), None]
    whole, chunking.cut_block = chunking.cut_block, lambda b, n: [b[:n]]
    try:
        assert cut(pd.Series([block]))[0] == [block[:20], block]
    finally:
        chunking.cut_block = whole


def test_gate_reports_prose_where_integrity_fails(spark):
    import os

    from quarrystone.plans import queries

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    got = {r.check: r.n_problems for r in queries.corpus_gate(spark, "/root/testdata/sf0.001").collect()}
    assert got["integrity"] > 0 and got["prose_kept"] == 0
