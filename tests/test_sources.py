import json

import pytest
from pyspark.sql import functions as F

from quarrystone import jobs, schemas
from quarrystone.sources import filings, records
from quarrystone.streaming import jobs as streams

QUESTION = {"question_id": "q1", "question": "Why?", "expected_answer": "So", "supporting_chunk_ids": ["1"], "hard_negative_chunk_ids": [], "question_type": "factual", "difficulty": "easy"}


def test_ticker_lists(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# head\n aapl # note\n\nMSFT\n")
    assert [r.ticker for r in records.read_tickers(spark, str(tmp_path / "t.txt")).collect()] == ["AAPL", "MSFT"]
    with pytest.raises(Exception):
        records.read_tickers(spark, str(tmp_path / "none.txt")).collect()


def test_strict_lenient_and_recovered_lines(spark, tmp_path):
    f = tmp_path / "q.jsonl"
    f.write_text(json.dumps(QUESTION) + "\n" + json.dumps(QUESTION)[:30])
    with pytest.raises(Exception):
        records.read_strict(spark, str(f), schemas.QUESTION).collect()
    assert records.read_lenient(spark, str(f), schemas.QUESTION).count() == 1
    assert records.read_recovered(spark, str(f), schemas.QUESTION).count() == 1
    assert records.read_strict(spark, str(tmp_path / "no"), schemas.QUESTION, missing_ok=True).count() == 0
    f.write_text("broken\n" + json.dumps(QUESTION) + "\n")
    with pytest.raises(Exception):
        records.read_recovered(spark, str(f), schemas.QUESTION).collect()


def test_line_problems(spark, tmp_path, rows):
    f = tmp_path / "q.jsonl"
    f.write_text("\ufeff" + json.dumps(QUESTION) + "\n\n{bad\n[1]\n{}\n" + json.dumps(QUESTION) + "\n", encoding="utf-8")
    got = rows(records.line_problems(spark, str(f), "question_id"))
    assert got == [(1, "repeated question_id"), (3, "no JSON"), (4, "no object"), (5, "no question_id"), (6, "repeated question_id")]


def test_question_problems(spark, rows):
    data = [("a", "Why?", ["1"], ["1"], "factual"), ("b", " ", ["9"], [], "odd"), ("c", "x", [], [], "unanswerable"), ("d", "x", [], None, "factual"), ("e", "x", ["1"], [], "factual")]
    q = spark.createDataFrame(data, "question_id string, question string, supporting_chunk_ids array<string>, hard_negative_chunk_ids array<string>, question_type string")
    got = rows(records.question_problems(q, spark.createDataFrame([(1,)], "chunk_id long")))
    assert got == [("a", "a passage is supporting and negative"), ("b", "no passage 9"), ("b", "no question"), ("b", "unknown type"), ("d", "passages and type do not agree")]


def test_logs_and_replaced_tables(spark, tmp_path):
    d = spark.createDataFrame([(1, "a")], "id long, v string")
    records.append_rows(d, str(tmp_path / "log"))
    records.append_rows(d.withColumn("id", F.lit(2)), str(tmp_path / "log"))
    log = spark.read.json(str(tmp_path / "log"))
    assert log.count() == 2
    assert records.new_only(spark.range(4), log, "id").count() == 2
    for v in ("x", "y"):
        records.replace_table(d.withColumn("v", F.lit(v)), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).first().v == "y" and len(list(tmp_path.glob("t*"))) == 1
    records.write_comparison(d.withColumn("m", F.array(F.lit(1))), str(tmp_path / "run"), ["v", "absent", "m"])
    assert spark.read.option("header", True).csv(str(tmp_path / "run/summary")).columns == ["v", "absent", "m"]
    runs = records.read_runs(spark, str(tmp_path / "log"), "id long, v string")
    assert runs.count() == 2 and "modified" in runs.columns


def test_an_index_needs_its_manifest_and_fingerprint(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta", "A", 2020, "1", "prose")], "doc_id long, text string, ticker string, fiscal_year int, item string, content_type string")
    docs.write.parquet(str(tmp_path / "docs"))
    out = str(tmp_path / "index")
    assert jobs.check(spark, str(tmp_path / "docs"), out) == ["no manifest"]
    jobs.bm25(spark, str(tmp_path / "docs"), out)
    assert jobs.check(spark, str(tmp_path / "docs"), out) == []
    mark = spark.read.json(out + "/manifest").first().fingerprint
    assert records.load_index(spark, out, ["postings"], mark)["postings"].count() == 2
    with pytest.raises(ValueError):
        records.load_index(spark, out, ["postings"], "other")
    docs.withColumn("text", F.lit("changed")).write.mode("overwrite").parquet(str(tmp_path / "docs"))
    assert len(jobs.check(spark, str(tmp_path / "docs"), out)) == 1
    records.remove(spark, out + "/manifest")
    with pytest.raises(ValueError):
        records.load_index(spark, out, ["postings"], mark)


def test_filters_reach_the_filing_source(spark, tmp_path):
    rows = [("A", 1, "Co", "10-K", "2021-01-01", "a1", "", "", "2020-12-31"), ("B", 2, "Co", "10-K/A", "2021-01-01", "b1", "", "", "2020-12-31")]
    spark.createDataFrame(rows, schemas.FILING).coalesce(1).write.parquet(str(tmp_path / "f"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    filings.register(spark)
    df = spark.read.format("filings").option("path", str(tmp_path / "f")).load()
    assert df.count() == 2
    assert [r.accession_no for r in df.where("ticker = 'B' and form in ('10-K/A', '10-Q')").collect()] == ["b1"]


PAGE = """<html><head><style>p{}</style></head><body><p>Item 1. Business</p><p>Item 7. Management</p>
<div>Item 1. Business</div><p>We sell &amp; rent<br/>pumps.</p><p>Item 7. Management's Discussion</p><p>Selected figures</p>
<table><tr><th></th><th>2021</th><th>2020</th></tr><tr><td>Sales</td><td>$</td><td>1,234</td></tr><tr><td>Cost</td><td>(5</td><td>)</td></tr></table><p>End.</p></body></html>"""


def test_html_to_sections(spark):
    pages = spark.createDataFrame([("a", PAGE), ("b", "plain text"), ("c", None)], "k string, html string")
    got = {(r.key, r.item): r for r in filings.parse_filings(pages, "k", "html").collect()}
    assert got[("a", "1")].text == "We sell & rent\n\npumps." and got[("a", "1")].is_key_section
    seven = got[("a", "7")]
    assert seven.n_tables == 1 and seven.tables[0].headers[1:] == ["2021", "2020"][: len(seven.tables[0].headers) - 1] and seven.tables[0].caption == "Selected figures"
    assert seven.tables[0].rows[0][:2] == ["Sales", "$1,234"] and got[("b", None)].problem and got[("c", None)].problem
    sections = spark.createDataFrame([("f", "8", "see item 15"), ("f", "15", "x" * 600), ("g", "8", "short"), ("g", "15", "short"), ("h", "8", "y" * 900)], "k string, item string, text string")
    assert {(r.k, r.item): r.resolved_from for r in filings.resolve_stubs(sections, "k").collect()} == {("f", "8"): "15", ("f", "15"): None, ("g", "8"): None, ("g", "15"): None, ("h", "8"): None}


def test_streams(spark, tmp_path):
    src = spark.createDataFrame([(1, "2024-01-01 00:10:00", 7, "a", 1.0), (2, "2024-01-01 00:20:00", 7, "a", 2.0), (3, "2024-01-01 05:00:00", 8, "b", 3.0)], "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    src.write.parquet(str(tmp_path / "in"))
    kind = "event_id long, t string, user_id long, event_type string, value double, ts timestamp"
    stream = streams.follow(spark, str(tmp_path / "in"), kind, "parquet")
    q = streams.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.event_type, r.n, r.total) for r in spark.sql("select * from counts").collect()][:1] == [("a", 2, 3.0)]
    q = streams.sessions(stream).writeStream.format("memory").queryName("runs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.sql("select * from runs where user_id = 7").collect()] == [2]
    for _ in range(2):
        streams.once(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_upserts_keep_the_newest_row(spark, tmp_path):
    kind = "id long, v string, at long"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([(1, "a", 1), (2, "b", 1)], [(1, "c", 2), (2, "old", 0), (3, "d", 1)], []):
        spark.createDataFrame(batch, kind).write.mode("append").parquet(src)
        streams.upsert_latest(streams.follow(spark, src, kind, "parquet"), out, "id", "at", str(tmp_path / "c")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, "c", 2), (2, "b", 1), (3, "d", 1)]


def test_upserts_touch_only_the_buckets_of_a_batch(spark, tmp_path):
    kind = "id long, v string, at long"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    stamps = []
    for batch in ([(i, "a", 1) for i in range(40)], [(7, "c", 2)]):
        spark.createDataFrame(batch, kind).write.mode("append").parquet(src)
        streams.upsert_latest(streams.follow(spark, src, kind, "parquet"), out, "id", "at", str(tmp_path / "c"), buckets=4).awaitTermination()
        stamps.append({str(p) for p in (tmp_path / "out").rglob("*.parquet")})
    got = spark.read.parquet(out)
    assert got.count() == 40 and got.where("id = 7").first().v == "c" and len(stamps[0] & stamps[1]) >= 3


def test_a_table_is_whole_after_a_crash_between_two_moves(spark, tmp_path):
    t = str(tmp_path / "t")
    records.replace_table(spark.range(3), t)
    (tmp_path / "t").rename(tmp_path / "t.old")
    records.recover(spark, t)
    assert spark.read.parquet(t).count() == 3
    spark.range(5).write.parquet(f"{t}.fresh")
    (tmp_path / "t").rename(tmp_path / "t.old")
    records.recover(spark, t)
    assert spark.read.parquet(t).count() == 5 and not (tmp_path / "t.old").exists()


def test_headings_may_be_long_and_sentences_are_none():
    long_title = "Item 5. " + "Market for Registrant's Common Equity, Related Stockholder Matters " * 5
    page = f"<html><body><!--{'x' * 30000}--><p>{long_title}</p><p>We have holders.</p><p>Item 7 of this report discusses it.</p><p>Item 9A. Controls. They are good. Very good.</p></body></html>"
    got = filings.read_html(page)
    assert [s["item"] for s in got] == ["5"] and len(got[0]["blocks"]) == 3


def test_partial_answers_only_grow():
    whole = '```json\n{"answerable": true, "sentences": [{"text": "A \\"b\\" \\u00e9\\n.", "sources": [1]}, {"text": "Next one.", "sources": []}]}\n```'
    shown = [streams.partial_prose(whole[:i]) for i in range(len(whole) + 1)]
    assert shown[-1] == 'A "b" é\n. Next one.'
    assert all(shown[-1].startswith(s.rstrip()) for s in shown)
    assert streams.partial_prose('{"answerable": false, "sent') == "The filings do not answer this question."
    assert streams.partial_prose("Plain te") == "Plain te"
