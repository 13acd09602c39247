import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.llm.quality import FEATURES, label_of, text_statistics, text_verdicts
from quarrystone.llm.rules import Condition, Rule, RuleList, induce

PROSE = "We may be unable to finance the plans that were set out in the report, and it is not clear whether this will be enough for all of our needs. "
LIST = "\n".join(f"({chr(97 + i)}) deferred yield and packaging;" for i in range(12))
TABLE = "(in thousands)\t2020\t2019\n" + "\n".join(f"Coastal renewals\t{363 + i},815\t(155,{413 + i})" for i in range(12))
JUNK = "\n".join("qL0" + "aZ9+/bQ" * 10 for _ in range(8))


def test_statistics_by_hand(spark):
    df = spark.createDataFrame([(1, "The cat sat. 12!\n\n- a b", "x"), (2, None, None), (3, "", ""), (4, " \n ", "")], "id long, text string, n_chars string")
    got = {r.id: r for r in text_statistics(df, "id", "text").collect()}
    one = got[1]
    assert (one.n_chars, one.n_words, one.n_lines) == (23, 6, 2)
    assert one.mean_word_chars == pytest.approx(11 / 5) and one.common_share == pytest.approx(2 / 5, abs=1e-6)
    assert one.ended_lines_share == 0.5 and one.digit_share == pytest.approx(2 / 16)
    for i in (2, 3, 4):
        assert all(got[i][f] == 0.0 for f in FEATURES) and got[i].n_words == 0


def test_the_learned_rules_hold_on_other_rows(spark):
    rng = np.random.default_rng(1)
    make = {"prose": PROSE * 3, "list": LIST, "table": TABLE, "junk": JUNK}
    rows = []
    for i in range(240):
        kind = list(make)[i % 4] if i % 2 else "prose"
        rows.append((i, make[kind][rng.integers(0, 20) :] + ("\n" + PROSE if i % 3 == 0 and kind != "prose" else ""), kind))
    df = spark.createDataFrame(rows, "id long, text string, kind string")
    got = text_verdicts(df, "id", "text").join(df.select("id", "kind"), "id")
    assert got.where("verdict = kind").count() >= 235


def test_null_and_blank_have_no_verdict(spark):
    df = spark.createDataFrame([(1, None), (2, "  "), (3, PROSE)], "id long, text string")
    rules = RuleList((Rule("junk", (Condition("junk_share", True, 0.5),)),), "prose")
    got = {r.id: r.verdict for r in text_verdicts(df, "id", "text", rules).collect()}
    assert got == {1: None, 2: None, 3: "prose"}
    assert text_verdicts(df.limit(0), "id", "text").count() == 0


def test_labels():
    assert [label_of(x) for x in (PROSE, LIST, TABLE, JUNK, "", PROSE + "\n" + LIST[:60])] == ["prose", "list", "table", "junk", "junk", "prose"]
    assert label_of(TABLE.replace("\t", "\n")) == "table"


def test_induced_rules_and_their_sql(spark):
    rng = np.random.default_rng(0)
    x, y = rng.random(600), rng.random(600)
    labels = np.where(x > 0.7, "a", np.where(y < 0.2, "b", "c")).astype(object)
    rules = induce({"x": x, "y": y}, labels, "c")
    assert (rules.predict({"x": x, "y": y}) == labels).mean() > 0.98
    df = spark.createDataFrame([(float(p), float(q)) for p, q in zip(x[:50], y[:50])], "x double, y double")
    said = [r.v for r in df.select(F.expr(rules.sql()).alias("v")).collect()]
    assert said == list(rules.predict({"x": x[:50], "y": y[:50]}))
    assert induce({"x": np.empty(0)}, np.empty(0, dtype=object), "c").sql() == "'c'"


def test_rules_from_a_given_table_of_labelled_documents(spark):
    make = {"prose": PROSE * 2, "list": LIST, "table": TABLE, "junk": JUNK}
    labelled = spark.createDataFrame([(i, make[k][i % 7 :], k) for i in range(120) for k in [list(make)[i % 4]]], "id long, text string, label string")
    df = spark.createDataFrame([(i, make[k][3 + i % 5 :] * 2, k) for i in range(40) for k in [list(make)[i % 4]]], "id long, text string, kind string")
    got = text_verdicts(df, "id", "text", labelled=labelled).join(df.select("id", "kind"), "id")
    assert got.where("verdict = kind").count() == 40
