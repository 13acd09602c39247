import pytest

from quarrystone.llm.pairs import broken_pairs, generation_pairs

Q = "What was Nolgarnol Energy's gross margin in fiscal year 2014?"
CASES = [
    (Q, None, "empty"), (Q, "  ​ ", "empty"), (Q, "[1]", "empty"), (Q, "N/A", "empty"), (Q, "(blank)", "empty"), (Q, "— —", "empty"), (Q, "TBD TBD", "empty"),
    (Q, "It amounted to $1,497.1 million.", None), (Q, "$4,980.2 million / $6,684.7 million", None), (Q, "Marhadpol, Prakelmihad", None), (Q, "9.1%", None),
    (Q, "It amounted to ", "truncated"), (Q, "The filing says that management could not estimate the loss from the Kel", "truncated"), (Q, "Nolgarnol, Tevgar,", "truncated"),
    (Q, "It was held at Trigallun Inc.", "truncated"), (Q, "The storage (approx. $19.42 billion", "truncated"), (Q, "Our capacity is…", "truncated"),
    (Q, "I'm sorry, but I cannot help with that request.", "refusal"), (Q, "My apologies: my guidelines keep me from commenting on Zantevcor Inc.", "refusal"), (Q, "Nothing I was shown lets me reply.", "refusal"),
    (Q, "The filing says that management could not estimate the loss from the Kelcorzan matter and recorded no accrual.", None), (Q, "Zorhadlix Holdings was unable to obtain insurance for the Corhadpra site in 2021.", None),
    (Q, "You asked: what was Nolgarnol Energy's gross margin in FY 2014", "copies_question"), (Q, Q, "copies_question"), (Q, f"{Q} {Q}", "copies_question"), (Q, "The gross margin of Nolgarnol Energy was 65.0% in 2014.", None),
    (Q, "La provision a financé la chaîne logistique chez Sel, alors que le stock a réduit la demande.", "other_language"), (Q, "De onderneming verwacht niet dat Cor een groot effect heeft op de kosten van dit jaar.", "other_language"),
    ("¿Qué riesgos menciona Tevtallix Systems en 2025 sobre tesorería?", "Some deployments and pensions of Yst broadly reflected material attrition.", "other_language"),
    ("Welche Risiken nennt Junruksel Systems für 2016 in Bezug auf Umsatzerlöse?", "Dazu kann ich keine Auskunft geben.", "refusal"),
    (Q, "Unfortunately, the material in front of me gives no basis for a response.", "refusal"),
    (Q, "Unfortunately, the material in front of me gives no basis for a response, since none of the excerpts that came with the question, neither the notes nor the tables nor the letters, touches on that topic in any way at all.", "refusal"),
    (Q, "Unfortunately, the company lost two of its plants to the flood in the spring, and demand for the remaining products was weak throughout the whole of the year, so that the margin of the segment came out lower than planned.", None),
    ("Quels risques Vorkellix cite-t-elle en 2017 au sujet de trésorerie ?", "Désolé, je préfère ne pas répondre.", "refusal"), (None, "It amounted to 5%.", None), (None, None, "empty"),
]


def test_defects(spark):
    df = spark.createDataFrame([("t", i, q, a, a, "x") for i, (q, a, _) in enumerate(CASES)], "pair_table string, pair_id long, question string, answer string, last_sentence string, tail string")
    got = {r.pair_id: (r.defect, r.defects) for r in broken_pairs(df).collect()}
    wrong = [(CASES[i][:2], CASES[i][2], got[i]) for i in range(len(CASES)) if got[i][0] != CASES[i][2]]
    assert not wrong


def test_generation_pairs(spark):
    g = spark.createDataFrame(
        [(1, 10, True, [("A whole answer.", [1]), ("It stops he", [])]), (2, 10, True, []), (3, 99, True, [(None, None)]), (4, 10, False, [("x", [])]), (5, 10, None, None)],
        "generation_id long, question_id long, answerable boolean, sentences array<struct<text:string,sources:array<int>>>",
    )
    q = spark.createDataFrame([(10, Q), (10, Q)], "question_id long, question string")
    got = {r.pair_id: r.defect for r in broken_pairs(generation_pairs(g, q)).collect()}
    assert got == {1: "truncated", 2: "empty", 3: "empty"}


def test_no_rows(spark):
    df = spark.createDataFrame([], "pair_table string, pair_id long, question string, answer string, last_sentence string")
    assert broken_pairs(df).count() == 0
