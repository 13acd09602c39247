import random

import pytest

from quarrystone.llm import winnow
from quarrystone.llm.spans import maximal_spans, shared_share, shared_spans

WORDS = [f"w{i}" for i in range(4000)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def brute(docs, least):
    """Every window of every text, compared as strings."""
    seen = {}
    texts = {}
    for i, t in docs:
        texts.setdefault(t, []).append(i)
    for t in texts:
        for s in range(len(t or "") - least + 1):
            seen.setdefault(t[s : s + least], set()).add(t)
    out = {}
    for t, ids in texts.items():
        if t is None or len(t) < least:
            continue
        if len(ids) > 1:
            hit = [True] * len(t)
        else:
            hit = [False] * len(t)
            for s in range(len(t) - least + 1):
                if len(seen[t[s : s + least]]) > 1:
                    hit[s : s + least] = [True] * least
        spans, open_ = [], None
        for p, h in enumerate([*hit, False]):
            if h and open_ is None:
                open_ = p
            elif not h and open_ is not None:
                spans.append((open_, p))
                open_ = None
        for i in ids:
            if spans:
                out[i] = spans
    return out


def run(spark, docs, least=60, anchor=24):
    df = spark.createDataFrame(docs, "doc_id long, text string, h string")
    got = {}
    for r in shared_spans(df, "doc_id", "text", least, anchor).collect():
        got.setdefault(r.id, []).append((r.start, r.end))
    return {k: sorted(v) for k, v in got.items()}


@pytest.mark.parametrize("seed", range(4))
def test_against_all_windows(spark, seed):
    rng = random.Random(seed)
    block = [prose(rng, rng.randint(8, 40)) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 20))]
        for _ in range(rng.randint(0, 2)):
            b = rng.choice(block)
            a = rng.randint(0, len(b) // 2)
            parts += [b[a : a + rng.randint(20, len(b))], prose(rng, rng.randint(0, 10))]
        docs.append((i, rng.choice(["", " ", "\n"]).join(parts), "x"))
    docs += [(100, docs[3][1], "x"), (101, None, None), (102, "", ""), (103, "a" * 400, ""), (104, "b" + "a" * 200, ""), (105, "é–" * 90, ""), (106, "x" + "é–" * 60, "")]
    docs += [(107, ("ab" * 100), ""), (108, "ab" * 70 + "c", "")]
    assert run(spark, docs) == brute([(i, t) for i, t, _ in docs], 60)


def test_the_length_is_a_threshold(spark):
    rng = random.Random(9)
    for n, found in ((60, True), (59, False)):
        s = prose(rng, 60)[:n]
        docs = [(1, prose(rng, 30) + "<" + s + ">" + prose(rng, 9), ""), (2, prose(rng, 5) + "[" + s + "]", "")]
        assert bool(run(spark, docs)) is found


def test_a_hot_passage_and_repetition_within(spark):
    rng = random.Random(4)
    common = prose(rng, 60)
    docs = [(i, f"{prose(rng, 6)} {common} {prose(rng, 6)}", "") for i in range(120)]
    own = prose(rng, 30)
    docs.append((999, own + " | " + own, ""))
    got = run(spark, docs)
    assert set(got) == set(range(120)) and all(len(v) == 1 and v[0][1] - v[0][0] >= len(common) for v in got.values())


def test_rows_of_one_id_and_of_none(spark):
    rng = random.Random(8)
    common, other = prose(rng, 30), prose(rng, 60)
    docs = [(1, other, ""), (1, prose(rng, 9) + common + prose(rng, 9), ""), (2, common + prose(rng, 9), ""), (None, common, ""), (3, common[:80] + prose(rng, 9), "")]
    got = run(spark, docs)
    assert set(got) == {1, 2, 3} and len(got[1]) == 1


def test_empty_table_and_shares(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shared_spans(empty, "doc_id", "text").count() == 0
    t = "abc " * 100
    df = spark.createDataFrame([(1, t), (2, t), (3, "x"), (4, None)], "doc_id long, text string")
    got = {r.id: (r.n_chars, r.n_spans, r.shared_chars, r.share) for r in shared_share(df, "doc_id", "text").collect()}
    assert got == {1: (400, 1, 400, 1.0), 2: (400, 1, 400, 1.0), 3: (1, 0, 0, 0.0), 4: (0, 0, 0, 0.0)}
    with pytest.raises(ValueError):
        shared_spans(df, "doc_id", "text", 50, 60)


def test_every_window_holds_an_anchor():
    rng = random.Random(2)
    text = "".join(rng.choice("abc ") for _ in range(900))
    h = winnow.RollingHash(text).all_windows(16)
    at = set(winnow.anchors(h, 20).tolist())
    assert all(any(p in at for p in range(s, s + 20)) for s in range(len(h) - 19))


def brute_runs(docs, least):
    """Maximal runs of each text that stand in another one, by growing each start as strings."""
    texts = {}
    for i, t in docs:
        if t is not None and len(t) >= least:
            texts.setdefault(t, []).append(i)
    out = {}
    for t, ids in texts.items():
        others = [u for u in texts if u != t]
        runs, e = [], 0
        for s in range(len(t) - least + 1):
            e, had = max(e, s + least - 1), e
            while e < len(t) and any(t[s : e + 1] in u for u in others):
                e += 1
            if e - s >= least and e > had:
                runs.append((s, e))
        for i in ids:
            if len(ids) > 1:
                out[i] = [(0, len(t))]
            elif runs:
                out[i] = runs
    return out


def runs_of(spark, docs, least=60, anchor=24):
    got = {}
    for r in maximal_spans(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", least, anchor).collect():
        got.setdefault(r.id, []).append((r.start, r.end))
        texts = dict(docs)
        assert r.other_id != r.id and texts[r.id][r.start : r.end] in texts[r.other_id]
    return {k: sorted(v) for k, v in got.items()}


@pytest.mark.parametrize("seed", range(6))
def test_maximal_runs_against_growing(spark, seed):
    rng = random.Random(seed)
    block = [prose(rng, rng.randint(8, 30)) for _ in range(4)]
    docs = []
    for i in range(40):
        parts = [prose(rng, rng.randint(0, 6))]
        for _ in range(rng.randint(0, 3)):
            b = rng.choice(block)
            a = rng.randint(0, len(b) // 2)
            parts += [b[a : a + rng.randint(20, len(b))], prose(rng, rng.randint(0, 3))]
        docs.append((i, rng.choice(["", " ", "\n"]).join(parts)))
    docs += [(100, docs[3][1]), (101, None), (102, ""), (103, "a" * 200), (104, "b" + "a" * 120), (105, "é–" * 90), (106, "x" + "é–" * 60), (107, "ab" * 50), (108, "ab" * 40 + "c")]
    assert runs_of(spark, docs) == brute_runs(docs, 60)


def test_neighbouring_repeats_of_two_texts_are_two_runs(spark):
    rng = random.Random(5)
    a, b = prose(rng, 30), prose(rng, 30)
    docs = [(1, a + b), (2, "<" + a + ">" + prose(rng, 9)), (3, "[" + b + "]" + prose(rng, 9))]
    assert runs_of(spark, docs)[1] == [(0, len(a)), (len(a), len(a + b))]
    got = {r.id: (r.n_spans, r.share) for r in shared_share(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 140).collect()}
    assert got[1] == (2, 1.0)
