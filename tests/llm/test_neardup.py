import random
import re

from quarrystone.llm.neardup import Fingerprint, _hot_pairs, near_duplicates, shingle_hashes, word_hashes


def shingles(text, n):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return set(zip(*[w[i:] for i in range(n)])), len(w)


def brute(docs, n, threshold, least):
    sets = {i: shingles(t, n) for i, t in docs}
    ids = sorted(i for i, (_, k) in sets.items() if k >= least)
    out = set()
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            s, t = sets[a][0], sets[b][0]
            if len(s & t) >= threshold * len(s | t):
                out.add((a, b))
    return out


def variants(seed, families, copies, words=90):
    rng = random.Random(seed)
    vocabulary = [f"term{i}" for i in range(3000)]
    docs, i = [], 0
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for k in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 6) if k else 0):
                p = rng.randrange(len(w))
                rng.choice([lambda: w.__setitem__(p, "new"), lambda: w.insert(p, "extra"), lambda: w.pop(p)])()
            docs.append((i, rng.choice([" ", "\n", "-"]).join(w)))
            i += 1
    return docs


def near(docs, threshold):
    """Pairs within 0.05 of the threshold may go either way only by chance of the fingerprint, never by the exact check."""
    return brute(docs, 3, threshold - 0.05, 60)


def test_pairs_against_brute_force(spark):
    docs = variants(1, 25, 5) + [(900, None), (901, ""), (902, "too short"), (903, "Term1 " * 80), (904, "term1, " * 80)]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "section_key long, text string, class string")
    found = near_duplicates(df, "section_key", "text", words=3, threshold=0.6)
    got = [tuple(r) for r in found.pairs().collect()]
    want = brute(docs, 3, 0.6, 60)
    assert len(got) == len(set(got)) and set(got) == want and (903, 904) in want


def test_hot_buckets_take_the_block_join(spark):
    docs = variants(2, 1, 90) + variants(3, 2, 3)
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    df = spark.createDataFrame(docs, "id long, text string")
    few = near_duplicates(df, "id", "text", words=3, threshold=0.6, most_in_bucket=8)
    assert {tuple(r) for r in few.pairs().collect()} == brute(docs, 3, 0.6, 60)


def test_groups_cover_every_row(spark):
    docs = variants(5, 3, 4) + [(500, None), (501, "short")]
    df = spark.createDataFrame(docs, "id long, text string")
    got = {r.id: (r["class"], r.group, r.n_links) for r in near_duplicates(df, "id", "text", words=3, threshold=0.5).groups().collect()}
    assert set(got) == {i for i, _ in docs}
    assert got[500] == (500, 500, 0) and got[501] == (501, 501, 0)
    assert all(got[i][1] == i // 4 * 4 for i in range(12))


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "id long, text string"), "id", "text").pairs().count() == 0


def test_words_are_runs_of_letters_and_digits():
    assert len(word_hashes("Äb-c 12x internationalization's É")) == 5
    assert (word_hashes("A-b") == word_hashes("a b")).all()
    assert word_hashes("internationalization")[0] != word_hashes("internationalizatiom")[0]
    assert len(shingle_hashes(word_hashes("a b c a b c a b c"), 3)) == 3


def test_the_distance_bound_follows_the_threshold():
    fp = Fingerprint()
    assert fp.most_distance(0.6) < fp.most_distance(0.4) < fp.width


def test_texts_that_share_half_meet_in_hot_buckets_and_join_nothing(spark):
    rng = random.Random(7)
    form = [f"form{i}" for i in range(60)]
    docs = [(i, " ".join(form + [f"own{rng.randrange(10**9)}" for _ in range(60)])) for i in range(300)]
    # and some that differ in a few words only
    docs += [(1000 + i, " ".join(form + [f"like{j}" for j in range(58)] + [f"x{i}", f"y{i}"])) for i in range(40)]
    df = spark.createDataFrame(docs, "id long, text string")
    found = near_duplicates(df, "id", "text", words=3, threshold=0.6, most_in_bucket=8)
    pairs = {tuple(r) for r in found.pairs().collect()}
    assert pairs == {(1000 + a, 1000 + b) for a in range(40) for b in range(a + 1, 40)}
    assert _hot_pairs(df.select("id"), df, 3, 0.6).count() == len(pairs)
