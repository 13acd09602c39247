import random

import pytest

from quarrystone.llm.mixing import mix_sources
from quarrystone.llm.packing import fill_report, pack, pack_counts
from quarrystone.llm.tokens import VOCABULARY, encoding, token_sizes

KINDS = "container_id int, name string, capacity_tokens int, separator_tokens int"


@pytest.mark.parametrize("seed", range(6))
def test_layout_places_every_item_within_the_capacity(seed):
    rng = random.Random(seed)
    capacity, sep = rng.choice([(50, 0), (64, 1), (100, 2)])
    counts = {}
    for _ in range(rng.randint(1, 400)):
        s = rng.randint(0, capacity)
        counts[s] = counts.get(s, 0) + rng.randint(1, 30)
    runs, n = pack_counts(counts, capacity, sep)
    bins, placed = {}, {}
    for r in runs:
        assert r.first == placed.get(r.size, 0)
        placed[r.size] = r.first + r.bins * r.per_bin
        for b in range(r.bin, r.bin + r.bins):
            bins.setdefault(b, []).extend([r.size] * r.per_bin)
    assert placed == counts and set(bins) == set(range(n))
    assert all(sum(b) + sep * (len(b) - 1) <= capacity for b in bins.values())
    assert all(sum(3 * s > capacity for s in b) <= 2 for b in bins.values())
    least = -(-sum(s * k for s, k in counts.items()) // capacity)
    big = sum(k for s, k in counts.items() if 2 * s > capacity)
    assert n <= 1.25 * max(least, big) + 2


def test_packing_cuts_only_what_is_too_large(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 300)) for i in range(500)] + [(1000, 100), (1001, None), (1002, 0), (1003, 201)]
    kinds = spark.createDataFrame([(1, "a", 100, 0), (2, "b", 128, 1)], KINDS)
    sizes = spark.createDataFrame(rows, "id long, n_tokens long")
    got = pack(sizes, kinds).toPandas()
    cap, sep = {1: 100, 2: 128}, {1: 0, 2: 1}
    for c, part in got.groupby("container_id"):
        per = part.groupby("bin").n_tokens.agg(["sum", "size"])
        assert (per["sum"] + sep[c] * (per["size"] - 1) <= cap[c]).all() and set(per.index) == set(range(len(per)))
        back = part.groupby("id").n_tokens.sum()
        assert back.to_dict() == {i: (n or 0) for i, n in rows}
        cut = part.groupby("id").size()
        assert {i for i in cut[cut > 1].index} == {i for i, n in rows if (n or 0) > cap[c]}
        for i, pieces in part.groupby("id"):
            p = pieces.sort_values("piece")
            assert list(p.piece) == list(range(len(p))) and list(p.start_token) == [k * cap[c] for k in range(len(p))]
    report = {r.container_id: r for r in fill_report(pack(sizes, kinds), kinds).collect()}
    assert report[1].filled_share > 0.97 and report[1].n_containers >= report[1].least_containers
    assert pack(sizes.limit(0), kinds).count() == 0 and pack(sizes, kinds.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack_counts({5: 1}, 4, 0)


def test_shares_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["Big-Source ", "big_source"]), rng.randint(1, 500)) for i in range(3000)]
    rows += [(5000 + i, "small", rng.randint(1, 500)) for i in range(200)] + [(9000, None, 5), (9001, "other", 5), (9002, "small", 0), (9003, "small", None)]
    sizes = spark.createDataFrame(rows, "id long, source string, n_tokens long")
    targets = spark.createDataFrame([("m", "big_source", 0.5, 1), ("m", "small", 0.3, 4), ("m", "absent", 0.2, 3), ("n", "small", 1.0, 2)], "mix string, source string, target_share double, max_repeats int")
    out = mix_sources(sizes, targets)
    report = {(r.mix, r.source): r for r in out.report.collect()}
    assert report[("m", "small")].most_copies <= 4 and report[("m", "big_source")].most_copies <= 1 and report[("m", "absent")].tokens == 0
    for k in (("m", "big_source"), ("m", "small")):
        assert report[k].actual_share == pytest.approx(report[k].wanted_share, abs=0.01)
    assert report[("n", "small")].actual_share == 1.0 and report[("n", "small")].most_copies == 2
    ids = {r.id for r in out.selection.where("mix = 'm'").collect()}
    assert not ids & {9000, 9001, 9002, 9003}
    short = {r.source: r for r in mix_sources(sizes, targets, total_tokens=10_000_000).report.where("mix = 'm'").collect()}
    assert short["small"].most_copies == 4 and short["big_source"].docs_used == 3000
    assert mix_sources(sizes.limit(0), targets).selection.count() == 0


def test_sizes_are_those_of_the_vocabulary(spark):
    texts = ["Hello world, this is 2024.", "", None, "naïve — straße " * 50]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.id: (r.source, r.n_tokens) for r in token_sizes(df, "doc_id", "text", ["source"]).collect()}
    e = encoding(VOCABULARY)
    assert got == {i: ("s", len(e.encode_ordinary(t or ""))) for i, t in enumerate(texts)}
    assert e.decode(e.encode_ordinary(texts[3])) == texts[3]


def test_a_layout_of_many_runs_is_joined_instead_of_sent(spark):
    from quarrystone.llm import packing

    rng = random.Random(3)
    sizes = spark.createDataFrame([(i, rng.choice([0, 3, 7, 40, 55, 61, 130])) for i in range(400)], "id long, n_tokens long")
    kinds = spark.createDataFrame([(1, 100, 2)], "container_id int, capacity_tokens int, separator_tokens int")
    sent = sorted(tuple(r) for r in packing.pack(sizes, kinds).collect())
    whole, packing.MOST_RUNS = packing.MOST_RUNS, 0
    try:
        plain = packing._into_runs.__defaults__
        packing._into_runs.__defaults__ = (0,)
        assert sorted(tuple(r) for r in packing.pack(sizes, kinds).collect()) == sent
    finally:
        packing._into_runs.__defaults__, packing.MOST_RUNS = plain, whole


def test_what_a_mix_cannot_use_is_reported(spark):
    sizes = spark.createDataFrame([(1, "a", 10), (2, None, 7), (3, "z", 5), (4, "a", None)], "id long, source string, n_tokens long")
    targets = spark.createDataFrame([("m", "a", 1.0, 2)], "mix string, source string, target_share double, max_repeats int")
    rest = mix_sources(sizes, targets).report.where("source is null").collect()
    assert [(r.source_docs, r.source_tokens, r.tokens) for r in rest] == [(3, 12, 0)]
