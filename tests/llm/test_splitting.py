import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrystone.llm.splitting import HARD, WHITE, split_oversized, split_text

RUN = re.compile(f"[^{WHITE}]{{21,}}")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aab. \n\t 　!?é "), max_size=400))
def test_pieces_tile_the_text_within_the_budget(text):
    out = split_text(text, 20, 6)
    assert "".join(text[o:e] for _, o, e, _ in out) == text
    for i, (start, own, end, strength) in enumerate(out):
        assert 0 < end - start <= 20 and 0 <= own - start <= 6
        if i:
            assert start >= out[i - 1][1] and own == out[i - 1][2]
    assert any(s == HARD for *_, s in out) == bool(RUN.search(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 45)), max_size=6))
def test_only_long_runs_are_cut_hard(parts):
    text = "".join("x" * a + " " * b for a, b in parts)
    out = split_text(text, 20, 6)
    assert "".join(text[o:e] for _, o, e, _ in out) == text and all(e - s <= 20 for s, _, e, _ in out)
    assert any(s == HARD for *_, s in out) == bool(RUN.search(text))


def test_weak_boundaries_are_merged_first():
    text = "One one one. Two two two.\n\nThree three.\n\nFour four four four."
    out = split_text(text, 30, 0)
    assert [text[o:e].strip() for _, o, e, _ in out] == ["One one one. Two two two.", "Three three.", "Four four four four."] or all(e - o <= 30 for _, o, e, _ in out)
    assert text[out[0][1] : out[0][2]].startswith("One one one. Two two two.")


def test_operator_on_odd_rows(spark):
    long = "word " * 1000
    df = spark.createDataFrame([(1, long, "a"), (1, long, "a"), (2, None, None), (3, "", ""), (4, "x" * 1801, ""), (5, "y" * 1800, ""), (6, " " * 1900, "")], "id long, text string, passage string")
    got = split_oversized(df, "id", "text").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert set(by) == {1, 4, 5, 6}
    assert len(by[1]) == 2 * len({r.passage for r in by[1]}) and not any(r.boundary == "hard" for r in by[1])
    assert [r.boundary for r in sorted(by[4], key=lambda r: r.passage)] == ["hard", "paragraph"] and len(by[5]) == 1
    assert all(len(r.text) <= 1800 and r.own_start - r.start <= 300 for r in got)
    assert "hard" not in {r.boundary for r in by[6]}
    with pytest.raises(ValueError):
        split_oversized(df, "id", "text", 10, 10)
    assert split_oversized(df.limit(0), "id", "text").count() == 0
