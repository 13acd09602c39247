"""Splitting oversized texts at natural boundaries by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The characters with the Unicode property White_Space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LINE = "\\r\\n|[\\n\\r\\x0b\\x0c\\x85\\u2028\\u2029]"

_PARAGRAPH = re.compile(f"(?:{_LINE})[{WHITE}]*(?:{_LINE})[{WHITE}]*")
_SENTENCE = re.compile(f"[.!?…]+[\"'”’»)\\]]*[{WHITE}]+(?=[^{WHITE}a-z])")
_LINE_END = re.compile(f"[ \\t]*(?:{_LINE})[{WHITE}]*")
_WORD = re.compile(f"[{WHITE}]+")

#: Strength of a boundary: inside a run without white space, between words, lines, sentences, paragraphs.
HARD, WORD, LINE, SENTENCE, PARAGRAPH = range(5)
NAMES = ("hard", "word", "line", "sentence", "paragraph")
_FINER = {PARAGRAPH: (_PARAGRAPH, PARAGRAPH), SENTENCE: (_SENTENCE, SENTENCE), LINE: (_LINE_END, LINE), WORD: (_WORD, WORD)}


def _atoms(text: str, start: int, end: int, level: int, limit: int) -> Iterator[tuple[int, int]]:
    """(end, strength of the boundary at end) of the atoms of text[start:end], made finer only where one is over the limit."""
    if level == HARD:
        white = _WORD.search(text, start, end)
        run_end = white.start() if white else end
        for at in range(start + limit, end, limit):
            # behind the run there is only its white space, which may be cut anywhere
            yield at, HARD if at < run_end else WORD
        return
    pattern, strength = _FINER[level]
    cuts = [m.end() for m in pattern.finditer(text, start, end) if m.end() < end]
    last = start
    for cut in [*cuts, end]:
        if cut - last > limit:
            yield from _atoms(text, last, cut, level - 1, limit)
        if cut < end:
            yield cut, strength
        last = cut


def _overlap(text: str, start: int, at: int, room: int) -> int:
    """Where the repeated part before ``at`` begins: the earliest natural boundary within room, or ``at`` itself."""
    low = max(start, at - room)
    if low >= at:
        return at
    if low == start:
        return start
    for level in (PARAGRAPH, SENTENCE, LINE, WORD):
        pattern, _ = _FINER[level]
        for m in pattern.finditer(text, max(start, low - 2), at):
            if low <= m.end() < at:
                return m.end()
    return at


def split_text(text: str, budget: int = 1800, overlap: int = 300) -> list[tuple[int, int, int, int]]:
    """(start, own_start, end, strength) of passages of at most ``budget`` characters; [own_start, end) tile the text.

    Atoms are paragraphs; one over the budget is cut into sentences, those into lines, words and, where there is no
    white space, into pieces of the budget. All neighbours wait in a heap by the strength of their boundary, then by
    joint size and position; the weakest boundary is merged first while both sides and the overlap fit the budget.
    Each passage then begins with up to ``overlap`` characters of the one before, from a natural boundary on, as far as
    the budget has room; ``strength`` is that of the boundary at its end, PARAGRAPH for the last one.
    """
    n = len(text)
    if n <= budget:
        return [(0, 0, n, PARAGRAPH)] if n else []
    ends, strengths = [], []
    # a run that fits the budget stays whole, with no room left for an overlap
    for at, strength in _atoms(text, 0, n, PARAGRAPH, budget):
        ends.append(at)
        strengths.append(strength)
    ends.append(n)
    strengths.append(PARAGRAPH)
    k = len(ends)
    begin = [0, *ends[:-1]]
    left, right, alive = list(range(-1, k - 1)), [*range(1, k), -1], [True] * k
    stop = list(ends)
    heap = [(strengths[i], ends[i + 1] - begin[i], i, i + 1, ends[i + 1]) for i in range(k - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j, upto = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or right[i] != j or stop[j] != upto or size != stop[j] - begin[i]:
            continue
        # the first passage has nothing before it to repeat
        if size + (overlap if begin[i] else 0) > budget:
            continue
        alive[j] = False
        stop[i], strengths[i], right[i] = stop[j], strengths[j], right[j]
        if right[j] >= 0:
            left[right[j]] = i
            heapq.heappush(heap, (strengths[i], stop[right[i]] - begin[i], i, right[i], stop[right[i]]))
        if left[i] >= 0:
            h = left[i]
            heapq.heappush(heap, (strengths[h], stop[i] - begin[h], h, i, stop[i]))
    out = []
    before = 0
    for i in (i for i in range(k) if alive[i]):
        room = min(overlap, budget - (stop[i] - begin[i]))
        start = begin[i] if not i else _overlap(text, before, begin[i], room)
        out.append((start, begin[i], stop[i], strengths[i]))
        before = begin[i]
    return out


_PASSAGES = "id long, passage int, start int, own_start int, end int, boundary string, text string"


def split_oversized(docs: DataFrame, id_col: str, text_col: str, budget: int = 1800, overlap: int = 300) -> DataFrame:
    """(id, passage, start, own_start, end, boundary, text): ordered passages of every text, in code points.

    Texts within the budget pass as they are, as one passage, without leaving the JVM; null texts and empty texts give no
    passage. The parts [own_start, end) of a text's passages join up to the text. Extra columns are left out, equal
    rows give equal passages, any length is processed whole.
    """
    if not 0 <= overlap < budget:
        raise ValueError("overlap must be less than the budget")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null and text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, (start, own, end, strength) in enumerate(split_text(text, budget, overlap)):
                    rows.append((key, i, start, own, end, NAMES[strength], text[start:end]))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
                names = ["id", "passage", "start", "own_start", "end", "boundary", "text"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    n = F.length("text")
    small = src.where(n <= budget).select(
        "id", F.lit(0).alias("passage"), F.lit(0).alias("start"), F.lit(0).alias("own_start"), n.alias("end"), F.lit(NAMES[PARAGRAPH]).alias("boundary"), "text"
    )
    return src.where(n > budget).mapInArrow(run, _PASSAGES).unionByName(small)
