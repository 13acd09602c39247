"""Long exact spans shared between records: seed on winnowed anchors, extend, keep maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.llm import winnow
from quarrystone.storage import spread, written

#: Anchor length; every run of min_length characters holds an anchor chosen by its content alone.
ANCHOR = 120

_SEEDS = "id long, digest long, kind int, h long, l long, p0 int, p1 int"


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _seeds(least: int, k: int):
    w = least - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, kinds, hs, ls, p0s, p1s = [], [], [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                roll = winnow.RollingHash(text)
                if roll.n < least:
                    continue
                grams = roll.all_windows(k)
                at = winnow.anchors(grams, w)
                lead = roll.windows(np.maximum(at + k - least, 0), at + k)
                h = grams[at]
                # a run of one repeated gram is one seed with a first and a last position
                first = np.ones(len(at), dtype=bool)
                first[1:] = (at[1:] != at[:-1] + 1) | (h[1:] != h[:-1]) | (lead[1:] != lead[:-1])
                starts = np.flatnonzero(first)
                ends = np.append(starts[1:], len(at)) - 1
                n = len(starts) + 1
                digest = np.uint64(winnow.digest64(text))
                ids.append(np.full(n, key, dtype=np.int64))
                digests.append(np.full(n, digest, dtype=np.uint64))
                kinds.append(np.concatenate([[0], np.ones(n - 1, dtype=np.int32)]))
                hs.append(np.concatenate([np.zeros(1, dtype=np.uint64), h[starts]]))
                ls.append(np.concatenate([np.zeros(1, dtype=np.uint64), lead[starts]]))
                p0s.append(np.concatenate([[0], at[starts]]))
                p1s.append(np.concatenate([[roll.n], at[ends]]))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(ids)),
                        pa.array(_signed(np.concatenate(digests))),
                        pa.array(np.concatenate(kinds).astype(np.int32)),
                        pa.array(_signed(np.concatenate(hs))),
                        pa.array(_signed(np.concatenate(ls))),
                        pa.array(np.concatenate(p0s).astype(np.int32)),
                        pa.array(np.concatenate(p1s).astype(np.int32)),
                    ],
                    ["id", "digest", "kind", "h", "l", "p0", "p1"],
                )

    return run


def _windows(least: int, k: int):
    """Windows of ``least`` characters at which a run may begin, with the character before them (-1 at the beginning of the text) and how far a run can reach.

    Where all texts of an anchor agree on what leads up to it (``same``) that is only the first window before it, elsewhere every window whose own anchor it is.
    A run ends at the latest with the last of the windows, without a gap, whose own anchors are seeds.
    """
    w = least - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, seeds, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if winnow.digest64(text) != digest & 0xFFFFFFFFFFFFFFFF:
                    continue  # another row of the same id
                roll = winnow.RollingHash(text)
                own = _signed(winnow._sliding(roll.all_windows(k), w, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF)))
                start = np.zeros(len(own), dtype=bool)
                for s in seeds:
                    low = max(s["p0"] + k - least, 0)
                    if s["same"]:
                        start[low : max(s["p1"] + k - least, 0) + 1] = True
                    else:
                        start[low : s["p1"] + 1] |= own[low : s["p1"] + 1] == s["h"]
                seeded = np.isin(own, np.array([s["h"] for s in seeds], dtype=np.int64))
                at = np.flatnonzero(start & seeded)
                if len(at):
                    gaps = np.append(np.flatnonzero(~seeded), len(own))
                    before = np.concatenate([[-1], winnow.code_points(text).astype(np.int32)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), digest, dtype=np.int64)),
                            pa.array(_signed(roll.windows(at, at + least))),
                            pa.array(before[at].astype(np.int32)),
                            pa.array(at.astype(np.int32)),
                            pa.array((gaps[np.searchsorted(gaps, at)] + least - 1).astype(np.int32)),
                        ],
                        ["digest", "wh", "before", "start", "reach"],
                    )

    return run


def _tails(least: int):
    """What follows the windows at the given starts, as far as a run can reach, with its hash and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, starts, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if winnow.digest64(text) != digest & 0xFFFFFFFFFFFFFFFF:
                    continue
                roll = winnow.RollingHash(text)
                for some in (starts[i : i + 1000] for i in range(0, len(starts), 1000)):
                    at, stop = (np.array([x[c] for x in some]) for c in ("start", "reach"))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([x["wh"] for x in some], pa.int64()),
                            pa.array(_signed(roll.windows(at + least, stop))),
                            pa.array((stop - at - least).astype(np.int32)),
                            pa.array([digest] * len(some), pa.int64()),
                            pa.array(at.astype(np.int32)),
                            pa.array([text[a + least : e] for a, e in zip(at, stop)], pa.string()),
                        ],
                        ["wh", "th", "n", "digest", "start", "tail"],
                    )

    return run


def _agree(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Longest match of each continuation with another text, from distinct (wh, tail) in order with the least and the greatest text that have it.

    Where two texts have it that is all of it, else it is with the nearest row that another text has. lo and hi become the texts matched.
    """
    # of the last rows of one text: hash, length, match with another text above, that text, agreement with the row above
    pending: list[tuple[int, int, int, int | None, int]] = []
    group = before = None
    tail = ""

    def close(below: int, other: int | None) -> Iterator[tuple]:
        for th, n, above, held, step in reversed(pending):
            if max(above, below) >= 0:
                best, text = (above, held) if above >= below else (below, other)
                yield group, th, n, best, text, text
            below = min(below, step)
        pending.clear()

    for batch in batches:
        out: list[tuple] = []
        for wh, th, n, lo, hi, t in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if wh != group:
                out += close(-1, None)
                group, before, step = wh, None, -1
            else:
                step = _agree(tail, t)
            if before is not None and before != (lo, hi) and pending:
                out += close(step, lo if lo != before[0] else hi)
            if lo != hi:
                out.append((wh, th, n, n, lo, hi))
            elif before is None:
                pending.append((th, n, -1, None, -1))
            elif before == (lo, hi):
                pending.append((th, n, min(pending[-1][2], step), pending[-1][3], step))
            else:
                pending.append((th, n, step, before[0] if before[0] != lo else before[1], step))
            before, tail = (lo, hi), t
        if out:
            yield _matches(out)
    if out := list(close(-1, None)):
        yield _matches(out)


def _matches(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["wh", "th", "n", "best", "lo", "hi"])


_SPAN = ("id", "start", "end", "n_chars", "other_id")


@dataclass(frozen=True)
class _Found:
    """The rows that hold each text (id, digest, n), texts (digest, rep, copies, n) and their maximal runs (digest, start, end, other)."""

    owners: DataFrame
    texts: DataFrame
    runs: DataFrame

    def spans(self, runs: DataFrame) -> DataFrame:
        """The runs of each row; a row whose text has a copy is one span, its other_id the least id of the other copies."""
        copied = self.texts.where("copies > 1")
        ids = self.owners.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        other = F.when(F.col("id") == F.col("first"), F.nullif("last", "first")).otherwise(F.col("first"))
        whole = self.owners.join(copied.select("digest"), "digest", "left_semi").join(ids, "digest").select(
            "id", F.lit(0).alias("start"), F.col("n").alias("end"), F.col("n").alias("n_chars"), other.alias("other_id")
        )
        reps = self.texts.select(F.col("digest").alias("other"), F.col("rep").alias("other_id"))
        partly = self.owners.join(runs, "digest").join(copied.select("digest"), "digest", "left_anti").join(reps, "other").withColumnRenamed("n", "n_chars")
        return whole.union(partly.select(*_SPAN))

    def joined(self) -> DataFrame:
        """Runs that overlap or touch as one stretch."""
        by_start = W.partitionBy("digest").orderBy("start")
        earlier = F.max("end").over(by_start.rowsBetween(W.unboundedPreceding, -1))
        island = F.sum(F.when(F.col("start") > F.col("earlier"), 1).otherwise(0)).over(by_start)
        return self.runs.withColumn("earlier", earlier).withColumn("island", island).groupBy("digest", "island").agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other")
        )


def maximal_spans(docs: DataFrame, id_col: str, text_col: str, min_length: int = 240, anchor: int = ANCHOR) -> DataFrame:
    """(id, start, end, n_chars, other_id): every maximal run of each text, of min_length characters or more, that stands verbatim in the text of ``other_id``.

    A run is maximal if no longer run of the same text that holds it stands in another text; runs shared with different texts may overlap, and other_id is
    one of the rows that hold the run. Equal texts under several ids are one text for the search and each of their ids is wholly shared. Null texts and texts shorter than
    min_length give no row; repetition inside one text does not count; rows of one id are taken as rows of their own, and
    other_id is null where a copy has the same id; rows without an id are left out; extra columns are ignored; an empty table gives no row.
    """
    found = _search(docs, id_col, text_col, min_length, anchor)
    return found.spans(found.runs)


def shared_spans(docs: DataFrame, id_col: str, text_col: str, min_length: int = 240, anchor: int = ANCHOR) -> DataFrame:
    """(id, start, end, n_chars): the union of the maximal runs of each row; parts of one stretch may come from different texts."""
    found = _search(docs, id_col, text_col, min_length, anchor)
    return found.spans(found.joined()).drop("other_id")


def _search(docs: DataFrame, id_col: str, text_col: str, min_length: int, anchor: int) -> _Found:
    """1. Each text of min_length or more gives its winnowed anchors, each with the hash of the window that ends with it. 2. Anchors held by two different texts are
    seeds (least and greatest digest per anchor, so a hot anchor costs one row per task). 3. To the left, a run can begin only at a window whose occurrences do not
    all follow the same character; such windows are looked for around the seeds. 4. To the right, what follows them is taken once per distinct continuation,
    with the least and the greatest text that have it, and sorted: the longest match of each is with its nearest neighbour of another text.
    5. Runs inside a longer run are left out. No step lists the texts of an anchor together or pairs them.
    """
    if not 8 <= anchor <= min_length:
        raise ValueError("the anchor must have 8 to min_length characters")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(
        F.col("id").isNotNull() & F.col("text").isNotNull() & (F.length("text") >= min_length)
    )
    base = written(spread(src).mapInArrow(_seeds(min_length, anchor), _SEEDS), "seeds")
    owners = base.where("kind = 0").select("id", "digest", F.col("p1").alias("n"))
    texts = owners.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"))
    seeds = base.where("kind = 1").select("id", "digest", "h", "l", "p0", "p1")
    per = seeds.groupBy("h").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.min("l").alias("l0"), F.max("l").alias("l1"))
    held = per.where("lo <> hi").select("h", (F.col("l0") == F.col("l1")).alias("same"))
    one_per_text = texts.select("digest", F.col("rep").alias("id"))
    per_text = (
        seeds.join(held, "h").join(one_per_text, ["digest", "id"], "left_semi")
        .groupBy("id", "digest").agg(F.collect_list(F.struct("h", "p0", "p1", "same")).alias("seeds"))
    )
    # one text per id even where an id repeats with other text: the digest settles which row was meant; the shuffles of the seeds can go before texts move
    around = written(written(per_text, "near").join(src, "id").select("digest", "seeds", "text"), "around")
    wins = written(around.mapInArrow(_windows(min_length, anchor), "digest long, wh long, before int, start int, reach int"), "windows")
    same = wins.groupBy("wh").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.min("before").alias("b0"), F.max("before").alias("b1"))
    begins = same.where("lo <> hi and (b0 <> b1 or b0 = -1)").select("wh")
    starts = wins.join(begins, "wh", "left_semi").groupBy("digest").agg(F.collect_list(F.struct("start", "reach", "wh")).alias("starts"))
    again = around.join(starts, "digest").select("digest", "starts", "text")
    tails = written(again.mapInArrow(_tails(min_length), "wh long, th long, n int, digest long, start int, tail string"), "tails")
    distinct = tails.groupBy("wh", "th", "n").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.first("tail").alias("tail"))
    ordered = distinct.repartition("wh").sortWithinPartitions("wh", "tail")
    matched = ordered.mapInArrow(_longest, "wh long, th long, n int, best int, lo long, hi long")
    other = F.when(F.col("lo") == F.col("digest"), F.col("hi")).otherwise(F.col("lo"))
    runs = tails.drop("tail").join(matched, ["wh", "th", "n"]).select("digest", "start", (F.col("start") + min_length + F.col("best")).alias("end"), other.alias("other"))
    earlier = F.max("end").over(W.partitionBy("digest").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn("earlier", earlier).where("earlier is null or end > earlier").select("digest", "start", "end", "other")
    return _Found(owners, texts, written(runs, "runs"))


def shared_share(docs: DataFrame, id_col: str, text_col: str, min_length: int = 240) -> DataFrame:
    """(id, n_chars, n_spans, shared_chars, share) for every row of docs with an id; 0 spans and share 0.0 where nothing is shared.

    n_spans counts maximal runs, which may overlap; shared_chars counts each character of their union once. Null and empty texts have 0 characters and share 0.0.
    """
    found = _search(docs, id_col, text_col, min_length, ANCHOR)
    covered = found.spans(found.joined()).groupBy("id").agg(F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
    counted = found.spans(found.runs).groupBy("id").agg(F.count(F.lit(1)).alias("n_spans"))
    spans = covered.join(counted, "id", "left")
    all_rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars")
    )
    return all_rows.join(spans, "id", "left").select(
        "id",
        "n_chars",
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("shared_chars", F.lit(0)).cast("long").alias("shared_chars"),
        F.when(F.col("n_chars") > 0, F.round(F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars"), 6)).otherwise(0.0).alias("share"),
    )
