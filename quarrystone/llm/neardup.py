"""Near-duplicate texts by multi-index hashing of min-hash fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.winnow import mix
from quarrystone.operators.components import connected_components
from quarrystone.storage import spread, written

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


@dataclass(frozen=True)
class Fingerprint:
    """segments x symbols min-hash values of 16 bits each; radius: symbols of one segment that may differ.

    A pair of similarity J agrees in one symbol with probability J, so in one segment of 6 within radius 1 with
    J**6 + 6 J**5 (1 - J), and is missed by all 24 segments with probability 1.7e-3 at J = 0.6, 1e-4 at 0.65 and below
    1e-9 at 0.8, while texts of J = 0.1 become candidates with probability 1.2e-3.
    ``slack``: a candidate is dropped when its symbols differ by so many standard deviations more than the threshold.
    """

    segments: int = 24
    symbols: int = 6
    slack: float = 4.0
    seed: int = 7

    @property
    def width(self) -> int:
        return self.segments * self.symbols

    def most_distance(self, threshold: float) -> int:
        p = 1 - threshold
        return int(np.ceil(self.width * p + self.slack * np.sqrt(self.width * p * threshold)))


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per run of a-z and 0-9 in the lower-cased text."""
    b = np.frombuffer(text.lower().encode("ascii", "replace"), dtype=np.uint8)
    # what is not ASCII became '?', which is no word character; a code point is one byte either way
    is_word = ((b >= 97) & (b <= 122)) | ((b >= 48) & (b <= 57))
    edge = np.diff(is_word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    # words padded to 8 bytes a block: hash by blocks of eight characters
    length = end - start
    padded = np.concatenate([b, np.zeros(8, dtype=np.uint8)])
    blocks = np.lib.stride_tricks.sliding_window_view(padded, 8)
    h = length.astype(np.uint64)
    live = np.arange(len(start))
    off = 0
    while len(live):
        at = start[live] + off
        word = np.ascontiguousarray(blocks[at]).view(np.uint64).ravel()
        left = length[live] - off
        keep = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1))
        h[live] = mix(h[live] * _MUL[0] + (word & keep))
        off += 8
        live = live[length[live] > off]
    return h


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of ``size`` consecutive words, sorted."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        h = (h + words[i : i + n]) * _MUL[i % len(_MUL)]
        h ^= h >> np.uint64(32)
    return np.unique(mix(h))


@lru_cache(maxsize=8)
def _permutations(width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 32, width, dtype=np.uint32) | np.uint32(1)
    return a[:, None], rng.integers(0, 1 << 32, width, dtype=np.uint32)[:, None]


def minhash(shingles: np.ndarray, fp: Fingerprint) -> np.ndarray:
    """The least value of each permutation, folded to 16 bits; blocks of shingles keep the work in the cache."""
    a, b = _permutations(fp.width, fp.seed)
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(fp.width, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(folded), 512):
        v = (folded[None, i : i + 512] ^ b) * a
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(least, v.min(axis=1), out=least)
    return ((least ^ (least >> np.uint32(16))) & np.uint32(0xFFFF)).astype(np.uint16)


def _fingerprints(size: int, least_words: int, fp: Fingerprint):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, prints = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = word_hashes(text)
                if len(words) < max(least_words, size):
                    continue
                ids.append(key)
                digests.append(xxhash.xxh3_64_intdigest(words.tobytes()) - (1 << 63))
                prints.append(minhash(shingle_hashes(words, size), fp).tobytes())
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(digests, pa.int64()), pa.array(prints, pa.binary())],
                    ["id", "digest", "fp"],
                )

    return run


def _beyond(keys: np.ndarray, most: int) -> np.ndarray:
    """Marks the rows of each key after its first ``most``."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.concatenate([[True], k[1:] != k[:-1]])
    at = np.arange(len(k))
    out = np.empty(len(k), dtype=bool)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0)) >= most
    return out


def _ball_keys(fp: Fingerprint, most: int):
    """Keys of the Hamming ball of radius 1 around each segment: one per symbol left out, exact match included in each.

    Of the rows of a key in one batch only one more than ``most`` go to its bucket, enough to show there that it is hot; the others are marked hot here and spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, fp.width + 1, dtype=np.uint64) * _MUL[1])
        place = salt * _MUL[2]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0), dtype=np.int64)
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16)
            symbols = raw.reshape(len(ids), fp.segments, fp.symbols).astype(np.uint64)
            for part in range(fp.segments):
                one = symbols[:, part, :]
                terms = mix(one + salt[part * fp.symbols : (part + 1) * fp.symbols])
                total = terms.sum(axis=1, dtype=np.uint64)
                for left_out in range(fp.symbols):
                    # which symbol is left out belongs to the key
                    key = mix(total - terms[:, left_out] + place[part * fp.symbols + left_out])
                    hot = _beyond(key, most + 1)
                    if hot.any():
                        key = np.where(hot, mix(ids.view(np.uint64)), key)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), pa.array(hot)], ["key", "id", "hot"])

    return run


def _pairs_of_runs(most: int):
    """Pairs inside each run of equal keys of sorted rows; the ids of longer runs, and of rows already marked, come out unpaired, as hot."""

    def rows(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), hot))], ["a", "b", "hot"])

    def emit(keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
        size = np.diff(np.append(start, len(keys)))
        left, right = [], []
        for n in np.unique(size):
            if n < 2 or n > most:
                continue
            some = ids[start[size == n][:, None] + np.arange(n)]
            i, j = np.triu_indices(n, 1)
            left.append(some[:, i].ravel())
            right.append(some[:, j].ravel())
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield rows(pair[:, 0], pair[:, 1], False)
        if (big := np.repeat(size > most, size)).any():
            once = np.unique(ids[big])
            yield rows(once, once, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_i = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            k, i, marked = np.asarray(batch.column(0), dtype=np.int64), np.asarray(batch.column(1), dtype=np.int64), np.asarray(batch.column(2))
            if marked.any():
                once = np.unique(i[marked])
                yield rows(once, once, True)
            k, i = np.concatenate([held_k, k[~marked]]), np.concatenate([held_i, i[~marked]])
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1], side="left"))
            yield from emit(k[:last], i[:last]) if last else ()
            held_k, held_i = k[last:], i[last:]
            if len(held_k) > most + 1:
                # an open run that is already too long: its rows leave, and enough stay to keep it hot
                yield from emit(held_k, held_i)
                held_k, held_i = held_k[: most + 1], held_i[: most + 1]
        if len(held_k):
            yield from emit(held_k, held_i)

    return run


def _hot_pairs(hot: DataFrame, src: DataFrame, words: int, threshold: float) -> DataFrame:
    """(a, b) of the texts in hot buckets that can be similar enough: an exact prefix join on their shingles, instead of all pairs of a bucket.

    Shingles are put in order of how few of these texts hold them. Of two texts of threshold t the longer one, of n shingles, holds a common one among its first
    n - tn + 1, the shorter one among its first n - 2tn / (1 + t) + 1, and where they first agree enough must be left to agree on. What most texts of a bucket
    have in common stands at the end of the order and joins nothing, unless they are similar indeed.
    """
    t = threshold
    least = lambda share, n: F.ceil(share * n - 1e-9)
    sets = src.join(hot, "id", "left_semi").mapInArrow(_shingle_lists(words), "id long, grams array<long>")
    each = written(sets.select("id", F.size("grams").alias("n"), F.explode("grams").alias("g")), "hot-grams")
    held = each.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    # the shingles of one text, as long as the text
    order = each.join(held, "g").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("s"))
    prefix = written(order.select("id", "n", F.posexplode(F.slice("s", F.lit(1), (F.col("n") - least(t, F.col("n")) + 1).cast("int"))).alias("pos", "s")).select("id", "n", "pos", "s.g"), "hot-prefixes")
    longer = prefix.select("g", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"))
    shorter = prefix.where(F.col("pos") < F.col("n") - least(2 * t / (1 + t), F.col("n")) + 1).select("g", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"))
    left = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    met = shorter.join(longer, "g").where(
        ((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))))
        & (F.col("nx") >= t * F.col("ny") - 1e-9)
        & (left >= least(t / (1 + t), F.col("nx") + F.col("ny")))
    )
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _shingle_lists(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                sets = [shingle_hashes(word_hashes(t), size).view(np.int64) for t in some.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["id", "grams"])

    return run


def _distances(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for c in (2, 3))
            keep = pa.array((x != y).sum(axis=1) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    return run


def _shingle_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(word_hashes(t), size).astype(np.uint32) for t in batch.column(1).to_pylist()]
            packed = [np.unique(s).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "grams"])

    return run


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in range(4)))
            found = []
            for a, b, x, y in rows:
                s, t = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
                both = len(np.intersect1d(s, t, assume_unique=True))
                value = both / (len(s) + len(t) - both)
                if value >= threshold:
                    found.append((a, b, value))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"]
                )

    return run


@dataclass
class NearDuplicates:
    """links: (a, b, similarity) between classes of equal word sequences; members: (id, class); ids: every row's id."""

    links: DataFrame
    members: DataFrame
    ids: DataFrame

    def pairs(self) -> DataFrame:
        """Every pair of rows, a < b, copies included: as many as the input has."""
        m, l = self.members, self.links
        x = m.select(F.col("id").alias("x"), F.col("class").alias("a"))
        y = m.select(F.col("id").alias("y"), F.col("class").alias("b"))
        across = l.select("a", "b").join(x, "a").join(y, "b").select("x", "y")
        within = x.join(y, F.col("a") == F.col("b")).where("x < y").select("x", "y")
        return across.union(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def groups(self) -> DataFrame:
        """(id, class, group, n_links) for every row: group is the least id linked over any chain; n_links counts other classes linked.

        Rows that take no part are classes and groups of their own.
        """
        ends = self.links.select(F.col("a").alias("class")).unionAll(self.links.select(F.col("b").alias("class")))
        degree = ends.groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
        comp = connected_components(self.links.select("a", "b")).withColumnRenamed("node", "class")
        return (
            self.ids.join(self.members, "id", "left")
            .withColumn("class", F.coalesce("class", "id"))
            .join(degree, "class", "left")
            .join(comp, "class", "left")
            .select("id", "class", F.coalesce("component", "class").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        )


def near_duplicates(
    docs: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: float = 0.8, least_words: int = 60, fp: Fingerprint = Fingerprint(), most_in_bucket: int = 64
) -> NearDuplicates:
    """Pairs of texts whose sets of ``words`` consecutive words have a Jaccard similarity of ``threshold`` or more.

    Words are the longest runs of a-z and 0-9 of the lower-cased text; texts of fewer than ``least_words`` words, null and
    empty texts take no part. Texts with the same words are one class, named by its least id; ids must be unique.
    Classes are looked up by multi-index hashing: each segment of a class's fingerprint is entered under the keys of its
    Hamming ball, table matches become candidates, the distance of the complete fingerprints drops chance meetings, and
    the shingle sets of what remains are compared. The classes of a key of more than ``most_in_bucket`` are compared by an exact prefix
    join on their shingles instead of all with each other, so no candidate is dropped for the size of its bucket. No links give no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null and length(text) >= 2")
    prints = written(spread(src).mapInArrow(_fingerprints(words, least_words, fp), "id long, digest long, fp binary"), "prints")
    classes = prints.groupBy("digest").agg(F.min("id").alias("class"))
    members = written(prints.select("id", "digest").join(classes, "digest").select("id", "class"), "members")
    reps = prints.join(classes.select(F.col("class").alias("id")), "id", "left_semi").select("id", "fp")
    keys = reps.mapInArrow(_ball_keys(fp, most_in_bucket), "key long, id long, hot boolean")
    parts = max(keys.sparkSession.sparkContext.defaultParallelism, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = written(keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_pairs_of_runs(most_in_bucket), "a long, b long, hot boolean"), "met")
    candidates = met.where("not hot").select("a", "b").distinct()
    left = reps.select(F.col("id").alias("a"), F.col("fp").alias("x"))
    right = reps.select(F.col("id").alias("b"), F.col("fp").alias("y"))
    both = candidates.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    close = both.mapInArrow(_distances(fp.most_distance(threshold)), "a long, b long")
    hot = met.where("hot").select(F.col("a").alias("id")).distinct()
    if not hot.isEmpty():
        close = close.union(_hot_pairs(hot, src, words, threshold)).distinct()
    close = written(close, "close")
    needed = close.select(F.col("a").alias("id")).union(close.select(F.col("b").alias("id"))).distinct()
    grams = written(src.join(needed, "id", "left_semi").mapInArrow(_shingle_sets(words), "id long, grams binary"), "grams")
    compared = (
        close.join(grams.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
        .join(grams.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    links = written(compared.mapInArrow(_similar(threshold), "a long, b long, similarity double"), "links")
    return NearDuplicates(links, members, docs.select(F.col(id_col).cast("long").alias("id")))
