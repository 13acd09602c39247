"""Fingerprints, manifests and incremental refresh of indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.text import digest


def corpus_fingerprint(corpus: DataFrame, key: str = "chunk_id", content: str = "text") -> DataFrame:
    """(n, fingerprint): independent of order, changed by any id or text; rows with equal digests count as often as they occur.

    Digests are gathered by their first byte, 256 groups whose hashes are hashed again, so no task holds the digests of all rows at once.
    """
    d = corpus.select(digest(F.col(key), F.col(content)).alias("d")).withColumn("part", F.substring("d", 1, 2))
    # a further cut by the next byte keeps a group small: 65,536 groups in all
    fine = d.withColumn("fine", F.substring("d", 3, 2)).groupBy("part", "fine").agg(
        F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("h")
    )
    coarse = fine.groupBy("part").agg(
        F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fine", "h"))), lambda x: x["h"]), ""), 256).alias("h")
    )
    return coarse.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), ""), 256).alias("fingerprint"),
    )


def index_difference(indexed: DataFrame, corpus: DataFrame) -> DataFrame:
    """(state, n) over the ids of both (id, digest): missing from the index, stale in it, orphaned there, or current; all four always listed."""
    met = indexed.select("id", F.col("digest").alias("old")).join(corpus.select("id", F.col("digest").alias("new")), "id", "full_outer")
    state = F.when(F.col("old").isNull(), "missing").when(F.col("new").isNull(), "orphaned").when(F.col("old") != F.col("new"), "stale").otherwise("current")
    row = met.select(state.alias("s")).agg(*[F.count_if(F.col("s") == k).alias(k) for k in ("missing", "stale", "orphaned", "current")])
    pairs = F.array(*[F.struct(F.lit(k).alias("state"), F.col(k).alias("n")) for k in ("missing", "stale", "orphaned", "current")])
    return row.select(F.inline(pairs))


def refreshed(indexed: DataFrame, corpus: DataFrame, encode, whole: bool = True) -> DataFrame:
    """The index after a refresh: current rows as they are, missing and stale ones encoded, orphans gone if the run covers the whole corpus.

    indexed(id, digest, vector); corpus(id, digest, text); ``encode`` turns (id, digest, text) into (id, digest, vector).
    """
    current = indexed.join(corpus.select("id", "digest"), ["id", "digest"], "left_semi")
    todo = corpus.join(indexed.select("id", "digest"), ["id", "digest"], "left_anti")
    out = current.unionByName(encode(todo))
    if whole:
        return out
    return out.unionByName(indexed.join(corpus.select("id"), "id", "left_anti"))


def reusable(needed: DataFrame, donors: DataFrame) -> DataFrame:
    """Vectors of needed(id, digest) found in donors(id, digest, vector, priority): of several the one of the least priority number."""
    met = needed.join(donors, ["id", "digest"])
    return met.groupBy("id", "digest").agg(F.min_by("vector", "priority").alias("vector"))


def chunk_settings(passages: DataFrame) -> DataFrame:
    """(budget, overlap, note): the one setting in use; nulls with a note where there are several or none is recorded."""
    s = passages.agg(F.collect_set(F.struct("chunk_budget", "chunk_overlap")).alias("s"), F.count("chunk_budget").alias("n"), F.count(F.lit(1)).alias("all"))
    one = (F.size("s") == 1) & (F.col("n") > 0)
    return s.select(
        F.when(one, F.col("s")[0]["chunk_budget"]).alias("budget"),
        F.when(one, F.col("s")[0]["chunk_overlap"]).alias("overlap"),
        F.when(one, "recorded").when(F.col("n") == 0, "assumed").otherwise("mixed").alias("note"),
    )


def encoders(indexed: DataFrame) -> DataFrame:
    """Vectors by (model, revision); more than one row means a mixed index."""
    return indexed.groupBy("model", "revision").agg(F.count(F.lit(1)).alias("n")).orderBy("model", "revision")


def refusals(manifest: DataFrame, identity: DataFrame, settings: dict[str, object]) -> DataFrame:
    """Reasons to refuse an index, one row each: another fingerprint, another count, or a setting that differs from the manifest's.

    manifest and identity are one row each: (fingerprint, n, settings...) and (fingerprint, n).
    """
    i = identity.select(F.col("fingerprint").alias("__f"), F.col("n").alias("__n"), F.lit(1).alias("__one"))
    met = manifest.withColumn("__one", F.lit(1)).join(i, "__one", "full_outer")
    checks: list[Column] = [
        F.when(F.col("fingerprint").isNull(), "no manifest"),
        F.when(F.col("fingerprint") != F.col("__f"), "the corpus has another fingerprint"),
        F.when(F.col("n") != F.col("__n"), "the corpus has another number of passages"),
    ]
    for name, value in settings.items():
        checks.append(F.when(~F.col(name).eqNullSafe(F.lit(value)), f"{name} differs"))
    return met.select(F.explode(F.array_compact(F.array(*checks))).alias("reason"))


def truncation_report(rows: DataFrame, key: str, tokens: str, kind: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows over the limit, the longest first, and counts by kind."""
    over = rows.where(F.col(tokens) > limit).select(key, kind, tokens).orderBy(F.col(tokens).desc(), key)
    summary = rows.groupBy(kind).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(tokens) > limit).alias("n_over"), F.max(tokens).alias("most"),
        F.round(F.count_if(F.col(tokens) > limit) / F.count(F.lit(1)), 6).alias("share_over"),
    )
    return over, summary
