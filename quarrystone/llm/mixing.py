"""Mixing sources to target weights by systematic sampling over prefix sums of expected copies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.operators.ranking import numbered_within


def source_name(source: Column) -> Column:
    """One spelling: trimmed, lower case, words joined by an underscore."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")


@dataclass
class Mixture:
    """selection: (mix, id, source, n_tokens, copies) of the documents used; report: one row per mix and target source, and one without source for the documents that the mix cannot use."""

    selection: DataFrame
    report: DataFrame


def mix_sources(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17) -> Mixture:
    """Selects documents so that each source has its target share of the tokens of its mix.

    sizes: (id, source, n_tokens), ids unique; targets: (mix, source, target_share, max_repeats), a small parameter table.
    Sources are compared in one spelling. Sources that have no tokens are left out of their mix and the shares of the others are
    scaled up to 1, which the report shows as ``wanted_share``. A mix is as large as its scarcest source, repeated
    ``max_repeats`` times, allows while all shares hold, or has ``total_tokens``; then a source that cannot reach its share
    within max_repeats gives all it may and the report shows the shortfall.

    A source needs e = share x total / its tokens expected copies of each document. Documents are numbered within the source
    by size; number k is emitted once for each integer that (k e + u, (k + 1) e + u] crosses, u being one random offset of mix
    and source. That is at most max_repeats times, and since neighbours have like sizes the tokens come out within one document of
    the target. Numbers come from counts, so no source is gathered in one task. Documents with null source, of a source that the mix does not name
    or of no tokens are not used, and the report counts them and their tokens in the row of the mix without source; null shares or repeats count as 0; an empty table gives no selection.
    """
    docs = sizes.select("id", source_name(F.col("source")).alias("source"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).where(
        "source is not null and n_tokens > 0"
    )
    wanted = targets.select(
        "mix",
        source_name(F.col("source")).alias("source"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce("max_repeats", F.lit(0)).cast("long").alias("max_repeats"),
    )
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_docs"), F.max("n_tokens").alias("largest_doc"))
    # as many rows as there are targets
    plan = wanted.join(have, "source", "left").withColumn(
        "usable", F.coalesce("source_tokens", F.lit(0)) * F.col("max_repeats") * F.col("target_share") > 0
    )
    w = W.partitionBy("mix")
    plan = plan.withColumn(
        "wanted_share", F.when(F.col("usable"), F.col("target_share")).otherwise(0.0) / F.sum(F.when(F.col("usable"), F.col("target_share"))).over(w)
    )
    most = F.col("max_repeats") * F.col("source_tokens")
    reach = F.min(F.when(F.col("usable"), most / F.col("wanted_share"))).over(w)
    total = reach if total_tokens is None else F.lit(float(total_tokens))
    plan = plan.withColumn("mix_tokens", total).withColumn(
        "expected_copies",
        F.when(F.col("usable"), F.least(F.col("wanted_share") * F.col("mix_tokens") / F.col("source_tokens"), F.col("max_repeats").cast("double"))),
    )
    plan = plan.withColumn("offset", F.pmod(F.xxhash64("mix", "source", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0)
    needed = docs.join(wanted.select("source").distinct(), "source", "left_semi")
    numbered = numbered_within(needed, ["source"], ["n_tokens"], "id", "k", salts=16)
    at = lambda k: F.floor(k * F.col("expected_copies") + F.col("offset"))
    selection = (
        numbered.join(plan.where("usable").select("mix", "source", "expected_copies", "offset", "max_repeats"), "source")
        .withColumn("copies", F.least(at(F.col("k") + 1) - at(F.col("k")), F.col("max_repeats")).cast("int"))
        .where("copies > 0")
        .select("mix", "id", "source", "n_tokens", "copies")
    )
    used = selection.groupBy("mix", "source").agg(
        F.count(F.lit(1)).alias("docs_used"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    report = plan.join(used, ["mix", "source"], "left").select(
        "mix",
        "source",
        "target_share",
        "max_repeats",
        F.round("wanted_share", 6).alias("wanted_share"),
        F.coalesce("source_docs", F.lit(0)).alias("source_docs"),
        F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"),
        F.coalesce("largest_doc", F.lit(0)).alias("largest_doc"),
        F.round("mix_tokens", 3).alias("mix_tokens"),
        F.coalesce("docs_used", F.lit(0)).alias("docs_used"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.round(F.coalesce("tokens", F.lit(0)) / F.sum("tokens").over(w), 6).alias("actual_share"),
    )
    # what a mix has no place for: all documents but those of its sources
    everything = sizes.agg(F.count(F.lit(1)).alias("all_docs"), F.coalesce(F.sum(F.coalesce("n_tokens", F.lit(0))), F.lit(0)).alias("all_tokens"))
    named = plan.groupBy("mix").agg(F.sum(F.coalesce("source_docs", F.lit(0))).alias("d"), F.sum(F.coalesce("source_tokens", F.lit(0))).alias("t"), F.round(F.max("mix_tokens"), 3).alias("mix_tokens"))
    rest = named.crossJoin(F.broadcast(everything)).select(  # one row of totals
        "mix", F.lit(None).cast("string").alias("source"), F.lit(0.0).alias("target_share"), F.lit(0).cast("long").alias("max_repeats"), F.lit(0.0).alias("wanted_share"),
        (F.col("all_docs") - F.col("d")).alias("source_docs"), (F.col("all_tokens") - F.col("t")).alias("source_tokens"), F.lit(0).cast("long").alias("largest_doc"), "mix_tokens",
        F.lit(0).cast("long").alias("docs_used"), F.lit(0).alias("most_copies"), F.lit(0).cast("long").alias("tokens"), F.lit(0.0).alias("actual_share"),
    )
    return Mixture(selection, report.unionByName(rest))
