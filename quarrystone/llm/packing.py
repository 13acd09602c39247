"""Filling containers of fixed capacity: large-item matching over counted sizes."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.operators.ranking import numbered_within
from quarrystone.storage import written


@dataclass(frozen=True)
class Run:
    """Items of one size, in order of their rank from ``first`` on: ``per_bin`` in each of ``bins`` containers from ``bin`` on."""

    size: int
    first: int
    bin: int
    bins: int
    per_bin: int


def pack_counts(counts: dict[int, int], capacity: int, separator: int) -> tuple[list[Run], int]:
    """Runs that place every counted item, and the number of containers.

    Works on sizes and their counts, so its work depends on the capacity and not on the number of items: containers with
    equal contents are kept as one class. Items of more than a third of the capacity come first: from the largest down,
    each is joined by the largest other one that still fits, so at most two share a container. The smaller ones follow
    from the largest down, each into the container with the least room that holds it; new containers are opened when none
    does. Between two items of a container ``separator`` tokens are lost. No size may exceed the capacity.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(s > capacity or s < 0 for s in left):
        raise ValueError("an item is larger than the capacity")
    given = dict.fromkeys(left, 0)
    runs: list[Run] = []
    rooms: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    n_bins = 0

    def place(size: int, bin_: int, bins: int, per_bin: int) -> None:
        runs.append(Run(size, given[size], bin_, bins, per_bin))
        given[size] += bins * per_bin
        left[size] -= bins * per_bin

    def keep(room: int, bin_: int, bins: int) -> None:
        if bins and room >= 0:
            if room not in rooms:
                rooms[room] = []
                insort(order, room)
            rooms[room].append((bin_, bins))

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    ascending = large[::-1]
    for size in large:
        while left[size]:
            # the largest partner that fits beside it
            i = bisect_left(ascending, capacity - size - separator + 1) - 1
            while i >= 0 and (not left[ascending[i]] or ascending[i] > size):
                i -= 1
            partner = ascending[i] if i >= 0 else None
            if partner is None or (partner == size and left[size] < 2):
                bins = left[size]
                place(size, n_bins, bins, 1)
                keep(capacity - size, n_bins, bins)
            elif partner == size:
                bins = left[size] // 2
                place(size, n_bins, bins, 2)
                keep(capacity - 2 * size - separator, n_bins, bins)
            else:
                bins = min(left[size], left[partner])
                place(size, n_bins, bins, 1)
                place(partner, n_bins, bins, 1)
                keep(capacity - size - partner - separator, n_bins, bins)
            n_bins += bins
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        need = size + separator
        while left[size]:
            i = bisect_left(order, need)
            if i == len(order):
                # open containers for what is left, each filled as far as this size goes
                fit = (capacity + separator) // need if need else left[size]
                bins, per_bin = (left[size] // fit, fit) if left[size] >= fit else (1, left[size])
                place(size, n_bins, bins, per_bin)
                keep(capacity - per_bin * size - (per_bin - 1) * separator, n_bins, bins)
                n_bins += bins
                continue
            room = order[i]
            start, bins = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(i)
            fit = room // need if need else left[size]
            if left[size] >= fit * bins:
                place(size, start, bins, fit)
                keep(room - fit * need, start, bins)
            elif left[size] >= fit:
                used = left[size] // fit
                place(size, start, used, fit)
                keep(room - fit * need, start, used)
                keep(room, start + used, bins - used)
            else:
                rest = left[size]
                place(size, start, 1, rest)
                keep(room - rest * need, start, 1)
                keep(room, start + 1, bins - 1)
    return runs, n_bins


def pack(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_id, id, piece, start_token, n_tokens, bin): every row of ``sizes`` (id, n_tokens) in a container of every kind.

    containers: (container_id, capacity_tokens, separator_tokens), a small parameter table. A text larger than the
    capacity is cut into pieces of the capacity, each alone in its container, and its rest is packed with the others;
    no other text is cut. Texts of 0 tokens are packed like any other. ids must be unique; null sizes count as 0; an empty
    table gives no row.

    Sizes are counted first, at most capacity + 1 counts per kind of container; the containers are laid out over the counts in
    one bounded task per kind; every item finds its container by its number among the items of its size, which is taken
    from counts too. Items are never gathered.
    """
    kinds = containers.select("container_id", "capacity_tokens", "separator_tokens").collect()  # a parameter table
    if any(k["capacity_tokens"] is None or k["capacity_tokens"] < 1 for k in kinds):
        raise ValueError("every container needs a capacity")
    if not kinds:
        return sizes.sparkSession.createDataFrame([], _PACKED)
    each = F.array(
        *[
            F.struct(
                F.lit(k["container_id"]).cast("int").alias("container_id"),
                F.lit(k["capacity_tokens"]).cast("long").alias("capacity"),
                F.lit(k["separator_tokens"] or 0).cast("long").alias("separator"),
            )
            for k in kinds
        ]
    )
    n_items = sizes.count()
    salts = max(4, -(-n_items // 2_000_000))
    items = sizes.select("id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.explode(each).alias("k")).select("id", "n_tokens", "k.*")
    whole = F.floor(F.col("n_tokens") / F.col("capacity")).cast("long")
    items = items.withColumn("whole", F.when(F.col("n_tokens") > F.col("capacity"), whole).otherwise(0))
    rest = items.withColumn("rest", F.col("n_tokens") - F.col("whole") * F.col("capacity")).where("whole = 0 or rest > 0")
    counts = rest.groupBy("container_id", "capacity", "separator", "rest").agg(F.count(F.lit(1)).alias("n"))

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        runs, n_bins = pack_counts(dict(zip(pdf["rest"].tolist(), pdf["n"].tolist())), int(pdf["capacity"].iloc[0]), int(pdf["separator"].iloc[0]))
        out = pd.DataFrame([(r.size, r.first, r.bin, r.bins, r.per_bin) for r in runs], columns=["size", "first", "bin", "bins", "per_bin"])
        out.insert(0, "container_id", int(pdf["container_id"].iloc[0]))
        return out.assign(n_bins=n_bins)

    layout = written(
        counts.groupBy("container_id").applyInPandas(lay, "container_id int, size long, first long, bin long, bins long, per_bin long, n_bins long"), "layout"
    )
    numbered = numbered_within(
        rest.select("container_id", "id", "n_tokens", "whole", "rest"), ["container_id", "rest"], [], "id", "rank", salts
    )
    placed = _into_runs(numbered, layout)
    first_free = layout.groupBy("container_id").agg(F.max("n_bins").alias("n_bins"))
    over = items.where("whole > 0").select("container_id", "capacity", "id", "whole")
    # pieces that fill a container of their own are numbered after the others, document by document
    before = numbered_within(over, ["container_id", "whole"], [], "id", "rank", salts)
    per_whole = over.groupBy("container_id", "whole").agg(F.count(F.lit(1)).alias("n"))
    starts = _running(per_whole)
    alone = (
        before.join(starts, ["container_id", "whole"])
        .join(first_free, "container_id", "left")
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
        .select(
            "container_id",
            "id",
            F.col("piece").cast("int").alias("piece"),
            (F.col("piece") * F.col("capacity")).alias("start_token"),
            F.col("capacity").alias("n_tokens"),
            (F.coalesce("n_bins", F.lit(0)) + F.col("start") + F.col("rank") * F.col("whole") + F.col("piece")).alias("bin"),
        )
    )
    return placed.unionByName(alone)


_PACKED = "container_id int, id long, piece int, start_token long, n_tokens long, bin long"


def _running(per_whole: DataFrame) -> DataFrame:
    """Containers taken by documents of fewer whole pieces; one row per number of pieces."""
    w = W.partitionBy("container_id").orderBy("whole").rowsBetween(W.unboundedPreceding, -1)
    return per_whole.select("container_id", "whole", F.coalesce(F.sum(F.col("n") * F.col("whole")).over(w), F.lit(0)).alias("start"))


#: Runs that are sent to every worker; a layout of more is joined instead.
MOST_RUNS = 1_000_000


def _into_runs(numbered: DataFrame, layout: DataFrame, most_runs: int = MOST_RUNS) -> DataFrame:
    """Looks up the run that holds each item's rank. Runs are bounded by the capacities, not by the items.

    Up to ``most_runs`` of them, the last run that begins at or before an item is searched in a sorted array per container and size that a
    worker reads once; beyond that items and runs are joined.
    """
    spark = layout.sparkSession
    if layout.count() > most_runs:
        runs = layout.select(F.col("container_id").alias("c"), "size", "first", F.col("bin").alias("from"), "bins", "per_bin")
        on = (F.col("container_id") == F.col("c")) & (F.col("rest") == F.col("size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("bins") * F.col("per_bin"))
        return numbered.join(runs, on).select(
            "container_id", "id", F.col("whole").cast("int").alias("piece"), (F.col("n_tokens") - F.col("rest")).alias("start_token"), F.col("rest").alias("n_tokens"),
            (F.col("from") + F.floor((F.col("rank") - F.col("first")) / F.col("per_bin"))).cast("long").alias("bin"),
        )
    runs = layout.orderBy("container_id", "size", "first").toPandas()
    table: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
    for key, part in runs.groupby(["container_id", "size"], sort=False):
        table[key] = tuple(part[c].to_numpy() for c in ("first", "bin", "per_bin"))
    shared = spark.sparkContext.broadcast(table)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            bins = np.empty(len(pdf), dtype=np.int64)
            for key, idx in pdf.groupby(["container_id", "rest"], sort=False).indices.items():
                first, bin_, per_bin = shared.value[key]
                rank = pdf["rank"].to_numpy()[idx]
                at = np.searchsorted(first, rank, side="right") - 1
                bins[idx] = bin_[at] + (rank - first[at]) // per_bin[at]
            start = pdf["n_tokens"].to_numpy() - pdf["rest"].to_numpy()
            yield pd.DataFrame(
                {"container_id": pdf["container_id"], "id": pdf["id"], "piece": pdf["whole"].astype("int32"), "start_token": start, "n_tokens": pdf["rest"], "bin": bins}
            )

    return numbered.select("container_id", "id", "n_tokens", "whole", "rest", "rank").mapInPandas(run, _PACKED)


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind of container: items, containers used, the least number that the tokens allow, and the filled share."""
    per_bin = packed.groupBy("container_id", "bin").agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"))
    total = per_bin.groupBy("container_id").agg(
        F.sum("items").alias("n_items"), F.count(F.lit(1)).alias("n_containers"), F.sum("tokens").alias("n_tokens"), F.max("tokens").alias("most_tokens")
    )
    least = F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))
    return total.join(F.broadcast(containers.select("container_id", "name", "capacity_tokens")), "container_id").select(
        "container_id",
        "name",
        "n_items",
        "n_containers",
        "n_tokens",
        least.cast("long").alias("least_containers"),
        F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("filled_share"),
    )
