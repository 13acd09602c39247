"""Row numbers within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered_within(df: DataFrame, group: list[str], order: list[str], tie: str, name: str, salts: int = 64) -> DataFrame:
    """0-based position of each row in its group, ordered by ``order`` and then by an arbitrary but fixed order.

    A group is cut into cells (group, order values, hash of ``tie`` modulo ``salts``). Cells are counted with
    map-side combining, the counts are summed up in order of the cells, and rows are numbered inside their cell
    only. The largest task is therefore one cell and the table of counts has at most
    groups x distinct order values x salts rows. ``tie`` must be unique within the group for a fixed result.
    Null keys form a group of their own. An empty input gives an empty result.
    """
    cell = "__cell"
    salted = df.withColumn(cell, F.pmod(F.xxhash64(F.col(tie)), F.lit(salts)).cast("int"))
    keys = [*group, *order, cell]
    counts = salted.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    # the running sums go over counts only, first over the order values of a group, then over the cells of a value
    coarse = [*group, *order]
    inner = F.coalesce(F.sum("__n").over(_before(coarse, [cell])), F.lit(0))
    if order:
        per_value = counts.groupBy(*coarse).agg(F.sum("__n").alias("__v"))
        before = F.coalesce(F.sum("__v").over(_before(group, order)), F.lit(0))
        before_value = per_value.withColumn("__before", before).drop("__v")
        offsets = null_safe_join(counts.withColumn("__inner", inner).drop("__n"), before_value, coarse).select(
            *keys, (F.col("__before") + F.col("__inner")).alias("__offset")
        )
    else:
        offsets = counts.select(*keys, inner.alias("__offset"))
    inside = salted.withColumn(
        "__row", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(tie).asc_nulls_first())) - 1
    )
    return (
        null_safe_join(inside, offsets, keys)
        .withColumn(name, (F.col("__offset") + F.col("__row")).cast("long"))
        .drop("__offset", "__row", cell)
    )


def _before(partition: list[str], order: list[str]):
    spec = W.partitionBy(*partition) if partition else W.partitionBy(F.lit(0))
    return spec.orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(W.unboundedPreceding, -1)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null equals null; the keys come once, from the left."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    on: Column = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])
