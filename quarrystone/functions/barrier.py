"""Columns that are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """The kept columns and the given ones, each expression evaluated once.

    They pass through a generator of one row, so that a filter above cannot copy costly expressions below itself.
    """
    row = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__row")
    return df.select(*keep, row).select(*keep, "__row.*")
