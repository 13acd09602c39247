"""Streams: append logs, windowed counts with late data, index upserts and partial answers."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrystone.sources.records import exists, replace_table
from quarrystone.storage import written


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and kind; rows later than ``late`` behind the newest are dropped by the watermark."""
    seen = events.withWatermark("ts", late)
    return seen.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events without a pause of ``gap``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n"
    )


def follow(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    """An append-only log as a stream."""
    return spark.readStream.schema(schema).format(form).load(path)


def once(stream: DataFrame, path: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """Appends what is new since the last run and stops."""
    return stream.writeStream.format(form).outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_latest(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, buckets: int = 1) -> StreamingQuery:
    """Keeps the newest row of each key in a table; a batch that is repeated after a failure changes nothing.

    With several ``buckets`` the table lies in folders by the hash of the key (column ``bucket``), and a batch reads, merges and replaces only the buckets it has rows of; with one it replaces the table as a whole.
    """

    def newest(rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c != key]
        return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.col(order), F.xxhash64(*others))).alias("r")).select(key, "r.*").select(*rows.columns)

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if buckets == 1:
            stored = batch if not exists(spark, path) else spark.read.schema(batch.schema).parquet(path).unionByName(batch)
            replace_table(newest(stored), path)
            return
        rows = written(batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "batch")
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        if exists(spark, path):
            rows = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(*touched)).unionByName(rows)
        merged = written(newest(rows), "merged")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def partial_prose(raw: str, abstain: str = "The filings do not answer this question.") -> str:
    """What can be shown of an answer that is still being written as JSON: the sentences so far, the open one up to its last whole escape; only ever grows until the answer is known to be none.

    Plain text shows as it is; nothing shows before the first sentence begins.
    """
    body = re.sub(r"^\s*```\w*\s*", "", raw)
    if not body.lstrip().startswith("{"):
        return "" if body.lstrip().startswith("`") else body.rstrip()
    if re.search(r'"answerable"\s*:\s*false', body):
        return abstain
    parts = []
    for m in re.finditer(r'"text"\s*:\s*"((?:[^"\\]|\\(?:u[0-9a-fA-F]{4}|[^u]))*)("?)', body):
        piece = m.group(1)
        if m.group(2) != '"' and re.search(r"\\u[dD][89abAB][0-9a-fA-F]{2}$", piece):
            piece = piece[:-6]
        try:
            parts.append(json.loads(f'"{piece}"', strict=False))
        except ValueError:
            break
    return " ".join(p.strip() if i < len(parts) - 1 else p.lstrip() for i, p in enumerate(parts) if p.strip())


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose second stage is not there yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
