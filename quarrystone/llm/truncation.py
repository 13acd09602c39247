"""Texts cut off by field limits: strict prefixes of longer copies, open structures and endings inside a sentence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.functions.barrier import computed_once
from quarrystone.llm.endings import clean, ends_whole, is_figure, without_citations
from quarrystone.llm.pairs import PLACEHOLDERS
from quarrystone.storage import written


#: What a truncated value is recognised by.
REASONS = ("longer_copy", "open_structure", "ending")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each value of a task once, so that one that many rows have moves once per task; eight bytes are kept per value of the task."""
    seen: set[int] = set()
    for batch in batches:
        keep = []
        for value in batch.column(0).to_pylist():
            digest = xxhash.xxh3_64_intdigest(value)
            keep.append(digest not in seen)
            seen.add(digest)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted values: what the next other value adds when it begins with the value. First and last value are marked."""
    held, first = None, True
    out: list[tuple] = []

    def flush():
        cols = list(zip(*out)) if out else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string()))], ["value", "rest", "edge"])

    for batch in batches:
        for value in batch.column(0).to_pylist():
            if first:
                out.append((value, None, "first"))
                first = False
            elif value == held:
                continue
            elif value.startswith(held):
                out.append((held, value[len(held) : len(held) + 40], None))
            held = value
        if out:
            yield flush()
            out.clear()
    if held is not None:
        out.append((held, None, "last"))
        yield flush()


def value_keys(value: Column) -> list[Column]:
    """Two hashes that together stand for a value, so that values are looked up without moving them."""
    return [F.xxhash64(value).alias("k1"), F.xxhash64(F.lit("value"), value).alias("k2")]


def longer_copy_keys(values: DataFrame, column: str) -> DataFrame:
    """(k1, k2, rest): the keys (``value_keys``) of each distinct value that is a strict prefix of another, with up to 40 characters of what the next one adds.

    Sorted by code points, a value that is a prefix of any other is a prefix of its successor, so one range partitioning
    and a look at neighbours finds them all, however many values share a beginning. Values move once, repeats only once per task. The two neighbours across a
    partition's edge are compared in a table of two rows per partition. Null and empty values are left out.
    """
    spark = values.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    once = values.select(F.col(column).alias("value")).where("value is not null and value <> ''").mapInArrow(_once, "value string")
    found = once.repartitionByRange(parts, "value").sortWithinPartitions("value").mapInArrow(_followers, "value string, rest string, edge string")
    seen = written(found.select(*value_keys(F.col("value")), "rest", "edge", F.when(F.col("edge").isNotNull(), F.col("value")).alias("value")), "followers")
    inside = seen.where("edge is null").select("k1", "k2", "rest")
    # two rows per partition
    edges = seen.where("edge is not null").withColumn("kind", F.when(F.col("edge") == "first", 0).otherwise(1))
    after = F.lead("value").over(W.partitionBy(F.lit(0)).orderBy("value", "kind"))
    across = (
        edges.withColumn("next", after)
        .where((F.col("edge") == "last") & F.col("next").isNotNull() & (F.length("next") > F.length("value")) & F.startswith("next", F.col("value")))
        .select("k1", "k2", F.expr("substring(next, length(value) + 1, 40)").alias("rest"))
    )
    return inside.union(across).distinct()


def longer_copies(values: DataFrame, column: str) -> DataFrame:
    """(value, rest): longer_copy_keys with the values themselves, each once."""
    held = values.select(F.col(column).alias("value")).where("value <> ''").distinct()
    return held.select("value", *value_keys(F.col("value"))).join(longer_copy_keys(values, column), ["k1", "k2"]).select("value", "rest")


def _stripped(raw: Column) -> Column:
    """Without what is put after a cut: white space, a closing fence, an ellipsis, a note that something was cut."""
    tail = r"(?:\s|```|…|\.{3,}|\[(?:truncated|cut|\.\.\.|…)\]|<truncated>)+$"
    return F.regexp_replace(F.coalesce(raw, F.lit("")), tail, "")


_JSON_BEGINS = r"^\s*(?:```\w*\s*)?[{]|^\s*(?:```\w*\s*)?\[\s*[{\"\]]|^\s*`{1,3}\w*\s*$"
_LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def structure_parts(raw: Column) -> dict[str, Column]:
    """Columns that structure_state reads: whether raw begins like JSON, and what is left of it without string literals, so that brackets inside them do not count."""
    text = F.coalesce(raw, F.lit(""))
    return {
        "begins": text.rlike(_JSON_BEGINS) | F.contains(text, F.lit('"answerable"')) & text.rlike(r'[{]\s*"answerable"'),
        "body": F.regexp_replace(F.regexp_replace(text, r"^[^{\[]*", ""), _LITERAL, ""),
    }


def structure_state(raw: Column) -> Column:
    """'closed' or 'open' where raw is JSON, whether valid or not, 'plain' elsewhere, 'blank' without any character; reads the columns begins and body."""
    body = F.col("body")
    count = lambda c: F.length(body) - F.length(F.replace(body, F.lit(c), F.lit("")))
    closed = body.rlike(r"^[{\[]") & (count("{") == count("}")) & (count("[") == count("]")) & ~F.contains(body, F.lit('"'))
    # quotes inside a literal may be unescaped; output that ends with the closing brackets of the whole is complete all the same
    ends = _stripped(raw).rlike(r"\]\s*,?\s*\}\s*$") & (count("{") <= count("}"))
    blank = ~F.coalesce(raw, F.lit("")).rlike(r"\S")
    return F.when(blank, "blank").when(~F.col("begins"), "plain").when(closed | ends, "closed").otherwise("open")


def _marker(text: Column) -> Column:
    """Ends inside a citation marker."""
    return text.rlike(r"\[\d{0,4}(?:\s*[,;–-]\s*\d{0,4})*\s*$")


def _says_nothing(text: Column) -> Column:
    bare = F.regexp_replace(text, r"\[\d{1,4}(?:\s*[,;–-]\s*\d{1,4})*\]", "")
    shell = F.regexp_replace(F.lower(bare), r"^[\s\p{P}\p{S}]+|[\s\p{P}\p{S}]+$", "")
    once = F.regexp_replace(shell, r"^(.{1,40}?)(?:[\s\p{P}\p{S}]+\1)+$", "$1")
    return (F.regexp_replace(bare, r"[\p{P}\p{S}\p{Z}\p{C}]+", "") == "") | once.rlike("^(?:" + PLACEHOLDERS + ")$")


def _goes_on(rest: Column) -> Column:
    """What a longer copy adds shows that the value stopped inside a word, a figure or a sentence."""
    return rest.rlike(r"^(?:[\p{Ll}\p{M}\d%]|[,;:)]|\s+\p{Ll})")


def rendered(sentences: Column) -> Column:
    """Sentences with their citation markers, as they are shown."""
    one = lambda s: F.concat(
        F.trim(F.coalesce(s["text"], F.lit(""))),
        F.when(F.size(s["sources"]) > 0, F.concat(F.lit(" "), F.array_join(F.transform(s["sources"], lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ""))).otherwise(""),
    )
    return F.array_join(F.transform(sentences, one), " ")


def truncated_values(generations: DataFrame) -> DataFrame:
    """(generation_id, provider, model, field, truncated, reason) for field 'raw' and 'text' of every row.

    reason: 'open_structure' (JSON that never closes), 'longer_copy' (a strict prefix of a longer value, rendered answers
    included, which goes on inside a word or sentence), 'ending' (stops inside a word, a sentence or a marker without a
    longer copy), null where the value is whole. Null and blank values, figures, names and placeholders are whole.
    Extra columns are left out; repeated rows and repeated values are judged alike; parse_error and stop_reason are not
    looked at.
    """
    base = generations.select("generation_id", "provider", "model", "raw", "text", rendered(F.col("sentences")).alias("shown"))
    values = base.select(
        "generation_id", "provider", "model", F.explode(F.array(F.struct(F.lit("raw").alias("field"), F.col("raw").alias("value")), F.struct(F.lit("text").alias("field"), F.col("text").alias("value")))).alias("v")
    ).select("generation_id", "provider", "model", "v.field", "v.value")
    everything = base.select(F.explode(F.array_distinct(F.array(F.rtrim("raw"), "text", "shown", _stripped(F.col("raw"))))).alias("value"))
    copies = longer_copy_keys(everything, "value")
    keys = ["generation_id", "provider", "model", "field"]
    is_raw = F.col("field") == "raw"
    # in steps, so that each costly expression is computed once and stays small enough to be compiled
    parts = computed_once(
        values, [*keys, "value"], {"cut": F.when(is_raw, _stripped(F.col("value"))).otherwise(F.coalesce("value", F.lit(""))), **{k: F.when(is_raw, c) for k, c in structure_parts(F.col("value")).items()}}
    )
    k1, k2 = value_keys(F.col("cut"))
    looked = computed_once(parts, [*keys, "value", "cut"], {"state": F.when(is_raw, structure_state(F.col("value"))).otherwise("plain"), "k1": k1, "k2": k2})
    # values whose structure decides need no look at how they end
    reads = ~F.col("state").isin("closed", "blank", "open")
    flat = computed_once(looked, [*keys, "k1", "k2", "state"], {"flat": F.when(reads, clean(F.col("cut"))), "noted": reads & is_raw & _note(F.col("value"))})
    tails = computed_once(flat, [*keys, "k1", "k2", "state", "flat", "noted"], {"tail": without_citations(F.col("flat")), "marker": _marker(F.col("flat")), "nothing": _says_nothing(F.col("flat"))})
    ends = computed_once(
        tails, [*keys, "k1", "k2", "state"],
        {"figure": is_figure(F.col("tail")), "whole": ~reads | (F.col("nothing") & ~F.col("marker")), "stops": F.col("marker") | F.col("noted") | ~ends_whole(F.col("tail"))},
    )
    # only hashes and what was read of a value are joined to its copies
    joined = ends.join(copies, ["k1", "k2"], "left")
    found_copy = F.col("rest").isNotNull()
    judged = joined.select(
        *keys,
        F.when(F.col("state") == "open", F.when(found_copy, "longer_copy").otherwise("open_structure"))
        .when(F.col("whole"), F.lit(None))
        .when(_goes_on(F.col("rest")) & ~F.col("figure"), "longer_copy")
        .when(F.col("stops"), F.when(found_copy, "longer_copy").otherwise("ending"))
        .alias("reason"),
    )
    return judged.withColumn("truncated", F.col("reason").isNotNull()).select(*keys, "truncated", "reason")


def prefix_values(generations: DataFrame) -> DataFrame:
    """(generation_id, field) of the raw and text values that are a strict prefix of another one; nothing else is looked at."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("raw", "text")])
    values = generations.select("generation_id", F.explode(fields).alias("v")).select("generation_id", "v.*").where("value <> ''")
    return values.select("generation_id", "field", *value_keys(F.col("value"))).join(longer_copy_keys(values, "value"), ["k1", "k2"]).select("generation_id", "field")


def _note(raw: Column) -> Column:
    """Output that ends with a sign that something was cut."""
    return F.coalesce(raw, F.lit("")).rlike(r"(?:…|\.{3}|\[(?:truncated|cut|\.\.\.|…)\]|<truncated>)\s*(?:```\s*)?$")


def truncation_rates(values: DataFrame) -> DataFrame:
    """Values and truncated values by provider (trimmed, lower case, 'unknown' where null) and model, per field, and how many were recognised by what."""
    source = F.coalesce(F.nullif(F.lower(F.trim("provider")), F.lit("")), F.lit("unknown"))
    return (
        values.groupBy(source.alias("provider"), F.coalesce("model", F.lit("unknown")).alias("model"), "field")
        .agg(F.count(F.lit(1)).alias("n_values"), F.count_if("truncated").alias("n_truncated"), *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in REASONS])
        .withColumn("truncated_share", F.round(F.col("n_truncated") / F.col("n_values"), 6))
    )
