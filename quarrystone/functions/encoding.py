"""An encoder without a model: signed word counts in hashed places, so that dense search runs and can be checked offline."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.storage import spread

_WORD = re.compile("[a-z0-9]+")


@lru_cache(maxsize=1_000_000)
def _place(word: str, width: int) -> tuple[int, float]:
    h = md5(word.encode()).hexdigest()
    return int(h[:2], 16) % width, 1.0 if h[2] < "8" else -1.0


def hashed_vectors(docs: DataFrame, text: str, keep: list[str], width: int = 64) -> DataFrame:
    """The kept columns and ``embedding``, array<float> of ``width`` (at most 256): each word adds or takes one at the place that its md5 names; null and wordless texts give zeros."""
    src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kinds = dict(src.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, width), dtype=np.float32)
            for row, value in zip(out, batch.column(batch.num_columns - 1).to_pylist()):
                for word in _WORD.findall(value.lower()):
                    at, by = _place(word, width)
                    row[at] += by
            ends = pa.array(np.arange(0, out.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], [*batch.schema.names[:-1], "embedding"])

    return spread(src).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", embedding array<float>")


def hashed_counts(passages: DataFrame, keep: list[str], width: int = 64) -> DataFrame:
    """hashed_vectors of passages whose words are counted already, as an index holds them in ``tokens`` and ``tfs``: no text is read again."""
    src = passages.select(*keep, "tokens", "tfs")
    kinds = dict(src.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column(batch.num_columns - 2), batch.num_rows
            words = lists.flatten().dictionary_encode()
            places = [_place(word, width) for word in words.dictionary.to_pylist()]
            at, by = np.array([p[0] for p in places], dtype=np.int64), np.array([p[1] for p in places])
            code, row = words.indices.to_numpy(), np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
            out = np.bincount(row * width + at[code], by[code] * batch.column(batch.num_columns - 1).flatten().to_numpy(), n * width).astype(np.float32) if len(code) else np.zeros(n * width, dtype=np.float32)
            ends = pa.array(np.arange(0, out.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.ListArray.from_arrays(ends, pa.array(out))], [*batch.schema.names[:-2], "embedding"])

    return spread(src).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", embedding array<float>")
