"""Sizes of texts in tokens of a public tokenizer; the vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.storage import spread

#: Where the vocabulary of the sizes is read from, on every executor.
VOCABULARY = os.environ.get("QUARRYSTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how this vocabulary cuts a text into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """One encoder per worker and file."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _ENCODINGS[path] = tiktoken.Encoding("vocabulary", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_sizes(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """id, the kept columns and n_tokens of every row; null and empty texts have 0 tokens. Whole texts are encoded."""
    keep = keep or []
    src = docs.select(F.col(id_col).cast("long").alias("id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kinds = dict(src.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["id", *keep]) + ", n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary)._core_bpe.encode_ordinary if hasattr(encoding(vocabulary), "_core_bpe") else encoding(vocabulary).encode_ordinary
        for batch in batches:
            sizes = pa.array([len(encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], [*batch.schema.names[:-1], "n_tokens"])

    return spread(src).mapInArrow(run, schema)
