"""Sizes of texts in tokens of a public tokenizer.

The vocabulary file is a parameter; it is read once per Python worker. Texts go to Python in Arrow batches and only
their sizes come back. Null and empty texts have size 0. Very long texts are measured whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A vocabulary of ranks: lines of a base64 token and its number.
VOCABULARY = os.environ.get("WAYFOLD_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that cuts texts into pieces before merging, published with this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(vocabulary: str, pattern: str = PATTERN):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _measure(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            at = batch.schema.get_field_index("text")
            sizes = pa.array([len(encode(t)) if t else 0 for t in batch.column(at).to_pylist()], pa.int64())
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], sizes], names=[*names, "tokens"])

    return run


def measured(documents: DataFrame, columns: dict[str, Column], vocabulary: str = VOCABULARY) -> DataFrame:
    """The given columns and tokens, one row per document."""
    taken = documents.select(*[c.alias(n) for n, c in columns.items()], F.col("text").cast("string").alias("text"))
    kept = taken.drop("text").schema
    return taken.mapInArrow(_measure(vocabulary), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", tokens long")
