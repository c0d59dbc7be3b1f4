"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "byte_bpe_50k.tiktoken"
SETTING = "spark.curatrix.tokenizer"


def vocabulary_path(spark: SparkSession | None = None, name: str = TOKENIZER) -> str:
    """The path that the session names by SETTING; where it doesn't, a vocabulary of the module public_tokenizers, if that is installed."""
    found = spark.conf.get(SETTING, None) if spark else None
    if found:
        return found
    import public_tokenizers

    return public_tokenizers.path(name)


# fixed value: how the public byte-level vocabularies cut a text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(path: str):
    """Reading it takes less than a tenth of a second, so each task does."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted_with(docs: DataFrame, keep: list[str], text_col: str, tokenizer: str | None = None) -> DataFrame:
    """The columns kept, and tokens, for every row; a null text has 0 tokens. `tokenizer` is the path of a tiktoken vocabulary that every worker can read."""
    path = tokenizer or vocabulary_path(docs.sparkSession)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_to_numpy
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    return docs.select(*keep, F.col(text_col)).mapInArrow(count, schema)
