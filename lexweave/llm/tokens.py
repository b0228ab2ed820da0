"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary lies on every executor, unless the session says otherwise in spark.lexweave.vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tokens of typical text that are added to each text before its mean is taken.
PRIOR_TOKENS = 20
# Fixed value: the public split pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_of(spark: SparkSession) -> str:
    return spark.conf.get("spark.lexweave.vocabulary", VOCABULARY)


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sizes(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return run


def sized(df: DataFrame, text: str, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """(*keep, n_tokens) of every row; a null text has 0 tokens. Whole texts are tokenised, in one pass and once each."""
    rows = df.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_sizes(path), f"{schema}, n_tokens long")


def _token_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total = encoding(path).encode_ordinary, np.zeros(encoding(path).n_vocab, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    total += np.bincount(np.asarray(encode(text), np.int64), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["token", "n"])

    return run


def _weighed(path: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, (chance, mean) = encoding(path).encode_ordinary, shared.value
        for batch in batches:
            n, weight = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                ids = encode(text) if text else []
                n.append(len(ids))
                weight.append(float(np.exp(-abs((chance[ids].sum() + PRIOR_TOKENS * mean) / (len(ids) + PRIOR_TOKENS) - mean))) if ids else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(weight, pa.float64())], names=[*batch.schema.names[:-1], "n_tokens", "weight"])

    return run


def sized_and_weighed(df: DataFrame, text: str, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """(*keep, n_tokens, weight) of every row: its tokens, and how typical it is of all texts.

    A unigram model of tokens is counted over all texts; its size is that of the vocabulary, whatever the data's. A text's
    weight is exp(-d), d being how far its mean log-probability a token lies from that of all texts, in either direction: both
    garbled and monotonous texts weigh little. Short texts are drawn to the mean. A text without tokens weighs 0.
    """
    counts = df.select(text).mapInArrow(_token_counts(path), "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(encoding(path).n_vocab, np.float64)
    n[counts["token"].to_numpy(np.int64)] = counts["n"].to_numpy(np.float64)
    chance = np.log((n + 1) / (n.sum() + len(n)))
    mean = float((n * chance).sum() / max(n.sum(), 1))
    rows = df.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_weighed(path, df.sparkSession.sparkContext.broadcast((chance, mean))), f"{schema}, n_tokens long, weight double")
