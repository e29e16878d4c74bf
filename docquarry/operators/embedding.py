"""Embeddings: feature hashing within a row, dense or sparse; a neural encoder behind an import guard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.tokens import tokenized
from docquarry.sources.shared import arrow_limits

DIM = 256


def _hashed(tokens: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, sign) of each token: the first eight md5 bytes as a little-endian number modulo dim, the sign by the top bit of the eighth."""
    raw = b"".join([hashlib.md5(x).digest() for x in tokens.cast(pa.binary()).to_pylist()])
    first = np.frombuffer(raw, dtype="<u8")[::2]
    return (first % np.uint64(dim)).astype(np.int64), np.where(first >> np.uint64(63), 1.0, -1.0)


def _tables(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """Each row's hashed vector as whole numbers: a hash for each different token of the batch, then one count."""
    sizes, tokens = tokenized(batch.column("lowered"))
    row = np.repeat(np.arange(batch.num_rows), sizes)
    known = tokens.dictionary_encode()
    bucket, sign = _hashed(known.dictionary, dim)
    place = known.indices.to_numpy(zero_copy_only=False)
    flat = np.bincount(row * dim + bucket[place], weights=sign[place], minlength=batch.num_rows * dim) if len(place) else np.zeros(batch.num_rows * dim)
    return flat.reshape(batch.num_rows, dim)


def hash_embed(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, bucket, value): the non-zero cells of each text's hashed vector, as whole numbers before normalisation.  A row alone decides its cells: no shuffle."""
    arrow_limits(df.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = _tables(batch, dim)
            row, bucket = np.nonzero(table)
            columns = [batch.column(key).take(pa.array(row)), pa.array(bucket, pa.int32()), pa.array(table[row, bucket].astype(np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "bucket", "value"])

    return df.select(key, F.lower(F.col(text)).alias("lowered")).mapInArrow(of, f"{key} {dict(df.dtypes)[key]}, bucket int, value long")


def hash_vectors(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, embedding): unit vectors of dim numbers; texts without a token have the zero vector.  No shuffle."""
    arrow_limits(df.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = _tables(batch, dim)
            length = np.sqrt((table * table).sum(axis=1, keepdims=True))
            table /= np.where(length == 0, 1.0, length)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, dim), pa.int32()), pa.array(table.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(key), vectors], names=[key, "embedding"])

    return df.select(key, F.lower(F.col(text)).alias("lowered")).mapInArrow(of, f"{key} {dict(df.dtypes)[key]}, embedding array<double>")


def neural_vectors(df: DataFrame, key: str, text: str, model: str = "sentence-transformers/all-MiniLM-L6-v2", batch: int = 32) -> DataFrame:
    """Unit vectors of a sentence-transformers model, loaded once in each worker.  Needs that package on every executor."""
    try:
        import sentence_transformers  # noqa: F401
    except ImportError as e:
        raise RuntimeError("the neural embedder needs sentence-transformers") from e

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from sentence_transformers import SentenceTransformer

        loaded = SentenceTransformer(model)
        for frame in frames:
            got = loaded.encode(frame[text].fillna("").tolist(), batch_size=batch, normalize_embeddings=True)
            yield pd.DataFrame({key: frame[key], "embedding": [x.astype(float).tolist() for x in got]})

    return df.select(key, text).mapInPandas(encode, f"{key} {dict(df.dtypes)[key]}, embedding array<double>")
