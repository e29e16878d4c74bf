"""Exact cosine top-k of a query set against all vectors, in blocks; metadata filters; an approximate backend."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import exprs as X
from docquarry.operators import topk

#: Digits that scores are rounded to before ranking, so that near-ties have one order everywhere.
DIGITS = 6


def metadata_filter(df: DataFrame, where: dict | None) -> Column:
    """All keys must match: a scalar by equality, a list by membership, null equals null; an unknown key reads as null."""
    met = F.lit(True)
    for key, want in (where or {}).items():
        value = F.col(key) if key in df.columns else F.lit(None).cast("string")
        if isinstance(want, list | tuple | set | frozenset):
            own = value.isin([x for x in want if x is not None]) if any(x is not None for x in want) else F.lit(False)
            met = met & (F.coalesce(own, F.lit(False)) | (value.isNull() if None in want else F.lit(False)))
        else:
            met = met & value.eqNullSafe(F.lit(want))
    return met


def vector_topk(
    vectors: DataFrame, queries: DataFrame, k: int = 8, where: dict | None = None, key: str = "vec_id", embedding: str = "embedding", query_key: str = "query_id", order: tuple[str, ...] = (), near: DataFrame | None = None
) -> DataFrame:
    """(query_key, key, similarity, distance, rank from 0): the k nearest of each query; ties by `order`, which is the key unless given.

    Vectors are assumed to be at unit length; those that are null are left out.  Filters hold before ranking.  Blocks of queries are broadcast as matrices and asked in one scan (`topk.PASS_BLOCKS` of them a
    scan); a batch of vectors is one product with each, and a task keeps k vectors for each query, so no pairs of vectors are ever rows.
    near: (query_key, similarity) of rows already found; vectors below a query's k-th best of them aren't held.
    """
    asked = queries.select(query_key, F.col(embedding).cast("array<double>").alias("e")).where("e is not null")
    asked = asked.withColumn("floor", F.lit(None).cast("double")) if near is None else topk.with_floors(asked, near, query_key, "similarity", k)
    rows = vectors.where(metadata_filter(vectors, where)).where(F.col(embedding).isNotNull())
    rows = rows.select(key, *(c for c in order if c != key), F.col(embedding).cast("array<double>").alias("e"))

    def scores(batch: pa.RecordBatch, matrix: np.ndarray) -> np.ndarray:
        own = batch.column("e").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        return np.round(own @ matrix.T, DIGITS) + 0.0

    passes = ([([r[query_key] for r in block], np.array([r["e"] for r in block]), topk.floor_of(block)) for block in blocks] for blocks in topk.query_passes(asked, query_key))
    found = topk.best(rows, passes, scores, k, queries.schema[query_key], key, order or (key,), "similarity")
    return found.select(query_key, key, "similarity", F.round(1 - F.col("similarity"), DIGITS).alias("distance"), "rank")


def quantised(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, code, scale): an index of every vector with a byte per number; a null vector has no row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("e").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            scale = np.abs(own).max(axis=1, initial=0.0) / 127
            code = np.rint(own / np.where(scale == 0, 1.0, scale)[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(scale)], names=[key, "code", "scale"])

    own = vectors.select(key, F.col(embedding).cast("array<double>").alias("e")).where("e is not null")
    return own.mapInArrow(of, f"{key} {dict(vectors.dtypes)[key]}, code binary, scale double")


def vector_topk_quantised(vectors: DataFrame, queries: DataFrame, k: int = 8, key: str = "vec_id", embedding: str = "embedding", query_key: str = "query_id", pool: int = 4, index: DataFrame | None = None, where: dict | None = None, order: tuple[str, ...] = (), exact: bool = False) -> DataFrame:
    """vector_topk() in two steps, approximate: `pool` * k candidates of each query by the index's codes alone (an eighth of the vectors' bytes), then exact similarities of these.

    The codes' error is a few thousandths whatever the number of vectors, so only neighbours nearer than that to the pool's edge can be missed.  index: quantised().
    Filters hold before ranking; equal similarities go by `order`, which is the key unless given.
    exact: a check follows: every vector that reaches the k-th similarity found is asked for, so that no nearer or equal one, of a large group of copies say, is missed.
    """
    codes, order = quantised(vectors, key, embedding) if index is None else index, order or (key,)
    if where:
        codes = codes.join(vectors.where(metadata_filter(vectors, where)).select(key), key, "left_semi")
    asked = queries.select(query_key, F.col(embedding).cast("array<double>").alias("e")).where("e is not null")

    def scores(batch: pa.RecordBatch, matrix: np.ndarray) -> np.ndarray:
        own = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.int8).reshape(batch.num_rows, -1)
        return (own.astype(np.float32) @ matrix.T) * batch.column("scale").to_numpy()[:, None]

    passes = ([([r[query_key] for r in block], np.array([r["e"] for r in block], dtype=np.float32)) for block in blocks] for blocks in topk.query_passes(asked, query_key))
    near = topk.best(codes, passes, scores, pool * k, queries.schema[query_key], key, (key,), "near").select(query_key, key)
    kept = [key, *(c for c in order if c != key)]
    pairs = near.join(vectors.select(*kept, F.col(embedding).alias("own")), key).join(asked, query_key)
    found = pairs.select(query_key, *kept, (F.round(X.dot(F.col("own"), F.col("e")), DIGITS) + F.lit(0.0)).alias("similarity"))
    if exact:
        return vector_topk(vectors, queries, k, where, key, embedding, query_key, order, found)
    best = topk.ranked(found, query_key, "similarity", k, order)
    return best.select(query_key, key, "similarity", F.round(1 - F.col("similarity"), DIGITS).alias("distance"), "rank")
