"""The k best rows of each query of a stated set: queries in blocks against all rows, k rows for each query and task before the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

#: Queries of a block at most, and blocks of a pass over the rows: what is broadcast, and a batch's scores, stay bounded however many queries there are.
QUERY_BLOCK, PASS_BLOCKS = 256, 64


def query_passes(queries: DataFrame, key: str, weight: int = 1, most: int = 0, together: int = 0) -> Iterator[list[list[Row]]]:
    """The queries as lists of blocks, a list for each pass over the rows; weight: how much larger than usual queries are.

    All that fit in one pass (`together` blocks of `most`) are fetched by one job; more are dealt to passes by a hash of their key.
    """
    size, together = max(1, (most or QUERY_BLOCK) // weight), together or PASS_BLOCKS
    found = queries.limit(size * together + 1).collect()  # bounded
    passes = 1 if len(found) <= size * together else -(-queries.count() // (size * together))
    for p in range(passes):
        rows = found if passes == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(passes)) == p).collect()  # about a pass
        yield [rows[i : i + size] for i in range(0, len(rows), size)]


def ranked(df: DataFrame, query_key: str, score: str, k: int, order: tuple[str, ...]) -> DataFrame:
    """The first k of each query with their rank from 0."""
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc(score), *order))
    # compared as the window gives it, so that partitions are cut to k rows before the shuffle
    return df.withColumn("rank", place).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


#: What two ways of adding up one similarity may differ by, rounding to six digits included.
SLACK = 2e-6


def with_floors(asked: DataFrame, found: DataFrame, query_key: str, score: str, k: int) -> DataFrame:
    """The queries with `floor`: the score of the k-th best row found, less SLACK; null where fewer were found."""
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc(score)))
    floors = found.select(query_key, score, place.alias("_n")).where(F.col("_n") <= k).where(F.col("_n") == k)
    return asked.join(floors.select(query_key, (F.col(score) - F.lit(SLACK)).alias("floor")), query_key, "left")


def floor_of(rows: list[Row]) -> np.ndarray:
    return np.array([-np.inf if r["floor"] is None else r["floor"] for r in rows])


class Held:
    """The k best rows of a block's queries among those seen so far."""

    def __init__(self, queries: int, k: int, order: tuple[str, ...], floor: np.ndarray | None = None) -> None:
        """floor: scores that are known to be reached by k rows of each query; lower ones aren't held."""
        self.k, self.by, self.rows = k, ["_query", "_score", *order], None
        self.floor = np.full(queries, -np.inf) if floor is None else np.array(floor, dtype=np.float64)

    def add(self, frame: pd.DataFrame, got: np.ndarray) -> None:
        """frame: rows in their order; got: a score for each row and query."""
        reached = got >= self.floor
        if reached.sum() > 4 * self.k * len(self.floor):
            # the k first of each column: those above its k-th score, and of those at it the first
            edge = np.partition(got, len(frame) - self.k, axis=0)[len(frame) - self.k]
            above, at = got > edge, got == edge
            at &= np.cumsum(at, axis=0) <= self.k - above.sum(axis=0)
            reached &= above | at
        row, asked = np.nonzero(reached)
        if not len(row):
            return
        found = frame.iloc[row].assign(_query=asked, _score=got[row, asked])
        found = found if self.rows is None else pd.concat([self.rows, found])
        found = found.sort_values(self.by, ascending=[True, False, *(True for _ in self.by[2:])], na_position="first", kind="stable").groupby("_query").head(self.k)
        full = found.groupby("_query")["_score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        at = full.index.to_numpy()
        self.rows, self.floor[at] = found, np.maximum(self.floor[at], full["min"].to_numpy())


def best(rows: DataFrame, passes: Iterable[list[tuple[list, Any]]], scores: Callable[[pa.RecordBatch, Any], np.ndarray], k: int, query: StructField, key: str, order: tuple[str, ...], score: str) -> DataFrame:
    """(query's key, key, order columns, score, rank from 0).

    query: the output's first column; passes: lists of (query keys, what scores() needs of them, optionally the floors of Held), each broadcast and asked in one pass over the rows;
    scores(batch, block) gives a row per row of the batch and a column per query.  Equal scores go by `order`.
    """
    spark, kept = rows.sparkSession, [key, *(c for c in order if c != key)]
    schema = StructType([query, *(rows.schema[c] for c in kept), StructField(score, DoubleType())])
    kinds = [to_arrow_type(x.dataType) for x in schema]

    def search(shared) -> Callable:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [Held(len(names), k, order, *floor) for names, _, *floor in shared.value]
            for batch in batches:
                if not batch.num_rows:
                    continue
                frame = batch.select(kept).to_pandas().sort_values(list(order), na_position="first", kind="stable")
                for mine, (_, block, *_) in zip(held, shared.value, strict=True):
                    mine.add(frame, scores(batch, block)[frame.index.to_numpy()])
            for mine, (names, *_) in zip(held, shared.value, strict=True):
                if mine.rows is not None:
                    columns = [[names[i] for i in mine.rows["_query"]], *(mine.rows[c] for c in kept), mine.rows["_score"]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k, from_pandas=True) for x, k in zip(columns, kinds, strict=True)], names=schema.names)

        return of

    found = None
    for blocks in passes:
        part = rows.mapInArrow(search(spark.sparkContext.broadcast(blocks)), schema)
        found = part if found is None else found.unionByName(part)
    return ranked(found, query.name, score, k, order)
