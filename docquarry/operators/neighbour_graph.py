"""An approximate vector index below linear cost: cells of near vectors, a navigable neighbour graph in each part of a cell, best-first walks.

Vectors go to the nearest of a few hundred centroids, learned from a bounded sample; a cell is dealt by a hash into parts of bounded size.  In a part, rounds of
joins of neighbours with their neighbours make each vector's list of nearest ones; lists are made two-way and get a few far links, so that a walk can
leave a cluster.  All vectors are indexed.  A question goes to the parts of its `probe` nearest cells only, and there from vector to vector,
always on from the nearest one that hasn't been followed yet, until the `beam` nearest ones seen are followed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from docquarry.operators import topk
from docquarry.operators.search import DIGITS, metadata_filter
from docquarry.sources.shared import stash

#: Numbers of a part's vectors, about; vectors that centroids are learned from; cells at most; rounds of learning them.
PART_NUMBERS, SAMPLE, CELLS, LEARN = 1 << 20, 20_000, 1024, 6
#: Near links of a vector, and links after those from the other side; far links; rounds of joins at most; vectors joined at a time.
NEAR, LINKS, FAR, ROUNDS, TOGETHER = 14, 24, 2, 10, 256
#: Cells that a question goes to, and vectors that a walk follows; it begins with as many as the root of their number, so that it meets most clusters.
PROBE, BEAM = 4, 160
#: Vectors that a check compares at a time.
COMPARED = 2048


@dataclass
class Graph:
    """parts: cell, part, n, radius (largest distance from the cell's centroid), vectors, links, a row per part; a node's number is its place in the order; nodes: part, node, key, order columns; centroids: cell, centroid."""

    parts: DataFrame
    nodes: DataFrame
    centroids: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f"graph_{x.name}": getattr(self, x.name) for x in fields(self)}

    @classmethod
    def of_tables(cls, tables: dict[str, DataFrame]) -> Graph:
        return cls(**{x.name: tables[f"graph_{x.name}"] for x in fields(cls)})


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def learned_cells(sample: np.ndarray, cells: int, rounds: int = LEARN) -> np.ndarray:
    """Unit centroids: spherical k-means from evenly spaced rows; a centroid that loses all its rows stays."""
    centroids = _unit(sample[np.linspace(0, len(sample) - 1, cells).astype(int)])
    for _ in range(rounds):
        own = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        has = np.bincount(own, minlength=cells) > 0
        centroids[has] = _unit(sums[has])
    return centroids


def _best(x: np.ndarray, rows: np.ndarray, candidates: np.ndarray, k: int) -> np.ndarray:
    """The k candidates nearest to each row, each once and never itself; -1 where there are fewer."""
    candidates = np.sort(candidates, axis=1)
    again = np.diff(candidates, axis=1, prepend=-2) == 0
    near = np.einsum("bd,bcd->bc", x[rows], x[candidates])
    near[again | (candidates == rows[:, None]) | (candidates < 0)] = -np.inf
    pick = np.argpartition(-near, min(k, near.shape[1]) - 1, axis=1)[:, :k]
    found = np.take_along_axis(candidates, pick, axis=1)
    found[np.isneginf(np.take_along_axis(near, pick, axis=1))] = -1
    return found


def _back(links: np.ndarray, width: int) -> np.ndarray:
    """For each node up to `width` nodes that link to it, by number; -1 where there are fewer."""
    n = len(links)
    source, target = np.repeat(np.arange(n), links.shape[1]), links.reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    begins = np.searchsorted(target, np.arange(n))
    place = np.arange(len(target)) - begins[target]
    out = np.full((n, width), -1, dtype=np.int64)
    out[target[place < width], place[place < width]] = source[place < width]
    return out


def neighbour_lists(x: np.ndarray, near: int = NEAR, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """About the `near` nearest of each row by dot product: from random lists, by joins of lists with their members' lists, until few of them change."""
    n, r = len(x), np.random.default_rng(seed)
    k = min(near, n - 1)
    if k <= 0:
        return np.full((n, 1), -1, dtype=np.int64)
    links = np.stack([(np.arange(n) + 1 + r.integers(0, n - 1, n)) % n for _ in range(k)], axis=1)
    for _ in range(rounds):
        back, grown = _back(links, k), np.empty_like(links)
        for at in range(0, n, TOGETHER):
            rows = np.arange(at, min(n, at + TOGETHER))
            own = links[rows]
            both = np.concatenate((own, back[rows]), axis=1)
            # a member's own list, and of those that name this row
            further = np.where(both[:, :, None] >= 0, links[both], -1).reshape(len(rows), -1)
            grown[rows] = _best(x, rows, np.concatenate((both, further), axis=1), k)
        changed = 1 - (np.sort(grown, axis=1) == np.sort(links, axis=1)).mean()
        links = grown
        if changed < 0.01:
            break
    return links


def navigable(links: np.ndarray, width: int = LINKS, far: int = FAR, seed: int = 1) -> np.ndarray:
    """Links of both sides, `width` of a node at most, and `far` random ones; each once, -1 behind the last."""
    n = len(links)
    if n < 2:
        return np.full((n, 1), -1, dtype=np.int32)
    r = np.random.default_rng(seed)
    random = (np.arange(n)[:, None] + 1 + r.integers(0, n - 1, (n, far))) % n
    whole = np.concatenate((links, _back(links, max(1, width - links.shape[1])), random), axis=1)
    order = np.argsort(whole, axis=1, kind="stable")
    ordered = np.take_along_axis(whole, order, axis=1)
    ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
    return -np.sort(-ordered, axis=1).astype(np.int32)


def walk(x: np.ndarray, links: np.ndarray, asked: np.ndarray, k: int, beam: int = BEAM, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """((questions, k) nodes found, -1 where there are fewer, vectors compared with each question); all questions walk side by side."""
    n, m = len(x), len(asked)
    start = np.unique(np.linspace(0, n - 1, int(np.ceil(np.sqrt(n)))).astype(int))
    beam = max(beam, k)
    seen, touched = np.zeros((m, n), dtype=bool), np.full(m, len(start))
    seen[:, start] = True
    ids = np.full((m, beam), -1, dtype=np.int64)
    near = np.full((m, beam), -np.inf)
    done = np.ones((m, beam), dtype=bool)  # followed, or nothing there
    out_ids, out_near = np.full((m, k), -1, dtype=np.int64), np.full((m, k), -np.inf)

    def meet(rows: np.ndarray, nodes: np.ndarray, values: np.ndarray) -> None:
        """nodes with values are new to the rows' beams, and to what they return."""
        for into, scores, width in ((ids, near, beam), (out_ids, out_near, k)):
            v = values if into is ids or allowed is None else np.where(allowed[nodes], values, -np.inf)
            all_ids, all_near = np.concatenate((into[rows], nodes), axis=1), np.concatenate((scores[rows], v), axis=1)
            pick = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
            into[rows], scores[rows] = np.take_along_axis(all_ids, pick, axis=1), np.take_along_axis(all_near, pick, axis=1)
            if into is ids:
                all_done = np.concatenate((done[rows], np.isneginf(values)), axis=1)
                done[rows] = np.take_along_axis(all_done, pick, axis=1)

    meet(np.arange(m), np.tile(start, (m, 1)), asked @ x[start].T)
    while True:
        open_ = np.where(done, -np.inf, near)
        at = np.argmax(open_, axis=1)
        rows = np.flatnonzero(~np.isneginf(open_[np.arange(m), at]))
        if not len(rows):
            break
        at = at[rows]
        done[rows, at] = True
        nodes = links[ids[rows, at]].astype(np.int64)
        fresh = (nodes >= 0) & ~seen[rows[:, None], nodes]
        seen[np.repeat(rows, fresh.sum(axis=1)), nodes[fresh]] = True
        touched[rows] += fresh.sum(axis=1)
        values = np.einsum("ad,ald->al", asked[rows], x[nodes])
        meet(rows, nodes, np.where(fresh, values, -np.inf))
    out_ids[np.isneginf(out_near)] = -1
    return out_ids, touched


def build(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", order: tuple[str, ...] = (), part_numbers: int = 0, sample: int = 0, cells: int = 0) -> Graph:
    """The index of all vectors that aren't null; unit vectors are assumed.  One shuffle of the vectors, by part; a cell of any size is split, so no part grows."""
    spark = vectors.sparkSession
    part_numbers, sample, cells = part_numbers or PART_NUMBERS, sample or SAMPLE, cells or CELLS
    kept = [key, *(c for c in order if c != key)]
    kind = "<f4" if isinstance(vectors.schema[embedding].dataType, ArrayType) and isinstance(vectors.schema[embedding].dataType.elementType, FloatType) else "<f8"
    own = vectors.where(F.col(embedding).isNotNull()).select(*kept, F.col(embedding).cast("array<double>").alias("_e"))
    n, width = own.agg(F.count("*"), F.coalesce(F.max(F.size("_e")), F.lit(1))).first()
    most = max(2, part_numbers // max(1, width))
    share = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = own.where(share <= min(1.0, sample / max(1, n))).select("_e").limit(2 * sample).collect() if n > most else []  # about `sample` rows by the hash
    wanted = min(cells, -(-n // most), max(1, len(chosen) // 8))
    centroids = learned_cells(np.array([r[0] for r in chosen]), wanted) if chosen and wanted > 1 else np.zeros((1, width))
    shared = spark.sparkContext.broadcast(centroids)
    columns = [vectors.schema[c] for c in kept]

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("_e"), width)
            cell = np.argmax(x @ shared.value.T, axis=1).astype(np.int32)
            flat = x.astype(kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(cell), pa.array([v.tobytes() for v in flat], pa.binary())], names=[*kept, "_cell", "_v"])

    dealt = stash(own.mapInArrow(celled, StructType([*columns, *StructType.fromDDL("_cell int, _v binary").fields])), "cells")
    sizes = {r[0]: r[1] for r in dealt.groupBy("_cell").count().collect()}  # a row per cell
    splits = F.create_map(*(F.lit(x) for c, size in (sizes or {0: 1}).items() for x in (c, -(-size // most))))
    part = F.col("_cell").cast("long") * (1 << 24) + F.pmod(F.xxhash64(key), splits[F.col("_cell")].cast("long"))
    schema = StructType([*columns, *StructType.fromDDL("part long, node int, cell int, n int, radius double, vectors binary, links binary").fields])

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*order, key], na_position="first", kind="stable").reset_index(drop=True)
        x = np.frombuffer(b"".join(rows["_v"]), dtype=kind).reshape(len(rows), width)
        links = navigable(neighbour_lists(x.astype(np.float32)))
        at, cell = int(rows["_part"].iloc[0]), int(rows["_cell"].iloc[0])
        nodes = rows[kept].assign(part=at, node=np.arange(len(rows), dtype=np.int32))
        whole = pd.DataFrame([{"part": at, "cell": cell, "n": len(rows), "radius": float(np.linalg.norm(x - shared.value[cell], axis=1).max()), "vectors": x.tobytes(), "links": links.astype("<i4").tobytes()}])
        out = pd.concat([nodes, whole], ignore_index=True).reindex(columns=schema.names)
        return out.astype({"part": "int64", "node": "Int32", "cell": "Int32", "n": "Int32"})

    held = stash(dealt.withColumn("_part", part).groupBy("_part").applyInPandas(linked, schema), "graph")
    nodes = held.where("node is not null").select(*(F.col(c).alias(c) for c in ("part", "node", *kept)))
    parts = held.where("node is null").select(*(F.col(c).alias(c) for c in ("cell", "part", "n", "radius", "vectors", "links")))
    learned = [(i, c) for i, c in enumerate(centroids.tolist())] if n else []
    return Graph(parts, nodes, spark.createDataFrame(learned, "cell int, centroid array<double>"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def walks(index: Graph, queries: DataFrame, k: int = 8, probe: int = 0, beam: int = 0, embedding: str = "embedding", query_key: str = "query_id", allowed: DataFrame | None = None) -> DataFrame:
    """(query_key, part, node, similarity, touched): what each question's walk through each part of its cells found; touched: vectors that the walk compared.

    allowed: (part, allowed), node numbers that may be returned; the others are only walked through.
    """
    spark, probe, beam = queries.sparkSession, probe or PROBE, beam or BEAM
    centroids = index.centroids.orderBy("cell").collect()  # bounded by CELLS
    centre, cells = np.array([r["centroid"] for r in centroids]), [r["cell"] for r in centroids]
    asked = queries.select(query_key, F.col(embedding).cast("array<double>").alias("e")).where("e is not null")
    parts = index.parts if allowed is None else index.parts.join(allowed, "part")
    schema = StructType([queries.schema[query_key], *StructType.fromDDL("part long, node int, similarity double, touched int").fields])
    kinds = [to_arrow_type(f.dataType) for f in schema]
    if not cells:
        return spark.createDataFrame([], schema)

    def of(shared) -> Callable:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    may = None
                    if "allowed" in row:
                        may = np.zeros(row["n"], dtype=bool)
                        may[row["allowed"]] = True
                    for names, matrix, where in shared.value:
                        mine = np.flatnonzero((where == row["cell"]).any(axis=1))
                        if len(mine):
                            yield found(row, may, names, matrix, mine)

        def found(row: dict, may: np.ndarray | None, names: list, matrix: np.ndarray, mine: np.ndarray) -> pa.RecordBatch:
            x = np.frombuffer(row["vectors"], dtype="<f8" if len(row["vectors"]) == 8 * row["n"] * matrix.shape[1] else "<f4").reshape(row["n"], -1)
            links = np.frombuffer(row["links"], dtype="<i4").reshape(row["n"], -1)
            nodes, touched = walk(x, links, matrix[mine], k, beam, allowed=may)
            q, c = np.nonzero(nodes >= 0)
            node = nodes[q, c]
            value = np.round(np.einsum("ij,ij->i", x[node].astype(np.float64), matrix[mine][q]), DIGITS) + 0.0
            columns = [[names[mine[i]] for i in q.tolist()], np.full(len(q), row["part"]), node, value, touched[q]]
            return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(columns, kinds, strict=True)], names=schema.names)

        return search

    out = None
    for blocks in topk.query_passes(asked, query_key):
        held, used = [], set()
        for rows in blocks:
            matrix = np.array([r["e"] for r in rows])
            near = np.argsort(-(matrix @ centre.T), axis=1, kind="stable")[:, :probe]
            held.append(([r[query_key] for r in rows], matrix, np.array(cells)[near]))
            used |= set(np.array(cells)[near].reshape(-1).tolist())
        wanted = parts.where(F.col("cell").isin(sorted(used)))  # other cells' files and row groups aren't read
        part = wanted.mapInArrow(of(spark.sparkContext.broadcast(held)), schema)
        out = part if out is None else out.unionByName(part)
    return out


def unmissed(index: Graph, found: DataFrame, queries: DataFrame, k: int = 8, embedding: str = "embedding", query_key: str = "query_id", allowed: DataFrame | None = None) -> DataFrame:
    """(query_key, part, node, similarity): of each part the k best that reach a question's k-th similarity in `found`, ties by node.

    A part's vectors are compared unless its cell's centroid and radius show that none of them can reach it.
    """
    spark = queries.sparkSession
    centroids = {r["cell"]: np.array(r["centroid"]) for r in index.centroids.collect()}  # bounded by CELLS
    asked = topk.with_floors(queries.select(query_key, F.col(embedding).cast("array<double>").alias("e")).where("e is not null"), found, query_key, "similarity", k)
    parts = (index.parts if allowed is None else index.parts.join(allowed, "part")).drop("links")
    schema = StructType([queries.schema[query_key], *StructType.fromDDL("part long, node int, similarity double").fields])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def of(shared) -> Callable:
        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    x = np.frombuffer(row["vectors"], dtype="<f8" if len(row["vectors"]) == 8 * row["n"] * len(centroids[row["cell"]]) else "<f4").reshape(row["n"], -1)
                    nodes = np.sort(np.array(row["allowed"], dtype=np.int64)) if "allowed" in row else np.arange(row["n"])
                    for names, matrix, floor in shared.value:
                        most = matrix @ centroids[row["cell"]] + np.linalg.norm(matrix, axis=1) * row["radius"]
                        mine = np.flatnonzero(most + topk.SLACK >= floor)
                        if not len(mine):
                            continue
                        held = topk.Held(len(mine), k, ("node",), floor[mine])
                        for at in range(0, len(nodes), COMPARED):
                            some = nodes[at : at + COMPARED]
                            held.add(pd.DataFrame({"node": some}), np.round(x[some].astype(np.float64) @ matrix[mine].T, DIGITS) + 0.0)
                        if held.rows is not None:
                            columns = [[names[mine[i]] for i in held.rows["_query"]], np.full(len(held.rows), row["part"]), held.rows["node"], held.rows["_score"]]
                            yield pa.RecordBatch.from_arrays([pa.array(v, kind, from_pandas=True) for v, kind in zip(columns, kinds, strict=True)], names=schema.names)

        return check

    out = spark.createDataFrame([], schema)
    for blocks in topk.query_passes(asked, query_key):
        held = [([r[query_key] for r in rows], np.array([r["e"] for r in rows]), topk.floor_of(rows)) for rows in blocks]
        out = out.unionByName(parts.mapInArrow(of(spark.sparkContext.broadcast(held)), schema))
    return out


def search(index: Graph, queries: DataFrame, k: int = 8, where: dict | None = None, rows: DataFrame | None = None, key: str = "vec_id", embedding: str = "embedding", query_key: str = "query_id", order: tuple[str, ...] = (), probe: int = 0, beam: int = 0, exact: bool = False) -> DataFrame:
    """(query_key, key, similarity, distance, rank from 0), as vector_topk() gives them but approximate: the near vectors that walks found; similarities are exact.

    where: a filter on the columns of `rows` (key and what is filtered by); a walk goes through other vectors, but only returns those that match.
    exact: a check of all parts follows (unmissed()), so that the result is that of vector_topk().
    """
    order, allowed = order or (key,), None
    if where:
        if rows is None:
            raise ValueError("a filter needs the rows' columns")
        match = rows.where(metadata_filter(rows, where)).select(key)
        allowed = index.nodes.join(match, key, "left_semi").groupBy("part").agg(F.collect_list("node").alias("allowed"))
    found = walks(index, queries, k, probe, beam, embedding, query_key, allowed)
    if exact:
        found = stash(found.drop("touched"), "walked")
        found = found.unionByName(unmissed(index, found, queries, k, embedding, query_key, allowed)).groupBy(query_key, "part", "node").agg(F.max("similarity").alias("similarity"))
    kept = [key, *(c for c in order if c != key)]
    named = found.join(index.nodes.select("part", "node", *kept), ["part", "node"])
    best = topk.ranked(named, query_key, "similarity", k, order)
    return best.select(query_key, key, "similarity", F.round(1 - F.col("similarity"), DIGITS).alias("distance"), "rank")
