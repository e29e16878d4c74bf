"""Index backends: what each keeps beside chunks and vectors, and how it is asked.  Filters are by equality and membership, before ranking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from docquarry.operators import neighbour_graph, search


@dataclass(frozen=True)
class Backend:
    """build(rows, key, order) -> tables that are stored with the index; rows have the key, the order columns and `embedding`.

    ask(tables, rows, asked, k, where, key, order) -> (query_id, key, similarity, distance, rank), for asked (query_id, embedding).
    """

    build: Callable[[DataFrame, str, tuple[str, ...]], dict[str, DataFrame]]
    ask: Callable[..., DataFrame]


def _exact(tables: dict, rows: DataFrame, asked: DataFrame, k: int, where: dict | None, key: str, order: tuple[str, ...]) -> DataFrame:
    return search.vector_topk(rows, asked, k, where, key, order=order)


def _quantised(tables: dict, rows: DataFrame, asked: DataFrame, k: int, where: dict | None, key: str, order: tuple[str, ...]) -> DataFrame:
    return search.vector_topk_quantised(rows, asked, k, key, index=tables["codes"], where=where, order=order)


def _graph(tables: dict, rows: DataFrame, asked: DataFrame, k: int, where: dict | None, key: str, order: tuple[str, ...]) -> DataFrame:
    return neighbour_graph.search(neighbour_graph.Graph.of_tables(tables), asked, k, where, rows, key, order=order)


EXACT = Backend(lambda rows, key, order: {}, _exact)
QUANTISED = Backend(lambda rows, key, order: {"codes": search.quantised(rows, key)}, _quantised)
GRAPH = Backend(lambda rows, key, order: neighbour_graph.build(rows, key, order=order).tables(), _graph)
