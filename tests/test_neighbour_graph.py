"""The neighbour graph: lists, walks, recall against exact search and how much of the vectors a walk touches."""

import numpy as np
import pytest
from docquarry.operators import neighbour_graph as G
from docquarry.operators import search
from pyspark.sql import functions as F


def vectors(n: int, d: int, clusters: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) if not clusters else r.normal(size=(clusters, d))[r.integers(0, clusters, n)] + 0.35 * r.normal(size=(n, d))
    return G._unit(x)


def test_lists_come_near_the_nearest():
    x = vectors(3000, 24, 30, 1).astype(np.float32)
    lists = G.neighbour_lists(x)
    near = np.argsort(-(x[:300] @ x.T), axis=1, kind="stable")[:, 1 : G.NEAR + 1]
    assert np.mean([len(set(a) & set(b)) / G.NEAR for a, b in zip(lists[:300].tolist(), near.tolist(), strict=True)]) > 0.9
    for i, row in enumerate(lists[:300].tolist()):
        assert i not in row and len(set(row)) == G.NEAR
    links = G.navigable(lists)
    for i, row in enumerate(links.tolist()):
        own = [v for v in row if v >= 0]
        assert len(own) == len(set(own)) and set(lists[i].tolist()) <= set(own) and row[len(own) :] == [-1] * (len(row) - len(own))


@pytest.mark.parametrize("n", [1, 2, 3, 9])
def test_small_parts(n):
    x = vectors(n, 4, 0, n)
    links = G.navigable(G.neighbour_lists(x.astype(np.float32)))
    found, touched = G.walk(x, links, x, 3)
    want = np.argsort(-(x @ x.T), axis=1, kind="stable")[:, :3]
    assert [sorted(v for v in row if v >= 0) for row in found.tolist()] == [sorted(row) for row in want.tolist()] and (touched == n).all()


def test_equal_vectors():
    x = np.repeat(vectors(2, 4, 0, 1), [900, 100], axis=0)
    links = G.navigable(G.neighbour_lists(x.astype(np.float32)))
    found, _ = G.walk(x, links, x[[0, 950]], 5)
    assert (found[0] < 900).all() and len(set(found[0].tolist())) == 5 and (found[1] >= 900).all()


@pytest.mark.parametrize(("clusters", "part", "probe", "touch"), [(60, 2500, 2, 0.15), (0, 16000, 1, 0.2)])
def test_recall_and_touched_share(spark, clusters, part, probe, touch):
    """At least 0.9 of the exact neighbours, with a part of the vectors compared: in cells of near ones, or in one graph of vectors without clusters."""
    n = 16000
    x = vectors(n, 32, clusters, 3)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    asked = df.where("vec_id % 200 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = G.build(df, part_numbers=part * 32)
    parts = {r["part"]: (r["cell"], r["n"]) for r in index.parts.select("part", "cell", "n").collect()}
    assert sum(size for _, size in parts.values()) == n == index.nodes.select("vec_id").distinct().count() and len(parts) >= n // part
    exact = {(r["query_id"], r["vec_id"]): r["similarity"] for r in search.vector_topk(df, asked, 8).collect()}
    rows = G.search(index, asked, 8, probe=probe).collect()
    found = {(r["query_id"], r["vec_id"]): r["similarity"] for r in rows}
    assert len(rows) == len(exact) == 640 and len(exact.keys() & found.keys()) / len(exact) >= 0.9
    assert all(abs(exact[x] - found[x]) < 2e-6 for x in exact.keys() & found.keys())
    walked = {(r["query_id"], r["part"]): r["touched"] for r in G.walks(index, asked, 8, probe=probe).collect()}
    assert sum(walked.values()) / 80 < touch * n
    # no other cell than the nearest ones is read
    cells = {}
    for q, p in walked:
        cells.setdefault(q, set()).add(parts[p][0])
    assert {len(c) for c in cells.values()} == {probe}


def test_filters_and_edges(spark):
    x = vectors(600, 8, 6, 5)
    rows = [(i, v, ["a", "b", None][i % 3]) for i, v in enumerate(x.tolist())] + [(900, None, "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, kind string")
    asked = df.where("vec_id % 60 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = G.build(df, part_numbers=200 * 8)
    for where in ({"kind": "a"}, {"kind": ["b", None]}, {"kind": "zz"}):
        want = {(r[0], r[1]) for r in search.vector_topk(df, asked, 8, where).select("query_id", "vec_id").collect()}
        got = {(r[0], r[1]) for r in G.search(index, asked, 8, where, df).select("query_id", "vec_id").collect()}
        assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
    tables = index.tables()
    assert set(tables) == {"graph_parts", "graph_nodes", "graph_centroids"} and G.Graph.of_tables(tables).nodes.count() == 600
    empty = G.build(df.limit(0))
    assert G.search(empty, asked, 8).count() == 0 and G.search(index, asked.limit(0), 8).count() == 0
    with pytest.raises(ValueError, match="filter"):
        G.search(index, asked, 8, {"kind": "a"})
