"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import drop_stash, stash


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for each node with a link, the smallest node that it reaches.

    links: columns a and b, any order, repeats and self-links allowed (they are ignored).  Each round groups by
    node with min() (combined before the shuffle) and joins back, so a node with very many links is split by
    adaptive skew joins and never gathered.  The number of rounds grows with the logarithm of a component's size.
    An empty table gives an empty result.
    """
    pair = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = stash(pair.distinct(), "edges")
    state = _state(edges)
    while state[0]:
        # large-star: all larger neighbours of a node move to the smallest of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # small-star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        older, edges = edges, stash(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_stash(older)
        state, before = _state(edges), state
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
