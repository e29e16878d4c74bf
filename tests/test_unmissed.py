"""Copies, near ties and vectors in other cells: the checked searches return what exact search returns."""

import numpy as np
import pytest
from docquarry.operators import neighbour_graph as G
from docquarry.operators import search
from docquarry.plans import queries
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def copies(spark):
    r = np.random.default_rng(4)
    x = np.repeat(G._unit(r.normal(size=(60, 16))), 50, axis=0)[r.permutation(3000)]
    return spark.createDataFrame([(i, v, i % 5) for i, v in enumerate(x.astype(np.float32).tolist())], "vec_id long, embedding array<float>, label int").repartition(3).cache()


def rows(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["similarity"], 5)) for r in df.collect())


@pytest.mark.parametrize("where", [None, {"label": [1, 2]}])
def test_checked_walks_and_codes_are_exact(copies, where):
    asked = copies.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = rows(search.vector_topk(copies, asked, 8, where))
    index = G.build(copies, part_numbers=300 * 16)
    assert rows(G.search(index, asked, 8, where, copies, probe=1, exact=True)) == want
    assert rows(G.search(index, asked, 8, where, copies, probe=1)) != want
    assert rows(search.vector_topk_quantised(copies, asked, 8, where=where, exact=True)) == want


def test_codes_miss_a_group_of_near_vectors_without_the_check(spark):
    r = np.random.default_rng(5)
    x = G._unit(G._unit(r.normal(size=16)) + 0.002 * r.normal(size=(2000, 16)))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(3)
    asked = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = rows(search.vector_topk(df, asked, 8))
    assert rows(search.vector_topk_quantised(df, asked, 8, exact=True)) == want != rows(search.vector_topk_quantised(df, asked, 8))


def test_similarities_are_rounded_as_the_sql_does(spark):
    one = spark.createDataFrame([(1, 2, 0.35155, 0)], "query_id long, vec_id long, similarity double, rank int")
    assert queries._shown(one, "vec_id").first()["similarity"] == 0.3515
