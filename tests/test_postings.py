"""The stored inverted index: packing, pruned search against all scores, whole results against BM25 row by row."""

import random

import numpy as np
import pandas as pd
import pytest
from docquarry.operators import keyword, postings
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F


@given(st.lists(st.integers(0, 1 << 33), max_size=200))
def test_packing(values):
    got = postings.unpack(postings.pack(np.array(values, dtype=np.int64)), len(values))
    assert got.tolist() == values


def corpus(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    pick = lambda: words[min(399, int(r.paretovariate(0.6)) - 1)]
    rows = [(f"c{i:05}", " ".join(pick() for _ in range(r.choice([0, 1, 5, 40, 200]))), r.choice(["A", "B", None])) for i in range(n)]
    rows += [(f"d{i:05}", "w7 w7 w300 twin", "A") for i in range(n // 3)]  # equal scores
    r.shuffle(rows)
    return rows


def test_pruned_search_finds_what_all_scores_say():
    import pyarrow as pa

    r, rows = random.Random(1), corpus(900, 2)
    tokens = [t.split() or ["\u0000"] for _, t, _ in rows]
    length, found = postings.invert(pa.array(tokens, pa.list_(pa.string())), 40.0, 1.5, 0.75)
    names = ["term", "block", "first", "last", "n", "best", "docs", "tfs"]
    frame = pd.DataFrame(found, columns=names)
    assert length.tolist() == [len(t) for t in tokens] and frame["n"].max() == postings.BLOCK
    norm = 1.5 * (1 - 0.75 + 0.75 * length / 40.0)
    allowed = np.array([r.random() < 0.5 for _ in rows])
    for _ in range(60):
        asked = {f"w{r.choice([0, 1, 2, 7, 30, 120, 300, 399])}": r.choice([0.2, 1.0, 6.0]) for _ in range(r.randint(1, 6))}
        for may in (None, allowed):
            held = {t: postings.Blocks(x) for t, x in frame.groupby("term")}
            docs, scores = postings.pruned_topk([(w, held[t]) for t, w in asked.items() if t in held], norm, 8, 1.5, may)
            full = [sum(w * postings.factor(ts.count(t), norm[d], 1.5) for t, w in asked.items()) if may is None or may[d] else 0.0 for d, ts in enumerate(tokens)]
            want = sorted((-round(s, 6), d) for d, s in enumerate(full) if round(s, 6) > 0)[:8]
            assert docs.tolist() == [d for _, d in want] and np.allclose(scores, [-s for s, _ in want], atol=2e-6)


def test_blocks_that_cannot_win_stay_packed():
    import pyarrow as pa

    r = random.Random(3)
    # a rare term settles who wins; the frequent one is looked up for its chunks alone
    tokens = [["often"] * r.randint(1, 4) + ["rare"] * (i % 700 == 5) + ["x"] * r.randint(0, 30) for i in range(16000)]
    length, found = postings.invert(pa.array(tokens, pa.list_(pa.string())), 20.0, 1.5, 0.75)
    frame = pd.DataFrame(found, columns=["term", "block", "first", "last", "n", "best", "docs", "tfs"])
    held = {t: postings.Blocks(x) for t, x in frame.groupby("term")}
    norm = 1.5 * (1 - 0.75 + 0.75 * length / 20.0)
    docs, _ = postings.pruned_topk([(0.1, held["often"]), (6.0, held["rare"])], norm, 8, 1.5)
    full = 0.1 * postings.factor(np.array([t.count("often") for t in tokens]), norm, 1.5) + 6.0 * postings.factor(np.array([t.count("rare") for t in tokens]), norm, 1.5)
    assert docs.tolist() == sorted(range(16000), key=lambda d: (-round(full[d], 6), d))[:8]
    assert len(held["often"].n) == 125 and len(held["often"].held) < 25


@pytest.mark.parametrize("segment", [70, 5000])
def test_equals_bm25_row_by_row(spark, segment):
    rows = corpus(500, 5)
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, section string").repartition(4)
    r = random.Random(9)
    asked = [(i, " ".join(f"w{r.choice([0, 1, 7, 50, 300, 398, 999])}" for _ in range(r.randint(0, 5)))) for i in range(30)] + [(90, "twin"), (91, ""), (92, None), (93, "w7 w7 W7")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    index = postings.build(chunks, segment=segment)
    assert index.lengths.count() >= len(rows) // segment and index.docs.count() == len(rows)
    for where in (None, {"section": "A"}, {"section": ["B", None]}, {"section": "Z"}):
        want = keyword.bm25_topk(chunks, queries, 8, where).select("query_id", "chunk_id", F.round("score", 5).alias("s"), "rank")
        got = postings.search(index, queries, 8, where, chunks).select("query_id", "chunk_id", F.round("score", 5).alias("s"), "rank")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_small_corpora(spark):
    queries = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    for rows in ([], [("x", "a")], [("x", "a"), ("y", "a"), ("z", "a b"), ("q", None)]):
        chunks = spark.createDataFrame(rows, "chunk_id string, text string")
        got = sorted(map(tuple, postings.search(postings.build(chunks), queries, 2, chunks=chunks).collect()))
        assert got == sorted(map(tuple, keyword.bm25_topk(chunks, queries, 2).collect()))
    with pytest.raises(ValueError, match="negative"):
        postings.search(postings.build(chunks.limit(1)), queries).collect()


def test_a_search_reads_blocks_alone(spark):
    """No text is scanned: the plan of a search has no column of the chunks."""
    chunks = spark.createDataFrame(corpus(300, 1), "chunk_id string, text string, section string")
    found = postings.search(postings.build(chunks), spark.createDataFrame([(1, "w7 w50")], "query_id long, query string"))
    plan = found._jdf.queryExecution().toString()
    assert "text" not in plan.replace("Text", "") and "section" not in plan
