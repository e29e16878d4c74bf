"""Ranked search by bag classes against scores of every document, one by one."""

import math
import random
import re
from collections import Counter

import pytest
from docquarry.llm import bag_search as B

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(i, Counter(cut(t))) for i, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(cut(t))
    out = []
    for i, ts in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(1 for _, b in bags if t in b) + 1))) for t in ts}
        found = []
        for d, b in bags:
            m = 100 - 90 + 90 * sum(b.values()) * n_docs // max(1, total)
            score = sum(w[t] * (1000000000 * b[t] // (1000 * b[t] + 8 * m)) for t in ts if b[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    words = ["the", "of", "and", *(f"w{i}" for i in range(60)), "Élan", "éLAN", "x1", "straße", "日本"]
    docs = [(i, " ".join(r.choice(words[: r.choice([4, 20, 70])]) for _ in range(r.choice([1, 3, 12, 60])))) for i in range(250)]
    # classes: a hot one, groups of equal bags with other words around, equal scores across classes
    docs += [(1000 + i, "the w1 w1 of") for i in range(130)] + [(500 - i, f"W1 other{i}, W1; of THE") for i in range(30)] + [(2000 + i, "w2 w3 and") for i in range(5)]
    docs += [(7, "w1 w2"), (7, "w1 w2"), (None, "w5 w5 w5"), (None, "w6"), (3001, None), (3002, ""), (3003, "!! ??"), (3004, "w7 " * 400_000)]
    r.shuffle(docs)
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 4, 30])))) for i in range(40)]
    return docs, items + [(50, None), (51, "?"), (52, "nowhere"), (None, "w1"), (3, "w9 w10"), (53, "w1 W1 w1"), (54, "w7"), (55, "w6 w5")]


@pytest.mark.parametrize(("block", "cells", "piece"), [(1 << 18, 1 << 21, 1 << 20), (40, 300, 50)])
def test_equals_brute_force(spark, rows, monkeypatch, block, cells, piece):
    monkeypatch.setattr(B, "CELLS", cells)
    monkeypatch.setattr(B, "PIECE", piece)
    docs, items = rows
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr("*", "1 as m", "'x' as ids", "'y' as item_id")
    asked = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "2 as score", "3 as rank")
    got = sorted((tuple(r) for r in B.search(df, asked, block_terms=block).collect()), key=str)
    assert got == brute(docs, items)
    if block == 40:
        assert len(list(B._blocks(asked, "item_id", "text", block))) > 3


def test_classes_are_told_apart_by_all_counts(spark, rows):
    """Each class once, with its smallest doc_ids, even if all hashes meet."""
    docs, _ = rows
    held = B.bags(spark.createDataFrame(docs, "doc_id long, text string"), {b"w1": 0, b"w2": 1, b"of": 2})
    got = B.bag_classes(held, 400, 4000, 10).collect()
    want = {}
    for r in held.collect():
        if r["ids"]:
            want.setdefault((10 + 90 * r["n"] * 400 // 4000, tuple(r["ids"]), tuple(r["tfs"])), []).append(r["doc_id"])
    assert {(r["m"], tuple(r["ids"]), tuple(r["tfs"])): r["docs"] for r in got} == {k: sorted(v, key=lambda x: (x is None, x))[:10] for k, v in want.items()}
    assert len(got) == len(want) < held.count() / 2


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert [tuple(r) for r in B.search(docs, items).collect()] == [("i", 1, 1, 287 * (1000000000 // (1000 + 8 * 100)))]
    assert B.search(docs.limit(0), items).count() == B.search(docs, items.limit(0)).count() == 0
    assert B.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
