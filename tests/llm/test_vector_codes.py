"""Product codes: trees against every distance, whole runs against plain rounds, codes read back."""

import hashlib

import numpy as np
import pytest
from docquarry.llm import vector_codes as V


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, e, label) for i, e, label in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    whole = [[int(np.floor(1024 * float(np.float32(x)))) for x in e] for _, e, _ in kept]
    codes, errors, named = [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        d = len(whole[0]) // parts
        x = [w[p * d : (p + 1) * d] for w in whole]
        book = [list(v) for v in x[:entries]]
        for last in [False] * rounds + [True]:
            nearest = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book)) for v in x]
            if last:
                break
            for e in range(len(book)):
                own = [v for v, n in zip(x, nearest, strict=True) if n[1] == e]
                if own:
                    book[e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        named += [str(c) for e in book for c in e]
        codes = [c + f"{n[1]:02x}" for c, n in zip(codes, nearest, strict=True)]
        errors = [a + n[0] for a, n in zip(errors, nearest, strict=True)]
    by = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by[label] = by.get(label, 0) + e
    sha = hashlib.sha256(",".join(named).encode()).hexdigest()
    return sorted(((i, c, e, by[label], sha) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)), key=str)


@pytest.mark.parametrize("kind", ["spread", "clusters", "grid", "equal", "line"])
@pytest.mark.parametrize("leaf", [4, 48])
def test_trees_own_what_is_nearest(kind, leaf):
    r = np.random.default_rng(5)
    for n in (1, 2, 60, 700):
        x = {
            "spread": r.normal(size=(n, 8)) * 100, "clusters": r.normal(size=(9, 8))[r.integers(0, 9, n)] * 900 + r.normal(size=(n, 8)) * 9, "grid": r.integers(-2, 3, size=(n, 3)),
            "equal": np.repeat(r.integers(-9, 9, size=(2, 5)), [n - n // 9, n // 9], axis=0), "line": np.cumprod(np.full((min(n, 25), 1), 2), axis=0),
        }[kind]
        x = np.floor(x).astype(np.int64)
        tree, book = V.build_tree(x.astype(np.int32), leaf), np.concatenate((x[:40], x[:40] + 1, x[:5]))
        assert sorted(tree.order.tolist()) == list(range(len(x))) and (tree.points == x[tree.order]).all()
        for ball in range(len(tree.left)):
            own = tree.points[tree.start[ball] : tree.stop[ball]]
            assert (own.sum(axis=0) == tree.total[ball]).all() and np.sqrt(((own - tree.centre[ball]) ** 2).sum(axis=1)).max() <= tree.radius[ball] + 1e-9
            if tree.left[ball] >= 0:
                assert (tree.start[tree.left[ball]], tree.stop[tree.left[ball]], tree.stop[tree.right[ball]]) == (tree.start[ball], tree.start[tree.right[ball]], tree.stop[ball])
        got, want = V.owners(V.Tree.from_bytes(tree.to_bytes()), book), ((x[:, None, :] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (got.entry == want[tree.order]).all()
        sums = np.zeros(book.shape, dtype=np.int64)
        np.add.at(sums, want, x)
        assert (got.sums == sums).all() and (got.counts == np.bincount(want, minlength=len(book))).all()


def test_anchors_and_lists_save_distances():
    r = np.random.default_rng(2)
    cluster = r.integers(0, 20, 4000)
    x = np.floor(r.normal(size=(20, 4))[cluster] * 9000 + r.normal(size=(4000, 4)) * 20).astype(np.int64)
    owned, looked = V.anchors(x.astype(float))
    assert sorted(np.concatenate(owned).tolist()) == list(range(4000)) and looked < 0.3 * len(owned) * 4000
    book = np.array([x[cluster == c][0] for c in range(20)])
    assert V.owners(V.build_tree(x.astype(np.int32)), book).looked < 400  # nearly all points go with a ball that one entry owns


@pytest.mark.parametrize(("n", "numbers"), [(600, 1 << 18), (330, 8 * 50), (40, 64)])
def test_equals_plain_rounds(spark, n, numbers):
    r = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in r.choice([0.1, 0.5]) * r.normal(size=8)], int(r.integers(3)) if r.random() < 0.8 else None) for i in r.permutation(n)]
    rows += [(1000 + i, list(rows[0][1]), 1) for i in range(n // 3)] + [(2000, None, 1), (2001, [1.0] * 7 + [None], 1), (2002, [float("nan")] * 8, 1), (2003, [float("-inf")] * 8, None), (3, rows[1][1], 7), (None, rows[2][1], None), rows[4]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).selectExpr("*", "'x' as code", "1 as error", "2 as label_error")
    found, books = V.compress(df, block_numbers=numbers)
    held = found.collect()
    want = brute(rows)
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in held), key=str) == sorted((w[:3] for w in want), key=str)
    assert V.books_sha256(books) == want[0][4]
    if numbers == 1 << 18:
        assert sorted((tuple(r) for r in V.codes_digest(df).collect()), key=str) == want
        for r in V.decode(found, books).collect():
            assert r["decoded"] == [x / 1024 for p in range(4) for x in books[p][int(r["code"][2 * p : 2 * p + 2], 16)].tolist()]


def test_edges(spark):
    empty = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert V.codes_digest(empty).count() == V.codes_digest(empty.limit(0)).count() == 0
    one = spark.createDataFrame([(1, [-0.0001] * 4, None)], "vec_id long, embedding array<double>, label string")
    assert [tuple(r) for r in V.codes_digest(one).collect()] == [(1, "00000000", 0, 0, hashlib.sha256(b"-1,-1,-1,-1").hexdigest())]
    for bad in ([1.0] * 5, [1e30] * 4):
        with pytest.raises(ValueError, match="vector"):
            V.compress(spark.createDataFrame([(1, bad, 1)], "vec_id long, embedding array<double>, label int"))
