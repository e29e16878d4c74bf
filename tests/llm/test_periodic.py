"""Repeated strings within one text: periodic runs, whose windows all share one mark."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from docquarry.llm import suffix_bcr


def brute(texts: list[str], length: int) -> list[tuple[int, int, int, str]]:
    raw = [t.encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        hit = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i : i + length] = True
        kept = bytes(x for x, h in zip(b, hit, strict=False) if not h)
        out.append((len(b), int(hit.sum()), int((np.diff(hit.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def unlike(r: random.Random, n: int) -> str:
    return "".join(chr(r.randrange(97, 123)) for _ in range(n))


@pytest.mark.parametrize("length", [200, 64])
def test_runs_of_one_period(spark, length):
    r = random.Random(length)
    texts = ["ab " * 90, "x" * (length + 1), "x" * length]
    for period in (*range(1, 12), 29, 31, 32, 33, 64, 100, 167, 168, 169, 170, 199, 200):
        # runs that hold one window, two equal ones, or many; alone, and within other text
        unit = unlike(r, period)
        for size in (length + period - 1, length + period, r.randrange(length + 1, 600)):
            run = (unit * (size // period + 1))[:size]
            texts += [run] if period % 2 else [unlike(r, r.randrange(300)) + run + unlike(r, r.randrange(300))]
    texts.append("long " * 20000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(suffix_bcr.repeats_digest(df, length).collect())
    assert [tuple(x[1:]) for x in got] == brute(texts, length)
    assert got[0]["n_removed"] == 270  # every byte


def test_a_mark_at_two_places_of_one_segment():
    one, two = unlike(random.Random(1), 400).encode(), b"ab " * 90
    assert not suffix_bcr.segments(one, 200)[3].any() and suffix_bcr.segments(two, 200)[3].all()


@pytest.mark.parametrize("length", [200, 64])
def test_a_common_passage_between_unlike_texts(spark, monkeypatch, length):
    # marks of very many different strings are cut further; no bucket writes a row for each of their windows
    rows, held, plain = [], {}, suffix_bcr.stash

    def counted(df, name):
        out = plain(df, name)
        held[name] = out.count()
        return out

    monkeypatch.setattr(suffix_bcr, "SPREAD", 8)
    monkeypatch.setattr(suffix_bcr, "stash", counted)
    r = random.Random(length)
    passage = unlike(r, 300)
    ends = [unlike(r, 20) for _ in range(4)]
    for _ in range(120):
        # some go on alike for some bytes on one side or both
        rows.append(unlike(r, r.randrange(50, 250)) + r.choice(ends)[r.randrange(20) :] + passage + r.choice(ends)[: r.randrange(20)] + unlike(r, r.randrange(50, 250)))
    rows += rows[:3] + ["ab " * 90, "ab " * 80 + passage, passage[:length]]
    df = spark.createDataFrame([*enumerate(rows), (0, rows[0])], "doc_id long, text string")
    got = sorted(tuple(x) for x in suffix_bcr.repeats_digest(df, length).collect())
    assert [x[1:] for x in got] == brute([rows[0], *rows], length)
    assert held["repeats"] <= 1000  # 20559 and 4071 before


def test_narrower_parts_of_equal_windows_share_their_mark():
    r = random.Random(5)
    core = unlike(r, 320)
    for width in (43, 11, 3, 1):
        marks = {}
        for raw in (core.encode(), (unlike(r, 90) + core[20:300] + unlike(r, 90)).encode(), b"ab " * 120):
            for first, count, _, _ in zip(*suffix_bcr.segments(raw, 200), strict=True):
                segment = raw[first : first + count + 199]
                parts = suffix_bcr.narrower(segment, 200, width)
                assert [a for a, _, _ in parts] == [sum(n for _, n, _ in parts[:i]) for i in range(len(parts))] and sum(n for _, n, _ in parts) == count
                for a, n, mark in parts:
                    assert n <= width
                    for x in range(a, a + n):
                        assert marks.setdefault(segment[x : x + 200], mark) == mark
