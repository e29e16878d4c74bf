"""Pipeline stages keep every column of their input, whatever its name; a ring of hosts ends soon and leaves little behind."""

import os
import random

from docquarry.llm import langid_hd, line_bitmaps, simhash_golay, url_links
from pyspark.sql import functions as F

NAMES = ("__id", "__rk", "__rk2", "__keep", "__KEEP_", "fp", "root", "doc_id2", "key", "n", "m", "h")


def test_clashing_names_keep_their_values(spark):
    r = random.Random(1)
    line = "a line of more than forty characters that many share"
    rows = [(i, "\n".join([" ".join(r.choice("abcdefgh") * 3 for _ in range(20)), line]), "en") for i in range(12)] + [(20, None, "en"), (21, "", None), (3, "other", "x"), (None, "no id", "en")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    wide = plain.withColumns({n: F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for n in NAMES})
    for stage in (line_bitmaps.drop_repeated_lines, simhash_golay.keep_one_of_each, lambda d: langid_hd.keep_identified(d, langid_hd.prototypes(d))):
        got, want = stage(wide), stage(plain)
        assert got.columns == wide.columns
        held = got.collect()
        assert sorted(str((x["doc_id"], x["text"])) for x in held) == sorted(str((x["doc_id"], x["text"])) for x in want.collect())
        assert all(x[n] == f"{n}-{'null' if x['doc_id'] is None else x['doc_id']}" for x in held for n in NAMES)
    assert line_bitmaps.drop_repeated_lines(wide).where(F.col("text").contains("forty")).count() == 1


def test_long_texts_of_unlearned_scripts_go(spark):
    r = random.Random(3)
    words = {"aa": "the of and this with", "bb": "der die und nicht mit", "cc": "les des est dans pour"}
    clean = [(i, " ".join(r.choice(words[k].split()) for _ in range(r.choice([2, 30, 300]))), k) for i, k in enumerate(r.choice(sorted(words)) for _ in range(300))]
    clean += [(400 + i, f"{w} " * 200, k) for i, (k, w) in enumerate((k, w) for k in words for w in words[k].split())]  # long, but of few n-grams
    junk = [(1000 + i, "".join(chr(r.randrange(a, a + 24)) for _ in range(r.choice([150, 900]))), None) for i, a in enumerate([0x3B1, 0x430] * 100)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    kept = {x["doc_id"] for x in langid_hd.keep_identified(df, langid_hd.prototypes(df)).collect()}
    assert {x[0] for x in clean} <= kept and len(kept - {x[0] for x in clean}) < 0.4 * len(junk)
    rules = [(u is not None, n >= langid_hd.MANY) for u, n in map(langid_hd.Profiler().look, ("the " * 500, "x" * 5000, junk[0][1], None, "12"))]
    assert rules == [(True, False), (True, False), (True, True), (False, False), (False, False)]


def test_a_ring_of_hosts(spark, tmp_path):
    n = 25
    rows = [(i, f"https://h{i}.org/p", f'<a href="https://h{(i + 1) % n}.org/">') for i in range(n)] + [(n, "https://bad.net/es/1", ""), (n + 1, "https://h5.org/x", '<a href="https://bad.net/es/1">')]
    shared = url_links.stash.__globals__["shared_dir"](spark).removeprefix("file:")
    before = set(os.listdir(shared))
    got = {r["host"]: r["distrust"] for r in url_links.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), (("net/es/", "block"),)).collect()}
    # h5 passes half of its mass on to the blocked host and half around the ring
    share = 0.85 * 0.5 / (1 - 0.5 * 0.85**n)
    want = {f"h{i}.org": share * 0.85 ** ((5 - i) % n) for i in range(n)} | {"bad.net": 1.0}
    assert all(abs(got[h] - want[h]) < 1e-7 for h in want)
    left = [x for d in set(os.listdir(shared)) - before if d.startswith("stash-") for x in os.listdir(f"{shared}/{d}")]
    assert left == ["ranks"]
