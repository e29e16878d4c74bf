"""Two queries that SQL can't express, as a whole: roles by style of transcript, cosines by plain binding."""

import random
from collections import Counter, defaultdict

import numpy as np
from docquarry.llm import chat_hmm, langid_hd, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_roles_by_style(spark):
    """Held-out rows of each style: role names, other role names, a bare dash, only a blank line."""
    style = F.pmod(F.xxhash64(F.lit("style"), F.col("conv_id")), F.lit(4))
    truth = {(r["conv_id"], r["turn"]): (r["role"], r["style"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").withColumn("style", style).collect()}
    right = defaultdict(list)
    for r in queries.op1_chat_hmm(spark, SF).where("held_out").collect():
        role, kind = truth[r["conv_id"], r["turn"]]
        if role in chat_hmm.ROLES:
            right[kind].append(r["role_pred"] == role)
    shares = {k: np.mean(v) for k, v in right.items()}
    assert set(shares) == {0, 1, 2, 3} and shares[0] == shares[1] == 1.0 and shares[2] > 0.9 and shares[3] > 0.85, shares


def test_cosines_by_plain_binding(spark):
    r = random.Random(5)
    words = {"aa": "the of and this with", "bb": "der die und nicht für", "cc": "les des été dans où"}
    rows = [(i, " ".join(r.choice(words[k].split()) for _ in range(r.choice([1, 5, 60]))), k if r.random() < 0.8 else None) for i, k in enumerate(r.choice(sorted(words)) for _ in range(120))]
    rows += [(200, None, "aa"), (201, "12 ?", "bb"), (202, "Ζευς", None), (203, "long words " * 40_000, None), rows[3], (None, "les des", "cc")]
    letters, symbols = langid_hd.letter_vectors().astype(float), langid_hd.symbol_table()

    def bundle(text):
        """Runs of what isn't a letter are one symbol; three letters are bound as their vectors, rotated by place."""
        s = [0]
        for c in (text or "").lower() + " ":
            x = int(symbols[ord(c)])
            if x or s[-1]:
                s.append(x)
        total = np.zeros(langid_hd.SIZE)
        for (a, b, c), n in Counter(zip(s, s[1:], s[2:])).items():  # noqa: B905
            total += n * np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return total / np.linalg.norm(total) if total.any() else None

    import zlib

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    sums = {}
    for i, t, k in rows:
        if k is not None and not held(i) and (u := bundle(t)) is not None:
            sums[k] = sums.get(k, 0) + u
    names = sorted(sums)
    matrix = np.array([sums[k] / np.linalg.norm(sums[k]) for k in names])
    got = {(x["doc_id"]): x for x in langid_hd.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    for i, t, _ in rows:
        u = bundle(t)
        cosines = matrix @ u if u is not None else [0.0]
        assert got[i]["held_out"] == held(i) and abs(got[i]["score"] - max(0.0, max(cosines))) < 2e-4
        assert got[i]["lang_pred"] == ("und" if u is None else names[int(np.argmax(np.round(cosines, 5)))])
