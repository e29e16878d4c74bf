"""The corpus pipeline on the smallest tables."""

import hashlib
import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from docquarry.llm.queries import ORACLE_SQL, QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@tables
def test_pipeline_keeps_columns_and_drops_copies(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    done = corpus_pipeline.run(spark, DATA)
    assert done.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert 0 < done.count() == docs.count() < 200


def test_a_query_for_each_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] and set(ORACLE_SQL) <= set(QUERIES)


@tables
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA), duck.sql(ORACLE_SQL[name])
    show = lambda columns, rows: sorted(str([r[i] for i in sorted(range(len(columns)), key=lambda i: columns[i])]) for r in rows)
    assert show(got.columns, [tuple(r) for r in got.collect()]) == show(want.columns, want.fetchall())


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_pipeline(docs, items):
    """The five stages over (doc_id, text, ...) rows, in plain Python."""
    rows = [(r[0], r[1]) for r in docs if any(c.isalpha() for c in r[1] or "")]
    held, top = defaultdict(set), {}
    key = lambda line: low(line.strip(" \t\n\x0b\f\r"))
    for i, t in rows:
        for line in t.split("\n"):
            held[key(line)].add(i)
    top = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    rows = [(i, "\n".join(x for x in t.split("\n") if top.get(key(x), i) == i)) for i, t in rows]
    rows = list(dict.fromkeys(rows))
    fp = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j in range(len(rows)) if (fp[i] ^ fp[j]).bit_count() <= 2) for i in range(len(rows))]
    least = defaultdict(list)
    for g, (i, _) in zip(group, rows, strict=True):
        least[g].append(i)
    rows = [r for g, r in zip(group, rows, strict=True) if r[0] == min(least[g])]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for _, t in items:
        w = word.findall(low(t or ""))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    def dirty(t):
        w = word.findall(low(t))
        return any(tuple(w[k : k + len(x)]) == x for x in windows for k in range(len(w) - len(x) + 1))
    rows = [r for r in rows if not dirty(r[1])]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        raw = np.array(ids, dtype="<u4").tobytes()
        out.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out)


def planted():
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghilmnoprstuéö") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    line, item, copy = "All rights reserved by the owners of this fine page", say(14), say(150)
    texts = [None, "", "123 456", "A.", "A.\nAll rights reserved.", say(3), "x" * 20_000, *(say(r.choice([5, 60, 200])) for _ in range(25))]
    texts += [copy, copy, copy + " end", *(f"{say(30)}\n {line.upper() if i % 2 else line}\t\n{say(20)}" for i in range(9))]
    texts += [f"{say(40)} {item.upper()} {say(9)}", f"{say(12)} {' '.join(item.split()[2:12])}, {say(12)}", f"{say(12)} {' '.join(item.split()[3:12])} {say(12)}", "short item!", line, line]
    docs = [(i, t, None if i % 7 == 3 else "ab"[i % 2], "s", len(t or "")) for i, t in enumerate(texts)]
    return docs + [docs[10], docs[-1]], [(1, item), (2, "Short item"), (3, None), (4, "!")]


def written(spark, at, docs, items):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_run_equals_plain_python(spark, tmp_path):
    docs, items = planted()
    got = corpus_pipeline.run(spark, written(spark, tmp_path, docs, items)).collect()
    want = plain_pipeline(docs, items)
    assert sorted((r["doc_id"], r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest(), r["decoded_sha256"]) for r in got) == want
    kept = {x[0] for x in want}
    assert {3, 4} <= kept and not {0, 1, 2} & kept and 20 < len(kept) < len(docs)


def test_run_without_documents_or_labels(spark, tmp_path):
    docs, items = planted()
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "a", [], items)).count() == 0
    # no language is learned: every document is `und`, as op6 says
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "b", [(*d[:2], None, *d[3:]) for d in docs[:9]], items)).count() == 0


def test_language_stage_fills_null_languages_only(spark, tmp_path):
    docs, items = planted()
    at = written(spark, tmp_path, docs, items)
    df = spark.read.parquet(f"{at}/documents.parquet")
    left = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, df, at).collect()}
    for i, t, lang, *_ in docs:
        assert (i in left) == any(c.isalpha() for c in t or "") and (i not in left or left[i] == lang or lang is None and left[i] in ("a", "b"))


def test_extra_columns_pass_through(spark, tmp_path):
    docs, items = planted()
    at = written(spark, tmp_path, docs, items)
    df = spark.read.parquet(f"{at}/documents.parquet").withColumns({c: F.lit(1) for c in ("h", "fp", "ids", "keep", "item_id")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, at)
        assert out.columns == df.columns and 0 < out.count() <= df.count()
