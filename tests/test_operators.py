"""The retrieval operators on small fixtures."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.functions import exprs as X
from docquarry.operators import chunking, cleanup, context, embedding, evaluation, generation, hybrid, keyword, parsing, search, visuals
from docquarry.plans import registry
from docquarry.plans.engine import Settings, answer_batch, ingest
from docquarry.sources import corpus


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


def test_parents_and_headings(spark):
    assert [one(spark, x, X.parent_of) for x in ("A1.2.2", "A1.2", "A1")] == ["A1.2", "A1", None]
    assert [one(spark, x, X.heading_like) for x in ("Overview", "17", "The rule holds.", "a list:", "", None, "w " * 11)] == [True, False, False, False, False, False, False]


def test_white_space(spark):
    assert one(spark, " a b\tc ", lambda c: F.array_join(X.words(c), "|")) == "a|b|c"
    assert one(spark, "a\r\n\n b\fc d", lambda c: F.array_join(X.lines(c), "|")) == "a|b|c|d"
    assert one(spark, None, lambda c: F.size(X.words(c))) == 0
    assert one(spark, "Straße  Titel A6", X.normalize_line) == "strasse titel"
    assert one(spark, "01/02/2024", X.iso_date) == "2024-02-01"


def article(n, text, **more):
    return ("f.pdf", "A", n, f"A1.{n}", "A1", None, text, 3)


ARTICLES = "source_filename string, section string, article_seq int, article_number string, parent_article string, heading string, text string, page int"


def sliding(text, most, step):
    w = text.split()
    if not w:
        return []
    return [text] if len(w) <= most else [" ".join(w[i : i + most]) for i in range(0, len(w), step)]


@pytest.mark.parametrize("n", [0, 1, 223, 224, 269, 270, 492, 493])
def test_windows(spark, n):
    text = " ".join(str(i) for i in range(n))
    got = chunking.chunk_regulation(spark.createDataFrame([article(1, text)], ARTICLES)).orderBy("chunk_index").collect()
    assert [r["text"] for r in got] == sliding(text, 269, 223)
    assert len({r["chunk_id"] for r in got}) == len(got)


def test_offsets_follow_the_cursor(spark):
    text = "one two\nthree " * 60
    rows = chunking.chunk_regulation(spark.createDataFrame([article(1, text)], ARTICLES), 26, 13).orderBy("chunk_index").collect()
    cursor = 0
    for r in rows:
        at = text.find(r["text"][:40], cursor)
        start = at if at >= 0 else cursor
        assert (r["char_start"], r["char_end"]) == (start, start + len(r["text"]))
        cursor = max(cursor, start + len(r["text"]) - 1)


def test_fixed_windows_ignore_articles(spark):
    parts = [" ".join(f"w{a}_{i}" for i in range(n)) for a, n in enumerate((7, 0, 30, 3, 41))]
    rows = chunking.chunk_fixed_window(spark.createDataFrame([article(i, t) for i, t in enumerate(parts)], ARTICLES), 26, 13).orderBy("chunk_index").collect()
    words = " ".join(parts).split()
    owner = [i for i, t in enumerate(parts) for _ in t.split()]
    assert [r["text"] for r in rows] == [" ".join(words[i : i + 20]) for i in range(0, len(words), 10)]
    assert [r["article_seq"] for r in rows] == [owner[i] for i in range(0, len(words), 10)]


#: Which lines belong together, over a letter for each line: a number with any next line, an article without a title with a next line that reads like a heading.
TOGETHER = re.compile("[nN].?|[eE][A-Z]?|.")


def letter(line):
    """t: article with a title, e: without one, n: number, g: annotation, b: other text; a capital if it reads like a heading."""
    kind = "t" if re.match(r"ARTICLE\s+[A-F]\d+\s*:\s*\S", line) else "e" if re.match(r"ARTICLE\s+[A-F]\d+\s*:", line) else "n" if re.fullmatch(r"[A-F]\d+(\.\d+)+", line) else "g" if re.match(r"(?i)(Advisory Committee|Governance)\s*:", line) else "b"
    return kind.upper() if not re.fullmatch(r"\d{1,3}", line) and len(line.split()) <= 10 and line[-1] not in ".;,:" else kind


def articles_by_grammar(lines):
    """The parser's rule, read off a string of line kinds."""
    records, heading = [], None
    kinds = "".join(map(letter, lines))
    for group in TOGETHER.finditer(kinds):
        line, *taken = lines[group.start() : group.end()]
        kind, reads_like_one = group[0][0].lower(), group[0][1:].isupper()
        if kind == "b" and records:
            records[-1][2].append(line)
        elif kind in "te":
            found = [line.partition(":")[2].strip()] if kind == "t" else taken
            heading = (found or [heading])[0]
            records.append((line.partition(":")[0].split()[1], (found or [None])[0], []))
        elif kind == "n":
            heading = taken[0] if reads_like_one else heading
            records.append((line, heading, [] if reads_like_one else taken))
    return [(number, title, "\n".join(said)) for number, title, said in records if title or said]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["ARTICLE A1:", "ARTICLE B2: TITLE", "A1.1", "A1.2.3", "Governance: x", "17", "Scope", "The rule holds.", "a;"]), max_size=14), min_size=1, max_size=12))
def test_parser_equals_the_grammar(spark, docs):
    rows = [(f"d{d}", "A", i + 1, line, False) for d, lines in enumerate(docs) for i, line in enumerate(lines)]
    pages = spark.createDataFrame(rows, "source_filename string, section string, page int, text string, is_toc boolean")
    got = parsing.parse_articles(parsing.line_stream(pages)).orderBy("source_filename", "article_seq").collect()
    for d, lines in enumerate(docs):
        assert [(r["article_number"], r["heading"], r["text"]) for r in got if r["source_filename"] == f"d{d}"] == articles_by_grammar(lines)


def test_cleanup_removes_headers_and_finds_contents(spark):
    page = lambda n, body: ("f", n, f"Common Header\n{body}\npage footer {n}", 800.0, [("Common Header", 5.0, 20.0), (body, 300.0, 600.0), (f"page footer {n}", 780.0, 795.0)])
    rows = [page(1, "CONTENTS"), page(2, "A1.1.1 text"), page(3, "CONTENTS of trade"), page(4, "x"), page(5, "Common Header")]
    pages = spark.createDataFrame(rows, "source_filename string, page int, raw_text string, height double, blocks array<struct<text:string,y0:double,y1:double>>")
    got = {r["page"]: r for r in cleanup.clean_pages(pages).collect()}
    assert got[4]["text"] == "x" and got[4]["removed_lines"] == ["Common Header", "page footer 4"]
    assert [got[i]["is_toc"] for i in range(1, 6)] == [True, False, False, False, False]
    assert got[5]["text"] == ""


def test_visual_detectors(spark):
    blocks = spark.createDataFrame([("f", 1, 40.0 * (i % 2), 12.0 * (i // 2)) for i in range(8)] + [("f", 2, 0.0, 12.0 * i) for i in range(9)], "source_filename string, page int, x0 double, y0 double")
    assert {r["page"]: r["has_table"] for r in visuals.table_pages(blocks).collect()} == {1: True, 2: False}
    assert [one(spark, x, visuals.has_equation) for x in ("a = b ± c ≤ d", "x2 m3 k4 = 1", "plain", None)] == [True, True, False, False]


def test_hash_embedding_equals_the_definition(spark):
    import hashlib

    texts = ["Tire tire pressure", "", "Überholen 2 cars", None]
    rows = {r["k"]: r["embedding"] for r in embedding.hash_vectors(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t", 48).collect()}
    import re

    for k, t in enumerate(texts):
        v = [0.0] * 48
        for w in re.findall("[a-z0-9]+", (t or "").lower()):
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            v[h % 48] += 1 if h >> 63 else -1
        n = math.sqrt(sum(x * x for x in v)) or 1
        assert rows[k] == pytest.approx([x / n for x in v])


def test_vector_search(spark):
    rows = [(i, [math.cos(i / 5), math.sin(i / 5)], None if i % 4 == 0 else i % 3) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0])], "query_id long, embedding array<double>")

    def brute(q, keep, k):
        found = sorted((-round(sum(a * b for a, b in zip(q, v, strict=True)), 6), i) for i, v, x in rows if keep(x))
        return [i for _, i in found[:k]]

    for where, keep in ((None, lambda x: True), ({"label": 1}, lambda x: x == 1), ({"label": [1, None]}, lambda x: x in (1, None)), ({"nothing": 3}, lambda x: False), ({"nothing": None}, lambda x: True)):
        got = search.vector_topk(vectors, asked, 5, where).orderBy("query_id", "rank").collect()
        for q, v in ((0, [1.0, 0.0]), (1, [0.0, 0.0])):
            assert [r["vec_id"] for r in got if r["query_id"] == q] == brute(v, keep, 5)
    assert search.vector_topk(vectors.limit(0), asked, 5).count() == 0


def okapi(texts, query, k1=1.5, b=0.75, eps=0.25):
    import re

    tok = lambda t: re.findall("[a-z0-9]+", t.lower())
    docs = [tok(t) or ["\0"] for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: eps * mean if v < 0 else v for w, v in idf.items()}
    return [sum(idf.get(w, 0) * d.count(w) * (k1 + 1) / (d.count(w) + k1 * (1 - b + b * len(d) / avg)) for w in tok(query)) for d in docs]


@pytest.mark.parametrize("texts", [["red car", "blue car car", "", "green tree"], ["car"], ["car a", "car b", "car c", "car d", "e"], ["x"] * 12 + ["y"]])
def test_bm25(spark, texts):
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, text string")
    for q in ("car car", "tree blue", "zzz", "x"):
        scores = okapi(texts, q)
        want = sorted(range(len(texts)), key=lambda i: (-round(scores[i], 6), i))[:3]
        got = keyword.bm25_topk(chunks, spark.createDataFrame([(0, q)], "query_id long, query string"), 3).orderBy("rank").collect()
        assert [r["chunk_id"] for r in got] == want
        assert [r["score"] for r in got] == pytest.approx([scores[i] for i in want], abs=1e-5)


def test_fusion(spark):
    v = spark.createDataFrame([(0, "a", 0.9, 0), (0, "b", 0.5, 1), (0, "c", 0.1, 2)], "query_id long, chunk_id string, similarity double, rank int")
    w = spark.createDataFrame([(0, "d", 7.0, 0), (0, "b", 3.0, 1)], "query_id long, chunk_id string, score double, rank int")
    got = hybrid.fuse(v, w, 4).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [("a", 0.5), ("d", 0.5), ("b", 0.25), ("c", 0.0)]
    flat = hybrid.fuse(v.withColumn("similarity", F.lit(1.0)), w, 4).orderBy("rank").collect()
    assert flat[0]["chunk_id"] == "d"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a b", "A  b", "c", "d e f"]), st.integers(0, 40)), min_size=1, max_size=8))
def test_packing_equals_the_sequential_rule(spark, items):
    rows = [(0, i, f"c{i}", f"l{i}", t, n) for i, (t, n) in enumerate(items)]
    got = context.pack_context(spark.createDataFrame(rows, "query_id long, rank int, chunk_id string, label string, text string, token_estimate int"), 50).first()
    used, kept, keys, out = 0, [], set(), []
    for _, _, c, _, t, n in rows:
        n, key = n or int(len(t.split()) * 1.3) + 1, " ".join(t.lower().split())[:160]
        if key in keys:
            out.append((c, "duplicate_of_selected"))
        elif used + n > 50 and kept:
            out.append((c, "budget_exhausted"))
        else:
            used, kept = used + n, [*kept, c]
            keys.add(key)
    assert [x["chunk_id"] for x in got["selected"]] == kept and got["token_estimate"] == used
    assert [(x["chunk_id"], x["reason"]) for x in got["discarded"]] == out


def test_citations(spark):
    answers = spark.createDataFrame([(0, "See [Art. A1.1 (Section A, p.A1)] and [Art. A1.1 (x)]"), (1, "UNANSWERABLE [Art. A1.1 (x)]"), (2, None)], "query_id long, answer string")
    selected = spark.createDataFrame([(q, f"c{i}", n) for q in range(3) for i, n in enumerate(("A1.1", "A1.1", "B2"))], "query_id long, chunk_id string, article_number string")
    assert sorted(tuple(r) for r in context.extract_citations(answers, selected).select("query_id", "chunk_id").collect()) == [(0, "c0"), (0, "c1")]


def test_metrics(spark):
    schema = "case_id string, answerable boolean, expected_articles array<string>, expected_answer_terms array<string>, retrieved_articles array<string>, context_articles array<string>, citation_articles array<string>, answer_text string, is_unanswerable boolean"
    rows = [("a", True, ["D3"], ["x"], ["D3.1", "A1"], ["D3.1"], ["D3.1"], "X here", False), ("b", True, ["A1"], [], ["B1", "A1"], ["B1"], ["C9"], "text", False), ("c", False, [], [], [], [], [], "UNANSWERABLE", True)]
    got = evaluation.metric_summary(spark.createDataFrame(rows, schema)).first()
    assert (got["recall_at_k"], got["mrr"], got["article_hit_rate"], got["citation_accuracy"]) == (1.0, 0.75, 1.0, 0.5)
    assert (got["unsupported_claim_rate"], got["unanswerable_handling"], got["answer_term_coverage"]) == (0.5, 1.0, 1.0)
    empty = evaluation.metric_summary(spark.createDataFrame([], schema)).first()
    assert (empty["n_cases"], empty["recall_at_k"]) == (0, 0.0)


def test_registry_prompts_and_stub():
    with pytest.raises(ValueError):
        registry.CHUNKERS.register("regulation", None)
    with pytest.raises(KeyError):
        registry.CHUNKERS.get("none such")
    with pytest.raises(KeyError):
        generation.prompt("q", "c", "v0")
    system, user = generation.prompt("why?", "[Art. A1 (x)]\ntext")
    assert "UNANSWERABLE" in system and generation.StubGenerator().generate(system, user) == "See [Art. A1 (x)]."


def test_index_is_rewritten_only_for_another_configuration(spark, tmp_path):
    chunks = chunking.chunk_regulation(spark.createDataFrame([article(1, "tyre pressure rules"), article(2, "race start signal")], ARTICLES))
    at = str(tmp_path / "index")
    assert ingest(spark, chunks, at, Settings(dim=32)) and not ingest(spark, chunks, at, Settings(dim=32)) and ingest(spark, chunks, at, Settings(dim=16))
    held, vectors, manifest = corpus.load_index(spark, at)
    assert (held.count(), vectors.count(), manifest["n_chunks"]) == (2, 2, 2)
    for retriever in ("bm25", "vector", "hybrid"):
        got = answer_batch(held, spark.createDataFrame([(5, " tyre   pressure ")], "query_id long, query string"), Settings(dim=32, retriever=retriever), 1).first()
        assert "tyre pressure" in got["text"]


def test_quantised_search_finds_the_neighbours(spark):
    """Recall against the exact search, on vectors without clusters and on copies of one another."""
    import numpy as np

    r = np.random.default_rng(4)
    own = r.normal(size=(3000, 48))
    own[2000:] = own[r.integers(0, 20, size=1000)] + r.normal(size=(1000, 48)) * 0.3
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(own.tolist())] + [(9999, None)], "vec_id long, embedding array<double>").repartition(5)
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r["query_id"], r["vec_id"]) for r in search.vector_topk(df, asked, 8).collect()}
    rows = search.vector_topk_quantised(df, asked, 8, index=search.quantised(df)).collect()
    found = {(r["query_id"], r["vec_id"]) for r in rows}
    assert len(rows) == len(exact) == 480 and len(exact & found) / len(exact) >= 0.99
    assert search.vector_topk_quantised(df.limit(0), asked, 8).count() == 0


def test_many_queries_are_asked_in_blocks(spark, monkeypatch):
    from docquarry.operators import topk

    rows = [(i, " ".join(f"w{j}" for j in range(i % 7, i % 7 + 3))) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").repartition(4)
    queries = spark.createDataFrame([(i, f"w{i % 9} w{i % 4} nothing") for i in range(40)], "query_id int, query string")
    once = sorted(map(tuple, keyword.bm25_topk(chunks, queries, 5).collect()))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "PASS_BLOCKS", 2)
    monkeypatch.setattr(keyword, "PASS_BLOCKS", 2)
    assert sorted(map(tuple, keyword.bm25_topk(chunks, queries, 5).collect())) == once and len(once) == 200


def test_ranks_are_cut_before_the_shuffle(spark):
    from docquarry.operators import topk

    df = spark.range(1000).selectExpr("id % 10 AS query_id", "id AS vec_id", "cast(id AS double) AS score")
    assert "WindowGroupLimit" in topk.ranked(df, "query_id", "score", 3, ("vec_id",))._jdf.queryExecution().toString()
