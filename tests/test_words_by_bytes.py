"""Words, chunks and holders of items, by bytes within the workers."""

import random

import numpy as np
import pyarrow as pa
import pytest
from docquarry.functions import words
from docquarry.functions.exprs import SPACES
from docquarry.operators import chunking
from docquarry.plans import queries
from pyspark.sql import functions as F

FIXED = [None, "", " ", "a", " a  b ", "x y　z ", "　", "né ü   漢字 ", "‐​⁠ â\u0085Â", "a\x1cb\x00c", "end\n", "€、　、"]


def odd_texts(n: int) -> list:
    r = random.Random(n)
    letters = "abé漢​‐Â、😀"
    return FIXED + ["".join(r.choice(letters if r.random() < 0.7 else SPACES) for _ in range(r.randrange(400))) for _ in range(n)]


def test_words_are_split_at_the_same_white_space():
    texts = odd_texts(60)
    for rows in (texts, texts[3:4], [], [None], texts[20:]):
        got = words.Words(pa.array(rows, pa.string()))
        want = ["".join(" " if x in SPACES else x for x in t or "").split(" ") for t in rows]
        want = [[w.encode() for w in ws if w] for ws in want]
        assert [b - a for a, b in zip(got.first, got.first[1:], strict=False)] == [len(w) for w in want]
        assert got.each().to_pylist() == [w for ws in want for w in ws]
        assert [got.joined(a, b) for a, b in zip(got.first, got.first[1:], strict=False)] == [b" ".join(w) for w in want]
    sliced = words.Words(pa.array(texts, pa.string()).slice(5, 7))
    assert np.array_equal(sliced.data, words.Words(pa.array(texts[5:12], pa.string())).data)


@pytest.mark.parametrize("tokens,overlap", [(350, 60), (13, 4), (2, 0)])
def test_chunks_by_bytes_are_those_of_the_columns(spark, tokens, overlap):
    df = spark.createDataFrame([(i, t, [i]) for i, t in enumerate(odd_texts(80))], "i long, text string, xs array<long>")
    want = df.select("i", "xs", F.posexplode(chunking.pieces(F.col("text"), tokens, overlap)).alias("chunk_index", "piece")).collect()
    got = chunking.cut_pieces(df, "text", tokens, overlap)
    assert sorted(got.drop("n_words").collect()) == sorted(want)
    from docquarry.functions import exprs as X

    assert got.where(F.size(X.words(F.col("piece"))) != F.col("n_words")).isEmpty()


def shuffled(spark) -> int:
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_holders_shuffle_no_text(spark, monkeypatch):
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefgh", k=9))
    texts = [" ".join(word() for _ in range(300)) for _ in range(200)]
    items = [(i, "  ".join(t.split(" ")[20 : 20 + n])) for i, (t, n) in enumerate(zip(texts, (1, 2, 3, 4, 8, 9, 40) * 10, strict=False))]
    docs = spark.createDataFrame([*enumerate(texts), (500, "　".join(texts[4].split(" "))), (501, None)], "doc_id long, text string").repartition(3).cache()
    asked = spark.createDataFrame([*items, (900, ""), (901, "a b c")], "query_id long, text string").select("query_id", queries.X.squeeze(F.col("text")).alias("query"))
    docs.count()
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = sorted(tuple(x) for x in queries._holders(docs, asked).collect())
        assert shuffled(spark) - before < 0.1 * sum(map(len, texts))  # hashes of all windows, and texts, before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    squeezed = [(i, " ".join(t.split())) for i, t in items]
    rows = [*enumerate(texts), (500, texts[4])]
    assert got == sorted((i, d) for i, x in squeezed for d, t in rows if x in t)
    # several passes give the same
    monkeypatch.setattr(queries.topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(queries.topk, "PASS_BLOCKS", 2)
    assert sorted(tuple(x) for x in queries._holders(docs, asked).collect()) == got


def test_hybrid_retrieval_cuts_its_chunks_once(spark, monkeypatch):
    made, plain = [], queries.chunks
    monkeypatch.setattr(queries, "chunks", lambda *a, **k: made.append(1) or plain(*a, **k))
    assert queries.retrieve_hybrid(spark, "/root/testdata/sf0.001").count() > 0
    assert len(made) == 1  # 2 before, cut three times


def test_terms_are_counted_whole_where_a_task_holds_few(spark, monkeypatch):
    r = random.Random(2)
    df = spark.createDataFrame([(i, " ".join(f"t{r.randrange(200)}" for _ in range(r.randrange(60)))) for i in range(300)], "i long, text string").repartition(3)
    rows = lambda: (sorted(map(tuple, queries.keyword.bm25_stats(df)[0].select("term", "df").collect())), queries.keyword.bm25_stats(df)[1].first()[:2])
    want = rows()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    monkeypatch.setattr(queries.keyword, "TERMS", 150)
    try:
        assert rows() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
