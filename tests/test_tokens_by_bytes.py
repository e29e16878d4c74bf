"""Tokens by bytes are those of the regular expression, row by row, and the statistics made of them are those of SQL's definition."""

import pyarrow as pa
from docquarry.functions import exprs as X
from docquarry.functions.tokens import tokenized
from docquarry.operators import chunking, embedding, keyword
from pyspark.sql import functions as F

TEXTS = ["The cat, the CAT; 12ab", "end", "begin", "", None, "Kelvin İx é-è", "a" * 70, "\u0000", "\u0000ab", "x_y z", "日本 a1", "...", "tail "]


def test_tokens_are_those_of_the_expression(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i long, t string").orderBy("i")
    rows = df.select("i", X.search_tokens(F.col("t")).alias("want"), keyword.lowered(F.col("t")).alias("low")).orderBy("i").collect()
    lowered = pa.array(["cut off", *[r["low"] for r in rows]], pa.string()).slice(1)
    sizes, flat = tokenized(lowered)
    assert sizes.tolist() == [len(r["want"]) for r in rows] and flat.to_pylist() == [t for r in rows for t in r["want"]]
    assert keyword.index_tokens(lowered).to_pylist() == [r["want"] or [keyword.NOTHING] for r in rows]
    assert tokenized(pa.array([], pa.string()))[0].tolist() == [] and tokenized(pa.array([None, ""], pa.string()))[0].tolist() == [0, 0]
    terms, corpus = keyword.bm25_stats(df.withColumnRenamed("t", "text"))
    want = {}
    for r in rows:
        for t in set(r["want"] or [keyword.NOTHING]):
            want[t] = want.get(t, 0) + 1
    assert {r["term"]: r["df"] for r in terms.collect()} == want
    assert corpus.first()["avgdl"] == sum(max(1, len(r["want"])) for r in rows) / len(rows) and corpus.first()["n_docs"] == len(rows)


def test_batches_of_vectors_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        embedding.hash_embed(spark.createDataFrame([(1, "a")], "k long, t string"), "k", "t")
        assert int(spark.conf.get(key)) <= 1024
    finally:
        spark.conf.set(key, before)


def test_chunks_without_places_are_the_same_chunks(spark):
    rows = [("f", "A", i, f"A{i}", None, None, " ".join(f"w{j}" for j in range(n)), 1) for i, n in enumerate((0, 1, 269, 270, 900))]
    articles = spark.createDataFrame(rows, "source_filename string, section string, article_seq long, article_number string, parent_article string, heading string, text string, page int")
    whole = chunking.chunk_regulation(articles).drop("char_start", "char_end")
    few = chunking.chunk_regulation(articles, places=False)
    assert few.columns == whole.columns and sorted(map(str, few.collect())) == sorted(map(str, whole.collect()))
