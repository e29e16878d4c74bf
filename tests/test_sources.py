"""Sources, sinks, streaming and the command line."""

import hashlib

import pytest
from pyspark.sql import functions as F

from docquarry import cli
from docquarry.operators.chunking import chunk_regulation
from docquarry.operators.diagnostics import markdown_report, render_trace
from docquarry.sources import corpus
from docquarry.streaming.incremental import stream_chunks

ARTICLES = "source_filename string, section string, article_seq int, article_number string, parent_article string, heading string, text string, page int"


def test_listing_and_hash(spark, tmp_path):
    with pytest.raises(ValueError):
        corpus.list_corpus(spark, str(tmp_path))
    for name, size in (("b.pdf", 3), ("a.pdf", 12), ("c.txt", 1)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = corpus.corpus_hash(corpus.list_corpus(spark, str(tmp_path))).first()[0]
    assert got == hashlib.sha1(b"a.pdf12b.pdf3").hexdigest()[:16]


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, "é\nb", None), (2, None, [1.5])], "a long, b string, c array<double>")
    corpus.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(map(str, corpus.read_jsonl(spark, str(tmp_path / "j"), df.schema).collect())) == sorted(map(str, df.collect()))


def test_front_matter(spark):
    df = spark.createDataFrame([("x\nIssue 7\nDate: 01/02/2024\nSECTION D: GENERAL RULES   0D", "f.pdf"), ("", "section-b.pdf"), (None, "f.pdf")], "t string, n string")
    got = df.select(*[c.alias(k) for k, c in corpus.front_matter(F.col("t")).items()], corpus.detect_section(F.col("n"), F.col("t")).alias("s"), corpus.detect_title(F.col("n"), F.col("t"), F.lit("")).alias("title")).collect()
    assert tuple(got[0]) == (7, "2024-02-01", None, "D", "SECTION D: GENERAL RULES")
    assert (got[1]["s"], got[1]["title"], got[2]["s"]) == ("B", "SECTION B", None)


def test_streamed_chunks_equal_batch_chunks(spark, tmp_path):
    rows = [("f.pdf", "A", i, f"A{i}", None, None, "word " * (300 * i), 1) for i in range(1, 4)]
    batch = spark.createDataFrame(rows, ARTICLES)
    for i in (0, 1):
        batch.where(F.col("article_seq") % 2 == i).write.mode("append").parquet(str(tmp_path / "in"))
        stream_chunks(spark, str(tmp_path / "in"), batch.schema, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == sorted(map(str, chunk_regulation(batch).select(got.columns).collect()))


def test_command_line(capsys):
    assert cli.main(["components"]) == 0
    assert "hashing" in capsys.readouterr().out


def test_reports():
    row = {"source_filename": "f", "page_count": 2, "n_toc_pages": 0, "n_articles": 1, "warnings": ["no contents pages"], "first_articles": [{"article_number": "A1", "parent_article": None, "heading": "a|b", "page": 1}], "likely_visual_pages": None}
    assert "a\\|b" in markdown_report(row) and "no contents pages" in markdown_report(row)
    assert "abc" in render_trace({"query": "q", "candidates": [{"rank": 0, "selected": True, "score": 1.0, "chunk_id": "abc", "text_preview": "t"}], "context": "c"})
