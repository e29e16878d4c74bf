"""From made-up pages to an index of each kind: metadata, steps as JSON lines, images, and the errors of the command line."""

import pytest
from docquarry import cli
from docquarry.plans import engine, registry
from docquarry.sources import corpus

PAGES = "source_filename string, page int, raw_text string, width double, height double, blocks array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>, areas array<double>, paths int, pdf_title string"
A = "SECTION A: GENERAL PROVISIONS\nIssue 3\nDate: 01/02/2024\nARTICLE A1: SCOPE\nA1.1\nPurpose\nThe rules say how a harbour is run.\nA1.2\nLanterns\nEvery quay keeps a green lantern lit at night."
B = "ARTICLE B1: FEES\nB1.1\nMooring\nA fee of ten coins is due on the first day."


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    at = tmp_path / "corpus"
    at.mkdir()
    texts = {"section-a.pdf": (A, ""), "section-b.pdf": (B, " Book of fees ")}
    for name in texts:
        (at / name).write_bytes(b"x")
    rows = [(name, 1, text, 500.0, 800.0, [(text, 10.0, 300.0, 400.0, 500.0)], [], 0, title) for name, (text, title) in texts.items()]
    df = spark.createDataFrame(rows, PAGES)
    monkeypatch.setattr(cli.pdf, "read_pages", lambda files: df)
    monkeypatch.setattr(cli.pdf, "render_pages", lambda files, path_of: df.select("source_filename", "page", path_of(df["source_filename"], df["page"]).alias("page_image_path"), df["raw_text"].cast("binary").alias("image")))
    return at


def test_chunks_carry_their_document(spark, folder, tmp_path):
    index = str(tmp_path / "index")
    assert cli.main(["ingest", "--corpus", str(folder), "--index", index, "--images"]) == 0
    chunks, _, held = corpus.load_index(spark, index)
    by = {r["article_number"]: r for r in chunks.collect()}
    a, b = by["A1.2"], by["B1.1"]
    assert (a["document_title"], a["issue_number"], a["publication_date"], a["page_image_path"]) == ("SECTION A: GENERAL PROVISIONS", 3, "2024-02-01", "section-a/page-001.png")
    assert (b["document_title"], b["issue_number"], b["publication_date"]) == ("Book of fees", None, None)
    images = {r["page_image_path"] for r in spark.read.parquet(f"{index}/images").collect()}
    assert {r["page_image_path"] for r in by.values()} == images
    # a filter on what chunks carry
    asked = spark.createDataFrame([(1, "lantern fee")], "query_id long, query string")
    got = engine.retrieve(chunks, asked, engine.Settings(retriever="bm25"), where={"issue_number": 3}, stored=corpus.load_more(spark, index)).join(chunks, "chunk_id")
    assert {r["section"] for r in got.collect()} == {"A"}
    assert held["index"] == "exact"
    for step, n in (("raw", 2), ("visual", 2), ("articles", 5), ("chunks", len(by))):
        rows = spark.read.json(f"{index}/steps/{step}")
        assert rows.count() == n and rows.where("source_filename = of_source_filename").count() == n


@pytest.mark.parametrize("kind", ["exact", "quantised", "graph"])
def test_every_index_kind_answers(spark, folder, tmp_path, capsys, kind):
    index = str(tmp_path / "index")
    assert cli.main(["ingest", "--corpus", str(folder), "--index", index, "--index-kind", kind]) == 0
    assert corpus.load_index(spark, index)[2]["index"] == kind
    assert any(x.startswith({"exact": "postings", "quantised": "codes", "graph": "graph"}[kind]) for x in corpus.load_more(spark, index))
    for retriever in ("vector", "hybrid"):
        assert cli.main(["ask", "green lantern at night", "--index", index, "--index-kind", kind, "--retriever", retriever, "--section", "A", "--k", "1"]) == 0
        assert "green lantern" in capsys.readouterr().out
    other = next(x for x in registry.INDEXES.names() if x != kind)
    assert cli.main(["ask", "lantern", "--index", index, "--index-kind", other]) == 1


def test_nothing_to_index_or_to_answer_from(spark, folder, tmp_path, monkeypatch, caplog):
    index, answers = str(tmp_path / "index"), str(tmp_path / "answers")
    assert cli.main(["ingest", "--corpus", str(folder), "--index", index]) == 0
    assert cli.main(["ask", "lantern", "--index", index, "--generator", "stub", "--answers", answers]) == 0
    assert spark.read.parquet(answers).count() == 1
    assert cli.main(["ask", "lantern", "--index", index, "--generator", "stub", "--answers", answers]) == 0
    assert spark.read.parquet(answers).count() == 1
    assert cli.main(["evaluate", "--index", index, "--retriever", "bm25", "--out", str(tmp_path / "runs")]) == 0  # the seed set
    empty = corpus.load_index(spark, index)[0].limit(0)
    with pytest.raises(ValueError, match="no chunks"):
        engine.ingest(spark, empty, str(tmp_path / "none"), engine.Settings())
    assert not corpus.is_current(spark, str(tmp_path / "none"), {})


def test_the_seed_set(spark):
    rows = corpus.seed_cases(spark).collect()
    assert len(rows) == 9 and sum(r["answerable"] for r in rows) == 7 and all(r["answerable"] == bool(r["expected_articles"]) for r in rows)
