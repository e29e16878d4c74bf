"""Every command on made-up pages: ingest, ask, diagnose, evaluate; the stored index, page labels, citations and reports."""

import json

import pytest

from docquarry import cli
from docquarry.operators import generation
from docquarry.plans import engine
from docquarry.sources import corpus

PAGES = "source_filename string, page int, raw_text string, width double, height double, blocks array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>, areas array<double>, paths int"
TEXTS = {
    "section-a.pdf": [
        "SECTION A: GENERAL\nIssue 3\nDate: 01/02/2024\nWMSC approval date: 03/02/2024\nARTICLE A1: SCOPE\nA1.1\nPurpose\nThe rules say how a harbour is run.",
        "A6\nA1.2\nLanterns\nEvery quay keeps a green lantern lit at night.\nA1.3\nRopes\nRopes are changed each spring.",
    ],
    "section-d.pdf": ["SECTION D: MONEY\nARTICLE D1: FEES\nD1.1\nMooring\nA mooring fee of ten coins is due on the first day.\nD1.2\nLanterns\nLantern oil is paid by the town."],
}


def made(spark, folder):
    rows = []
    for name, texts in TEXTS.items():
        if (folder / name).exists():
            for i, text in enumerate(texts):
                rows.append((name, i + 1, text, 500.0, 800.0, [(text, 10.0, 300.0, 400.0, 500.0)], [200_000.0] if name == "section-d.pdf" else [], 0))
    return spark.createDataFrame(rows, PAGES)


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    at = tmp_path / "corpus"
    at.mkdir()
    (at / "section-a.pdf").write_bytes(b"one")
    monkeypatch.setattr(cli.pdf, "read_pages", lambda files: made(spark, at))
    return at


def test_all_commands(spark, folder, tmp_path, capsys):
    index, where = str(tmp_path / "index"), ["--corpus", str(folder), "--index", str(tmp_path / "index")]
    assert cli.main(["ingest", *where]) == 0 and cli.main(["ingest", *where]) == 0
    assert capsys.readouterr().out.split("\n")[:2] == ["written", "up to date"]
    (folder / "section-d.pdf").write_bytes(b"two")  # the same settings, another corpus
    assert cli.main(["ingest", *where]) == 0
    assert "written" in capsys.readouterr().out
    chunks, vectors, held = corpus.load_index(spark, index)
    assert held["n_chunks"] == chunks.count() == vectors.count() and held["corpus_hash"]
    labels = {r["article_number"]: r["label"] for r in chunks.collect()}
    assert labels["A1.2"] == "Art. A1.2 (Section A, A6)" and labels["D1.1"] == "Art. D1.1 (Section D, pdf p.1)"

    trace = str(tmp_path / "trace")
    assert cli.main(["ask", "Which lantern does a quay keep lit?", "--index", index, "--retriever", "hybrid", "--k", "3", "--generator", "stub", "--trace", trace]) == 0
    said = capsys.readouterr().out
    assert "See [Art. A1.2 (Section A, A6)]." in said and "cites  Art. A1.2" in said and "green lantern" in said
    row = spark.read.json(trace).first().asDict(recursive=True)
    assert [c["article_number"] for c in row["citations"]] == ["A1.2"] and row["unanswerable"] is False and "green lantern" in row["prompt"] and row["prompt_version"] == "v1"
    assert any(c["selected"] for c in row["candidates"]) and row["config"]["retriever"] == "hybrid"
    assert cli.main(["ask", "lantern", "--index", index, "--section", "d", "--retriever", "bm25"]) == 0
    assert "Section A" not in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["ask", "lantern", "--index", index, "--section", "X"])
    assert cli.main(["ask", "lantern", "--index", str(tmp_path / "none")]) == 1

    out = tmp_path / "reports"
    assert cli.main(["diagnose", *where, "--out", str(out)]) == 0
    found = {r["source_filename"]: r for r in spark.read.json(str(out / "json")).collect()}
    assert found["section-a.pdf"]["issue_number"] == 3 and found["section-a.pdf"]["page_count"] == 2
    assert found["section-d.pdf"]["likely_visual_pages"][0]["kinds"] == ["image"] and "no issue number on page 1" in found["section-d.pdf"]["warnings"]
    text = "".join(p.read_text() for p in (out / "markdown" / "source_filename=section-d.pdf").glob("*.txt"))
    assert text.startswith("# section-d.pdf") and "| D1.1 |" in text

    cases = [
        {"id": "lamp", "question": "green lantern at night", "expected_articles": ["A1.2"], "expected_answer_terms": ["A1.2"], "answerable": True},
        {"id": "moon", "question": "zzz", "answerable": False},
    ]
    (tmp_path / "set.json").write_text(json.dumps({"version": "1", "cases": cases}, indent=1))
    runs = tmp_path / "runs"
    assert cli.main(["evaluate", "--dataset", str(tmp_path / "set.json"), "--index", index, "--retriever", "bm25", "--generate", "--generator", "stub", "--out", str(runs)]) == 0
    (run,) = runs.iterdir()
    record = spark.read.json(str(run / "record")).first().asDict(recursive=True)
    assert record["metrics"]["recall_at_k"] == 1.0 and record["metrics"]["answer_term_coverage"] == 1.0 and record["metrics"]["citation_accuracy"] == 1.0
    assert record["corpus_hash"] == held["corpus_hash"] and record["prompt_version"] == "v1"
    by_case = {r["case_id"]: r for r in spark.read.json(str(run / "cases")).collect()}
    assert by_case["lamp"]["citation_articles"] == ["A1.2"] and len(by_case) == 2


def test_unknown_section_is_an_error(spark, folder, tmp_path, monkeypatch, caplog):
    (folder / "other.pdf").write_bytes(b"x")
    monkeypatch.setitem(TEXTS, "other.pdf", ["no header here"])
    assert cli.main(["ingest", "--corpus", str(folder), "--index", str(tmp_path / "i")]) == 1
    assert "other.pdf" in caplog.text


def test_failed_save_leaves_the_index(spark, tmp_path):
    at, one = str(tmp_path / "i"), spark.createDataFrame([("a", 1.0)], "chunk_id string, embedding double")
    corpus.save_index(one.select("chunk_id"), one, at, {"dim": 1})
    with pytest.raises(ValueError):
        corpus.save_index(one.select("chunk_id"), one.limit(0), at, {"dim": 2})
    assert corpus.is_current(spark, at, {"dim": 1}) and not corpus.is_current(spark, at, {"dim": 2})
    corpus.save_index(one.union(one).select("chunk_id"), one.union(one), at, {"dim": 3})
    assert corpus.load_index(spark, at)[0].count() == 2 and not corpus.is_current(spark, str(tmp_path / "no"), {})


def test_index_of_another_embedder_is_refused(spark, tmp_path):
    at, one = str(tmp_path / "i"), spark.createDataFrame([("a", "t", [1.0])], "chunk_id string, text string, embedding array<double>")
    corpus.save_index(one.select("chunk_id", "text"), one.select("chunk_id", "embedding"), at, engine.Settings(dim=1).index_config())
    assert engine.load(spark, at, engine.Settings(dim=1))[2]["n_chunks"] == 1
    with pytest.raises(ValueError):
        engine.load(spark, at, engine.Settings(dim=2))


def test_questions_without_a_hit_keep_an_empty_context(spark):
    schema = "chunk_id string, source_filename string, section string, article_seq int, article_number string, chunk_index int, text string, label string, token_estimate int"
    chunks, asked = spark.createDataFrame([], schema), spark.createDataFrame([(1, "what?")], "query_id long, query string")
    for retriever in ("bm25", "vector", "hybrid"):
        own = engine.Settings(retriever=retriever, dim=16)
        (row,) = engine.answer_batch(chunks, asked, own).collect()
        assert (row["query_id"], row["selected"], row["discarded"], row["text"], row["token_estimate"]) == (1, [], [], "", 0)
    (row,) = engine.ask(chunks, asked, engine.Settings(retriever="bm25"), make=generation.StubGenerator).collect()
    assert row["answer"] is None and row["citations"] == [] and row["unanswerable"] is False


def test_cases_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "q", ["A1"], ["x"], True, None), ("b", "r", [], [], False, "n")], corpus.CASES)
    corpus.save_cases(df, str(tmp_path / "c"))
    assert sorted(map(str, corpus.load_cases(spark, str(tmp_path / "c")).collect())) == sorted(map(str, df.collect()))
