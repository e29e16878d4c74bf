"""Answers are asked for once: stored by prompt, kept beside failures, equal prompts together."""

import sys
from pathlib import Path

import pytest
from docquarry.operators import generation
from docquarry.plans import engine
from docquarry.operators.evaluation import metric_summary
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def maker(log: str, fails: tuple[str, ...] = (), first_only: bool = False):
    class Counting:
        """Notes each call in a file; fails for some questions."""

        name = "counting"

        def generate(self, system: str, prompt: str) -> str:
            question = prompt.partition("Question: ")[2].partition("\n")[0]
            with open(log, "a") as f:
                f.write(question + "\n")
            again = Path(log).read_text().split("\n").count(question) > 1
            if question in fails and not (first_only and again):
                raise OSError("service is away")
            return f"answer to {question}"

    return Counting


def calls(log) -> dict[str, int]:
    said = Path(log).read_text().split("\n")[:-1] if Path(log).exists() else []
    return {q: said.count(q) for q in said}


@pytest.fixture
def contexts(spark):
    rows = [(i, f"q{i % 7}", f"text {i % 7}") for i in range(20)] + [(90, "none", ""), (91, "null", None)]
    return generation.with_prompts(spark.createDataFrame(rows, "query_id long, query string, text string"))


def test_each_prompt_is_asked_once(spark, contexts, tmp_path):
    log, at = str(tmp_path / "log"), str(tmp_path / "answers")
    for _ in range(2):
        got = {r["query_id"]: r["answer"] for r in generation.generate_once(contexts, maker(log), at, of_a_task=2).collect()}
        assert got == {i: f"answer to q{i % 7}" for i in range(20)} | {90: None, 91: None}
        assert calls(log) == {f"q{i}": 1 for i in range(7)}
    more = contexts.unionByName(generation.with_prompts(spark.createDataFrame([(99, "new", "text")], "query_id long, query string, text string")))
    assert generation.generate_once(more, maker(log), at).where("query_id = 99").first()["answer"] == "answer to new"
    assert calls(log) == {f"q{i}": 1 for i in range(7)} | {"new": 1}


def test_a_failure_keeps_the_other_answers(contexts, tmp_path):
    log, at = str(tmp_path / "log"), str(tmp_path / "answers")
    with pytest.raises(RuntimeError, match="1 prompts have no answer.*away"):
        generation.generate_once(contexts, maker(log, ("q3",)), at, tries=2, wait_s=0.01, of_a_task=100)
    assert calls(log) == {f"q{i}": 1 for i in range(7)} | {"q3": 2}
    # the next run asks for what is missing alone
    got = generation.generate_once(contexts, maker(log), at)
    assert got.where("answer is null").count() == 2 and calls(log) == {f"q{i}": 1 for i in range(7)} | {"q3": 3}


def test_a_second_try_can_do(contexts, tmp_path):
    log = str(tmp_path / "log")
    got = generation.generate_once(contexts, maker(log, ("q1",), first_only=True), str(tmp_path / "answers"), wait_s=0.01)
    assert got.where("answer = 'answer to q1'").count() == 3 and calls(log)["q1"] == 2


def test_matrix_equals_single_runs(spark):
    rows = [(f"c{i:03}", "s.pdf", "A", i, f"A{i % 12}.{i}", 0, " ".join(f"w{(i * j) % 31}" for j in range(1, 14)), "l", 10) for i in range(80)]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_filename string, section string, article_seq int, article_number string, chunk_index int, text string, label string, token_estimate int")
    cases = spark.createDataFrame([(f"k{i}", f"w{i} w{i * 2 % 31} w5", [f"A{i % 12}"], [], i % 5 > 0, None) for i in range(15)], "case_id string, question string, expected_articles array<string>, expected_answer_terms array<string>, answerable boolean, notes string")
    configs = [engine.Settings(retriever=r, top_k=k, alpha=a, pool=p, dim=32) for r, k, a, p in (("bm25", 3, 0.5, 4), ("bm25", 8, 0.5, 4), ("vector", 5, 0.5, 4), ("hybrid", 8, 0.5, 4), ("hybrid", 4, 0.2, 2), ("hybrid", 4, 0.9, 4))]
    got = {r["config"]: r.asDict() for r in engine.evaluate_matrix(chunks, cases, configs).collect()}
    for i, config in enumerate(configs):
        want = metric_summary(engine.case_results(chunks, cases, config), config.top_k).first().asDict()
        assert {k: got[i][k] for k in want} == want and got[i]["retriever"] == config.retriever
    with pytest.raises(ValueError, match="different indexes"):
        engine.evaluate_matrix(chunks, cases, [engine.Settings(dim=32), engine.Settings(dim=64)])
