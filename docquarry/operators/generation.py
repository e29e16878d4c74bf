"""Prompts and answers: a versioned template and the protocol of a generator."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docquarry.functions.exprs import UNANSWERABLE
from docquarry.sources.shared import stash

PROMPTS = {
    "v1": (
        f"Answer from the excerpts alone. Behind each statement give the label of its excerpt in square brackets, as printed. If the excerpts don't hold the answer, begin with {UNANSWERABLE} and say what is missing.",
        "Question: {question}\n\nExcerpts:\n\n{context}\n",
    )
}


class Generator(Protocol):
    name: str

    def generate(self, system: str, prompt: str) -> str: ...


def prompt(question: str, context: str, version: str = "v1") -> tuple[str, str]:
    """(system text, user text); an unknown version is a KeyError."""
    system, user = PROMPTS[version]
    return system, user.format(question=question, context=context)


def with_prompts(contexts: DataFrame, question: str = "query", context: str = "text", version: str = "v1") -> DataFrame:
    before, between = PROMPTS[version][1].split("{question}")[0], PROMPTS[version][1].split("{question}")[1].split("{context}")
    return contexts.withColumn("prompt", F.concat(F.lit(before), F.col(question), F.lit(between[0]), F.col(context), F.lit(between[1])))


def generate(contexts: DataFrame, make: Callable[[], Generator], version: str = "v1") -> DataFrame:
    """contexts with `answer`; rows without context have none.  `make` builds the generator once in each task."""
    schema = StructType([*contexts.schema, StructField("answer", StringType())])

    def of(frames):
        generator = make()
        for frame in frames:
            asked = zip(frame["query"], frame["text"], strict=True)
            yield frame.assign(answer=[generator.generate(*prompt(q, t, version)).strip() if t else None for q, t in asked])

    return contexts.mapInPandas(of, schema)


#: Tries of a prompt, the wait before the second one (doubled each time), calls at a time in a task, and prompts of a task: what a lost task can ask for again.
TRIES, WAIT_S, IN_FLIGHT, OF_A_TASK = 3, 0.5, 4, 16
ANSWERS = "key string, model string, version string, answer string, at timestamp"


def prompt_key(system: str, prompt: Column, model: str, version: str) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(model), F.lit(version), F.lit(system), prompt), 256)


def generate_once(contexts: DataFrame, make: Callable[[], Generator], path: str, version: str = "v1", tries: int = TRIES, wait_s: float = WAIT_S, in_flight: int = IN_FLIGHT, of_a_task: int = OF_A_TASK) -> DataFrame:
    """contexts (with_prompts()) with `answer`, each prompt of a model and version asked for once, however often this is called.

    Answers are rows of a table in `path`.  Prompts that it lacks are asked for, equal ones together, `in_flight` at a time in a task; one that fails `tries`
    times doesn't fail its task, so what was answered beside it is kept, and the error that names it is raised once all others are stored.  Rows without context
    have no answer.
    """
    spark, model = contexts.sparkSession, make().name
    keyed = contexts.withColumn("_key", F.when(F.coalesce("text", F.lit("")) != "", prompt_key(PROMPTS[version][0], F.col("prompt"), model, version)))
    wanted = keyed.where("_key is not null").groupBy("_key").agg(F.first(F.struct("query", "text")).alias("x")).select(F.col("_key").alias("key"), "x.query", "x.text")
    missing = wanted.join(stored_answers(spark, path).select("key"), "key", "left_anti")
    tasks = max(1, -(-missing.count() // of_a_task))

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = make()

        def call(asked: tuple[str, str]) -> tuple[str | None, str | None]:
            for n in range(tries):
                try:
                    return generator.generate(*prompt(*asked, version)).strip(), None
                except Exception as e:  # any failure of a service is a reason to try again
                    failed = f"{type(e).__name__}: {e}"
                    if n < tries - 1:
                        time.sleep(wait_s * 2**n)
            return None, failed

        with ThreadPoolExecutor(in_flight) as pool:
            for frame in frames:
                found = list(pool.map(call, zip(frame["query"], frame["text"], strict=True)))
                yield pd.DataFrame({"key": frame["key"], "answer": [x for x, _ in found], "failed": [x for _, x in found]})

    # written before it is looked at: each prompt is asked by one task of one job
    got = stash(missing.repartition(tasks, "key").mapInPandas(of, "key string, answer string, failed string"), "answered")
    good = got.where("failed is null").select("key", F.lit(model).alias("model"), F.lit(version).alias("version"), "answer", F.current_timestamp().alias("at"))
    good.write.mode("append").parquet(path)
    bad = got.where("failed is not null")
    if first := bad.first():
        raise RuntimeError(f"{bad.count()} prompts have no answer, the others are stored; the first failed with {first['failed']}")
    answers = stored_answers(spark, path).groupBy(F.col("key").alias("_key")).agg(F.min("answer").alias("answer"))
    return keyed.join(answers, "_key", "left").drop("_key")


def stored_answers(spark: SparkSession, path: str) -> DataFrame:
    """ANSWERS in `path`; empty where there are none yet."""
    try:
        return spark.read.schema(ANSWERS).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ANSWERS)


class StubGenerator:
    """Cites the first excerpt's label: for tests and dry runs."""

    name = "stub"

    def generate(self, system: str, prompt: str) -> str:
        label = prompt.partition("Excerpts:\n\n[")[2].partition("]")[0]
        return f"See [{label}]." if label else f"{UNANSWERABLE} no excerpt"


def anthropic_generator(model: str, max_tokens: int = 1024) -> Generator:
    """A generator over the public anthropic package; needs the package, and a key in ANTHROPIC_API_KEY where it runs: no key travels with a task."""
    key = os.environ.get("ANTHROPIC_API_KEY")
    if not key:
        raise RuntimeError("an API key is needed: ANTHROPIC_API_KEY")
    import anthropic

    client = anthropic.Anthropic(api_key=key)

    class Remote:
        name = model

        def generate(self, system: str, prompt: str) -> str:
            got = client.messages.create(model=model, max_tokens=max_tokens, temperature=0, system=system, messages=[{"role": "user", "content": prompt}])
            return "".join(x.text for x in got.content if x.type == "text")

    return Remote()
