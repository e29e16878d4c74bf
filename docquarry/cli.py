"""Command line: ingest, ask, diagnose, evaluate, components."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import generation
from docquarry.operators.diagnostics import markdown_report, render_trace
from docquarry.plans import engine, registry
from docquarry.sources import corpus, pdf
from docquarry.sources.shared import stash

log = logging.getLogger("docquarry")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docquarry")
    top.add_argument("--log-level", default="INFO")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("ingest", "ask", "diagnose", "evaluate", "components"):
        p = sub.add_parser(name)
        if name == "components":
            continue
        p.add_argument("--index", default="index")
        for option in ("chunker", "embedder", "retriever", "reranker"):
            p.add_argument(f"--{option}")
        p.add_argument("--index-kind", choices=registry.INDEXES.names())
        p.add_argument("--k", type=int, default=0)
        if name in ("ingest", "diagnose"):
            p.add_argument("--corpus", required=True)
            p.add_argument("--force", action="store_true")
            p.add_argument("--images", action="store_true", help="render every page into the index's folder")
        if name == "ask":
            p.add_argument("question")
            p.add_argument("--section", type=section)
            p.add_argument("--trace", help="folder for the trace as JSON")
        if name == "evaluate":
            p.add_argument("--dataset", help="evaluation cases; the seed set if none is given")
            p.add_argument("--generate", action="store_true")
        if name in ("ask", "evaluate"):
            p.add_argument("--generator", choices=("none", "stub", "anthropic"), default="none")
            p.add_argument("--model", default="")
            p.add_argument("--answers", help="folder of a table of answers that are never asked for again")
        if name in ("diagnose", "evaluate"):
            p.add_argument("--out", default=name, help="folder for the reports")
    return top


def section(value: str) -> str:
    if value.upper() not in tuple("ABCDEF"):
        raise argparse.ArgumentTypeError(f"{value!r} is no section: A to F")
    return value.upper()


def generator(args: argparse.Namespace):
    """What makes the generator in each task, or None."""
    if args.generator == "stub":
        return generation.StubGenerator
    if args.generator == "anthropic":
        model = args.model
        generation.anthropic_generator(model)  # fails here rather than in a task
        return lambda: generation.anthropic_generator(model)
    return None


def settings(args: argparse.Namespace) -> engine.Settings:
    given = {k: getattr(args, k, None) for k in ("chunker", "embedder", "retriever", "reranker")} | {"index": getattr(args, "index_kind", None)}
    return replace(engine.Settings.from_environment(), **{k: v for k, v in given.items() if v})


def pages_of(spark: SparkSession, folder: str):
    """(pages, corpus hash); a file of an unknown section is an error."""
    files = corpus.list_corpus(spark, folder)
    pages = pdf.read_pages(files)
    first = pages.where("page = 1").select("source_filename", corpus.detect_section(F.col("source_filename"), F.col("raw_text")).alias("section"))
    corpus.check_sections(first)
    return pages.join(first, "source_filename"), corpus.corpus_hash(files).first()[0]


def run(args: argparse.Namespace) -> int:
    if args.command == "components":
        for r in registry.ALL:
            print(f"{r.kind}: {', '.join(r.names())}")
        return 0
    spark, own = SparkSession.builder.getOrCreate(), settings(args)
    if args.command == "ingest":
        pages, named = pages_of(spark, args.corpus)
        if not args.force and corpus.is_current(spark, args.index, own.index_config(named)):
            print("up to date")
            return 0
        parsed = engine.write_steps(engine.parse(pages, own), f"{args.index}/steps")
        if args.images:
            pdf.render_pages(corpus.list_corpus(spark, args.corpus), engine.image_path).write.mode("overwrite").parquet(f"{args.index}/images")
        engine.ingest(spark, parsed.chunks, args.index, own, True, named)
        print("written")
    elif args.command == "diagnose":
        report(engine.diagnose(pages_of(spark, args.corpus)[0]), args.out)
        print(args.out)
    elif args.command == "ask":
        chunks, vectors, _ = engine.load(spark, args.index, own)
        where = {"section": args.section} if args.section else None
        asked = spark.createDataFrame([(0, args.question)], "query_id long, query string")
        make = generator(args)
        trace = stash(engine.ask(chunks, asked, own, args.k, where, vectors, make, stored=corpus.load_more(spark, args.index), answers_at=args.answers), "trace")
        if make and not trace.where("context != ''").take(1):
            raise ValueError("nothing was found to answer from")
        if args.trace:
            corpus.write_jsonl(trace, args.trace)
        for row in trace.collect():  # one question
            print(render_trace(row.asDict(recursive=True)))
    else:
        chunks, vectors, held = engine.load(spark, args.index, own)
        make = generator(args) if args.generate else None
        cases = corpus.load_cases(spark, args.dataset) if args.dataset else corpus.seed_cases(spark)
        summary, at = engine.save_run(chunks, cases, own, args.out, args.k, vectors, make, held["corpus_hash"], corpus.load_more(spark, args.index))
        summary.show(truncate=False)
        print(at)
    return 0


def report(found: DataFrame, out: str) -> None:
    """Diagnostics as JSON lines, and as Markdown in a folder for each document."""
    held = stash(found, "diagnostics")
    corpus.write_jsonl(held, f"{out}/json")
    schema = "source_filename string, markdown string"
    pages = held.select("source_filename", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")).mapInPandas(_markdown, schema)
    pages.repartition("source_filename").write.mode("overwrite").partitionBy("source_filename").text(f"{out}/markdown", lineSep="\n")


def _markdown(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"source_filename": frame["source_filename"], "markdown": [markdown_report(json.loads(x)) for x in frame["row"]]})


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level.upper(), stream=sys.stderr)
    try:
        return run(args)
    except Exception:
        log.exception("%s failed", args.command)
        return 1


if __name__ == "__main__":
    sys.exit(main())
