"""Ingest, batch answering and evaluation over DataFrames."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import exprs as X
from docquarry.operators import chunking, cleanup, generation, hybrid, keyword, parsing, postings, visuals
from docquarry.operators.context import extract_citations, unanswerable
from docquarry.operators.diagnostics import corpus_diagnostics, query_trace
from docquarry.operators.evaluation import metric_summary
from docquarry.plans import registry
from docquarry.sources import corpus
from docquarry.sources.shared import stash


@dataclass(frozen=True)
class Settings:
    chunker: str = "regulation"
    embedder: str = "hashing"
    retriever: str = "vector"
    reranker: str = "none"
    index: str = "exact"
    dim: int = 256
    chunk_tokens: int = 350
    overlap_tokens: int = 60
    top_k: int = 8
    context_tokens: int = 3000
    alpha: float = 0.5
    pool: int = 4

    @classmethod
    def from_environment(cls) -> Settings:
        """Fields from DOCQUARRY_<FIELD>."""
        kinds = {name: type(field.default) for name, field in cls.__dataclass_fields__.items()}
        return cls(**{k: kind(os.environ[f"DOCQUARRY_{k.upper()}"]) for k, kind in kinds.items() if f"DOCQUARRY_{k.upper()}" in os.environ})


    def index_config(self, corpus_hash: str | None = None) -> dict:
        """What an index depends on."""
        return {k: getattr(self, k) for k in ("chunker", "embedder", "index", "dim", "chunk_tokens", "overlap_tokens")} | {"corpus_hash": corpus_hash}


#: Retrievers that need vectors.
WITH_VECTORS = ("vector", "hybrid")
ORDER = ("source_filename", "article_seq", "chunk_index", "chunk_id")


@dataclass(frozen=True)
class Parsed:
    """What ingest makes of raw pages, step by step."""

    pages: DataFrame
    visuals: DataFrame
    articles: DataFrame
    chunks: DataFrame


def parse(pages: DataFrame, settings: Settings, min_fraction: float = 0.5) -> Parsed:
    """Raw pages (source_filename, section, page, raw_text, height, blocks; pdf_title where there is one): cleaned, parsed, cut into chunks.

    Chunks carry their document's title, issue and date, and the path of their first page's image.
    """
    clean = cleanup.clean_pages(pages, min_fraction).join(pages.select("source_filename", "page", "section"), ["source_filename", "page"])
    articles = parsing.parse_articles(parsing.line_stream(clean))
    chunks = registry.CHUNKERS.get(settings.chunker)(articles, settings.chunk_tokens, settings.overlap_tokens)
    seen = visuals.visual_pages(pages).withColumn("page_image_path", image_path(F.col("source_filename"), F.col("page")))
    chunks = chunks.join(document_meta(pages), "source_filename", "left")
    return Parsed(pages, seen, articles, chunking.with_page_images(chunks, seen))


def image_path(source_filename: Column, page: Column) -> Column:
    """Where a page's image is kept: the name of its row in the table of images."""
    return F.concat(F.regexp_replace(source_filename, r"\.[^.]*$", ""), F.lit("/page-"), F.when(page > 999, page.cast("string")).otherwise(F.lpad(page.cast("string"), 3, "0")), F.lit(".png"))


def document_meta(pages: DataFrame) -> DataFrame:
    """(source_filename, document_title, issue_number, publication_date) from each document's first page."""
    text, title = F.col("raw_text"), F.col("pdf_title") if "pdf_title" in pages.columns else F.lit("")
    front = corpus.front_matter(text)
    return pages.where("page = 1").select(
        "source_filename", corpus.detect_title(F.col("source_filename"), text, F.coalesce(title, F.lit(""))).alias("document_title"), front["issue_number"].alias("issue_number"), front["publication_date"].alias("publication_date")
    )


def build_chunks(pages: DataFrame, settings: Settings, min_fraction: float = 0.5) -> DataFrame:
    return parse(pages, settings, min_fraction).chunks


def write_steps(parsed: Parsed, path: str) -> Parsed:
    """The steps as JSON lines, a folder for each document: raw, visual, articles, chunks; read back, so that none is computed again."""
    spark, held = parsed.pages.sparkSession, {}
    for name, df in (("raw", parsed.pages), ("visual", parsed.visuals), ("articles", parsed.articles), ("chunks", parsed.chunks)):
        corpus.write_jsonl(df, f"{path}/{name}", by="source_filename")
        held[name] = corpus.read_jsonl(spark, f"{path}/{name}", df.schema)
    return Parsed(held["raw"], held["visual"], held["articles"], held["chunks"])


def ingest(spark: SparkSession, chunks: DataFrame, path: str, settings: Settings, force: bool = False, corpus_hash: str | None = None) -> bool:
    """Writes the index (chunks, vectors, postings, and what its backend keeps) unless one of the same corpus and configuration is there; whether it wrote.  No chunks is an error."""
    config = settings.index_config(corpus_hash)
    if not force and corpus.is_current(spark, path, config):
        return False
    held = stash(chunks, "chunks")
    vectors = stash(registry.EMBEDDERS.get(settings.embedder)(held, "chunk_id", "text", settings.dim), "vectors")
    order = tuple(c for c in ORDER if c in held.columns)
    more = postings.sorted_for_terms(postings.build(held, "chunk_id", order)).tables()
    more |= registry.INDEXES.get(settings.index).build(held.select(*order).join(vectors, "chunk_id"), "chunk_id", order)
    corpus.save_index(held, vectors, path, config, more)
    return True


def load(spark: SparkSession, path: str, settings: Settings) -> tuple[DataFrame, DataFrame, dict]:
    """(chunks, vectors, configuration) of the index; one that was made otherwise than the settings say is an error."""
    chunks, vectors, held = corpus.load_index(spark, path)
    for name in ("embedder", "dim", "index"):
        if held.get(name, "exact") != getattr(settings, name):
            raise ValueError(f"the index has {name} {held.get(name, 'exact')}, not {getattr(settings, name)}")
    return chunks, vectors, held


def _vector(chunks: DataFrame, queries: DataFrame, settings: Settings, k: int, where: dict | None, vectors: DataFrame | None, stored: dict[str, DataFrame] | None) -> DataFrame:
    """Stored vectors if given, else those of the settings' embedder; equal similarities in corpus order.  A backend other than the exact one needs its stored tables."""
    embed = registry.EMBEDDERS.get(settings.embedder)
    asked = embed(queries.select("query_id", "query"), "query_id", "query", settings.dim)
    held = chunks.join(embed(chunks, "chunk_id", "text", settings.dim) if vectors is None else vectors, "chunk_id")
    backend = registry.INDEXES.get(settings.index if stored else "exact")
    found = backend.ask(stored or {}, held, asked, k, where, "chunk_id", ORDER)
    return found.select("query_id", "chunk_id", "similarity", F.col("similarity").alias("score"), "rank")


def _keyword(chunks: DataFrame, queries: DataFrame, k: int, where: dict | None, stored: dict[str, DataFrame] | None) -> DataFrame:
    """BM25 from stored postings if there are any, else over the chunks' texts."""
    if stored and "postings_blocks" in stored:
        return postings.search(postings.Postings.of_tables(stored), queries, k, where, chunks, "chunk_id", ORDER)
    return keyword.bm25_topk(chunks, queries, k, where, order=ORDER)


def retrieve(chunks: DataFrame, queries: DataFrame, settings: Settings, k: int = 0, where: dict | None = None, vectors: DataFrame | None = None, stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) for queries (query_id, query); k = 0 is the default k; vectors: (chunk_id, embedding) of the index; stored: its further tables."""
    k = k or settings.top_k
    queries = queries.withColumn("query", X.squeeze(F.col("query")))
    if settings.retriever == "bm25":
        got = _keyword(chunks, queries, k, where, stored)
    elif settings.retriever == "vector":
        got = _vector(chunks, queries, settings, k, where, vectors, stored)
    elif settings.retriever == "hybrid":
        pool = settings.pool * k
        got = hybrid.fuse(_vector(chunks, queries, settings, pool, where, vectors, stored), _keyword(chunks, queries, pool, where, stored), k, settings.alpha)
    else:
        registry.RETRIEVERS.get(settings.retriever)
        raise ValueError(f"{settings.retriever} can't be used here")
    return registry.RERANKERS.get(settings.reranker)(got)


EMPTY_CONTEXT = {
    "selected": "array<struct<chunk_id:string,label:string,tokens:int>>", "discarded": "array<struct<chunk_id:string,label:string,reason:string>>",
}


def answer_batch(chunks: DataFrame, queries: DataFrame, settings: Settings, k: int = 0, where: dict | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, query, selected, discarded, text, token_estimate): packed contexts of all queries at once; empty ones where nothing was found."""
    found = retrieve(chunks, queries, settings, k, where, vectors).select("query_id", "chunk_id", "rank")
    return _contexts(queries, found.join(chunks, "chunk_id"), settings)


def _contexts(queries: DataFrame, found: DataFrame, settings: Settings) -> DataFrame:
    packed = queries.join(registry.PACKERS.get("greedy")(found, settings.context_tokens), "query_id", "left")
    empty = {c: F.coalesce(c, F.array().cast(kind)) for c, kind in EMPTY_CONTEXT.items()}
    return packed.withColumns(empty | {"text": F.coalesce("text", F.lit("")), "token_estimate": F.coalesce("token_estimate", F.lit(0))})


def ask(chunks: DataFrame, queries: DataFrame, settings: Settings, k: int = 0, where: dict | None = None, vectors: DataFrame | None = None, make: Callable[[], generation.Generator] | None = None, version: str = "v1", stored: dict[str, DataFrame] | None = None, answers_at: str | None = None) -> DataFrame:
    """A trace row per query (query_id, query): candidates, context and, where `make` gives a generator, prompt, answer and citations.

    Each step is written once, as later ones read it several times and an answer must not be generated anew.  answers_at: a table of answers that are
    never asked for again (see generate_once()).
    """
    found = retrieve(chunks, queries, settings, k, where, vectors, stored).select("query_id", "chunk_id", "score", "rank")
    found = stash(found.join(chunks, "chunk_id"), "candidates")
    contexts = stash(_contexts(queries, found, settings), "contexts")
    answers = None
    if make is not None:
        asked = generation.with_prompts(contexts.select("query_id", "query", "text"), version=version)
        said = generation.generate_once(asked, make, answers_at, version) if answers_at else generation.generate(asked, make, version)
        said = stash(said.select("query_id", "prompt", "answer"), "answers")
        held = contexts.select("query_id", F.explode("selected.chunk_id").alias("chunk_id")).join(found, ["query_id", "chunk_id"]).select("query_id", "chunk_id", "label", "article_number", "rank")
        cited = extract_citations(said, held).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "label", "article_number"))).alias("citations"))
        none = F.array().cast("array<struct<rank:int,chunk_id:string,label:string,article_number:string>>")
        answers = said.join(cited, "query_id", "left").withColumns({"prompt_version": F.lit(version), "unanswerable": unanswerable(F.col("answer")), "citations": F.coalesce("citations", none)})
    config = {"retriever": settings.retriever, "reranker": settings.reranker, "embedder": settings.embedder, "index": settings.index, "dim": settings.dim, "k": k or settings.top_k, "where": json.dumps(where or {}), "context_tokens": settings.context_tokens}
    return query_trace(queries, found, contexts, config, answers)


def diagnose(pages: DataFrame, min_fraction: float = 0.5) -> DataFrame:
    """corpus_diagnostics() of raw pages (source_filename, section, page, raw_text, height, blocks; areas, paths and width where there are any)."""
    clean = cleanup.clean_pages(pages, min_fraction).join(pages.select("source_filename", "page", "section"), ["source_filename", "page"])
    clean = stash(clean, "clean")
    articles = parsing.parse_articles(parsing.line_stream(clean))
    first = pages.where("page = 1")
    meta = first.select("source_filename", *(c.alias(name) for name, c in corpus.front_matter(F.col("raw_text")).items()))
    return corpus_diagnostics(meta, clean, articles, visuals.visual_pages(pages))


def case_results(chunks: DataFrame, cases: DataFrame, settings: Settings, k: int = 0, vectors: DataFrame | None = None, make: Callable[[], generation.Generator] | None = None, stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """The cases with retrieved_articles, context_articles, citation_articles, answer_text and is_unanswerable."""
    queries = cases.select(F.col("case_id").alias("query_id"), F.col("question").alias("query"))
    none = F.array().cast("array<string>")
    if make is None:
        found = retrieve(chunks, queries, settings, k, vectors=vectors, stored=stored).join(chunks.select("chunk_id", "article_number"), "chunk_id")
        lists = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "article_number"))), lambda x: x["article_number"]).alias("retrieved_articles"))
        full = cases.join(lists.withColumnRenamed("query_id", "case_id"), "case_id", "left").withColumn("retrieved_articles", F.coalesce("retrieved_articles", none))
        return full.withColumns({"context_articles": F.col("retrieved_articles"), "citation_articles": none, "answer_text": F.lit(None).cast("string"), "is_unanswerable": F.lit(False)})
    trace = ask(chunks, queries, settings, k, vectors=vectors, make=make, stored=stored)
    numbers = lambda xs: F.transform(xs, lambda c: c["article_number"])
    got = trace.select(
        F.col("query_id").alias("case_id"), F.coalesce(numbers("candidates"), none).alias("retrieved_articles"), F.coalesce(numbers(F.filter("candidates", lambda c: c["selected"])), none).alias("context_articles"),
        F.coalesce(numbers("citations"), none).alias("citation_articles"), F.col("answer").alias("answer_text"), F.coalesce("unanswerable", F.lit(False)).alias("is_unanswerable"),
    )
    return cases.join(got, "case_id")


def evaluate(chunks: DataFrame, cases: DataFrame, settings: Settings, k: int = 0, vectors: DataFrame | None = None, make: Callable[[], generation.Generator] | None = None, stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """metric_summary() over cases (case_id, question, answerable, expected_articles, expected_answer_terms)."""
    full = case_results(chunks, cases, settings, k, vectors, make, stored)
    return metric_summary(full, k or settings.top_k).withColumn("config", F.lit(str(sorted(asdict(settings).items()))))


def evaluate_matrix(chunks: DataFrame, cases: DataFrame, configs: list[Settings], vectors: DataFrame | None = None, stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """(config, retriever, alpha, k, metrics): a row per configuration, all from one vector search and one BM25 search.

    Each search goes as deep as the deepest configuration needs; the others read the first ranks of the same rows, keyed by configuration.  Configurations
    share an index: chunker, embedder, dim and index have to be alike.
    """
    if len({json.dumps(c.index_config(), sort_keys=True) for c in configs}) != 1:
        raise ValueError("the configurations are of different indexes")
    queries = cases.select(F.col("case_id").alias("query_id"), X.squeeze(F.col("question")).alias("query"))
    depth = [c.top_k * (c.pool if c.retriever == "hybrid" else 1) for c in configs]
    about = [F.struct(F.lit(i).alias("config"), F.lit(c.alpha).alias("alpha"), F.lit(c.top_k).alias("k"), F.lit(d).alias("depth")) for i, (c, d) in enumerate(zip(configs, depth, strict=True))]

    def keyed(found: DataFrame, retriever: str) -> DataFrame | None:
        """The ranks that each configuration of a retriever needs, under (configuration, query) as their query."""
        mine = [a for a, c in zip(about, configs, strict=True) if c.retriever == retriever]
        if not mine:
            return None
        each = found.withColumn("c", F.explode(F.array(*mine))).where(F.col("rank") < F.col("c.depth"))
        return each.withColumn("query_id", F.struct("c.config", "c.alpha", "c.k", F.col("query_id").alias("id"))).drop("c")

    parts, pools = [], {}
    for kind, uses in (("vector", ("vector", "hybrid")), ("bm25", ("bm25", "hybrid"))):
        deepest = max((d for c, d in zip(configs, depth, strict=True) if c.retriever in uses), default=0)
        if deepest:
            got = _vector(chunks, queries, configs[0], deepest, None, vectors, stored) if kind == "vector" else _keyword(chunks, queries, deepest, None, stored)
            held = stash(got, "pool")
            pools[kind] = keyed(held, "hybrid")
            parts.append(keyed(held, kind))
    if pools.get("vector") is not None and pools.get("bm25") is not None:
        fused = hybrid.fuse(pools["vector"], pools["bm25"], max(c.top_k for c in configs), F.col("query_id.alpha"))
        parts.append(fused.where(F.col("rank") < F.col("query_id.k")))
    each = None
    for part in parts:
        if part is not None:
            own = part.select(F.col("query_id.config").alias("config"), F.col("query_id.id").alias("case_id"), "chunk_id", "rank")
            each = own if each is None else each.unionByName(own)
    named = each.join(chunks.select("chunk_id", "article_number"), "chunk_id")
    lists = named.groupBy("config", "case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "article_number"))), lambda x: x["article_number"]).alias("retrieved_articles"))
    none = F.array().cast("array<string>")
    full = cases.withColumn("config", F.explode(F.array(*(F.lit(i) for i in range(len(configs)))))).join(lists, ["config", "case_id"], "left")
    full = full.withColumn("retrieved_articles", F.coalesce("retrieved_articles", none)).withColumns({"context_articles": F.col("retrieved_articles"), "citation_articles": none, "answer_text": F.lit(None).cast("string"), "is_unanswerable": F.lit(False)})
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("config") + 1)
    summary = metric_summary(full, by=("config",))
    return summary.withColumns({"retriever": at([c.retriever for c in configs]), "alpha": at([c.alpha for c in configs]), "k": at([c.top_k for c in configs])})


def save_run(chunks: DataFrame, cases: DataFrame, settings: Settings, path: str, k: int = 0, vectors: DataFrame | None = None, make: Callable[[], generation.Generator] | None = None, corpus_hash: str | None = None, stored: dict[str, DataFrame] | None = None) -> tuple[DataFrame, str]:
    """(summary row, folder): an evaluation whose record (time, settings, corpus, metrics) and results by case are written as JSON lines."""
    spark, at = chunks.sparkSession, f"{path}/{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:6]}"
    corpus.write_jsonl(case_results(chunks, cases, settings, k, vectors, make, stored), f"{at}/cases")
    full = corpus.read_jsonl(spark, f"{at}/cases", RESULTS)
    summary = metric_summary(full, k or settings.top_k)
    about = {"timestamp": datetime.now(UTC).isoformat(), "corpus_hash": corpus_hash, "config": json.dumps(asdict(settings) | {"k": k or settings.top_k}), "prompt_version": "v1" if make else None}
    corpus.write_jsonl(summary.select(*(F.lit(v).cast("string").alias(c) for c, v in about.items()), F.struct(*summary.columns).alias("metrics")), f"{at}/record")
    return summary, at


RESULTS = corpus.CASES + ", retrieved_articles array<string>, context_articles array<string>, citation_articles array<string>, answer_text string, is_unanswerable boolean"
