"""Corpus diagnostics and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST, PREVIEW, SHOWN = 15, 120, 4000


def corpus_diagnostics(meta: DataFrame, pages: DataFrame, articles: DataFrame, visuals: DataFrame | None = None) -> DataFrame:
    """A report row per document.

    meta: source_filename, issue_number, publication_date, wmsc_approval_date; pages: source_filename, page, page_label, is_toc;
    articles as parsed; visuals: source_filename, page, kinds.
    """
    by_page = pages.groupBy("source_filename").agg(F.count("*").alias("page_count"), F.sum(F.col("is_toc").cast("long")).alias("n_toc_pages"), F.count("page_label").alias("labelled"))
    ranked = articles.where("article_seq is not null")
    count = ranked.groupBy("source_filename").agg(F.count("*").alias("n_articles"))
    row = F.struct("article_seq", "article_number", "parent_article", "heading", "page", F.substring("text", 1, PREVIEW).alias("text_preview"))
    # cut before it's gathered: a bounded list for each document
    place = F.row_number().over(Window.partitionBy("source_filename").orderBy("article_seq"))
    first = ranked.withColumn("place", place).where(F.col("place") <= FIRST).groupBy("source_filename").agg(F.array_sort(F.collect_list(row)).alias("first_articles"))
    out = meta.join(by_page, "source_filename", "left").join(count, "source_filename", "left").join(first, "source_filename", "left")
    if visuals is not None:
        seen = visuals.where(F.size("kinds") > 0).groupBy("source_filename").agg(F.array_sort(F.collect_list(F.struct("page", "kinds"))).alias("likely_visual_pages"))
        out = out.join(seen, "source_filename", "left")
    out = out.na.fill(0, ["page_count", "n_toc_pages", "labelled", "n_articles"])
    warn = F.array_compact(F.array(
        F.when(F.col("issue_number").isNull(), F.lit("no issue number on page 1")),
        F.when(F.col("publication_date").isNull(), F.lit("no publication date on page 1")),
        F.when(F.col("wmsc_approval_date").isNull(), F.lit("no approval date on page 1")),
        F.when(F.col("n_toc_pages") == 0, F.lit("no contents pages")),
        F.when(F.col("n_articles") == 0, F.lit("no articles")),
        F.when(F.col("labelled") < F.col("page_count") * 0.5, F.concat(F.lit("page labels on "), F.col("labelled").cast("string"), F.lit("/"), F.col("page_count").cast("string"), F.lit(" pages"))),
    ))
    return out.withColumn("warnings", warn)


def query_trace(queries: DataFrame, candidates: DataFrame, contexts: DataFrame, config: dict[str, str], answers: DataFrame | None = None, query_key: str = "query_id") -> DataFrame:
    """A nested row per query: the query, its candidates with previews and whether selected, the context and the configuration.

    answers: query_key, prompt_version, prompt, answer, unanswerable, citations, where there are any.
    """
    row = F.struct("rank", "chunk_id", "article_number", "score", F.substring("text", 1, 200).alias("text_preview"))
    found = candidates.groupBy(query_key).agg(F.array_sort(F.collect_list(row)).alias("candidates"))
    joined = queries.join(found, query_key, "left").join(contexts.select(query_key, "selected", "discarded", F.col("text").alias("context"), "token_estimate"), query_key, "left")
    if answers is not None:
        joined = joined.join(answers, query_key, "left")
    settings = F.create_map(*(F.lit(str(x)) for pair in sorted(config.items()) for x in pair))
    marked = F.transform("candidates", lambda c: c.withField("selected", F.exists("selected", lambda s: s["chunk_id"] == c["chunk_id"])))
    return joined.withColumn("candidates", marked).withColumn("config", settings)


def render_trace(row: dict) -> str:
    """A trace row as text."""
    lines = [f"query  {row.get('query')}", f"config {row.get('config')}", ""]
    lines += [f"{c['rank']:>3} {'*' if c['selected'] else ' '} {c['score']:>10.4f} {c['chunk_id']}  {c['text_preview'][:60]}" for c in row.get("candidates") or []]
    lines += ["", (row.get("context") or "")[:SHOWN]]
    if row.get("answer"):
        lines += ["", f"answer ({row.get('prompt_version')})", row["answer"], "", *(f"cites  {c['label']}  {c['chunk_id']}" for c in row.get("citations") or [])]
    return "\n".join(lines)


def markdown_report(row: dict) -> str:
    """A diagnostics row as Markdown."""
    cell = lambda x: str(x if x is not None else "").replace("|", "\\|")
    lines = [f"# {row['source_filename']}", "", f"Pages {row['page_count']}, contents pages {row['n_toc_pages']}, articles {row['n_articles']}.", ""]
    lines += [f"- {w}" for w in row["warnings"]]
    lines += ["", "| article | parent | heading | page |", "|-|-|-|-|"]
    lines += [f"| {cell(a['article_number'])} | {cell(a['parent_article'])} | {cell(a['heading'])} | {a['page']} |" for a in row.get("first_articles") or []]
    lines += [f"- page {v['page']}: {', '.join(v['kinds'])}" for v in (row.get("likely_visual_pages") or [])[:25]]
    return "\n".join(lines) + "\n"
