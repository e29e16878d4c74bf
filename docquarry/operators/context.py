"""Context packing, citations and answers' flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import exprs as X

BUDGET = 3000


def pack_context(candidates: DataFrame, budget: int = BUDGET, query_key: str = "query_id") -> DataFrame:
    """(query_key, selected, discarded, text, token_estimate), a row per query.

    candidates: query_key, rank, chunk_id, label, text, token_estimate, a query's top k.  In rank order a chunk is discarded as
    duplicate_of_selected if its key was selected, else as budget_exhausted if it doesn't fit beside what is selected (later ones may),
    else selected; the first is always taken.
    """
    tokens = F.when(F.coalesce("token_estimate", F.lit(0)) > 0, F.col("token_estimate")).otherwise(X.token_estimate(F.col("text"))).cast("int")
    row = F.struct("rank", "chunk_id", "label", "text", tokens.alias("tokens"), X.dedup_key(F.col("text")).alias("key"))
    lists = candidates.groupBy(query_key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    picked = "array<struct<chunk_id:string,label:string,text:string,tokens:int,key:string>>"
    start = F.struct(F.lit(0).alias("used"), F.array().cast(picked).alias("kept"), F.array().cast("array<struct<chunk_id:string,label:string,reason:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        again = F.exists(s["kept"], lambda y: y["key"] == x["key"])
        full = ~again & (s["used"] + x["tokens"] > budget) & (F.size(s["kept"]) > 0)
        take = ~again & ~full
        reason = F.when(again, F.lit("duplicate_of_selected")).otherwise(F.lit("budget_exhausted"))
        own = F.struct(x["chunk_id"].alias("chunk_id"), x["label"].alias("label"), x["text"].alias("text"), x["tokens"].alias("tokens"), x["key"].alias("key"))
        return F.struct(
            (s["used"] + F.when(take, x["tokens"]).otherwise(0)).alias("used"),
            F.when(take, F.concat(s["kept"], F.array(own))).otherwise(s["kept"]).alias("kept"),
            F.when(take, s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(x["chunk_id"].alias("chunk_id"), x["label"].alias("label"), reason.alias("reason"))))).alias("out"),
        )

    done = lists.select(query_key, F.aggregate("rows", start, step).alias("s"))
    text = F.array_join(F.transform("s.kept", lambda x: F.concat(F.lit("["), x["label"], F.lit("]\n"), x["text"])), "\n\n")
    selected = F.transform("s.kept", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["label"].alias("label"), x["tokens"].alias("tokens")))
    return done.select(query_key, selected.alias("selected"), F.col("s.out").alias("discarded"), text.alias("text"), F.col("s.used").alias("token_estimate"))


def unanswerable(answer: Column) -> Column:
    return F.coalesce(F.startswith(answer, F.lit(X.UNANSWERABLE)), F.lit(False))


def cited_articles(answer: Column) -> Column:
    """The different article numbers that an answer cites; none if it declines."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(X.CITED_ARTICLE), F.lit(1)))
    return F.when(unanswerable(answer), F.array().cast("array<string>")).otherwise(found)


def extract_citations(answers: DataFrame, selected: DataFrame, query_key: str = "query_id") -> DataFrame:
    """The selected chunks (query_key, chunk_id, article_number, rank, ...) whose article the query's answer cites, each once."""
    cited = answers.select(query_key, F.explode(cited_articles(F.col("answer"))).alias("article_number"))
    return selected.join(cited, [query_key, "article_number"], "left_semi").dropDuplicates([query_key, "chunk_id"])
