"""Retrieval and answer metrics over one row per case.

Cases: case_id, answerable, expected_articles[], expected_answer_terms[], retrieved_articles[] in rank order, context_articles[],
citation_articles[], answer_text, is_unanswerable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def article_match(expected: Column, retrieved: Column) -> Column:
    """Equal, or the expected number is a plain prefix (so D3 also matches D30)."""
    return F.startswith(retrieved, expected)


def article_match_strict(expected: Column, retrieved: Column) -> Column:
    """Equal, or below the expected number."""
    return (retrieved == expected) | F.startswith(retrieved, F.concat(expected, F.lit(".")))


def any_match(expected: Column, retrieved: Column) -> Column:
    return F.exists(expected, lambda e: F.exists(retrieved, lambda r: article_match(e, r)))


def recall(expected: Column, retrieved: Column) -> Column:
    found = F.size(F.filter(expected, lambda e: F.exists(retrieved, lambda r: article_match(e, r))))
    return F.when(F.size(expected) == 0, 1.0).otherwise(found / F.size(expected))


def reciprocal_rank(expected: Column, retrieved: Column) -> Column:
    hits = F.transform(retrieved, lambda r: F.exists(expected, lambda e: article_match(e, r)))
    at = F.array_position(hits, True)
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def case_scores(cases: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Every case with its scores; null where a metric leaves the case out.  by: further columns to keep."""
    c = F.col
    scored = c("answerable") & (F.size("expected_articles") > 0)
    answered = (F.coalesce("answer_text", F.lit("")) != "") & ~c("is_unanswerable")
    known = F.forall("citation_articles", lambda x: F.array_contains("context_articles", x))
    terms = F.filter("expected_answer_terms", lambda t: F.contains(F.lower("answer_text"), F.lower(t)))
    return cases.select(
        *by, "case_id", "answerable",
        F.when(scored, recall(c("expected_articles"), c("retrieved_articles"))).alias("recall"),
        F.when(scored, reciprocal_rank(c("expected_articles"), c("retrieved_articles"))).alias("rr"),
        F.when(scored, any_match(c("expected_articles"), c("retrieved_articles")).cast("double")).alias("hit"),
        F.when(scored & (F.size("citation_articles") > 0), any_match(c("expected_articles"), c("citation_articles")).cast("double")).alias("cited"),
        F.when(answered, ((F.size("citation_articles") == 0) | ~known).cast("double")).alias("unsupported"),
        (c("answerable") != c("is_unanswerable")).cast("double").alias("handled"),
        F.when(answered & (F.size("expected_answer_terms") > 0), F.size(terms) / F.size("expected_answer_terms")).alias("coverage"),
    )


def metric_summary(cases: DataFrame, k: int = 8, by: tuple[str, ...] = ()) -> DataFrame:
    """One row of rounded means, or one for each value of `by`, which then has k; an empty denominator gives 0."""
    mean = lambda name, out: F.round(F.coalesce(F.avg(name), F.lit(0.0)), 4).alias(out)
    return case_scores(cases, by).groupBy(*by).agg(
        F.count("*").alias("n_cases"), F.coalesce(F.sum(F.col("answerable").cast("long")), F.lit(0)).alias("n_answerable"), mean("recall", "recall_at_k"), mean("rr", "mrr"), mean("hit", "article_hit_rate"),
        mean("cited", "citation_accuracy"), mean("unsupported", "unsupported_claim_rate"), mean("handled", "unanswerable_handling"), mean("coverage", "answer_term_coverage"), *(() if by else (F.lit(k).alias("k"),)),
    )
