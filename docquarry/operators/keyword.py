"""Okapi BM25 over all chunks: statistics by grouping, scores chunk by chunk against blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import exprs as X
from docquarry.functions.tokens import tokenized
from docquarry.operators import topk
from docquarry.operators.search import metadata_filter
from docquarry.sources.shared import arrow_limits, stash

# ---- fixed values: the usual constants of the formula
K1, B, EPSILON = 1.5, 0.75, 0.25
DIGITS = 6
#: What an empty text is indexed as.
NOTHING = "\u0000"
#: Stands for the chunk itself among its terms.
EVERY = ""
#: Blocks of queries of a pass; a block's table of terms by queries is a dense one.
PASS_BLOCKS = 16
#: Counts of terms that a task holds at a time.
TERMS = 1 << 20
#: Cells of a table of chunks by query terms.
CELLS = 1 << 22


def lowered(text: Column) -> Column:
    """What index_tokens() takes a text's tokens from."""
    return F.lower(F.coalesce(text, F.lit("")))


def index_tokens(texts: pa.Array) -> pa.ListArray:
    """The tokens of each lowered() text; one without a token counts as one token that no query has."""
    sizes, tokens = tokenized(texts)
    empty = np.flatnonzero(sizes == 0)
    if len(empty):
        at = np.insert(np.arange(len(tokens)), (np.cumsum(sizes) - sizes)[empty], len(tokens))
        tokens, sizes = pa.concat_arrays([tokens, pa.array([NOTHING], pa.string())]).take(pa.array(at)), np.maximum(sizes, 1)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), tokens)


def bm25_stats(chunks: DataFrame, text: str = "text", epsilon: float = EPSILON) -> tuple[DataFrame, DataFrame]:
    """(terms: term, df, idf; corpus: one row n_docs, avgdl, mean_idf).  A negative idf becomes epsilon times the mean of all.

    A chunk counts once for each of its terms and once for all, so one pass gives both and only (term, count) is shuffled, counted within a task's batches first.
    """
    arrow_limits(chunks.sparkSession)
    most = TERMS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, total = [], 0, [0, 0]

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("term").aggregate([("df", "sum")]).rename_columns(["term", "df"])

        def given() -> Iterator[pa.RecordBatch]:
            for part in pa.concat_tables(held).combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(len(part), pa.int64())], names=["term", "df", "total"])

        for batch in batches:
            tokens = index_tokens(batch.column("lowered"))
            sizes, known = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64), tokens.flatten().dictionary_encode()
            pairs = pd.unique(known.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sizes) + np.repeat(np.arange(len(sizes)), sizes))
            df = np.bincount(pairs // max(1, len(sizes)), minlength=len(known.dictionary))
            held.append(pa.table({"term": known.dictionary, "df": pa.array(df, pa.int64())}))
            rows, total = rows + len(df), [total[0] + len(sizes), total[1] + int(sizes.sum())]
            if rows > most:
                held = [added()]
                if held[0].num_rows > most // 2:
                    yield from given()
                    held = []
                rows = sum(x.num_rows for x in held)
        if held:
            held = [added()]
            yield from given()
        yield pa.RecordBatch.from_arrays([pa.array([EVERY], pa.string()), pa.array(total[:1], pa.int64()), pa.array(total[1:], pa.int64())], names=["term", "df", "total"])

    each = chunks.select(lowered(F.col(text)).alias("lowered")).mapInArrow(counted, "term string, df long, total long")
    counts = stash(each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")), "terms")
    n_docs = F.coalesce(F.sum(F.when(F.col("term") == EVERY, F.col("df"))), F.lit(0))
    size = counts.agg(n_docs.alias("n_docs"), F.sum("total").alias("total")).select("n_docs", F.try_divide("total", "n_docs").alias("avgdl"))
    df = counts.where(F.col("term") != EVERY).select("term", "df")
    raw = df.crossJoin(F.broadcast(size)).select("term", "df", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    return terms, size.crossJoin(mean)


def bm25_topk(
    chunks: DataFrame, queries: DataFrame, k: int = 8, where: dict | None = None, key: str = "chunk_id", order: tuple[str, ...] = ("chunk_id",), query_key: str = "query_id", query: str = "query", k1: float = K1, b: float = B, epsilon: float = EPSILON
) -> DataFrame:
    """(query_key, key, order columns, score, rank from 0): scores over the whole corpus, filtered after scoring; ties, and chunks without a query term
    (score 0), in the corpus order given by `order`.

    Blocks of queries, as weights of their terms, are broadcast.  A chunk is scored in its own row against all of a block's queries by one
    product, and each task keeps k chunks for each query, so no pairs of query and chunk are ever rows.  Statistics and the queries' weights are worked out as this is
    called, as blocks are made of them; the scan of the chunks waits for an action.
    """
    terms, corpus = bm25_stats(chunks, epsilon=epsilon)
    asked = queries.select(query_key, F.explode(X.search_tokens(F.col(query))).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("times"))
    weights = asked.join(terms, "term").groupBy(query_key).agg(F.collect_list(F.struct("term", (F.col("times") * F.col("idf")).alias("w"))).alias("weights"))
    weights = stash(queries.select(query_key).distinct().join(weights, query_key, "left"), "weights")
    longest = weights.agg(F.max(F.size("weights"))).first()[0] or 0
    average = corpus.first()["avgdl"] or 1.0

    def asked_terms(rows: list) -> tuple[list, tuple]:
        found = sorted({x["term"] for r in rows for x in r["weights"] or []})
        place = {t: i for i, t in enumerate(found)}
        table = np.zeros((len(found), len(rows)))
        for i, r in enumerate(rows):
            for x in r["weights"] or []:
                table[place[x["term"]], i] = x["w"]
        return [r[query_key] for r in rows], (found, table)

    def passes() -> Iterator[list]:
        for blocks in topk.query_passes(weights, query_key, weight=1 + longest // 1000, together=PASS_BLOCKS):
            yield [asked_terms(rows) for rows in blocks]

    def scores(batch: pa.RecordBatch, block: tuple) -> np.ndarray:
        found, table = block
        tokens = index_tokens(batch.column("lowered"))
        length = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(length)), length)
        term = pc.index_in(tokens.flatten(), value_set=pa.array(found, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
        row, term = row[term >= 0], term[term >= 0].astype(np.int64)
        out = np.zeros((len(length), table.shape[1]))
        step = max(1, CELLS // max(1, len(found)))
        for at in range(0, len(length) if len(found) else 0, step):
            n, mine = min(step, len(length) - at), slice(*np.searchsorted(row, (at, at + step)))
            cells, tf = np.unique((row[mine] - at) * len(found) + term[mine], return_counts=True)
            weight = np.zeros(n * len(found))
            weight[cells] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[at + cells // len(found)] / average))
            out[at : at + n] = weight.reshape(n, len(found)) @ table
        return np.round(out, DIGITS) + 0.0

    eligible = chunks.where(metadata_filter(chunks, where)).select(key, *(c for c in order if c != key), lowered(F.col("text")).alias("lowered"))
    return topk.best(eligible, passes(), scores, k, queries.schema[query_key], key, order, "score")
