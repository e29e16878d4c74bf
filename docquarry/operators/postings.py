"""A stored inverted index for BM25: segments of chunks in corpus order, block postings with score bounds, pruned search.

A segment's postings of a term are cut into blocks of BLOCK; a block has delta-coded, bit-packed document numbers and counts, and the largest factor that a
chunk of it can have in a score.  A search reads the blocks of the questions' terms alone, never a text.  In each segment terms are taken from the largest bound
down: once the k-th best partial score is above what the remaining terms can still add, only chunks that have been met can win, and only blocks
that hold one of them and could lift it over that score are unpacked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from docquarry.functions import exprs as X
from docquarry.operators import topk
from docquarry.operators.keyword import B, DIGITS, EPSILON, K1, bm25_stats, bm25_topk, index_tokens, lowered
from docquarry.operators.search import metadata_filter
from docquarry.sources.shared import stash

#: Chunks of a segment at most, postings of a block, terms that are sought by a list of values (more by a join), and what rounding may move a score by.
SEGMENT, BLOCK, LISTED, MARGIN = 16384, 128, 2000, 2e-6


@dataclass
class Postings:
    """docs: segment, doc, key, order columns; lengths: segment, lengths; blocks: term, segment, block, first, last, n, best, docs, tfs; terms and corpus as bm25_stats() gives them."""

    docs: DataFrame
    lengths: DataFrame
    blocks: DataFrame
    terms: DataFrame
    corpus: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f"postings_{x.name}": getattr(self, x.name) for x in fields(self)}

    @classmethod
    def of_tables(cls, tables: dict[str, DataFrame]) -> Postings:
        return cls(**{x.name: tables[f"postings_{x.name}"] for x in fields(cls)})


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as many bits each as the largest needs; the first byte is that width."""
    width = int(values.max(initial=0)).bit_length()
    if not width:
        return b""
    bits = (values[:, None] >> np.arange(width)) & 1
    return bytes([width]) + np.packbits(bits.astype(np.uint8)).tobytes()


def unpack(raw: bytes, n: int) -> np.ndarray:
    if not raw:
        return np.zeros(n, dtype=np.int64)
    width = raw[0]
    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, offset=1), count=n * width).reshape(n, width)
    return bits.astype(np.int64) @ (1 << np.arange(width))


def factor(tf: np.ndarray, norm: np.ndarray, k1: float) -> np.ndarray:
    return tf * (k1 + 1) / (tf + norm)


def invert(tokens: pa.ListArray, average: float, k1: float, b: float) -> tuple[np.ndarray, list[tuple]]:
    """(length of each chunk, blocks as (term, block, first, last, n, best, docs, tfs) by term)."""
    length = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    known = tokens.flatten().dictionary_encode()
    order = np.argsort(np.array(known.dictionary.to_pylist(), dtype=object), kind="stable") if len(known.dictionary) else np.zeros(0, np.int64)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order))
    pairs, tf = np.unique(number[known.indices.to_numpy(zero_copy_only=False)] << 32 | np.repeat(np.arange(len(length)), length), return_counts=True)
    if not len(pairs):
        return length, []
    term, doc = pairs >> 32, pairs & 0xFFFFFFFF
    heads = np.flatnonzero(np.diff(term, prepend=-1))
    within = np.arange(len(term)) - np.repeat(heads, np.diff(np.append(heads, len(term))))
    starts = np.flatnonzero(within % BLOCK == 0)
    stops = np.append(starts[1:], len(term))
    best = np.maximum.reduceat(factor(tf, k1 * (1 - b + b * length[doc] / average), k1), starts)
    tops = np.maximum.reduceat(tf, starts).tolist()  # most blocks are of a rare term, once in each chunk: nothing to pack
    gaps, names = np.diff(doc, prepend=0) - 1, known.dictionary.take(pa.array(order)).to_pylist()
    out = []
    for i, (a, z) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
        packed = pack(gaps[a + 1 : z]) if z - a > 1 else b""
        out.append((names[term[a]], int(within[a]) // BLOCK, int(doc[a]), int(doc[z - 1]), z - a, float(best[i]), packed, pack(tf[a:z] - 1) if tops[i] > 1 else b""))
    return length, out


def build(chunks: DataFrame, key: str = "chunk_id", order: tuple[str, ...] = ("chunk_id",), text: str = "text", k1: float = K1, b: float = B, epsilon: float = EPSILON, segment: int = 0) -> Postings:
    """The index of all chunks.  Two passes over the texts (statistics, then postings); what is shuffled is texts by corpus order and packed blocks by term."""
    segment = segment or SEGMENT
    terms, corpus = (stash(x, "statistics") for x in bm25_stats(chunks, text, epsilon))
    row = corpus.first()
    average, n = row["avgdl"] or 1.0, row["n_docs"] or 0
    kept = [key, *(c for c in order if c != key)]
    rows = chunks.select(*kept, lowered(F.col(text)).alias("_lowered"))
    # a range of the corpus order for each task, about a segment
    rows = rows.repartitionByRange(max(1, -(-n // segment)), *(F.col(c).asc_nulls_first() for c in order)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in order))
    own = [chunks.schema[c] for c in kept]
    block = "kind string, segment long, doc int, lengths binary, term string, block int, first int, last int, n int, best double, docs binary, tfs binary"
    schema = StructType([*own, *StructType.fromDDL(block).fields])
    arrow = pa.schema(_arrow(x) for x in schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0

        def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            length, found = invert(index_tokens(whole.column("_lowered").combine_chunks()), average, k1, b)
            at = part << 20 | number
            yield _rows(arrow, len(length), {**{c: whole.column(c).combine_chunks() for c in kept}, "kind": ["doc"] * len(length), "segment": [at] * len(length), "doc": np.arange(len(length), dtype=np.int32)})
            yield _rows(arrow, 1, {"kind": ["lengths"], "segment": [at], "lengths": [length.astype("<i4").tobytes()]})
            for i in range(0, len(found), 4096):
                some = list(zip(*found[i : i + 4096], strict=True))
                yield _rows(arrow, len(some[0]), dict(zip(("term", "block", "first", "last", "n", "best", "docs", "tfs"), some, strict=True)) | {"kind": ["block"] * len(some[0]), "segment": [at] * len(some[0])})

        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = segment - sum(x.num_rows for x in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(x.num_rows for x in held) == segment:
                    yield from made(held)
                    held, number = [], number + 1
        if held:
            yield from made(held)

    found = stash(rows.mapInArrow(of, schema), "postings")

    def of_kind(kind: str, *columns: str) -> DataFrame:
        return found.where(F.col("kind") == kind).select(*(F.col(c).alias(c) for c in columns))  # columns of its own: the three are joined later

    blocks = of_kind("block", "term", "segment", "block", "first", "last", "n", "best", "docs", "tfs")
    return Postings(of_kind("doc", "segment", "doc", *kept), of_kind("lengths", "segment", "lengths"), blocks, terms, corpus)


def _arrow(field: StructField) -> pa.Field:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.field(field.name, to_arrow_type(field.dataType))


def _rows(schema: pa.Schema, n: int, given: dict) -> pa.RecordBatch:
    columns = [given[f.name].cast(f.type) if isinstance(given.get(f.name), pa.Array) else pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def sorted_for_terms(index: Postings) -> Postings:
    """The index with blocks in the order of their terms, as they are stored: a term's blocks lie in few files and row groups, a very frequent one's in many."""
    blocks = index.blocks.repartitionByRange("term", "segment").sortWithinPartitions("term", "segment", "block")
    return Postings(index.docs, index.lengths, blocks, index.terms, index.corpus)


class Blocks:
    """A term's blocks in one segment."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.first, self.last, self.n, self.best = (rows[c].to_numpy() for c in ("first", "last", "n", "best"))
        self.docs, self.tfs, self.most = rows["docs"].tolist(), rows["tfs"].tolist(), float(rows["best"].max())
        self.held: dict[int, tuple] = {}

    def unpacked(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, counts) of a block, unpacked once for all questions."""
        if i not in self.held:
            n = int(self.n[i])
            docs = np.cumsum(np.append(self.first[i], unpack(self.docs[i], n - 1) + 1))
            self.held[i] = docs, unpack(self.tfs[i], n) + 1
        return self.held[i]


def pruned_topk(asked: list[tuple[float, Blocks]], norm: np.ndarray, k: int, k1: float, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of one segment's k best with a score above 0: highest first, then by number.  asked: positive weights with their terms' blocks."""
    asked = sorted(asked, key=lambda x: -x[0] * x[1].most)
    rest = np.append(np.cumsum([w * x.most for w, x in asked][::-1])[::-1], 0.0)  # what the terms from here on can add
    score, met, edge = np.zeros(len(norm)), np.zeros(0, dtype=np.int64), 0.0
    closed = False  # whether only documents that were met can win
    for i, (w, blocks) in enumerate(asked):
        closed = closed or edge > rest[i] + MARGIN
        if not closed:
            parts = [blocks.unpacked(j) for j in range(len(blocks.n))]
            docs, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
            if allowed is not None:
                docs, tf = docs[allowed[docs]], tf[allowed[docs]]
            score[docs] += w * factor(tf, norm[docs], k1)
            met = np.union1d(met, docs)
        else:
            met = met[score[met] + rest[i] >= edge - MARGIN]
            at = np.searchsorted(blocks.last, met)
            inside = at < len(blocks.last)
            inside[inside] = blocks.first[at[inside]] <= met[inside]
            mine, at = met[inside], at[inside]
            can = score[mine] + w * blocks.best[at] + rest[i + 1] >= edge - MARGIN
            for j in np.unique(at[can]).tolist():
                docs, tf = blocks.unpacked(j)
                own = mine[can & (at == j)]
                place = np.searchsorted(docs, own)
                hit = docs[np.minimum(place, len(docs) - 1)] == own
                own, place = own[hit], place[hit]
                score[own] += w * factor(tf[place], norm[own], k1)
        if len(met) >= k:
            edge = float(np.partition(score[met], len(met) - k)[len(met) - k])
    value = np.round(score[met], DIGITS)
    order = np.lexsort((met, -value))[:k]
    order = order[value[order] > 0]
    return met[order], value[order]


def search(index: Postings, queries: DataFrame, k: int = 8, where: dict | None = None, chunks: DataFrame | None = None, key: str = "chunk_id", order: tuple[str, ...] = ("chunk_id",), query_key: str = "query_id", query: str = "query", k1: float = K1, b: float = B) -> DataFrame:
    """The rows of bm25_topk() over the same chunks, from the index: (query_key, key, order columns, score, rank from 0).

    chunks is read only for a filter's columns, and as a whole where the mean idf is negative (most terms in most chunks: then bounds say nothing).
    """
    spark, corpus = queries.sparkSession, index.corpus.first()
    if (corpus["mean_idf"] or 0.0) < 0:
        if chunks is None:
            raise ValueError("scores of this corpus can be negative: the chunks are needed")
        return bm25_topk(chunks, queries, k, where, key, order, query_key, query, k1, b)
    average, kind = corpus["avgdl"] or 1.0, queries.schema[query_key]
    kept = [key, *(c for c in order if c != key)]
    docs = index.docs
    if where:
        if chunks is None:
            raise ValueError("a filter needs the chunks' columns")
        docs = docs.join(chunks.where(metadata_filter(chunks, where)).select(key), key, "left_semi")
    asked = queries.select(query_key, F.explode(X.search_tokens(F.col(query))).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("times"))
    weights = asked.join(index.terms, "term").groupBy(query_key).agg(F.collect_list(F.struct("term", (F.col("times") * F.col("idf")).alias("w"))).alias("weights"))
    weights = stash(queries.select(query_key).distinct().join(weights, query_key, "left"), "weights")
    lengths = index.lengths
    if where:  # a segment's chunks that the filter lets through
        lengths = lengths.join(docs.groupBy("segment").agg(F.collect_list("doc").alias("allowed")), "segment")
    found = None
    for blocks in topk.query_passes(weights, query_key):
        part = _pass(index, lengths, [r for rows in blocks for r in rows], k, query_key, kind, k1, b, average, bool(where))
        found = part if found is None else found.unionByName(part)
    held = stash(found.join(docs.select("segment", "doc", *kept), ["segment", "doc"]).select(query_key, *kept, "score"), "found")
    # questions with fewer than k chunks of a score: those of none follow in corpus order, and 2 k of them are enough to choose from
    first = docs.select(*kept).orderBy(*(F.col(c).asc_nulls_first() for c in order)).limit(2 * k).collect()
    short = weights.select(query_key).join(held.groupBy(query_key).count().where(F.col("count") >= k), query_key, "left_anti")
    if first:
        each = F.array(*(F.struct(*(F.lit(r[c]).cast(f.dataType).alias(c) for c, f in zip(kept, docs.select(*kept).schema, strict=True))) for r in first))
        zero = short.select(query_key, F.explode(each).alias("_x")).select(query_key, "_x.*")
        held = held.unionByName(zero.join(held.select(query_key, key), [query_key, key], "left_anti").withColumn("score", F.lit(0.0)))
    return topk.ranked(held, query_key, "score", k, order).select(query_key, *kept, "score", "rank")


def _pass(index: Postings, lengths: DataFrame, asked: list, k: int, query_key: str, kind: StructField, k1: float, b: float, average: float, filtered: bool) -> DataFrame:
    """(query_key, segment, doc, score): the k best of each question and segment."""
    spark = index.blocks.sparkSession
    shared = spark.sparkContext.broadcast(([r[query_key] for r in asked], [[(x["term"], x["w"]) for x in r["weights"] or [] if x["w"] > 0] for r in asked]))
    terms = sorted({t for ts in shared.value[1] for t, _ in ts})
    if len(terms) <= LISTED:
        wanted = index.blocks.where(F.col("term").isin(terms))
    else:
        wanted = index.blocks.join(spark.createDataFrame([(t,) for t in terms], "term string"), "term", "left_semi")
    schema = StructType([kind, *StructType.fromDDL("segment long, doc int, score double").fields])

    def of(rows: pd.DataFrame, sizes: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(sizes):
            length = np.frombuffer(sizes["lengths"].iloc[0], dtype="<i4")
            norm, allowed = k1 * (1 - b + b * length / average), None
            if filtered:
                allowed = np.zeros(len(length), dtype=bool)
                allowed[np.asarray(sizes["allowed"].iloc[0])] = True
            held = {t: Blocks(x) for t, x in rows.sort_values("block").groupby("term")}
            for name, weights in zip(*shared.value, strict=True):
                mine = [(w, held[t]) for t, w in weights if t in held]
                if mine:
                    docs, scores = pruned_topk(mine, norm, k, k1, allowed)
                    out += zip([name] * len(docs), [int(rows["segment"].iloc[0])] * len(docs), docs.tolist(), scores.tolist(), strict=True)
        return pd.DataFrame(out, columns=schema.names)

    return wanted.groupBy("segment").cogroup(lengths.groupBy("segment")).applyInPandas(of, schema)
