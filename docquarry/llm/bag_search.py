"""Ranked lexical search by bag deduplication.

Documents are restricted to the vocabulary of the items that are asked for: what remains of one are its length factor m and the counts of those
words.  Documents that agree in both have the same score for every item, so they are one class: a hash deals them out, and equality of
m and all counts makes the class.  Each class is scored once against a block of items; the members of the best ones are listed by ascending doc_id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from docquarry.llm.common import arrow_limits, drop_stash, pick, stash

#: Bytes outside a term become blanks, A-Z become a-z; all bytes of other characters belong to terms.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of a text that are cut into terms at a time; terms of a block of items, about; cells of a table of terms by classes.
PIECE, BLOCK_TERMS, CELLS = 1 << 20, 1 << 18, 1 << 21


def terms(text: str | None) -> Iterator[list[bytes]]:
    """A text's terms in order, a list for each piece of it; none for null."""
    flat = (text or "").encode().translate(_TABLE)
    at = 0
    while at < len(flat):
        stop = flat.find(b" ", at + PIECE)
        stop = len(flat) if stop < 0 else stop
        yield flat[at:stop].split()
        at = stop


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _blocks(items: DataFrame, item_id: str, text: str, block_terms: int) -> Iterator[list[tuple]]:
    """The items as (id, sorted terms), in blocks of about block_terms terms by a hash of the id; rows that share an id are one item."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({t.decode() for piece in terms(x) for t in piece}) for x in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(found, pa.list_(pa.string()))], names=["i", "terms"])

    rows = items.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).where("i is not null")
    held = stash(rows.mapInArrow(of, StructType([StructField("i", items.schema[item_id].dataType), StructField("terms", ArrayType(StringType()))])), "items")
    blocks = max(1, -(-(held.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    for b in range(blocks):
        block: dict = {}
        for i, found in held.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect():
            block.setdefault(i, set()).update(found)
        if block:
            yield [(i, sorted(block[i])) for i in sorted(block)]
    drop_stash(held)


def bags(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, ids, tfs): all terms of a document with repeats, and the counts of those in the vocabulary by ascending number."""
    arrow_limits(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for batch in batches:
            sizes, ids, tfs, ends = [], [], [], [0]
            for body in batch.column("text").to_pylist():
                n, counts = 0, Counter()
                for piece in terms(body):
                    n += len(piece)
                    counts.update(map(known, piece))
                counts.pop(None, None)
                mine = sorted(counts)
                sizes.append(n)
                ids += mine
                tfs += [counts[i] for i in mine]
                ends.append(len(ids))
            offsets = pa.array(ends, pa.int32())
            lists = (pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ids, tfs))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "ids", "tfs"])

    return pick(docs, doc_id, text).mapInArrow(of, "doc_id long, n long, ids array<int>, tfs array<int>")


def bag_classes(held: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(m, ids, tfs, docs): classes of bags with a term of the vocabulary; docs: their k smallest doc_ids, ascending, nulls last.

    The hash deals classes out; all of m, ids and tfs tell them apart, so classes whose hashes meet stay two.  A task passes on k rows of a class at most.
    """
    m = F.lit(100 - 90) + F.expr(f"(90L * n * {n_docs}L) div {max(1, n_terms)}L")
    own = held.where(F.size("ids") > 0).select("doc_id", m.cast("long").alias("m"), "ids", "tfs")
    key = ["h", "m", "ids", "tfs"]
    own = own.withColumn("h", F.xxhash64("m", "ids", "tfs"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("doc_id").asc_nulls_last()))
    # array_agg() would leave nulls out
    few = own.withColumn("place", place).where(F.col("place") <= k).groupBy(*key).agg(F.collect_list(F.struct("place", "doc_id")).alias("x"))
    return few.select("m", "ids", "tfs", F.transform(F.array_sort("x"), lambda x: x["doc_id"]).alias("docs"))


def class_scores(m: np.ndarray, row: np.ndarray, ids: np.ndarray, tfs: np.ndarray, weights: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Scores by item and class: flat has the items' terms one after the other, starts where each item's begin (each has one at least)."""
    table = np.zeros((len(weights), len(m)), dtype=np.int64)
    table[ids, row] = weights[ids] * ((1000000000 * tfs) // (1000 * tfs + 8 * m[row]))
    return np.add.reduceat(table[flat], starts, axis=0)


class _Best:
    """The k best classes of each item so far: highest score first, then the smallest doc_id."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.floor, self.docs = k, np.ones(items, dtype=np.int64), []
        self.item, self.score, self.first, self.which = (np.zeros(0, dtype=np.int64) for _ in range(4))

    def add(self, scores: np.ndarray, first: np.ndarray, docs: list) -> None:
        item, at = np.nonzero(scores >= self.floor[:, None])
        used, which = np.unique(at, return_inverse=True)
        mine = [np.concatenate(x) for x in ((self.item, item), (self.score, scores[item, at]), (self.first, first[at]), (self.which, which + len(self.docs)))]
        self.docs += [docs[i] for i in used.tolist()]
        order = np.lexsort((mine[2], -mine[1], mine[0]))
        item, score, first, which = (x[order] for x in mine)
        begins = np.flatnonzero(np.diff(item, prepend=-1))
        place = np.arange(len(item)) - np.repeat(begins, np.diff(np.append(begins, len(item))))
        last = place == self.k - 1
        self.floor[item[last]] = score[last]
        self.item, self.score, self.first, which = (x[place < self.k] for x in (item, score, first, which))
        used, self.which = np.unique(which, return_inverse=True)
        self.docs = [self.docs[i] for i in used.tolist()]


def _score(classes: DataFrame, shared, kind: StructField, k: int) -> DataFrame:
    """(item_id, score, docs): the k best classes of each item and task."""
    schema = StructType([kind, StructField("score", LongType()), StructField("docs", ArrayType(LongType()))])
    arrow = to_arrow_type(kind.dataType)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, flat, starts = shared.value
        best, step = _Best(len(names), k), max(1, CELLS // max(len(weights), len(flat)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                lists = [batch.column(c) for c in ("ids", "tfs")]
                sizes = np.diff(lists[0].offsets.to_numpy())
                ids, tfs = (x.flatten().to_numpy().astype(np.int64) for x in lists)
                docs = batch.column("docs").to_pylist()
                first = np.array([x[0] if x[0] is not None else 2**63 - 1 for x in docs], dtype=np.int64)
                best.add(class_scores(batch.column("m").to_numpy(), np.repeat(np.arange(batch.num_rows), sizes), ids, tfs, weights, flat, starts), first, docs)
        columns = [pa.array([names[i] for i in best.item.tolist()], arrow), pa.array(best.score, pa.int64()), pa.array([best.docs[i] for i in best.which.tolist()], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return classes.mapInArrow(of, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank from 1, doc_id, score): each item's k documents of the highest score above 0, equal scores by ascending doc_id.

    Null and empty texts have no terms; items without a term, or whose terms no document holds, have no rows, and items of a null id are ignored.  Rows that share an
    item_id are one item with the terms of all.  Repeated rows of docs are documents of their own; a null doc_id comes last.  An empty table gives
    no row; further columns are ignored.  Items are a stated set: blocks of about block_terms terms are asked one after the other, each in passes over all rows.
    """
    kind = StructField("item_id", items.schema[item_id].dataType)
    found = None
    for block in _blocks(items, item_id, item_text, block_terms):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, found_ in block for t in found_}))}
        asked = [(i, [vocabulary[t] for t in ts]) for i, ts in block if ts]
        if not asked:
            continue
        held = stash(bags(docs, {t.encode(): i for t, i in vocabulary.items()}, doc_id, text), "bags")
        n_docs, n_terms = held.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        weights = np.zeros(len(vocabulary), dtype=np.int64)
        for i, df in held.select(F.explode("ids").alias("i")).groupBy("i").count().collect():  # a row per term of the block
            weights[i] = weight(n_docs, df)
        starts = np.cumsum([0, *(len(ts) for _, ts in asked)])[:-1]
        shared = docs.sparkSession.sparkContext.broadcast(([i for i, _ in asked], weights, np.array([t for _, ts in asked for t in ts]), starts))
        part = stash(_score(bag_classes(held, n_docs, n_terms or 0, k), shared, kind, k), "scored")
        drop_stash(held)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], StructType([kind, StructField("score", LongType()), StructField("docs", ArrayType(LongType()))]))
    # k documents lie in the k best classes, as each class has a first document; only these are listed
    best = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.get("docs", F.lit(0)).asc_nulls_last()))
    each = found.withColumn("best", best).where(F.col("best") <= k).select("item_id", "score", F.explode("docs").alias("doc_id"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
