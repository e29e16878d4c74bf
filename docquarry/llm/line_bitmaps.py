"""Line dedup: range-partitioned line hashes, streamed in order, returned as compressed per-document keep bitmaps.

Line keys are hashed to 128 bits and only hashes, ids and positions are shuffled: range-partitioned and sorted by
(hash, doc_id descending).  A task streams its partition: the first document of a hash is the largest and keeps
its lines, later ones lose theirs once enough documents have been seen.  A hash of very many documents spans several
partitions; each partition reports the counts of its first and last hash (two rows per partition), from which
hashes that cross a boundary get their total.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import arrow_limits, fresh, pick, row_key, shared_dir, stash

BLANK = " \t\n\v\f\r"


def line_key(line: str) -> str:
    """The line without ASCII white space at both ends."""
    return line.strip(BLANK)


def line_hashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40) -> DataFrame:
    """(h1, h2, doc_id, rk, n_lines, positions): a row for each key of at least min_chars code points and row of docs."""
    arrow_limits(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, rk, body in zip(*(batch.column(i).to_pylist() for i in (0, 2, 1)), strict=True):
                lines = (body or "").split("\n")
                held: dict[int, list[int]] = {}
                for at, line in enumerate(lines):
                    key = line_key(line)
                    if len(key) >= min_chars:
                        held.setdefault(xxhash.xxh3_128_intdigest(key.encode().lower()), []).append(at)
                for h, at in held.items():
                    for into, x in zip(out, ((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), doc, rk, len(lines), at), strict=True):
                        into.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=["h1", "h2", "doc_id", "rk", "n_lines", "positions"]
            )

    schema = "h1 long, h2 long, doc_id long, rk long, n_lines long, positions array<int>"
    return pick(docs, doc_id, text).withColumn("rk", row_key("doc_id", "text")).mapInArrow(of, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the first and the last hash of a sorted partition: the number of distinct documents."""
    found: list[list] = []
    last = None
    for h1, h2, doc, *_ in _runs(batches):
        if not found or [h1, h2] != found[-1][:2]:
            found = [*found[:1], [h1, h2, 0]]
            last = found
        if last is found or doc != last:
            found[-1][2] += 1
        last = doc
    part = TaskContext.get().partitionId()
    rows = [pa.array([part] * len(found), pa.int64()), *(pa.array([x[i] for x in found], pa.int64()) for i in range(3))]
    yield pa.RecordBatch.from_arrays(rows, names=["part", "h1", "h2", "n_docs"])


def dropped_lines(hashes: DataFrame, min_docs: int = 5) -> DataFrame:
    """(doc_id, rk, n_lines, positions) of the lines to drop, from line_hashes()."""
    spark = hashes.sparkSession
    shared_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", F.col("doc_id").desc_nulls_last()]
    ordered = stash(hashes, "hashes").repartitionByRange(parts, *order).sortWithinPartitions(*order).checkpoint()
    # at most two rows for each partition, however many rows it has
    crossing: dict[tuple[int, int], list[int]] = {}
    for part, h1, h2, n in ordered.mapInArrow(_boundaries, "part long, h1 long, h2 long, n_docs long").collect():
        held = crossing.setdefault((h1, h2), [0, part, 0])
        crossing[h1, h2] = [held[0] + n, min(held[1], part), held[2] + 1]
    crossing = {k: v for k, v in crossing.items() if v[2] > 1}

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, keeper, doc, n, wait, out = TaskContext.get().partitionId(), None, False, None, 0, [], []

        def batch() -> pa.RecordBatch:
            kinds = {"doc_id": pa.int64(), "rk": pa.int64(), "n_lines": pa.int64(), "positions": pa.list_(pa.int32())}
            made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds.values())], names=list(kinds))
            out.clear()
            return made

        for h1, h2, this, *rest in _runs(batches):
            if key != (h1, h2):
                key, wait, n = (h1, h2), [], 0
                total, first, _ = crossing.get(key, (0, part, 0))
                keeper = first == part  # this partition holds the largest document of the hash
                fresh = True
            else:
                fresh = this != doc
            doc, n = this, n + fresh
            if keeper and n == 1:
                continue  # the largest document, with all its rows, keeps its lines
            if total >= min_docs or n >= min_docs:
                out.extend(wait)
                out.append((this, *rest))
                wait = []
            elif not total:
                wait.append((this, *rest))
            if len(out) > 4096:
                yield batch()
        yield batch()

    return ordered.mapInArrow(stream, "doc_id long, rk long, n_lines long, positions array<int>")


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, rk, n_lines, n_dropped, keep): zlib-compressed bits, 1 for each line kept, of the rows that lose lines.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys of at least min_chars code
    points in at least min_docs documents lose all their lines but those of the largest doc_id.  Rows that keep every line have
    no bitmap.  Null and empty texts are one empty line.  Rows that share a doc_id count as one document; rk
    (row_key of id and text) tells them apart.  A null doc_id is the smallest document.
    """
    lost = dropped_lines(line_hashes(docs, doc_id, text, min_chars), min_docs)
    rows = lost.groupBy("doc_id", "rk", "n_lines").agg(F.flatten(F.collect_set("positions")).alias("lost"))

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, gone = [], []
            for n, at in zip(batch.column("n_lines").to_pylist(), batch.column("lost").to_pylist(), strict=True):
                bits = np.ones(n, dtype=bool)
                bits[at] = False
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
                gone.append(n - int(bits.sum()))
            columns = [*batch.columns[:3], pa.array(gone, pa.int64()), pa.array(keep, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rk", "n_lines", "n_dropped", "keep"])

    return rows.mapInArrow(bitmaps, "doc_id long, rk long, n_lines long, n_dropped long, keep binary")


def kept_text(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    """(kept text, lines, lines dropped) by a bitmap of keep_bitmaps(), or none."""
    lines = (text or "").split("\n")
    if keep is None:
        return text or "", len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=len(lines))
    left = [line for line, bit in zip(lines, bits.tolist(), strict=True) if bit]
    return "\n".join(left), len(lines), len(lines) - len(left)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """(docs with one more column, its name): bitmaps joined by id and row key, nulls included.  Columns of docs keep their names and values, whatever these are."""
    keep, rk, other, own_id = fresh(docs, "__keep", "__rk", "__rk2", "__id")
    own = docs.withColumn(rk, F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string")))
    right = bitmaps.select(F.col("doc_id").alias(own_id), F.col("rk").alias(other), F.col("keep").alias(keep))
    on = (F.col(rk) == F.col(other)) & F.col(doc_id).cast("long").eqNullSafe(F.col(own_id))
    return own.join(right, on, "left").drop(rk, other, own_id), keep


def line_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row, with its bitmap applied."""
    joined, keep = with_bitmaps(pick(docs, doc_id, text), keep_bitmaps(docs, doc_id, text, min_chars, min_docs))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [kept_text(x, y) for x, y in zip(batch.column("text").to_pylist(), batch.column(keep).to_pylist(), strict=True)]
            columns = [
                batch.column("doc_id"),
                pa.array([x[1] for x in got], pa.int64()),
                pa.array([x[2] for x in got], pa.int64()),
                pa.array([sha256(x[0].encode()).hexdigest() for x in got], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined.select("doc_id", "text", keep).mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with the lines of keep_bitmaps() taken out of the text column; every row and every other column stays."""
    joined, keep = with_bitmaps(docs, keep_bitmaps(docs, doc_id, text, min_chars, min_docs), doc_id, text)
    names, place = docs.columns, docs.columns.index(text)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(text).to_pylist(), batch.column(keep).to_pylist(), strict=True)
            kept = pa.array([x if bits is None else kept_text(x, bits)[0] for x, bits in pairs], pa.string())
            columns = [*batch.columns[:place], kept, *batch.columns[place + 1 : -1]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select(*(F.col(f"`{c}`") for c in names), keep).mapInArrow(of, docs.schema)
