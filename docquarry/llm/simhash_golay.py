"""SimHash near-duplicates: Golay-code fuzzy hashing of fingerprint segments.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  Two fingerprints with at most two differing
bits have, by pigeonhole, one segment i without any error, and the segment after it (cyclically) has two errors
at most.  A 23-bit word decodes to the codewords of the perfect binary Golay code near it: the one within
distance 2, else the one at distance 3 and the five at distance 4.  Words within two bits of each other always
share one of those codewords (tests check every coset and error pattern), so the keys (i, exact segment i, codeword
index of the next segment) find every link; candidates are then verified by popcount.

Keys of many fingerprints (a large group of near copies) would give all pairs of the group.  Their fingerprints
get another exact way, linear in their number: two words differ in two bits or fewer exactly if some word z is within
one bit of both, so each of them names its 65 words z, and all that share a z link to the smallest of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import arrow_limits, fresh, pick, row_key, stash
from docquarry.llm.components import connected_components

#: Generator polynomial of the (23,12,7) code: x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
#: Segments of a fingerprint: lowest bit and width.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Keys of more fingerprints than this take the linear way through shared words z.
PAIRS_UP_TO = 48
#: Shingles hashed at a time; bounds the memory of a very long text.
BLOCK = 1 << 15


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each 12-bit upper part, error patterns to nearby codewords by syndrome, six wide, repeats as filler)."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    upper = np.array([remainder(x << 11) for x in range(4096)], dtype=np.int64)
    one = [remainder(1 << b) for b in range(23)]
    near: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= one[b]
            held = near[syndrome]
            if weight < 4 or held[0].bit_count() == 3:
                held.append(sum(1 << b for b in bits))
    return upper, np.array([(x * 6)[:6] for x in near], dtype=np.int64)


def codeword_indices(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For 23-bit words, the 12-bit indices of their nearby codewords, six columns with repeats."""
    upper, near = tables
    syndrome = upper[words >> 11] ^ (words & 2047)
    return (words[:, None] ^ near[syndrome]) >> 11


def golay_keys(fingerprints: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of unsigned fingerprints, each key of a row once."""
    parts = [((fingerprints >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        index = np.sort(codeword_indices(parts[(i + 1) % 3], tables), axis=1)
        key = (i << 40) | (parts[i][:, None] << 12) | index
        fresh = np.ones(index.shape, dtype=bool)
        fresh[:, 1:] = index[:, 1:] != index[:, :-1]
        row, col = np.nonzero(fresh)
        rows.append(row)
        keys.append(key[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of word shingles (A-Z lower-cased, XXH64 with seed 42): a bit is set if it is in over half of the hashes."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    stops = ends[min(width, len(words)) - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : min(at + BLOCK, n)].tolist(), stops[at : min(at + BLOCK, n)].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed 64-bit integer; null and blank texts have fingerprint 0."""
    arrow_limits(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(x, width) for x in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return pick(docs, doc_id, text).mapInArrow(of, "doc_id long, fp long")


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints (column fp, each once) that have the same closure as all pairs within two bits."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            row, key = golay_keys(fp.view(np.uint64), tables)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    keys = fps.select("fp").mapInArrow(keyed, "key long, fp long")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stash(keys.join(sizes, "key"), "keys")
    few = shared.where(F.col("n") <= PAIRS_UP_TO).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = (
        few.select("fps", F.explode("fps").alias("a"))
        .select("a", F.explode(F.expr("filter(fps, x -> x > a and bit_count(x ^ a) <= 2)")).alias("b"))
        .distinct()
    )
    many = shared.where(F.col("n") > PAIRS_UP_TO).select("fp").distinct()
    flips = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    words = many.select("fp", F.explode(flips).alias("z"))
    least = words.groupBy("z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("z", "a")
    stars = words.join(least, "z").where("fp > a").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per row of docs.

    component_id is the smallest doc_id reachable over links of two or fewer differing bits, itself included.
    Null or blank texts have fingerprint zero and link to each other; rows with equal fingerprints are one group
    (counted before any join); a null doc_id takes part and is never the smallest unless alone.
    """
    own = stash(fingerprints(docs, doc_id, text, width), "fingerprints")
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected_components(fingerprint_links(fps), "a", "b").withColumnRenamed("node", "fp")
    rooted = fps.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stash(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(ids, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """The rows of docs whose id is the smallest of its component; of rows equal in id and text one stays."""
    near = near_duplicates(docs, doc_id, text, width)
    own_id, rk = fresh(docs, "__id", "__rk")
    kept = stash(near.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(own_id)).distinct(), "kept")
    own = docs.withColumn(rk, row_key(doc_id, text)).join(kept.hint("merge"), F.col(doc_id).cast("long").eqNullSafe(F.col(own_id)), "left_semi")
    # only rows with an equal one are dealt by their key: written down, so that their number is known before texts would move
    again = stash(docs.select(row_key(doc_id, text).alias(rk)).groupBy(rk).count().where("count > 1").select(rk), "again")
    return own.join(again, rk, "left_anti").unionByName(own.join(again, rk, "left_semi").dropDuplicates([doc_id, rk])).drop(rk)
