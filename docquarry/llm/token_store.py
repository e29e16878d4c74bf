"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Frequent ids get small ranks.  A block holds the ranks of consecutive documents, in ascending doc_id order: control bytes (two bits
for each rank: its bytes less one) apart from the data bytes (little-endian).  Blocks are rows of Parquet files in
shared storage, with the number of ids before them in their part; the ranks are a file of their own.  The reader decodes
a block by a table of 256 rows of four lengths and one gather.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.bpe_stream import byte_letters
from docquarry.llm.common import arrow_limits, pick, shared_dir, stash

#: Ids after which a block ends (with its document): a batch of blocks stays small beside a worker's memory.
BLOCK_IDS = 1 << 15
#: Known chunks of a generation of a worker's table; a full one becomes the older of two.
KNOWN = 400_000
#: Letters of the longest chunk that is remembered.
LONGEST = 64
#: UTF-8 bytes of code points below U+0240.
LOW_BYTES = bytes(range(0xC9))
#: Letters, then ASCII marks (the apostrophe starts pre-tokens of its own).
MARKED = re.compile(r"(.*[^\W\d_])([!-&(-/:-@\[-`{-~]+)", re.DOTALL)
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    padded[: len(values)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values of pack(): lengths by table lookup, places by a running sum, bytes by a gather."""
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:count]
    at = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    if not count:
        return np.zeros(0, dtype=np.uint32)
    return (raw[at] | raw[at + 1] << 8 | raw[at + 2] << 16 | raw[at + 3] << 24) & _MASKS[lengths]


class Chunks(dict):
    """Ids of blank-separated chunks; unknown ones are looked up in the generation before, else asked of the library."""

    def __init__(self, ask: Callable[[str], bytes], older: dict[str, bytes] | None = None) -> None:
        super().__init__()
        self.ask, self.older = ask, older or {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.ask(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids

    def aged(self) -> Chunks:
        """This table, or where it's full an empty one that remembers it."""
        if len(self) < KNOWN:
            return self
        self.older = {}
        return Chunks(self.ask, self)


class Encoder:
    """Ids by the tokenizers library, asked once for each distinct blank-separated chunk (no pre-token spans white space).

    The file's normaliser is NFC, one blank for white space, lower case.  A lower-cased run of letters below U+0240 is one pre-token that
    normalising leaves as it is, so the library's model is asked directly; such a run and ASCII marks behind it are two pre-tokens.  Any
    other chunk, and all chunks of texts with other letters, go through the whole library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            self.special = [x["content"].lower() for x in json.load(file).get("added_tokens", [])]
        letters = {b: c for c, b in byte_letters().items()}
        self.letters = [letters[b] for b in range(256)]
        self.low, self.raw = Chunks(self.chunk), Chunks(self.library)

    def library(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """Ids of a lower-cased chunk of is_low() letters without an added token."""
        if chunk.isalpha():
            spelt = chunk if chunk.isascii() else "".join([self.letters[b] for b in chunk.encode()])
            return array("I", [x.id for x in self.model.tokenize(spelt)]).tobytes()
        cut = MARKED.fullmatch(chunk)
        return self.low[cut[1]] + self.low[cut[2]] if cut else self.library(chunk)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = (text or "").replace("\n", " ")
        if is_low(text):
            low = text.lower()
            # an added token is sought before lower-casing: only its own spelling counts
            if not any(x in low for x in self.special):
                self.low = self.low.aged()
                return b"".join(map(self.low.__getitem__, low.split(" ")))
        self.raw = self.raw.aged()
        return b"".join(map(self.raw.__getitem__, text.split(" ")))


def is_low(text: str) -> bool:
    """Code points below U+0240 only, each with a lower case of one letter that NFC leaves alone."""
    return text.isascii() or (not text.encode().translate(None, LOW_BYTES) and "\u0130" not in text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process: its table of known chunks serves later tasks too."""
    return Encoder(path)


def tokens(docs: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): 16-bit little-endian ids where the vocabulary allows, else 32-bit, the end id last."""
    arrow_limits(docs.sparkSession)
    kind = id_kind(path)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path)
        for batch in batches:
            got = [np.append(np.frombuffer(x, dtype="<u4"), end_id).astype(kind).tobytes() for x in map(library.encode, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.binary())], names=["doc_id", "ids"])

    return pick(docs, doc_id, text).mapInArrow(of, "doc_id long, ids binary")


def id_kind(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def write_store(docs: DataFrame, path: str, into: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes `into`/ranks and `into`/blocks.

    Rows are in ascending doc_id order (nulls first; equal ids by their tokens).  Null texts hold the end id alone.  The driver sees a
    count per vocabulary entry and nothing per document.
    """
    spark = docs.sparkSession
    kind = id_kind(path)
    held = stash(tokens(docs, path, end_id, doc_id, text), "tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for x in batch.column("ids").to_pylist():
                got = np.bincount(np.frombuffer(x, dtype=kind), minlength=len(total))
                got[: len(total)] += total
                total = got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    counts = held.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = [r[0] for r in counts.orderBy(F.desc("n"), "id").select("id").collect()]  # at most the vocabulary
    spark.createDataFrame([(i, x) for i, x in enumerate(ranked)], "rank long, id long").coalesce(1).write.parquet(f"{into}/ranks")
    rank_of = np.zeros(max(ranked, default=0) + 1, dtype=np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)
    schema = "part int, seq int, before long, n_ids long, doc_ids array<long>, sizes array<int>, control binary, data binary"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before, docs_, bodies, n = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def block() -> pa.RecordBatch:
            control, data = pack(shared.value[np.concatenate(bodies)])
            values = (part, seq, before, n, docs_, [len(x) for x in bodies], control, data)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs_.append(doc)
                bodies.append(np.frombuffer(ids, dtype=kind))
                n += len(bodies[-1])
                if n >= BLOCK_IDS:
                    yield block()
                    seq, before, docs_, bodies, n = seq + 1, before + n, [], [], 0
        if docs_:
            yield block()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = held.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(blocks, schema).write.parquet(f"{into}/blocks")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): each document's ids as 32-bit little-endian integers and the number of ids before it, from the files alone."""
    blocks = spark.read.parquet(f"{path}/blocks")
    base, total = {}, 0
    for part, n in sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect()):  # a row per part
        base[part], total = total, total + n
    ranked = np.array([r[0] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").collect()], dtype="<u4")
    shared = spark.sparkContext.broadcast((base, ranked))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ranked = shared.value
            for part, before, n, docs, sizes, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = ranked[unpack(control, data, n)]
                ends = np.cumsum(sizes)
                start = starts[part] + before + ends - sizes
                bodies = [ids[b - s : b].tobytes() for b, s in zip(ends.tolist(), sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start, pa.int64()), pa.array(bodies, pa.binary())], names=["doc_id", "start", "ids"])

    few = blocks.select("part", "before", "n_ids", "doc_ids", "sizes", "control", "data")
    return few.mapInArrow(of, "doc_id long, start long, ids binary")


def token_digest(docs: DataFrame, path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row, from the files that write_store() wrote; no row of an empty table.

    Null and empty texts hold the end id alone; repeated rows count one by one.
    """
    spark = docs.sparkSession
    into = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_store(docs, path, into, end_id, doc_id, text)
    return read_store(spark, into).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))

