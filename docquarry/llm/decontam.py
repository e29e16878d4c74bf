"""Benchmark decontamination: one Aho-Corasick automaton over normalised questions and answers.

Each item gives windows of consecutive words; the automaton holds every distinct window once, and each text is scanned
once.  Matches come back as word ranges and, through the words' places, as offsets in the original text.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import arrow_limits, pick, stash

#: Words of a text in its own case: all ASCII but letters and digits separates; other characters don't.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Characters of windows that one automaton takes, about; larger benchmarks are scanned for in several passes.
PASS_CHARS = 32_000_000


def normalise(text: str | None) -> str:
    """Words lower-cased in A-Z, with one blank before, between and after; '' without words."""
    words = text.encode().translate(_TABLE).split() if text else []
    # bytes.split() also cuts at no other byte: the table leaves no further ASCII white space
    return f" {b' '.join(words).decode()} " if words else ""


def windows(text: str | None, width: int = 10) -> list[str]:
    """The windows of an item; an item with fewer words than width is one window, one without words has none."""
    words = normalise(text).split(" ")[1:-1]
    return [f" {' '.join(words[i : i + width])} " for i in range(max(1, len(words) - width + 1))] if words else []


def automaton(patterns: dict[str, tuple[int, ...]]) -> ahocorasick.Automaton | None:
    """patterns: windows with the places of the items that have them."""
    if not patterns:
        return None
    made = ahocorasick.Automaton()
    for window, items in patterns.items():
        made.add_word(window, (len(window), items))
    made.make_automaton()
    return made


def scan(text: str | None, machine: ahocorasick.Automaton | None) -> tuple[int, list[tuple[int, int]], set[int]]:
    """(words, merged ranges of hit words, items): every occurrence of every window counts, overlaps included."""
    flat = normalise(text)
    n = max(0, flat.count(" ") - 1)
    if machine is None or not flat:
        return n, [], set()
    found = list(machine.iter(flat))
    if not found:
        return n, [], set()
    blanks = [i for i, c in enumerate(flat) if c == " "]
    ranges: list[tuple[int, int]] = []
    items: set[int] = set()
    for a, b, held in sorted((end - size + 1, end, held) for end, (size, held) in found):
        items.update(held)
        first, stop = bisect_left(blanks, a), bisect_left(blanks, b)
        if ranges and first <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(ranges[-1][1], stop))
        else:
            ranges.append((first, stop))
    return n, ranges, items


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as [start, end) code-point offsets in the original text."""
    places = [m.span() for m in WORD.finditer(text)] if ranges else []
    return [(places[a][0], places[b - 1][1]) for a, b in ranges]


def _patterns(items: list[tuple[str, str | None]], width: int) -> dict[str, list[int]]:
    made: dict[str, list[int]] = {}
    for place, (_, text) in enumerate(items):
        for window in windows(text, width):
            held = made.setdefault(window, [])
            if not held or held[-1] != place:
                held.append(place)
    return made


@lru_cache(maxsize=1)
def _held(token: str) -> list:
    """A worker's automaton of one pass, made by the first task that needs it; [None] until then."""
    return [None]


def _passes(benchmark: DataFrame, item_id: str, item_text: str, width: int, pass_chars: int) -> Iterator[Broadcast]:
    """(name, item ids, windows by their items) of the items in as many parts as their size asks for, each about pass_chars characters of windows."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null").distinct()
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, -(-size * width // pass_chars))
    for part in range(parts):
        items = sorted((tuple(r) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).collect()), key=lambda x: (x[0], x[1] or ""))
        yield benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [x[0] for x in items], _patterns(items, width)))


def _scanner(shared: Broadcast) -> tuple[list[str], ahocorasick.Automaton | None]:
    token, names, patterns = shared.value
    held = _held(token)
    if held[0] is None and patterns:
        held[0] = automaton(patterns)
    return names, held[0]


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, pass_chars: int = PASS_CHARS
) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, spans): a row per row of docs.

    item_ids: ids of the items with an occurring window, as sorted strings; spans: [start, end) offsets of the merged hits in the
    original text.  Null texts have no words; items without words have no window; a null item id is ignored.  The
    benchmark is a test set, not the corpus: its windows are one automaton, made once in each worker.  Beyond pass_chars characters of windows
    it is cut into passes, each a job of its own that writes down the few rows with a hit, so neither the driver nor a worker holds more than one pass.
    """
    arrow_limits(docs.sparkSession)
    own = pick(docs, doc_id, text)
    passes = list(_passes(benchmark, item_id, item_text, width, pass_chars))
    if len(passes) == 1:
        return own.mapInArrow(_contamination(passes[0], False), f"doc_id long, {_HITS}")
    own = own.select("*", *_row_keys())
    found = None
    for shared in passes:
        part = stash(own.mapInArrow(_contamination(shared, True), f"doc_id long, k1 long, k2 long, {_HITS}").where("n_hit > 0").select("k1", "k2", "item_ids", "spans").distinct(), "hits")
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.flatten(F.collect_list("spans")).alias("spans"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                places = [m.span() for m in WORD.finditer(body or "")] if spans else []
                starts, ends = [p[0] for p in places], [p[1] for p in places]
                ranges = merged([(bisect_left(starts, a), bisect_left(ends, b) + 1) for a, b in spans or []])
                rows.append((scan(body, None)[0], sum(b - a for a, b in ranges), [list(x) for x in original_spans(body or "", ranges)]))
            columns = [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), batch.column("item_ids"), pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "item_ids", "spans"])

    joined = own.join(found, ["k1", "k2"], "left").select("doc_id", "text", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "spans")
    return joined.mapInArrow(counted, f"doc_id long, {_HITS}")


_HITS = "n_words long, n_hit long, item_ids array<string>, spans array<array<int>>"


def _row_keys() -> tuple[Column, Column]:
    return F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit("second"), "doc_id", "text").alias("k2")


def _contamination(shared: Broadcast, keyed: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, machine = _scanner(shared)
        keys = ["doc_id", "k1", "k2"] if keyed else ["doc_id"]
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for body in batch.column("text").to_pylist():
                n, ranges, held = scan(body, machine)
                for into, x in zip(out, (n, sum(b - a for a, b in ranges), sorted({names[i] for i in held}), original_spans(body or "", ranges)), strict=True):
                    into.append(x)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())))
            columns = [*(batch.column(k) for k in keys), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "n_words", "n_hit", "item_ids", "spans"])

    return of


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, pass_chars: int = PASS_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs; no join, no shuffle.  Each further pass reads what the one before wrote."""
    arrow_limits(docs.sparkSession)

    def clean(shared: Broadcast):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = _scanner(shared)[1]
            for batch in batches:
                yield batch.filter(pa.array([not scan(x, machine)[1] for x in batch.column(text).to_pylist()], pa.bool_()))

        return of

    left = docs
    for i, shared in enumerate(_passes(benchmark, item_id, item_text, width, pass_chars)):
        left = (stash(left, "clean") if i else left).mapInArrow(clean(shared), docs.schema)
    return left


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) from contamination()."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )

