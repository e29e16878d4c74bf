"""Suffix-array dedup: byte strings that occur twice, found by column-wise construction of Burrows-Wheeler transforms.

Over a whole corpus the column-wise construction would take as many passes over all data as the longest document has bytes, so it runs
on collections of short strings that together hold every window of `length` bytes that can occur twice:

1. A window's mark is the smallest hash of a GRAM-byte string in it.  Windows that follow one another and share their mark are cut as one
   segment: each window of the corpus lies in one segment, and equal windows have equal marks.
2. Equal windows hold their mark at two places: in two segments, or twice in one (a periodic text).  Marks at one place in the whole corpus hold no repeat; nothing
   else is left out.  Equal segments of the other marks are one string with a weight.  Up to here, and between the tasks, only hashes and places are dealt; one
   place of each string then fetches its bytes.
3. Strings are dealt into buckets by mark.  Each string gives `word` strings of words, one for each start modulo `word`, and over
   them the collection's transform and common prefixes grow by one symbol (a word of bytes) of each string a round, from the last column to the
   first, by sequential passes over two files.  Neighbours in suffix order that share `length` bytes form classes; a class of two windows, or of one
   in a string of weight two, is a repeat.
4. Strings of a mark with very many different ones are cut further, into windows whose mark lies within `width` places of each other.  Those share more bytes
   than the mark, which are their new mark; `width` goes down to 1, where a mark's strings are all alike.  Parts are places in the different strings, whose bytes
   are there already; what is found in them is carried back to the strings.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from functools import reduce
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import arrow_limits, drop_stash, pick, stash

#: Bytes of a marking string; windows hashed at a time; strings of a bucket, about; different strings of a mark from which they are cut further.
GRAM, BLOCK, BUCKET, SPREAD = 32, 1 << 15, 1000, 1000
#: By what a window's width goes down when strings of one mark are cut further.
NARROW = 4
#: Bytes of a symbol at most; strings of one construction, about; records of a file that are held at a time.
WORD, TOGETHER, RECORDS = 25, 250, 1 << 17
_ODD = 0x9E3779B97F4A7C15
_LOW = (1 << 32) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_ODD, BLOCK + 4096), _powers(pow(_ODD, -1, 1 << 64), BLOCK + 4096)
_LETTERS = np.random.default_rng(11).integers(0, 1 << 64, size=256, dtype=np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings: a rolling polynomial modulo 2**64, mixed."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LETTERS[data] * _UP[: len(data)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def segments(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, mark, whether the mark is at two or more places in it) of each segment, in order; at most length - GRAM + 1 windows each."""
    data, width = np.frombuffer(raw, dtype=np.uint8), length - GRAM + 1
    firsts, counts, marks, twice = [], [], [], []
    for at in range(0, len(data) - length + 1, BLOCK):
        hashes = gram_hashes(data[at : min(at + BLOCK + length - 1, len(data))])
        least = _least(hashes, width)
        starts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        sizes = np.diff(np.append(starts, len(least)))
        if (sizes > width).any():  # the same string again and again
            pieces = -(-sizes // width)
            within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            left = np.repeat(sizes, pieces) - within * width
            starts, sizes = np.repeat(starts, pieces) + within * width, np.minimum(left, width)
        spans = sizes + width - 1  # strings of GRAM bytes in each segment
        begun = np.cumsum(spans) - spans
        within = np.arange(begun[-1] + spans[-1], dtype=np.int32) + np.repeat((starts - begun).astype(np.int32), spans)
        places = np.add.reduceat(hashes[within] == np.repeat(least[starts], spans), begun, dtype=np.int32)
        firsts.append(starts + at)
        counts.append(sizes)
        marks.append(least[starts])
        twice.append(places > 1)
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(marks), np.concatenate(twice)


def narrower(segment: bytes, length: int, width: int) -> list[tuple[int, int, int]]:
    """(first window, windows, mark) of a segment's parts, in order: windows that hold its first mark in one of `width` places, counted from the window's start.

    Equal windows hold it at one place, so they get equal marks, which are made of the bytes that all such windows share.
    """
    hashes = gram_hashes(np.frombuffer(segment, dtype=np.uint8))
    at = np.flatnonzero(hashes == hashes.min())
    starts = np.arange(len(segment) - length + 1)
    place = at[np.searchsorted(at, starts)]
    group = (place - starts) // width
    firsts = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (group[1:] != group[:-1])))
    out = []
    for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(starts)], strict=True):
        c = int(group[a])
        begin = int(place[a]) - c * width  # the last start of such windows
        shared = segment[begin : begin + length - width + 1] if width < length else b""
        out.append((a, b - a, xxhash.xxh3_64_intdigest(b"%d %d " % (width, c) + shared) - (1 << 63)))
    return out


class Records:
    """A file of equal numbers that is only written and read from its start to its end."""

    def __init__(self, kind: str, scratch: Callable[[], BinaryIO]) -> None:
        self.kind, self.file = np.dtype(kind), scratch()

    def append(self, values: np.ndarray) -> None:
        self.file.write(memoryview(np.ascontiguousarray(values, dtype=self.kind)).cast("B"))

    def blocks(self) -> Iterator[np.ndarray]:
        self.file.seek(0)
        while raw := self.file.read(RECORDS * self.kind.itemsize):
            yield np.frombuffer(raw, dtype=self.kind)

    def close(self) -> None:
        self.file.close()


def _beside(keys: Records, asked: np.ndarray) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """(number, keys of no symbol, place of the same symbol before, and behind, each -1 where there is none) of sorted keys that are in the file."""
    at, sides, zero, start, last = np.zeros(len(asked), np.int64), np.full((2, len(asked)), -1, np.int64), 0, 0, np.int64(-1)
    done, waiting = 0, None
    for block in keys.blocks():
        if waiting is not None and block[0] >> 32 == asked[waiting] >> 32:
            sides[1, waiting] = block[0] & _LOW
        stop = int(np.searchsorted(asked, block[-1], side="right"))
        mine, waiting = asked[done:stop], None
        if len(mine):
            place = np.searchsorted(block, mine)
            at[done:stop] = start + place
            wide = np.concatenate(([last], block, [np.int64(-1)]))
            for side, beside in enumerate((wide[place], wide[place + 2])):
                sides[side, done:stop] = np.where(beside >> 32 == mine >> 32, beside & _LOW, -1)
            waiting = stop - 1 if place[-1] == len(block) - 1 else None
        zero += int(np.searchsorted(block, 1 << 32))
        start, last, done = start + len(block), block[-1], stop
    return at, zero, sides[0], sides[1]


def _least_between(prefixes: Records, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The least of the file's numbers first..stop - 1, for each pair."""
    got, start = np.full(len(first), 1 << 30, dtype=np.int64), 0
    for block in prefixes.blocks():
        mine = np.flatnonzero((first < start + len(block)) & (stop > start))
        if len(mine):
            a, b = np.maximum(first[mine] - start, 0), np.minimum(stop[mine] - start, len(block))
            # two ranges of a power of two cover each
            power, of, least = np.frexp(b - a)[1] - 1, np.empty(len(mine), dtype=np.int64), block
            for k in range(int(power.max()) + 1):
                now = np.flatnonzero(power == k)
                of[now] = np.minimum(least[a[now]], least[b[now] - (1 << k)])
                least = np.minimum(least[: -(1 << k)], least[1 << k :])
            got[mine] = np.minimum(got[mine], of)
        start += len(block)
    return got


def column_wise(strings: list, scratch: Callable[[], BinaryIO] = io.BytesIO) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transform, common prefixes, places) of a collection of strings of symbols above 0 (bytes or whole numbers).

    transform: the symbol before each suffix in order (0 where there is none); common prefixes: symbols shared with the suffix before;
    places: by string and start, the suffix's number in order (-1 behind a string's end).
    """
    sizes = np.array([len(s) for s in strings])
    symbols = np.zeros((len(strings), sizes.max() + 1), dtype=np.int64)
    for i, s in enumerate(strings):
        symbols[i, symbols.shape[1] - len(s) :] = list(s)
    return construct(symbols, sizes, scratch)


def construct(symbols: np.ndarray, sizes: np.ndarray, scratch: Callable[[], BinaryIO] = io.BytesIO) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """column_wise() of a table with a string of `sizes` symbols at the end of each row; what is left of it, and all of column 0, is 0.

    Two files hold the collection's state: keys (a suffix's symbol before it, then its place) in their order, and the common prefixes by place.  A round reads
    both from start to end and writes the next ones; scratch makes a file.  A key's number is where the suffix with its symbol belongs.
    """
    m, longest = len(symbols), symbols.shape[1] - 1
    keys, prefixes = Records("<i8", scratch), Records("<i4", scratch)
    active, place, n = np.arange(m), np.arange(m), m
    keys.append(np.sort(symbols[:, longest] << 32 | place))
    prefixes.append(np.zeros(m))
    for column in range(longest - 1, -1, -1):
        asked = symbols[active, column + 1] << 32 | place
        now = np.flatnonzero(asked > _LOW)
        if not len(now):
            break
        now = now[np.argsort(asked[now])]
        active, place, asked = active[now], place[now], asked[now]
        at, zero, before, behind = _beside(keys, asked)
        to = m + at - zero  # ascending, as the keys are
        # what a new suffix shares with its neighbours: one more than the least common prefix between the symbol's occurrences
        sides, has = np.zeros((2, len(to)), dtype=np.int64), np.stack((before >= 0, behind >= 0))
        first, stop = np.concatenate((before[has[0]], place[has[1]])) + 1, np.concatenate((place[has[0]], behind[has[1]])) + 1
        sides[has] = 1 + _least_between(prefixes, first, stop)
        slot = to - np.arange(len(to))  # old suffixes before the new one
        grown, done, start = Records("<i4", scratch), 0, 0
        for block in prefixes.blocks():
            end = len(slot) if start + len(block) == n else int(np.searchsorted(slot, start + len(block)))
            where, block = slot[done:end] - start, block.copy()
            inner = where < len(block)
            block[where[inner]] = sides[1, done:end][inner]
            grown.append(np.insert(block, where, sides[0, done:end]))
            start, done = start + len(block), end
        prefixes.close()
        prefixes = grown
        shift = np.cumsum(np.bincount(slot, minlength=n + 1))
        fresh = np.sort(symbols[active, column] << 32 | to)
        grown, done, start = Records("<i8", scratch), 0, 0
        for block in keys.blocks():
            block = block + shift[block & _LOW]
            end = len(fresh) if start + len(block) == n else int(np.searchsorted(fresh, block[-1]))
            grown.append(np.insert(block, np.searchsorted(block, fresh[done:end]), fresh[done:end]))
            start, done = start + len(block), end
        keys.close()
        keys, place, n = grown, to, n + len(to)
    whole, lcp = np.concatenate([*keys.blocks()]), np.concatenate([*prefixes.blocks()])
    keys.close()
    prefixes.close()
    bwt, rank = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    bwt[whole & _LOW] = whole >> 32
    rank[whole & _LOW] = np.arange(n)
    shift = m - int((bwt == 0).sum())
    places = np.full((m, longest + 1), -1, dtype=np.int64)
    at, live = np.arange(m), np.arange(m)
    for back in range(longest + 1):  # from each empty suffix to the whole string
        places[live, sizes[live] - back] = at
        on = bwt[at] > 0
        at, live = rank[at[on]] + shift, live[on]
        if not len(live):
            break
    return bwt, lcp, places


def classes(strings: list[bytes], length: int, scratch: Callable[[], BinaryIO] = io.BytesIO) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, class) of all windows of `length` bytes, by string and start; equal windows have equal classes."""
    word = next(w for w in range(WORD, 0, -1) if length % w == 0)
    ends = np.cumsum([len(s) for s in strings])
    names = word_names(np.frombuffer(b"".join(strings), dtype=np.uint8), word) + 1
    # a string of words for each start modulo `word` that has a window
    long = np.array([len(s) for s in strings])
    phases = np.minimum(word, np.maximum(long - length + 1, 0))
    which = np.repeat(np.arange(len(strings)), phases)
    if not len(which):
        return (np.zeros(0, np.int64),) * 3
    phase = np.arange(len(which)) - np.repeat(np.cumsum(phases) - phases, phases)
    sizes = (long[which] - word - phase) // word + 1
    back = np.arange(-int(sizes.max()) - 1, 0)[None, :] + sizes[:, None]
    first = (ends - long)[which] + phase
    symbols = np.where(back >= 0, names[np.maximum(first[:, None] + back * word, 0)], 0)
    _, lcp, places = construct(symbols, sizes, scratch)
    row, start = np.nonzero(np.arange(places.shape[1])[None, :] + length // word <= sizes[:, None])
    number = np.cumsum(lcp < length // word)[places[row, start]]
    who, at = which[row], start * word + phase[row]
    order = np.argsort(who << 32 | at)
    return who[order], at[order], number[order]


def word_names(data: np.ndarray, word: int) -> np.ndarray:
    """A number for each start: equal ones for equal strings of `word` bytes, and for no others.  A name of more bytes is the pair of two shorter ones' names."""
    width = min(word, 8)
    names = data[: len(data) - width + 1].astype(np.uint64)
    for k in range(1, width):
        names |= data[k : len(data) - width + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    names = np.unique(names, return_inverse=True)[1]
    while width < word:
        step = min(width, word - width)
        names = np.unique(names[:-step] << 32 | names[step:], return_inverse=True)[1]
        width += step
    return names


FOUND_SCHEMA = "s1 long, s2 long, first int, stop int"


def bucket_repeats(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Of one bucket: ranges of windows that are repeats."""
    pdf = pdf.drop_duplicates(["h", "s1", "s2"]).sort_values("h", kind="stable")  # repeated rows fetch a string twice
    marks, segs, weight = pdf["h"].to_numpy(), pdf["seg"].tolist(), pdf["n"].to_numpy()
    key = pdf[["s1", "s2"]].to_numpy().tolist()
    # a mark's strings are neighbours, so cutting the list between marks keeps them together
    changes = np.flatnonzero(np.diff(marks)) + 1
    cuts = [0]
    for x in changes.tolist():
        if x - cuts[-1] >= TOGETHER:
            cuts.append(x)
    out = []
    for begin, end in zip(cuts, [*cuts[1:], len(segs)], strict=True):
        who, start, number = classes(segs[begin:end], length)
        own = weight[begin:end][who]
        repeat = np.bincount(number, weights=own).astype(np.int64)[number] > 1
        edges = np.diff(np.where(repeat, who + 1, 0), prepend=0, append=0)
        at = np.flatnonzero(edges)
        # runs of repeated windows of one string: both sides of each change
        for a, b in zip(at, at[1:]):  # noqa: B905
            if repeat[a]:
                out.append((*key[begin + who[a]], int(start[a]), int(start[b - 1]) + 1))
    names = [x.split()[0] for x in FOUND_SCHEMA.split(", ")]
    return pd.DataFrame(out, columns=names).astype({"s1": "int64", "s2": "int64", "first": "int32", "stop": "int32"})


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows with a key of 128 bits; equal rows share it, and their results."""
    own = pick(docs, doc_id, text)
    return own.select("*", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit("second"), "doc_id", "text").alias("k2"))


def _narrowed(strings: DataFrame, length: int, width: int) -> DataFrame:
    """Members (k1, k2, at, windows, h, s1, s2, n) of strings (s1, s2, n, seg), which are their k1 and k2, cut by narrower(); those whose new mark is at one place are left out."""

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "at", "windows", "h", "s1", "s2", "n"]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            rows = []
            for k1, k2, n, seg in zip(*(batch.column(x).to_pylist() for x in ("s1", "s2", "n", "seg")), strict=True):
                for first, count, mark in narrower(seg, length, width):
                    s = xxhash.xxh3_128_digest(seg[first : first + count + length - 1])
                    rows.append((k1, k2, first, count, mark, int.from_bytes(s[:8], "little", signed=True), int.from_bytes(s[8:], "little", signed=True), n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    cut = stash(strings.select("s1", "s2", "n", "seg").mapInArrow(narrow, "k1 long, k2 long, at int, windows int, h long, s1 long, s2 long, n long"), "narrower")
    shared = cut.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    held = stash(cut.join(shared, "h"), "members")
    drop_stash(cut)
    return held


def _fetched(bodies: DataFrame, strings: DataFrame, length: int) -> DataFrame:
    """(h, s1, s2, n, seg): the strings' bytes, each from its place (k1, k2, at, windows) in the bodies (k1, k2, body).  A repeated body may give a string twice; its n is above 1 then."""
    dealt = strings.select("k1", "k2", F.struct("h", "s1", "s2", "n", "at", "windows").alias("x"))
    wanted = dealt.groupBy("k1", "k2").agg(F.collect_list("x").alias("cut"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, last = ["h", "s1", "s2", "n"], None
        for batch in batches:
            rows = zip(*(batch.column(x).to_pylist() for x in ("k1", "k2", "cut")), batch.column("body").cast(pa.binary()).to_pylist(), strict=True)
            got, parts = [], []
            for k1, k2, cut, raw in rows:
                if (k1, k2) == last:
                    continue
                last = (k1, k2)
                got += cut
                parts += [raw[x["at"] : x["at"] + x["windows"] + length - 1] for x in cut]
            for at in range(0, len(got), 4096):
                columns = [pa.array([x[c] for x in got[at : at + 4096]], pa.int64()) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(parts[at : at + 4096], pa.binary())], names=[*names, "seg"])

    return bodies.join(wanted, ["k1", "k2"]).mapInArrow(fetch, "h long, s1 long, s2 long, n long, seg binary")


def repeat_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """(k1, k2, spans) by a row's key: its bytes [start, end) that lie in a repeated string.  Rows without a repeat are left out."""
    arrow_limits(docs.sparkSession)
    own = _keyed(docs, doc_id, text).where(F.octet_length("text") >= length)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                first, count, mark, twice = segments(raw, length)
                digests = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)])
                s = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
                for into, x in zip(out, (first.astype(np.int32), count.astype(np.int32), mark.view(np.int64), s[:, 0], s[:, 1], twice), strict=True):
                    into.append(x)
            kinds = (pa.list_(pa.int32()),) * 2 + (pa.list_(pa.int64()),) * 3 + (pa.list_(pa.bool_()),)
            columns = [batch.column("k1"), batch.column("k2"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "at", "windows", "h", "s1", "s2", "twice"])

    schema = "k1 long, k2 long, at array<int>, windows array<int>, h array<long>, s1 array<long>, s2 array<long>, twice array<boolean>"
    cut = stash(own.select("text", "k1", "k2").mapInArrow(find, schema), "segments")
    places = F.sum(F.when(F.col("x.twice"), 2).otherwise(1))
    shared = stash(cut.select(F.explode(F.arrays_zip("h", "twice")).alias("x")).groupBy(F.col("x.h").alias("h")).agg(places.alias("places")).where("places > 1").select("h"), "marks")
    each = cut.select("k1", "k2", F.explode(F.arrays_zip("at", "windows", "h", "s1", "s2")).alias("x")).select("k1", "k2", "x.*")
    members = stash(each.join(shared, "h"), "members")
    drop_stash(cut)
    members, bodies, levels, width = members.withColumn("n", F.lit(1).cast("long")), own.select("k1", "k2", F.col("text").alias("body")), [], length - GRAM + 1
    while True:
        # all of a string's firsts are of one row
        strings = members.groupBy("h", "s1", "s2").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("k1", "k2", "at", "windows")))
        strings = stash(strings, "strings")
        many = stash(strings.groupBy("h").count().where(F.col("count") > SPREAD).select("h"), "many")
        got = _fetched(bodies, strings, length)
        if width == 1 or many.isEmpty():
            levels.append((members, strings, got, (strings,)))
            break
        # strings are cut further where they are, so that the texts are shuffled for bytes once; many has a row for over SPREAD strings
        got, many = stash(got, "bytes"), F.broadcast(many)
        levels.append((members, strings.join(many, "h", "left_anti"), got.join(many, "h", "left_anti"), (strings, got)))
        width = -(-width // NARROW)
        bodies = got.join(many, "h", "left_semi")
        members = _narrowed(bodies, length, width)
        bodies = bodies.select(F.col("s1").alias("k1"), F.col("s2").alias("k2"), F.col("seg").alias("body"))
    union = lambda i: reduce(DataFrame.unionByName, (x[i] for x in levels))
    buckets = union(1).count() // BUCKET + 1
    bucket = F.pmod(F.xxhash64("h"), F.lit(buckets))
    found = stash(union(2).groupBy(bucket.alias("bucket")).applyInPandas(lambda pdf: bucket_repeats(pdf, length), FOUND_SCHEMA), "repeats")
    for held in (x for level in levels for x in level[3]):
        drop_stash(held)
    # what was found in a part lies in the string that was cut, from the narrowest to the first
    for members, *_ in reversed(levels[1:]):
        above = members.join(found, ["s1", "s2"]).select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("stop")).alias("stop"))
        found = found.unionByName(above)
    members = levels[0][0]
    ranges = found.groupBy("s1", "s2").agg(F.collect_set(F.struct("first", "stop")).alias("ranges"))
    spans = members.select("k1", "k2", "at", "s1", "s2").join(ranges, ["s1", "s2"])
    span = F.transform("ranges", lambda x: F.struct((F.col("at") + x["first"]).alias("a"), (F.col("at") + x["stop"] - 1 + length).alias("b")))
    return spans.select("k1", "k2", F.explode(span).alias("x")).groupBy("k1", "k2").agg(F.collect_set("x").alias("spans"))


def merge_spans(spans: list | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept), a row per row of docs: bytes covered by a `length`-byte string that also starts elsewhere are removed.

    Strings are bytes of UTF-8, within a document, judged on the input; `spans` are the maximal removed runs, `kept` the other bytes.  Null and
    short texts keep everything; repeated rows count as further documents; an empty table gives no row; further columns are ignored.
    `length` is at least GRAM.
    """
    spans = repeat_spans(docs, doc_id, text, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
        for batch in batches:
            rows = []
            for raw, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = raw or b""
                gone = merge_spans(found)
                ends = [0, *(x for pair in gone for x in pair), len(raw)]
                kept = b"".join([raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)])
                rows.append((len(raw), len(raw) - len(kept), [list(x) for x in gone], kept))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    joined = _keyed(docs, doc_id, text).join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<array<int>>, kept binary")


def repeats_digest(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) from remove_repeats()."""
    got = remove_repeats(docs, length=length)
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
