"""BPE encoding and decoding as bounded-lookahead streaming transducers.

Encoding.  A text is read in slices (`Encoding.feed`) and cut into pieces (the byte-level pre-tokens, each encoded apart from the others): a blank before a
non-blank starts a piece whatever follows, and any other piece is decided by three characters from its start and one behind its end.  All ids leave through one
rule, `Transducer.stable`: of the bytes of a piece that are read and haven't left, those tokens leave that nothing behind them can change.

* A merge rule a+b can be undone at the right edge of a prefix only by an earlier rule that takes b, or a piece at b's right end, together with what
  follows; that rule can in turn be undone only by a still earlier one.  Such chains run through strictly falling ranks.  So a token's end is
  settled once as many bytes behind it are read as the longest chain from the token's own right edge has (`lookaheads`: 119 bytes at most for a
  vocabulary of 50,000, 47 or fewer for half of its tokens), and a settled end settles all tokens before it.
* Behind a piece's end nothing can change it: there the lookahead is met whatever the token.

Unknown pieces are fed FEED bytes at a time, so what is held stays below FEED and the largest lookahead (`Transducer.lookahead`) however long a piece is; short
pieces that were encoded before are remembered in tables of bounded size, as a shortcut with the same ids.

Decoding.  Token bytes pass through an incremental byte-to-text machine, which holds the up to three bytes of an
unfinished character between steps.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from array import array
from bisect import bisect_left
from collections.abc import Generator, Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docquarry.llm.common import arrow_limits, pick

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a generation of the tables of known pieces; a full one becomes the older of two, or starts anew.
KNOWN = 300_000
#: Characters that are read at a time; an unfinished piece of more is encoded token by token.
SLICE = 1 << 14
#: Bytes of a piece that are looked at together with those that haven't left.
FEED = 64
#: A pair that no rule merges.
NONE = 1 << 62
#: Letters of the longest piece, or blank and what stands behind it, that is remembered.
LONGEST = 64
#: The kinds of pieces that go on with further characters.
RUNS = {kind: regex.compile(pattern) for kind, pattern in (("letters", r"\p{L}*"), ("numbers", r"\p{N}*"), ("marks", r"[^\s\p{L}\p{N}]*"), ("spaces", r"\s*"))}
#: Ids decoded in one step.
STEP = 1 << 16


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def lookaheads(merges: list[tuple[bytes, bytes]]) -> dict[bytes, int]:
    """Bytes behind a token that settle its end.  Tokens that aren't named need none.

    A rule that crosses the end takes the token, or a part at its right end before that part was merged away: so by a rank under that of the rule that took the
    part.  What it takes from behind can be undone in the same manner, by a still lower rank.  The longest such chain is what has to be seen.
    """
    made: dict[bytes, list[tuple[int, bytes]]] = {}  # by which rules, with which right parts
    ranks: dict[bytes, list[int]] = {}
    most: dict[bytes, list[int]] = {}  # of rules with this left part: ascending ranks, and the longest chain up to each

    def along(end: bytes, below: int) -> int:
        """The longest chain from a token's right end by rules of lower ranks than `below`."""
        at = bisect_left(ranks.get(end, ()), below)
        longest = most[end][at - 1] if at else 0
        for rank, right in made.get(end, ()):
            longest = max(longest, along(right, min(below, rank)))
        return longest

    for rank, (left, right) in enumerate(merges):
        need = len(right) + along(right, rank)
        held = most.setdefault(left, [])
        ranks.setdefault(left, []).append(rank)
        held.append(max(need, held[-1]) if held else need)
        made.setdefault(left + right, []).append((rank, right))
    return {token: need for token in {*ranks, *made} if (need := along(token, len(merges)))}


class Chunks(dict):
    """Ids of a blank and the letters behind it; unknown ones are looked up in the generation before, else encoded."""

    def __init__(self, machine: Transducer, older: dict[str, bytes]) -> None:
        super().__init__()
        self.machine, self.older = machine, older

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = b"".join(map(self.machine._piece, self.machine.split(" " + part)))
            if len(part) > LONGEST:
                return ids
        self[part] = ids
        return ids


class Transducer:
    """Encodes and decodes with a byte-level BPE vocabulary file."""

    def __init__(self, path: str, slice_: int = SLICE) -> None:
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, letters = whole["model"], byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        merges = [tuple(raw(x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.special = {x["content"]: x["id"] for x in whole.get("added_tokens", [])}
        ids = {raw(k): v for k, v in model["vocab"].items() if k not in self.special}
        self.single = [ids[bytes([b])] for b in range(256)]
        #: (left id << 20 | right id) -> rank << 20 | merged id
        self.rules = {ids[a] << 20 | ids[b]: rank << 20 | ids[a + b] for rank, (a, b) in reversed([*enumerate(merges)])}
        self.bytes_of = {v: k for k, v in ids.items()} | {v: k.encode() for k, v in self.special.items()}
        self.lengths = {v: len(k) for k, v in ids.items()}
        needs = lookaheads(merges)
        self.slice, self.lookahead = slice_, max(needs.values(), default=0)
        self.need = {v: needs.get(k, 0) for k, v in ids.items()}
        pattern = regex.compile(PATTERN)
        self.split, self.each = pattern.findall, pattern.finditer
        self.starts = tuple({x[:n] for x in self.special for n in range(1, len(x))})
        self.apart = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pieces: dict[str, bytes] = {}
        self.chunks = Chunks(self, {})
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]

    def held(self, text: str) -> int:
        """Characters at the end that may be the start of a special token."""
        return max(map(len, filter(text.endswith, self.starts))) if text.endswith(self.starts) else 0

    def merge(self, data: bytes) -> list[int]:
        """Applies the merge rules to a whole byte string: lowest rank first, leftmost among equals."""
        ids = [self.single[b] for b in data]
        if len(ids) > 48:
            return self._merge_long(ids)
        rule = self.rules.get
        pairs = [rule(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while pairs and (best := min(pairs)) != NONE:
            i = pairs.index(best)
            ids[i] = best & 0xFFFFF
            del ids[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rule(ids[i] << 20 | ids[i + 1], NONE)
            if i:
                pairs[i - 1] = rule(ids[i - 1] << 20 | ids[i], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rules, n = self.rules, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(rule, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rule := rules.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rule, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rule & 0xFFFFF, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (rule := rules.get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (rule, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def stable(self, data: bytes, ended: bool) -> tuple[list[int], bytes]:
        """(ids of the first tokens that no bytes behind data can change, the bytes behind those tokens); ended: the piece ends with data."""
        ids = self.merge(data)
        if ended:
            return ids, b""
        sure, end, behind = 0, 0, len(data)
        for i, x in enumerate(ids):
            behind -= self.lengths[x]
            if behind >= self.need[x]:  # this end is settled, and so are those before it
                sure, end = i + 1, len(data) - behind
        return ids[:sure], data[end:]

    def run(self, piece: bytes) -> Iterator[list[int]]:
        """A whole piece's ids, as they are settled while it is fed."""
        held = b""
        for at in range(0, max(1, len(piece)), FEED):
            held += piece[at : at + FEED]
            ids, held = self.stable(held, at + FEED >= len(piece))
            yield ids

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            data = piece.encode()
            got = array("I", self.stable(data, True)[0] if len(data) <= FEED else [x for ids in self.run(data) for x in ids]).tobytes()
            if len(piece) <= LONGEST:
                if len(self.pieces) >= KNOWN:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def plain(self, text: str) -> bytes:
        """Ids of decided text: whole pieces, none of which goes on behind it."""
        if re.search(r" \s", text):  # runs of white space: the pattern decides where they end
            return b"".join(map(self._piece, self.split(text)))
        if len(self.chunks) >= KNOWN:
            self.chunks.older = {}
            self.chunks = Chunks(self, self.chunks)
        first, *rest = text.split(" ")  # a blank before a non-blank always starts a piece
        return b"".join([*map(self._piece, self.split(first)), *map(self.chunks.__getitem__, rest)])

    def stream(self, text: str | None) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, as they are decided; null as the empty text; special tokens' strings give their ids."""
        state = Encoding(self)
        for at in range(0, len(text or ""), self.slice):
            yield from state.feed(text[at : at + self.slice])
        yield from state.finish()

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.stream(text))

    def decoded(self, ids: Iterable[bytes]) -> Iterator[str]:
        """The text of ids as stream() gives them, step by step; bytes that are no UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for some in ids:
            numbers = np.frombuffer(some, dtype="<u4")
            for at in range(0, len(numbers), STEP):
                part = numbers[at : at + STEP]
                part = part[part < len(self.table)]  # numbers without a token have no bytes
                yield machine.decode(b"".join(map(self.table.__getitem__, part.tolist())))
        yield machine.decode(b"", True)

    def decode(self, ids: bytes) -> str:
        return "".join(self.decoded([ids]))


class Encoding:
    """The state of one text between slices: characters that aren't decided, or an unfinished piece's kind and its bytes behind the last stable token."""

    def __init__(self, machine: Transducer) -> None:
        self.machine, self.rest, self.kind, self.open = machine, "", None, b""

    def feed(self, text: str) -> Iterator[bytes]:
        """Ids that are decided by now."""
        machine, text = self.machine, self.rest + text
        if machine.apart:
            while found := machine.apart.search(text):
                self.rest = ""
                yield from self._read(text[: found.start()], True)
                yield machine.special[found.group()].to_bytes(4, "little")
                text = text[found.end() :]
            held = machine.held(text)
            if held:
                yield from self._read(text[:-held], False)
                self.rest += text[-held:]
                return
        yield from self._read(text, False)

    def finish(self) -> Iterator[bytes]:
        """Ids of what is left, as no text follows."""
        yield from self._read(self.rest, True)

    def _read(self, text: str, last: bool) -> Iterator[bytes]:
        if self.kind:
            text = yield from self._go_on(text, last)
        cut = len(text) if last else last_start(text)
        if cut:
            yield self.machine.plain(text[:cut])
        if len(text) - cut > self.machine.slice:
            yield from self._by_pieces(text[cut:])
        else:
            self.rest = text[cut:]

    def _by_pieces(self, text: str) -> Iterator[bytes]:
        """Text without a sure start of a piece near its end."""
        for found in self.machine.each(text):
            if found.end() == len(text) or found.start() + 3 > len(text):
                break
            yield self.machine._piece(found.group())
        text = text[found.start() :]
        self.rest = text
        if len(text) > max(3, self.machine.slice):  # no contraction
            self.kind = next(kind for kind, run in RUNS.items() if run.match(text[-1]).end())
            self.rest, text = (text[-1], text[:-1]) if self.kind == "spaces" else ("", text)
            self.open = text.encode()
            yield from self._settled(False)

    def _go_on(self, text: str, last: bool) -> Generator[bytes, None, str]:
        """Reads an unfinished piece's further characters; what is behind them.  The last blank of several may belong to the next piece."""
        end = RUNS[self.kind].match(text).end()
        ended = last or end < len(text)
        if self.kind == "spaces" and not (last and end == len(text)):
            end -= 1
        self.open += text[:end].encode()
        yield from self._settled(ended)
        if ended:
            self.kind = None
        return text[end:]

    def _settled(self, ended: bool) -> Iterator[bytes]:
        """Ids of the open piece that are settled; FEED further bytes are looked at with what is held."""
        data, self.open = self.open, b""
        for at in range(0, max(1, len(data)), FEED):
            ids, self.open = self.machine.stable(self.open + data[at : at + FEED], ended and at + FEED >= len(data))
            yield array("I", ids).tobytes()


def last_start(text: str) -> int:
    """The last blank before a non-blank: a piece starts there whatever follows; 0 where there is none."""
    at = len(text)
    while (at := text.rfind(" ", 0, at)) > 0:
        if text[at + 1 : at + 2].strip():
            return at
    return 0


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One for each worker process: its tables of known pieces serve later tasks too."""
    return Transducer(path)


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): a row per row of docs, ids as little-endian unsigned 32-bit integers; null texts are empty."""
    arrow_limits(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            got = [machine.encode(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.binary())], names=["doc_id", "ids"])

    return pick(docs, doc_id, text).mapInArrow(of, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the decoded text of each row of encode_documents()."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            got = [machine.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(got, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(of, "doc_id long, ids binary, text string")


def encode_checked(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each row: the ids as encode_documents() gives them and the hash of their decoded text."""
    arrow_limits(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            ids = [machine.encode(x) for x in batch.column("text").to_pylist()]
            n, back = [len(x) // 4 for x in ids], [_hash(x.encode() for x in machine.decoded([y])) for y in ids]
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return pick(docs, doc_id, text).mapInArrow(of, "doc_id long, n_tokens long, ids binary, decoded_sha256 string")


def _hash(parts: Iterable[bytes]) -> str:
    done = sha256()
    for x in parts:
        done.update(x)
    return done.hexdigest()


def _digest(machine: Transducer, text: str | None) -> tuple[int, str, str]:
    """(tokens, hash of the ids, hash of the decoded text): ids pass from the encoder to the decoder as they are decided and aren't gathered."""
    n, ids_hash = 0, sha256()

    def passing() -> Iterator[bytes]:
        nonlocal n
        for ids in machine.stream(text):
            n += len(ids) // 4
            ids_hash.update(ids)
            yield ids

    back = _hash(x.encode() for x in machine.decoded(passing()))
    return n, ids_hash.hexdigest(), back


def bpe_digest(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, encoded and decoded in one pass.

    Null texts are empty; repeated rows and rows that share an id are worked out one by one; an empty table gives no row; further columns are ignored.
    """
    arrow_limits(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            n, a, b = zip(*[_digest(machine, x) for x in batch.column("text").to_pylist()], strict=True) if batch.num_rows else ((), (), ())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, doc_id, text).mapInArrow(of, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
