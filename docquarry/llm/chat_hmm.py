"""Chat formatting: a hidden Markov model recovers the speakers of a transcript, then turns are rendered in one canonical form.

States are roles, each as the first line of a turn or a later one; a line's observation is its speaker marker (of a role,
of nobody in particular, none) and its shape (blank, question, short, middle, long).  Scores are whole numbers (thousandths of natural
logarithms), so sums are exact and ties have one answer: the lowest last state, then the lowest predecessor each time.

Rows are range-partitioned by conversation and place, so a conversation of any length is spread over as many tasks as its share
needs.  A conversation that crosses partitions is decoded exactly: each partition gives a max-plus matrix of its stretch, the driver
folds these (two rows for each partition), each stretch then maps its last state to its first, and the last states follow backwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import arrow_limits, shared_dir, stash

ROLES = ("assistant", "system", "user")
#: State 2*r begins a turn of ROLES[r], state 2*r+1 continues it.
STATES = 2 * len(ROLES)
NAMES = {
    "assistant": ("assistant", "ai", "bot", "model", "answer", "a"),
    "system": ("system", "instructions", "instruction", "context"),
    "user": ("user", "human", "customer", "question", "q", "me"),
}
_ROLE_OF = {name: i for i, role in enumerate(ROLES) for name in NAMES[role]}
MARKER = re.compile(r"^\s*(?:[\[(<*#]*\s*([A-Za-z]{1,12})\s*[\])>*]*\s*:\s*|([-*>•])\s+)")
#: Marker classes: one of each role, one of nobody in particular, none.  Shapes of a line, in characters.
MARKERS, SHAPES, SHORT, LONG = len(ROLES) + 2, 5, 40, 200
OBSERVATIONS = MARKERS * SHAPES
NEVER = -(10**12)


def read_line(line: str) -> tuple[int, str]:
    """(observation, line without its speaker marker)."""
    marker, rest = MARKERS - 1, line
    if m := MARKER.match(line):
        role = _ROLE_OF.get((m[1] or "").lower())
        if role is not None or m[2]:
            marker, rest = len(ROLES) if role is None else role, line[m.end() :]
    bare = rest.strip()
    shape = 0 if not bare else 1 if bare.endswith("?") else 2 if len(bare) < SHORT else 3 if len(bare) < LONG else 4
    return marker * SHAPES + shape, rest


@dataclass
class Model:
    start: np.ndarray = field(default_factory=lambda: np.zeros(STATES, dtype=np.int64))
    move: np.ndarray = field(default_factory=lambda: np.zeros((STATES, STATES), dtype=np.int64))
    emit: np.ndarray = field(default_factory=lambda: np.zeros((OBSERVATIONS, STATES), dtype=np.int64))


def scores(counts: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Thousandths of log shares along the last axis, one added to each allowed count."""
    held = np.where(allowed, counts + 1.0, 0.0)
    with np.errstate(divide="ignore"):
        logs = 1000 * np.log(held / held.sum(axis=-1, keepdims=True))
    return np.where(allowed, np.rint(np.where(allowed, logs, 0)), NEVER).astype(np.int64)


def fit(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Model:
    """Counts over all rows whose role is known: emissions and moves within a row, moves between rows of neighbouring turn numbers.

    The counts are a few hundred numbers; nothing of a row reaches the driver.  Without labelled rows all scores are even.
    """
    arrow_limits(rows.sparkSession)
    own = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.lower(F.col(role).cast("string")).alias("role"), F.col(text).cast("string").alias("text"))
    own = own.where(F.col("role").isin(*ROLES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            for who, body in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                state = 2 * ROLES.index(who)
                for i, line in enumerate((body or "").split("\n")):
                    cell = (read_line(line)[0], state + (i > 0))
                    seen[cell] = seen.get(cell, 0) + 1
        keys = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], names=["seen", "state", "n"])

    emissions = own.select("role", "text").mapInArrow(count, "seen int, state int, n long").groupBy("seen", "state").agg(F.sum("n").alias("n")).collect()
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    # one row for each place of a conversation, so repeated rows don't multiply in the join
    places = own.groupBy("conv_id", "turn").agg(F.max(F.struct("role", lines.alias("lines"))).alias("x")).select("conv_id", "turn", "x.role", "x.lines")
    after = places.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    pairs = places.join(after, ["conv_id", "turn"]).groupBy("role", (F.col("lines") > 1).alias("long"), "next").count().collect()
    before = places.select("conv_id", (F.col("turn") + 1).alias("turn"))
    first = places.join(before, ["conv_id", "turn"], "left_anti").groupBy("role").count().collect()
    inside = places.groupBy("role").agg(F.sum(F.greatest(F.col("lines") - 2, F.lit(0))), F.sum((F.col("lines") > 1).cast("long"))).collect()
    begin, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((OBSERVATIONS, STATES))
    for o, s, n in emissions:
        emit[o, s] = n
    for who, is_long, then, n in pairs:
        move[2 * ROLES.index(who) + is_long, 2 * ROLES.index(then)] = n
    for who, n in first:
        begin[2 * ROLES.index(who)] = n
    for who, more, once in inside:
        s = 2 * ROLES.index(who)
        move[s, s + 1], move[s + 1, s + 1] = once, more
    opens = np.arange(STATES) % 2 == 0
    allowed = opens[None, :] | (np.arange(STATES)[:, None] // 2 == np.arange(STATES)[None, :] // 2)
    return Model(scores(begin, opens), scores(move, allowed), scores(emit.T, np.ones((STATES, OBSERVATIONS), dtype=bool)).T)


def forward(model: Model, seen: list[int], entry: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(scores of the last state, back pointers by line); entry: scores of the state before the first line, None at a transcript's start."""
    back = np.zeros((len(seen), STATES), dtype=np.int8)
    alpha = entry
    for t, o in enumerate(seen):
        if alpha is None:
            alpha = model.start + model.emit[o]
            continue
        through = alpha[:, None] + model.move
        back[t] = through.argmax(axis=0)
        alpha = through.max(axis=0) + model.emit[o]
    return alpha, back


def backward(back: np.ndarray, last: int) -> list[int]:
    path = [last]
    for t in range(len(back) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return path[::-1]


def viterbi(model: Model, seen: list[int]) -> list[int]:
    """The best states of a whole transcript."""
    if not seen:
        return []
    alpha, back = forward(model, seen, None)
    return backward(back, int(alpha.argmax()))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple], list[list[tuple[int, str]]]]]:
    """(conversation, rows, read lines by row) of each stretch of a sorted partition."""
    key, rows, lines = None, [], []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[0] != key:
                yield key, rows, lines
                rows, lines = [], []
            key = row[0]
            rows.append(row)
            lines.append([read_line(x) for x in (row[3] or "").split("\n")])
    if rows:
        yield key, rows, lines


def _seen(lines: list[list[tuple[int, str]]]) -> list[int]:
    return [o for row in lines for o, _ in row]


def render(lines: list[list[tuple[int, str]]], path: list[int], opened: bool, closes: bool) -> list[tuple[str, int, str]]:
    """(role, turns begun, rendered text) of each row; the texts of a conversation's rows joined give its canonical form."""
    out, at = [], 0
    for i, row in enumerate(lines):
        parts, begun, fresh = [], 0, False
        states = path[at : at + len(row)]
        at += len(row)
        for (_, body), state in zip(row, states, strict=True):
            if state % 2 == 0:
                parts.append(("<|end|>\n" if opened else "") + f"<|{ROLES[state // 2]}|>\n")
                opened, fresh, begun = True, True, begun + 1
                body = body.lstrip()
            if fresh and not body.strip():
                continue  # blank lines before a turn's first words
            parts.append(body if fresh else "\n" + body)
            fresh = False
        if closes and i == len(lines) - 1:
            parts.append("<|end|>\n")
        out.append((ROLES[states[-1] // 2], begun, "".join(parts)))
    return out


def parse_transcripts(rows: DataFrame, model: Model, conv_id: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv_id, turn, role_pred, n_lines, n_turns, rendered), a row per row of the transcript.

    A row is a stretch of transcript lines; rows are in the order of turn (nulls first), then of a hash of the text.  role_pred is the role of its last
    line, n_turns the turns that begin in it; `rendered` drops speaker markers, and a conversation's rendered rows in order are its
    canonical form.  A null text is one empty line; rows with a null conv_id are one conversation; an empty table gives none.
    """
    spark = rows.sparkSession
    arrow_limits(spark)
    shared_dir(spark)
    own = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.xxhash64(F.col(text).cast("string")).alias("h"), F.col(text).cast("string").alias("text"))
    order = ["conv_id", "turn", "h"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = stash(own, "transcript").repartitionByRange(parts, *order).sortWithinPartitions(*order).checkpoint()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for key, _, lines in _runs(batches):
            found = [*found[:1], (key, _seen(lines))]
        part = TaskContext.get().partitionId()
        rows = []
        for key, seen in found:
            grid = [forward(model, seen, np.where(np.arange(STATES) == s, 0, NEVER * 4))[0].tolist() for s in range(STATES)]
            rows.append((part, key, forward(model, seen, None)[0].tolist(), sum(grid, [])))
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "conv_id", "own", "grid"])

    found = sorted(ordered.mapInArrow(ends, "part int, conv_id long, own array<long>, grid array<long>").collect(), key=lambda r: r[0])  # two rows for each partition at most
    chains: list[list] = []
    for r in found:
        if chains and chains[-1][-1][1] == r[1] and chains[-1][-1][0] != r[0]:
            chains[-1].append(r)
        else:
            chains.append([r])
    chains = [c for c in chains if len(c) > 1]
    entry: dict[tuple, np.ndarray] = {}  # scores of the state before a stretch
    for chain in chains:
        alpha = np.array(chain[0][2])
        for part, key, _, grid in chain[1:]:
            entry[part, key] = alpha
            alpha = (alpha[:, None] + np.array(grid).reshape(STATES, STATES)).max(axis=0)
        entry[None, chain[0][1]] = alpha
    last: dict[tuple, int] = {}

    def first_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = TaskContext.get().partitionId(), []
        for key, _, lines in _runs(batches):
            if (part, key) in entry:
                back = forward(model, _seen(lines), entry[part, key])[1]
                rows.append((part, key, [backward(back, s)[0] for s in range(STATES)]))
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "conv_id", "to"])

    if chains:
        to = {(r[0], r[1]): r[2] for r in ordered.mapInArrow(first_states, "part int, conv_id long, to array<long>").collect()}
        for chain in chains:
            state = int(entry.pop((None, chain[0][1])).argmax())
            for part, key, _, _ in reversed(chain[1:]):
                last[part, key] = state
                state = int((entry[part, key] + model.move[:, to[part, key][state]]).argmax())
            last[chain[0][0], chain[0][1]] = state
    closing = {(c[-1][0], c[-1][1]) for c in chains}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = ["conv_id", "turn", "role_pred", "n_lines", "n_turns", "rendered"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        out: list[tuple] = []
        for key, rows, lines in _runs(batches):
            alpha, back = forward(model, _seen(lines), entry.get((part, key)))
            crosses = (part, key) in last
            path = backward(back, last[part, key] if crosses else int(alpha.argmax()))
            shown = render(lines, path, (part, key) in entry, not crosses or (part, key) in closing)
            out += [(r[0], r[1], role, len(x), n, said) for r, x, (role, n, said) in zip(rows, lines, shown, strict=True)]
            if len(out) > 1024:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return ordered.mapInArrow(decode, "conv_id long, turn long, role_pred string, n_lines long, n_turns long, rendered string")


def as_transcript(rows: DataFrame, conv_id: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """The text column as raw transcripts write it; the style goes by conversation: names, other names, a bare dash, or only a blank line.

    A null or other role is marked as nobody's.
    """
    style = F.pmod(F.xxhash64(F.lit("style"), F.col(conv_id)), F.lit(4))
    who = F.lower(F.col(role).cast("string"))
    name = lambda i: F.coalesce(*(F.when(who == r, F.lit(NAMES[r][i].capitalize())) for r in ROLES))
    mark = F.when(style == 0, F.coalesce(F.concat(name(0), F.lit(": ")), F.lit("- "))).when(style == 1, F.coalesce(F.concat(name(1), F.lit(": ")), F.lit("- "))).when(style == 2, F.lit("- ")).otherwise(F.lit("\n"))
    return rows.withColumn(text, F.concat(F.coalesce(mark, F.lit("- ")), F.coalesce(F.col(text).cast("string"), F.lit(""))))


def held_out(conv_id: str = "conv_id"):
    return F.coalesce(F.crc32(F.col(conv_id).cast("string")) % 3 == 1, F.lit(False))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, held_out, role_pred, n_lines, n_turns, rendered_sha256): learns from the conversations that aren't held out, parses all."""
    raw = as_transcript(conversations)
    got = parse_transcripts(raw, fit(raw.where(~held_out())))
    return got.select("conv_id", "turn", held_out().alias("held_out"), "role_pred", "n_lines", "n_turns", F.sha2("rendered", 256).alias("rendered_sha256"))
