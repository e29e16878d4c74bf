"""Vector code compression: product codes whose codebooks are trained by exact k-means over metric trees.

Rows are taken in blocks, and in each block the parts of one position form a metric tree by the anchors hierarchy: about sqrt(n) anchors own the points nearest
to them, taking them from older ones with the triangle inequality; anchors are joined two by two to the top (middle-out) and cut again
below.  Every ball keeps its centre, radius, sum and count.  In a round a ball inherits the codebook entries that may own one of its points from the ball
above and strikes off those that can't; a ball with one entry left adds its cached sum and count, and only the leaves that stay contested look at points.
Trees are written once and read by every round; tasks return a sum per entry, so what is shuffled doesn't grow with the rows.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docquarry.llm.common import arrow_limits, stash

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Numbers of a block of vectors, about; points of a leaf at most, unless they are equal.
BLOCK_NUMBERS, LEAF = 1 << 18, 64
#: Share of a distance by which a bound must hold before an entry is struck off: far above what doubles lose.
SURE = 1e-9


@dataclass
class Tree:
    """points: in the order of the leaves; order: their numbers in the block.  Of each ball: its points [start, stop), children (-1 in leaves), centre, radius, sum; depth by depth from the root, number 0."""

    points: np.ndarray
    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        for x in vars(self).values():
            np.save(out, x)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Tree:
        held = io.BytesIO(raw)
        return cls(*(np.load(held) for _ in cls.__dataclass_fields__))


def anchors(points: np.ndarray) -> tuple[list[np.ndarray], int]:
    """(the points that each anchor owns, distances looked at): about sqrt(n) anchors, each the point farthest from its own anchor so far."""
    gap, owner = np.sqrt(((points - points[0]) ** 2).sum(axis=1)), np.zeros(len(points), dtype=np.int64)
    pivots, looked = [points[0]], len(points)
    for _ in range(1, int(np.ceil(np.sqrt(len(points))))):
        far = int(np.argmax(gap))
        if gap[far] == 0:
            break  # only equal points are left together
        new = points[far]
        between = np.sqrt(((np.array(pivots) - new) ** 2).sum(axis=1))
        # a point within half the way from its anchor to the new one can't be nearer to that one
        may = np.flatnonzero(gap > between[owner] / 2)
        distance = np.sqrt(((points[may] - new) ** 2).sum(axis=1))
        looked += len(may)
        go = distance < gap[may]
        owner[may[go]], gap[may[go]] = len(pivots), distance[go]
        pivots.append(new)
    order = np.argsort(owner, kind="stable")
    owned = np.split(order, np.cumsum(np.bincount(owner, minlength=len(pivots)))[:-1])
    # an anchor that is a copy of a later one's place could lose all its points; it is no ball then
    return [x for x in owned if len(x)], looked


def _joined(points: np.ndarray, balls: list) -> tuple:
    """One binary tree (left, right) over balls (numbers, what is below): the two whose common ball is smallest are joined, again and again."""
    n = len(balls)
    count = np.array([len(x[0]) for x in balls], dtype=np.float64)
    centre = np.array([points[x[0]].mean(axis=0) for x in balls])
    radius = np.array([np.sqrt(((points[x[0]] - c) ** 2).sum(axis=1).max()) for x, c in zip(balls, centre, strict=True)])
    balls, alive = list(balls), np.ones(n, dtype=bool)

    def costs(i: int) -> np.ndarray:
        share = (count / (count + count[i]))[:, None]
        middle = centre * share + centre[i] * (1 - share)
        own = np.sqrt(((middle - centre) ** 2).sum(axis=1)) + radius
        other = np.sqrt(((middle - centre[i]) ** 2).sum(axis=1)) + radius[i]
        return np.where(alive & (np.arange(n) != i), np.maximum(own, other), np.inf)

    table = np.array([costs(i) for i in range(n)])
    for _ in range(n - 1):
        i, j = divmod(int(np.argmin(table)), n)
        i, j = min(i, j), max(i, j)
        whole = np.concatenate((balls[i][0], balls[j][0]))
        total = count[i] + count[j]
        centre[i] = (centre[i] * count[i] + centre[j] * count[j]) / total
        count[i], alive[j] = total, False
        radius[i] = np.sqrt(((points[whole] - centre[i]) ** 2).sum(axis=1).max())
        balls[i] = (whole, (balls[i], balls[j]))
        table[j], table[:, j] = np.inf, np.inf
        table[i] = costs(i)
        table[:, i] = table[i]
    return balls[int(np.argmax(alive))]


def build_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """points: whole numbers, a row per point, one at least."""
    real = points.astype(np.float64)

    def below(numbers: np.ndarray) -> tuple:
        """(numbers, None) of a leaf, (numbers, (left, right)) of a ball."""
        if len(numbers) <= leaf:
            return numbers, None
        found, _ = anchors(real[numbers])
        if len(found) == 1:
            return numbers, None
        return _joined(real, [below(numbers[x]) for x in found])

    order, queue, i = np.empty(len(points), dtype=np.int64), [(below(np.arange(len(points))), 0)], 0
    left, right = [], []
    while i < len(queue):
        (numbers, children), start = queue[i]
        left.append(len(queue) if children else -1)
        right.append(len(queue) + 1 if children else -1)
        if children:
            queue += [(children[0], start), (children[1], start + len(children[0][0]))]
        else:
            order[start : start + len(numbers)] = numbers
        i += 1
    start = np.array([at for _, at in queue])
    stop = start + np.array([len(x[0]) for x, _ in queue])
    points, real = points[order], real[order]
    total = np.array([points[a:b].sum(axis=0, dtype=np.int64) for a, b in zip(start, stop, strict=True)])
    centre = total / (stop - start)[:, None]
    radius = np.array([np.sqrt(((real[a:b] - c) ** 2).sum(axis=1).max()) for a, b, c in zip(start, stop, centre, strict=True)])
    return Tree(points, order, start, stop, np.array(left), np.array(right), centre, radius, total)


@dataclass
class Owners:
    """What a codebook makes of a tree's points: counts and sums by entry; entry: of each point, in the tree's order; looked: points that were compared one by one."""

    counts: np.ndarray
    sums: np.ndarray
    entry: np.ndarray
    looked: int


def owners(tree: Tree, book: np.ndarray) -> Owners:
    """Each point's nearest entry (squared Euclidean distance, ties to the lower number), exactly: bounds only strike off what is farther by more than rounding."""
    _, first = np.unique(book, axis=0, return_index=True)
    names = np.sort(first)  # of equal entries the lowest owns all
    whole = book[names]
    real, width = whole.astype(np.float64), whole.shape[1]
    most = max(1, int(np.abs(whole).max(initial=0)), int(np.abs(tree.points).max(initial=0)))
    kind = np.float64 if 4 * width * most * most < 1 << 53 else np.int64  # sums of products are whole numbers that doubles hold, if they are small enough
    points, exact = tree.points.astype(kind), whole.astype(kind)
    norms, between = (exact * exact).sum(axis=1), np.sqrt(((real[:, None, :] - real[None, :, :]) ** 2).sum(axis=2))
    slack = SURE * width * float(most) ** 2
    entry, sums, counts = np.zeros(len(points), dtype=np.int64), np.zeros(book.shape, dtype=np.int64), np.zeros(len(book), dtype=np.int64)
    balls, lists, contested = np.zeros(1, dtype=np.int64), np.ones((1, len(names)), dtype=bool), []
    while len(balls):
        # distances to the ball's centre, less what is the same for all entries
        gap = np.where(lists, (real * real).sum(axis=1) - 2 * tree.centre[balls] @ real.T, np.inf)
        best = np.argmin(gap, axis=1)
        gap -= gap[np.arange(len(balls)), best][:, None]
        lists = lists & (gap <= 2 * tree.radius[balls][:, None] * between[best] * (1 + SURE) + slack)
        alone, leaf = lists.sum(axis=1) == 1, tree.left[balls] < 0
        np.add.at(sums, names[best[alone]], tree.total[balls[alone]])
        np.add.at(counts, names[best[alone]], tree.stop[balls[alone]] - tree.start[balls[alone]])
        for ball, one in zip(balls[alone].tolist(), names[best[alone]].tolist(), strict=True):
            entry[tree.start[ball] : tree.stop[ball]] = one
        for row in np.flatnonzero(leaf & ~alone).tolist():
            mine, may = slice(int(tree.start[balls[row]]), int(tree.stop[balls[row]])), np.flatnonzero(lists[row])
            entry[mine] = names[may[np.argmin(norms[may] - 2 * (points[mine] @ exact[may].T), axis=1)]]
            contested.append(np.arange(mine.start, mine.stop))
        on = ~alone & ~leaf
        lists = np.repeat(lists[on], 2, axis=0)
        balls = np.stack((tree.left[balls[on]], tree.right[balls[on]]), axis=1).reshape(-1)
    looked = np.concatenate(contested) if contested else np.zeros(0, dtype=np.int64)
    np.add.at(sums, entry[looked], tree.points[looked])
    np.add.at(counts, entry[looked], 1)
    return Owners(counts, sums, entry, len(looked))


def _whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x); exact distances need the numbers to be within what 64 bits can square and add."""
    out = np.floor(vectors.astype(np.float64) * SCALE)
    if vectors.size and 4 * vectors.shape[1] * np.abs(out).max() ** 2 >= 2.0**62:
        raise ValueError("vector components are too large for exact distances")
    return out.astype(np.int64)


def usable(embedding: str) -> Column:
    """Neither null nor with a null or non-finite component."""
    return F.col(embedding).isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _table(batch: pa.RecordBatch, width: int) -> np.ndarray:
    own = batch.column("e")
    if batch.num_rows and set(np.diff(own.offsets.to_numpy())) != {width}:
        raise ValueError(f"a vector's length is not {width}")
    return own.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _trees(kept: DataFrame, width: int, parts: int, numbers: int) -> DataFrame:
    """(ids, labels, trees): a row per block of vectors, with a tree for each part position."""
    most, kinds = max(1, numbers // max(1, width)), [kept.schema[c].dataType for c in ("vec_id", "label")]
    lists = [pa.list_(to_arrow_type(x)) for x in kinds]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            whole = _whole(np.concatenate([_table(x, width) for x in held]))
            trees = [build_tree(np.ascontiguousarray(x).astype(np.int32 if np.abs(x).max(initial=0) < 1 << 31 else np.int64)).to_bytes() for x in np.split(whole, parts, axis=1)]
            columns = [pa.array([[v for x in held for v in x.column(c).to_pylist()]], kind) for c, kind in zip(("vec_id", "label"), lists, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([trees], pa.list_(pa.binary()))], names=["ids", "labels", "trees"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = most - sum(x.num_rows for x in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(x.num_rows for x in held) == most:
                    yield made()
                    held = []
        if held:
            yield made()

    names = [x.simpleString() for x in kinds]
    return kept.mapInArrow(of, f"ids array<{names[0]}>, labels array<{names[1]}>, trees array<binary>")


def _sums(books: list[np.ndarray], entries: int, width: int) -> Callable:
    """A task's (part, entry, place, total) over its blocks; place -1 has the count."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(books), entries, width + 1), dtype=np.int64)
        for batch in batches:
            for trees in batch.column("trees").to_pylist():
                for p, raw in enumerate(trees):
                    got = owners(Tree.from_bytes(raw), books[p])
                    total[p, : len(books[p]), 0] += got.counts
                    total[p, : len(books[p]), 1:] += got.sums
        part, entry = np.nonzero(total[:, :, 0])
        flat = total[part, entry]
        columns = [np.repeat(part, width + 1).astype(np.int32), np.repeat(entry, width + 1).astype(np.int32), np.tile(np.arange(-1, width, dtype=np.int32), len(part)), flat.reshape(-1)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["part", "entry", "place", "total"])

    return of


def train(trees: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after so many rounds: each entry becomes floor(sum / count) of its parts, unused ones stay.  A round returns a sum per entry and component."""
    entries, width = books[0].shape
    for _ in range(rounds):
        found = trees.select("trees").mapInArrow(_sums(books, entries, width), "part int, entry int, place int, total long")
        rows = found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()  # parts * entries * (width + 1) rows at most
        counts = {(r[0], r[1]): r[3] for r in rows if r[2] < 0}
        books = [x.copy() for x in books]
        for p, e, at, total in rows:
            if at >= 0:
                books[p][e, at] = total // counts[p, e]
    return books


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block_numbers: int = BLOCK_NUMBERS
) -> tuple[DataFrame, list[np.ndarray]]:
    """((key, label, code, error) of every usable vector, the codebooks of each part position).

    A vector that is null, or holds a null or non-finite component, is left out.  Codebooks start as the parts of the `entries` (256 at most) smallest keys, nulls
    last and repeated keys by their vectors; where there are fewer rows, there are fewer entries.  Repeated rows count and are coded each.  No usable row
    gives an empty table and no codebook.  Vectors of different lengths, a length that isn't a multiple of `parts`, and components too large for
    exact 64-bit distances are errors.  Further columns are ignored.
    """
    spark = vectors.sparkSession
    arrow_limits(spark)
    kept = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("e")).where(usable("e"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "e").limit(entries).select("e").collect()
    schema = f"vec_id {dict(vectors.dtypes)[key]}, label {dict(vectors.dtypes)[label]}, code string, error long"
    if not first:
        return spark.createDataFrame([], schema), []
    width = len(first[0][0])
    if width % parts or len({len(r[0]) for r in first}) > 1 or not 0 < entries <= 256:
        raise ValueError(f"vectors have to be of one length, a multiple of {parts}; entries at most 256")
    books = [np.ascontiguousarray(x) for x in np.split(_whole(np.array([r[0] for r in first]).reshape(len(first), width)), parts, axis=1)]
    trees = stash(_trees(kept, width, parts, block_numbers), "trees")
    books = train(trees, books, rounds)
    return trees.mapInArrow(_codes(books, [kept.schema[c].dataType for c in ("vec_id", "label")]), schema), books


def _codes(books: list[np.ndarray], kinds: list) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, trees in zip(*(batch.column(c).to_pylist() for c in ("ids", "labels", "trees")), strict=True):
                codes, error = np.zeros((len(ids), len(books)), dtype=np.uint8), np.zeros(len(ids), dtype=np.int64)
                for p, raw in enumerate(trees):
                    tree = Tree.from_bytes(raw)
                    entry = owners(tree, books[p]).entry
                    codes[tree.order, p] = entry
                    error[tree.order] += ((tree.points.astype(np.int64) - books[p][entry]) ** 2).sum(axis=1)
                flat, n = codes.tobytes().hex(), 2 * len(books)
                columns = [pa.array(ids, to_arrow_type(kinds[0])), pa.array(labels, to_arrow_type(kinds[1])), pa.array([flat[i : i + n] for i in range(0, len(flat), n)], pa.string()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return of


def decode(codes: DataFrame, books: list[np.ndarray], code: str = "code", into: str = "decoded") -> DataFrame:
    """codes with the vector that each code stands for."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.frombuffer(bytes.fromhex("".join(batch.column(code).to_pylist())), dtype=np.uint8).reshape(batch.num_rows, len(books))
            table = np.concatenate([book[at[:, p]] for p, book in enumerate(books)], axis=1) / SCALE
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * table.shape[1], pa.int32()), pa.array(table.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], names=[*batch.schema.names, into])

    return codes.mapInArrow(of, ", ".join(f"`{c}` {kind}" for c, kind in [*codes.dtypes, (into, "array<double>")]))


def codes_digest(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): label_error is the error summed over the rows of a label, nulls together."""
    found, books = compress(vectors)
    held = stash(found.toDF("vec_id", "label", "code", "error"), "codes")
    totals = stash(held.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")  # written, so that its size decides on the join
    other = totals.select(F.col("label").alias("l"), "label_error")
    return held.join(other, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
