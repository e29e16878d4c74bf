"""Language ID by hyperdimensional profiles.

Letters are random +1/-1 vectors.  An n-gram is the product (binding) of its letters' vectors, each rotated
(permuted) once for every place before the last; a text is the sum (bundle) of its n-grams; a language's prototype is
the sum of its texts' bundles at unit length.  A document's language is the prototype of the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import arrow_limits

#: Symbols: 0 is any run of non-letters, the rest are letters; letters beyond a-z share the symbols after them.
SYMBOLS = 64
#: n-gram length and vector size.
ORDER, SIZE = 3, 256
#: Labelled documents of each language to learn from, at most.
SAMPLE = 4000
#: A text of so many different n-grams (the square of their number over the sum of their counts' squares) whose largest cosine is under so many times the
#: spread of unrelated vectors' cosines, 1 / sqrt(SIZE), is in no learned language.
MANY, SPREADS = 96, 1.6
#: Code points looked at together; bounds the memory of a very long text.
BLOCK = 1 << 18


def letter_vectors(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), size=(SYMBOLS, SIZE))


def ngram_vectors(letters: np.ndarray) -> np.ndarray:
    """Bound vectors of all trigrams, by code s0*SYMBOLS**2 + s1*SYMBOLS + s2."""
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    pairs = first[:, None, :] * second[None, :, :]
    return (pairs[:, :, None, :] * letters[None, None, :, :]).reshape(-1, SIZE)


def symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 for what isn't a letter."""
    table = np.zeros(0x110000, dtype=np.int32)
    points = np.array([c for c in range(0x110000) if chr(c).isalpha()], dtype=np.int64)
    table[points] = 27 + points % (SYMBOLS - 27)
    table[97:123] = np.arange(1, 27)
    return table


def ngram_counts(text: str, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the trigrams of a text, in lower case, each run of non-letters as one symbol."""
    total = None
    tail = np.zeros(1, dtype=np.int32)
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        s = np.concatenate((tail, symbols[points], [0] if at + BLOCK >= len(text) else [])).astype(np.int32)
        keep = np.ones(len(s), dtype=bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        s = s[keep]
        got = np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**ORDER)
        total = got if total is None else total + got
        tail = s[-2:]
    if total is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    codes = np.flatnonzero(total)
    return codes, total[codes]


class Profiler:
    """Bundles texts."""

    def __init__(self) -> None:
        self.symbols = symbol_table()
        self.vectors = ngram_vectors(letter_vectors())  # a byte each: they stay with the worker

    def unit(self, text: str | None) -> np.ndarray | None:
        """The text's bundle at unit length; None for null and for texts without a letter."""
        return self.look(text)[0]

    def look(self, text: str | None) -> tuple[np.ndarray | None, float]:
        """(unit(), how many different n-grams the text's are worth)."""
        if not text:
            return None, 0.0
        codes, counts = ngram_counts(text, self.symbols)
        keep = codes != 0
        codes, counts = codes[keep], counts[keep].astype(np.float32)
        if not len(codes):
            return None, 0.0
        bundle = counts @ self.vectors[codes].astype(np.float32)
        norm = float(np.linalg.norm(bundle))
        return (bundle / norm if norm else None), float(counts.sum()) ** 2 / float(counts @ counts)


@lru_cache(maxsize=1)
def shared_profiler() -> Profiler:
    """One for each worker process: its table of trigram vectors serves later tasks too."""
    return Profiler()


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def prototypes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from labelled rows that are not held out.

    Of each language about `sample` documents, chosen by a hash of the id (so the number spreads by its root), are read; all of them where
    there are fewer.  Only one sum of SIZE numbers per language reaches the driver.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(~F.coalesce(held_out("doc_id"), F.lit(False)) & F.col("lang").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    share = F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, sample / n))))
    chosen = rows.where(place < share[F.col("lang")])

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, sums = shared_profiler(), {}
        for batch in batches:
            for body, label in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                unit = profiler.unit(body)
                if unit is not None:
                    sums[label] = sums.get(label, 0.0) + np.round(unit.astype(np.float64) * 2**30)
        names = sorted(sums)
        flat = [int(x) for k in names for x in sums[k]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k in names for _ in range(SIZE)], pa.string()), pa.array([i for _ in names for i in range(SIZE)], pa.int32()), pa.array(flat, pa.int64())],
            names=["lang", "place", "total"],
        )

    # whole numbers: sums don't depend on the order of tasks
    summed = chosen.select("text", "lang").mapInArrow(bundles, "lang string, place int, total long").groupBy("lang", "place").agg(F.sum("total").alias("total"))
    made: dict[str, np.ndarray] = {}
    for label, at, total in summed.collect():
        made.setdefault(label, np.zeros(SIZE))[at] = total
    return {k: v / n for k, v in sorted(made.items()) if (n := np.linalg.norm(v))}


def predict(docs: DataFrame, protos: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the language of the largest cosine (ties: the first by name), the cosine as score, 0 at least.

    `und` with score 0 for null texts, texts without a letter, and where nothing was learned.
    """
    arrow_limits(docs.sparkSession)
    names, matrix = sorted(protos), np.array([protos[k] for k in sorted(protos)])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = shared_profiler()
        for batch in batches:
            langs, scores = [], []
            for body in batch.column("text").to_pylist():
                unit = profiler.unit(body) if names else None
                cosine = matrix @ unit.astype(np.float64) if unit is not None else None
                best = int(np.argmax(np.round(cosine, 6))) if cosine is not None else -1
                langs.append(names[best] if best >= 0 else "und")
                scores.append(round(min(1.0, max(0.0, float(cosine[best]))), 4) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(of, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, protos: dict[str, np.ndarray], text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, that predict() doesn't call `und`, a null lang filled with the predicted one; no join, no shuffle.

    Where no language was learned, every document is `und`, so none is left.  Cosines of unrelated vectors spread by 1 / sqrt(SIZE), and a short clean text can lie
    within that; so only texts worth MANY different n-grams are rejected for a cosine, if all of theirs are under SPREADS times the spread.
    """
    arrow_limits(docs.sparkSession)
    names, matrix = sorted(protos), np.array([protos[k] for k in sorted(protos)])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = shared_profiler()
        for batch in batches:
            looked = [profiler.look(x) if names else (None, 0.0) for x in batch.column(text).to_pylist()]
            cosines = [matrix @ u.astype(np.float64) if u is not None else None for u, _ in looked]
            stays = [c is not None and (n < MANY or c.max() >= SPREADS * SIZE**-0.5) for c, (_, n) in zip(cosines, looked, strict=True)]
            filled = [names[int(np.argmax(np.round(c, 6)))] if x is None and c is not None else x for x, c in zip(batch.column(lang).to_pylist(), cosines, strict=True)]
            at = batch.schema.get_field_index(lang)
            yield batch.set_column(at, batch.schema.field(at), pa.array(filled, batch.schema.field(at).type)).filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(of, docs.schema)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from the labelled two thirds, predicts every row from its text alone."""
    got = predict(docs, prototypes(docs, doc_id, text, lang), doc_id, text)
    return got.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
