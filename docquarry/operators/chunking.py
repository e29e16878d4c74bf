"""Chunks of articles: overlapping word windows with ids, labels and offsets.

Articles: source_filename, section, article_seq, article_number, parent_article, heading, text, page; optional page_label.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from docquarry.functions import exprs as X
from docquarry.functions.words import Words
from docquarry.operators.prefix import running_total
from docquarry.sources.shared import arrow_limits

CHUNK_TOKENS, OVERLAP_TOKENS = 350, 60
#: Texts that are cut at a time: their bytes stay in a core's cache.
BLOCK = 64


def window_shape(tokens: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> tuple[int, int]:
    """(words of a window, step)."""
    most = max(1, int(tokens / X.WORDS_PER_TOKEN))
    return most, most - min(max(0, int(overlap / X.WORDS_PER_TOKEN)), most - 1)


def pieces(text: Column, tokens: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """Windows of a text: the text itself if it fits in one, else blank-joined words at every step until the words end."""
    most, step = window_shape(tokens, overlap)

    def cut(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(step)), lambda i: F.array_join(F.slice(w, i + 1, most), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) <= most, F.array(text)).otherwise(windows)

    # bound as a variable, so that a text is split once and not for each window
    return F.element_at(F.transform(F.array(X.words(text)), cut), 1)


def cut_pieces(df: DataFrame, text: str = "text", tokens: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """df without its text, a row for each of pieces(): chunk_index, piece and n_words, its number of words.  Texts are cut by bytes, a batch at a time."""
    arrow_limits(df.sparkSession)
    most, step = window_shape(tokens, overlap)
    kept = [x for x in df.schema if x.name != text]
    schema = StructType([*kept, StructField("chunk_index", IntegerType()), StructField("piece", StringType()), StructField("n_words", IntegerType())])
    kinds = [to_arrow_type(x.dataType) for x in schema]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, BLOCK) for whole in batches for at in range(0, whole.num_rows, BLOCK)):
            words, texts = Words(batch.column(text)), batch.column(text).cast(pa.large_binary())
            row, number, piece, size = [], [], [], []
            for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                starts = range(a, b, step) if b - a > most else range(a, b, most)
                for k, start in enumerate(starts):
                    stop = min(start + most, b)
                    row.append(i)
                    number.append(k)
                    piece.append(words.joined(start, stop) if b - a > most else texts[i].as_py())
                    size.append(stop - start)
            own = [batch.column(x.name).take(pa.array(row, pa.int32())) for x in kept]
            made = pa.array(number, pa.int32()), pa.array(piece, pa.binary()).view(pa.string()), pa.array(size, pa.int32())
            yield pa.RecordBatch.from_arrays([x.cast(k) for x, k in zip((*own, *made), kinds, strict=True)], names=schema.names)

    return df.mapInArrow(cut, schema)


def offsets(text: Column, parts: Column) -> Column:
    """(start, stop) of each piece: its first 40 characters are sought from the end of the last piece; without a find it begins there."""
    empty = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<struct<char_start:int,char_end:int>>").alias("found"))

    def step(state: Column, part: Column) -> Column:
        at = F.call_function("locate", F.substring(part, 1, 40), text, state["cursor"] + 1)
        start = F.when(at > 0, at - 1).otherwise(state["cursor"])
        stop = start + F.length(part)
        return F.struct(F.greatest(state["cursor"], stop - 1).alias("cursor"), F.concat(state["found"], F.array(F.struct(start.cast("int").alias("char_start"), stop.cast("int").alias("char_end")))).alias("found"))

    return F.aggregate(parts, empty, step, lambda s: s["found"])


def _finish(df: DataFrame, article_key: Column) -> DataFrame:
    label = F.col("page_label") if "page_label" in df.columns else F.lit(None).cast("string")
    return df.select(
        X.chunk_id(F.col("source_filename"), article_key, F.col("chunk_index")).alias("chunk_id"), "source_filename", "section", "article_seq", "article_number", "parent_article",
        F.col("heading").alias("article_heading"), "page", label.alias("page_label"), "chunk_index", F.col("piece").alias("text"), "char_start", "char_end",
        (X.token_estimate(F.col("piece")) if "n_words" not in df.columns else X.tokens_of(F.col("n_words"))).alias("token_estimate"), X.citation_label(F.col("article_number"), F.col("section"), label, F.col("page")).alias("label"),
    )


def chunk_regulation(articles: DataFrame, tokens: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, places: bool = True) -> DataFrame:
    """Chunks of each article with text; the index starts anew for each article.  Without `places` their offsets aren't sought and there are no such columns."""
    if not places:
        none = F.lit(None).cast("int")
        each = cut_pieces(articles, "text", tokens, overlap).withColumns({"char_start": none, "char_end": none})
        return _finish(each, F.col("article_number")).drop("char_start", "char_end")
    parts = articles.withColumn("parts", pieces(F.col("text"), tokens, overlap))
    parts = parts.withColumn("places", offsets(F.col("text"), F.col("parts")))
    each = parts.select("*", F.posexplode(F.arrays_zip("parts", "places")).alias("chunk_index", "x"))
    each = each.withColumns({"piece": F.col("x.parts"), "char_start": F.col("x.places.char_start"), "char_end": F.col("x.places.char_end")})
    return _finish(each, F.col("article_number"))


def chunk_fixed_window(articles: DataFrame, tokens: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Windows over the words of a whole document, whatever the articles; a window belongs to the article of its first word.

    Word numbers come from running totals of article lengths in two levels (see running_total()), so a document is never gathered, nor one task's work: each
    article sends its stretch of words to the windows that it overlaps.  An article's number is its own within its document.
    """
    most, step = window_shape(tokens, overlap)
    sizes = articles.select("source_filename", "article_seq", F.size(X.words(F.col("text"))).alias("size")).where("size > 0")
    # over lengths alone; texts are joined to them, not sorted
    sizes = running_total(sizes, "source_filename", ("article_seq",), "size", "first").select("source_filename", "article_seq", "first")
    w = articles.join(sizes, ["source_filename", "article_seq"])

    def cut(w: Column) -> Column:
        first, end = F.col("first"), F.col("first") + F.size(w)
        low = F.greatest(F.lit(0).cast("long"), F.floor((first - most) / step) + 1)
        high = F.floor((end - 1) / step)

        def part(i: Column) -> Column:
            start = F.greatest(i * step, first)
            within = (start - first + 1).cast("int"), (F.least(i * step + most, end) - start).cast("int")
            return F.struct(i.cast("int").alias("win"), F.array_join(F.slice(w, *within), " ").alias("said"))

        return F.when(low <= high, F.transform(F.sequence(low, high), part))

    label = F.col("page_label") if "page_label" in articles.columns else F.lit(None).cast("string")
    # an article's windows are cut within its row, so that no row holds the words of the whole article beside a window
    parts = F.element_at(F.transform(F.array(X.words(F.col("text"))), cut), 1)
    few = [F.col("first"), *map(F.col, ("source_filename", "section", "article_seq", "article_number", "parent_article", "heading", "page")), label.alias("page_label")]
    each = w.select(*few, parts.alias("parts")).select("*", F.explode("parts").alias("part")).drop("parts")
    each = each.select("source_filename", "section", "part.win", F.struct("first", "article_seq", "article_number", "parent_article", "heading", "page", "page_label", "part.said").alias("x"))
    made = each.groupBy("source_filename", "section", "win").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    head = lambda name: F.element_at("xs", 1)[name].alias(name)
    made = made.select("source_filename", "section", F.col("win").alias("chunk_index"), *(head(n) for n in ("article_seq", "article_number", "parent_article", "heading", "page", "page_label")), F.array_join(F.transform("xs", lambda x: x["said"]), " ").alias("piece"))
    made = made.withColumns({"char_start": F.lit(None).cast("int"), "char_end": F.lit(None).cast("int")})
    return _finish(made, F.concat(F.lit("fw:"), F.col("article_number")))


def with_page_images(chunks: DataFrame, visuals: DataFrame) -> DataFrame:
    """Chunks with the image of their page, null where there is none; visuals: source_filename, page, page_image_path."""
    return chunks.join(visuals.select("source_filename", "page", "page_image_path"), ["source_filename", "page"], "left")


def id_collisions(chunks: DataFrame) -> DataFrame:
    """Chunk ids that several chunks share."""
    return chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1")
