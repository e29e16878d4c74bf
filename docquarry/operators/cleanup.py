"""Cleanup of raw pages: recurring headers and footers, fixed boilerplate, tables of contents.

Pages: source_filename, page (1-based), raw_text, height, blocks array<struct<text, y0, y1>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import exprs as X

TOP, BOTTOM, MIN_CHARS, MIN_BARE_INTS = 0.10, 0.90, 6, 5
CONTENTS = r"(?im)^\s*CONTENTS"
THREE_LEVEL = r"^\s*[A-F]\d+\.\d+\.\d+\b"


def in_band(y0: Column, y1: Column, height: Column) -> Column:
    """At the top or bottom of the page; a page without height has no bands."""
    at = lambda y: F.when(height == 0, 0.5).otherwise(y / height)
    return (at(y0) <= TOP) | (at(y1) >= BOTTOM)


def recurring_lines(pages: DataFrame, min_fraction: float = 0.5) -> DataFrame:
    """(source_filename, norm, n_pages): lines in a band on at least max(2, int(pages * min_fraction)) pages.

    Counted in two steps: a line once for each page, then pages for each line; only text of the bands is shuffled.
    """
    block = pages.select("source_filename", "page", "height", F.explode("blocks").alias("b")).where(in_band(F.col("b.y0"), F.col("b.y1"), F.col("height")))
    norms = block.select("source_filename", "page", F.explode(X.lines(F.col("b.text"))).alias("line")).select("source_filename", "page", X.normalize_line(F.col("line")).alias("norm"))
    counts = norms.where(F.length("norm") >= MIN_CHARS).distinct().groupBy("source_filename", "norm").agg(F.count("*").alias("n_pages"))
    totals = pages.groupBy("source_filename").agg(F.greatest(F.lit(2), (F.count("*") * F.lit(min_fraction)).cast("int")).alias("least"))
    return counts.join(totals, "source_filename").where("n_pages >= least").select("source_filename", "norm", "n_pages")


def page_lines(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """(source_filename, page, pos, line) of the stripped lines that aren't empty."""
    return pages.select("source_filename", "page", F.posexplode(X.lines(F.col(text))).alias("pos", "line"))


def split_boilerplate(pages: DataFrame, min_fraction: float = 0.5) -> DataFrame:
    """page_lines() with `removed`: recurring anywhere on the page, or fixed boilerplate."""
    lines = page_lines(pages).withColumn("norm", X.normalize_line(F.col("line")))
    again = recurring_lines(pages, min_fraction).select("source_filename", "norm", F.lit(True).alias("again"))
    joined = lines.join(again, ["source_filename", "norm"], "left")
    return joined.select("source_filename", "page", "pos", "line", (F.coalesce("again", F.lit(False)) | X.is_boilerplate(F.col("line"))).alias("removed"))


def toc_signal(text: Column, lines: Column | None = None) -> Column:
    """A CONTENTS line, or five lines or more that are bare numbers; lines: the text's, where they are known."""
    return text.rlike(CONTENTS) | (F.size(F.filter(X.lines(text) if lines is None else lines, lambda x: x.rlike(X.BARE_INT))) >= MIN_BARE_INTS)


def body_start(pages: DataFrame) -> DataFrame:
    """(source_filename, body_start): the first page with a three-level number, else 1."""
    has = F.exists(X.lines(F.col("raw_text")), lambda x: x.rlike(THREE_LEVEL))
    return pages.groupBy("source_filename").agg(F.coalesce(F.min(F.when(has, F.col("page"))), F.lit(1)).alias("body_start"))


def toc_pages(pages: DataFrame) -> DataFrame:
    """(source_filename, page, is_toc): pages with the signal before the body."""
    joined = pages.join(body_start(pages), "source_filename")
    return joined.select("source_filename", "page", ((F.col("page") < F.col("body_start")) & toc_signal(F.col("raw_text"))).alias("is_toc"))


def clean_pages(pages: DataFrame, min_fraction: float = 0.5) -> DataFrame:
    """(source_filename, page, page_label, text, is_toc, removed_lines), a row per page.

    A page is cut into lines once and cleaned within its row: only a document's recurring lines and its body's first page are joined to it, so no line is
    shuffled.  A document's recurring lines are at most those that its bands hold, divided by the pages that each of them is on.
    """
    again = recurring_lines(pages, min_fraction).groupBy("source_filename").agg(F.collect_list("norm").alias("_again"))
    own = pages.select("source_filename", "page", "raw_text").join(body_start(pages), "source_filename").join(again, "source_filename", "left").withColumn("_lines", X.lines(F.col("raw_text")))
    removed = lambda x: F.coalesce(F.array_contains("_again", X.normalize_line(x)), F.lit(False)) | X.is_boilerplate(x)
    is_toc = (F.col("page") < F.col("body_start")) & toc_signal(F.col("raw_text"), F.col("_lines"))
    marked = own.select("source_filename", "page", X.label_among(F.col("_lines")).alias("page_label"), is_toc.alias("is_toc"), F.transform("_lines", lambda x: F.struct(x.alias("line"), removed(x).alias("removed"))).alias("all"))
    pick = lambda removed: F.transform(F.filter("all", lambda x: x["removed"] == removed), lambda x: x["line"])
    return marked.select("source_filename", "page", "page_label", X.strip(F.array_join(pick(False), "\n")).alias("text"), "is_toc", pick(True).alias("removed_lines"))
