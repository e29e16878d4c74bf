"""Articles from a stream of lines, with look-ahead, as window functions over stretches of lines.

A document's lines are numbered without gaps and cut into stretches of STRETCH.  Windows run within a stretch; what it takes over from those before it (the
last line that takes none, the open record's number, the last heading) is folded from one small row per stretch.  So a document is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import exprs as X
from docquarry.operators.prefix import running_total
from docquarry.sources.shared import stash

#: Lines of a stretch.
STRETCH = 8192


def line_stream(pages: DataFrame, text: str = "text") -> DataFrame:
    """(source_filename, section, seq, line, page) of the non-contents pages, and their page_label where there is one; seq counts the lines of a document from 1.

    A page's number is its own within its document.  Pages are counted by running totals in two levels; only lines are exploded, never sorted.
    """
    label = [c for c in pages.columns if c == "page_label"]
    kept = pages.where(~F.coalesce(F.col("is_toc"), F.lit(False))).select("source_filename", "section", "page", *label, X.lines(F.col(text)).alias("_lines"))
    sizes = kept.select("source_filename", "page", F.size("_lines").alias("_n")).where("_n > 0")
    first = running_total(sizes, "source_filename", ("page",), "_n", "_first").select("source_filename", "page", "_first")
    each = kept.join(first, ["source_filename", "page"]).select("source_filename", "section", "page", *label, "_first", F.posexplode("_lines").alias("_pos", "line"))
    return each.select("source_filename", "section", (F.col("_first") + F.col("_pos") + 1).cast("int").alias("seq"), "line", "page", *label)


def _carried(stretches: DataFrame, **of: Column) -> DataFrame:
    """(source_filename, _stretch, of): what the stretches before each one leave to it; of: aggregates over those before."""
    before = Window.partitionBy("source_filename").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row per stretch
    return stretches.select("source_filename", "_stretch", *(c.over(before).alias(name) for name, c in of.items()))


def parse_articles(stream: DataFrame, stretch: int = 0) -> DataFrame:
    """(source_filename, section, article_seq, article_number, parent_article, heading, text, page) from line_stream(), with the page_label of
    an article's first page where the lines have it.

    A number takes the next line, whatever it is: as its heading if it reads like one, else as the first line of its text.  An ARTICLE line
    without a heading takes a heading-like next line.  Whether a line may take its successor depends on the two alone; in a run of such
    lines every second one is taken, which its distance to the last line that takes none tells.  A record without a heading has the last heading before it.
    Records with neither text nor heading are dropped.  seq runs from 1 without gaps.
    """
    stretch = stretch or STRETCH
    label, at = [c for c in stream.columns if c == "page_label"], ["source_filename", "_stretch"]
    own = Window.partitionBy(*at).orderBy("seq")
    s = stream.select("source_filename", "section", "seq", "line", "page", *label, F.floor((F.col("seq") - 1) / stretch).alias("_stretch"))
    heads = s.where((F.col("seq") > 1) & ((F.col("seq") - 1) % stretch == 0)).select("source_filename", (F.col("_stretch") - 1).alias("_stretch"), F.col("line").alias("_head"))
    s = s.withColumn("nxt", F.lead("line").over(own)).join(heads, at, "left").withColumn("nxt", F.coalesce("nxt", "_head")).drop("_head")
    s = s.withColumn("kind", X.line_kind(F.col("line")))
    s = s.withColumn("inline", F.when(F.col("kind") == "article", X.strip(F.regexp_extract("line", X.ARTICLE_INLINE, 2))))
    s = s.withColumn("next_heads", X.heading_like(F.col("nxt")))
    takes = (F.col("kind") == "number") | ((F.col("kind") == "article") & (F.col("inline") == "") & F.col("next_heads"))
    s = stash(s.withColumn("takes", F.coalesce(takes & F.col("nxt").isNotNull(), F.lit(False))), "lines")

    takes_none = F.when(~F.col("takes"), F.col("seq"))
    carried = _carried(s.groupBy(*at).agg(F.max(takes_none).alias("_last")), _last=F.max("_last"))
    last = F.max(takes_none).over(own.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("_mine", last).join(carried, at)
    s = s.where((F.col("seq") - 1 - F.coalesce("_mine", "_last", F.lit(0))) % 2 == 0)
    starts, seeded = F.col("kind").isin("article", "number"), (F.col("kind") == "number") & ~F.col("next_heads")
    title = F.when(F.col("kind") == "article", F.when(F.col("inline") != "", F.col("inline")).when(F.col("next_heads"), F.col("nxt"))).when(F.col("kind") == "number", F.when(F.col("next_heads"), F.col("nxt")))
    said = F.when(starts, F.when(seeded, F.col("nxt"))).when(F.col("kind") == "body", F.col("line"))
    number = F.when(starts, F.coalesce(X.extract(F.col("line"), X.ARTICLE_INLINE), X.extract(F.col("line"), X.BARE_NUMBER)))
    s = stash(s.select("source_filename", "section", "seq", "_stretch", "page", *label, starts.alias("starts"), seeded.alias("seeded"), title.alias("title"), said.alias("said"), number.alias("number")), "kept")

    sums = s.groupBy(*at).agg(F.sum(F.col("starts").cast("int")).alias("_n"), F.max_by("title", F.when(F.col("title").isNotNull(), F.col("seq"))).alias("_title"))
    carried = _carried(sums, _records=F.sum("_n"), _heading=F.last("_title", ignorenulls=True))
    up_to = own.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({"_n": F.sum(F.col("starts").cast("int")).over(up_to), "_title": F.last("title", ignorenulls=True).over(up_to)}).join(carried, at)
    s = s.withColumns({"record": F.coalesce("_records", F.lit(0)) + F.col("_n"), "last_title": F.coalesce("_title", "_heading")}).where("record > 0")
    first = lambda c: F.max(F.when(F.col("starts"), c))
    heading = F.when(F.col("seeded"), F.col("last_title")).otherwise(F.col("title"))
    made = s.groupBy("source_filename", "section", "record").agg(
        *(first(F.col(c)).alias(c) for c in label), first(F.col("number")).alias("article_number"), first(heading).alias("heading"), first(F.col("page")).alias("page"),
        F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("seq", "said")))).alias("said"),
    )
    text = X.strip(F.array_join(F.transform("said", lambda x: x["said"]), "\n"))
    made = made.withColumn("text", text).where((F.col("text") != "") | (F.coalesce("heading", F.lit("")) != ""))
    return made.select("source_filename", "section", F.col("record").cast("int").alias("article_seq"), "article_number", X.parent_of(F.col("article_number")).alias("parent_article"), "heading", "text", "page", *label)
