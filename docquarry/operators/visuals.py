"""Detectors of visual pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: thresholds and signs of the detectors
MATH_SIGNS = "=≤≥±×÷√∑∫∂∞≈≠→←°µΩπλ"
SUPERSCRIPT = r"\b\w\^?-?\d\b"
DRAWING_PATHS, ALIGNED_ROWS, COLUMN_WIDTH, ROW_HEIGHT, IMAGE_SHARE = 40, 4, 40, 12, 0.03


def table_pages(blocks: DataFrame) -> DataFrame:
    """(source_filename, page, has_table) from blocks (source_filename, page, x0, y0): at least eight blocks and four rows of two columns."""
    cells = blocks.select("source_filename", "page", F.floor(F.col("x0") / COLUMN_WIDTH).alias("c"), F.floor(F.col("y0") / ROW_HEIGHT).alias("r"))
    rows = cells.groupBy("source_filename", "page", "r").agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("c").alias("most"))
    pages = rows.groupBy("source_filename", "page").agg(F.sum("n").alias("n"), F.sum((F.col("least") != F.col("most")).cast("int")).alias("wide"))
    return pages.select("source_filename", "page", ((F.col("n") >= 2 * ALIGNED_ROWS) & (F.col("wide") >= ALIGNED_ROWS)).alias("has_table"))


def has_equation(text: Column) -> Column:
    """Three mathematical signs, or one with three superscript-like tokens."""
    text = F.coalesce(text, F.lit(""))
    signs = F.length(F.regexp_replace(text, f"[^{MATH_SIGNS}]", ""))
    return (signs >= 3) | ((signs >= 1) & (F.regexp_count(text, F.lit(SUPERSCRIPT)) >= 3))


def has_image(areas: Column, page_area: Column) -> Column:
    """An image of at least three hundredths of the page; a page without area counts as covered."""
    share = lambda a: F.when(page_area == 0, 1.0).otherwise(a / page_area)
    return F.exists(areas, lambda a: share(a) >= IMAGE_SHARE)


def kinds(image: Column, paths: Column, table: Column, equation: Column) -> Column:
    """The ordered kinds of a page; many drawing paths are a diagram and a drawing."""
    drawn = paths >= DRAWING_PATHS
    pairs = (("image", image), ("diagram", drawn), ("drawing", drawn), ("table", table), ("equation", equation))
    return F.array_compact(F.array(*(F.when(on, F.lit(name)) for name, on in pairs)))


def visual_pages(pages: DataFrame) -> DataFrame:
    """(source_filename, page, kinds) of pages (source_filename, page, raw_text, blocks; width and height, areas of images and paths of drawings where there are any)."""
    has = set(pages.columns)
    wide = {"x0", "y0"} <= set(pages.schema["blocks"].dataType.elementType.names)
    areas = F.coalesce("areas", F.array().cast("array<double>")) if "areas" in has else F.array().cast("array<double>")
    paths = F.coalesce("paths", F.lit(0)) if "paths" in has else F.lit(0)
    size = F.col("width") * F.col("height") if {"width", "height"} <= has else F.lit(0.0)
    own = pages.select("source_filename", "page", has_image(areas, size).alias("image"), paths.alias("paths"), has_equation(F.col("raw_text")).alias("equation"))
    if wide:
        tables = table_pages(pages.select("source_filename", "page", F.explode("blocks").alias("b")).select("source_filename", "page", "b.x0", "b.y0"))
        own = own.join(tables, ["source_filename", "page"], "left")
    table = F.coalesce("has_table", F.lit(False)) if wide else F.lit(False)
    return own.select("source_filename", "page", kinds(F.col("image"), F.col("paths"), table, F.col("equation")).alias("kinds"))
