"""Pages of PDF files as a Spark data source: partitions are ranges of pages, and only the asked columns are made.

Reading needs PyMuPDF where tasks run (another reader can be set), and paths that Python can open there, such as a shared mount.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Pages of a partition.
PAGES_OF_A_TASK, DPI = 32, 150
#: What each column costs is paid only if it is asked for.
COLUMNS = {
    "raw_text": "string", "width": "double", "height": "double", "blocks": "array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>", "areas": "array<double>", "paths": "int", "pdf_title": "string", "image": "binary",
}
TEXT = ("raw_text", "width", "height", "blocks", "areas", "paths", "pdf_title")


class Pdf(Protocol):
    """An opened file; pages count from 0."""

    n_pages: int

    def value(self, page: int, column: str, dpi: int) -> Any: ...

    def close(self) -> None: ...


class Pymupdf:
    """A file by the public PyMuPDF package."""

    def __init__(self, path: str) -> None:
        try:
            import pymupdf
        except ImportError as e:
            raise RuntimeError("reading PDF needs PyMuPDF") from e
        self.file = pymupdf.open(path)
        self.n_pages = self.file.page_count

    def value(self, page: int, column: str, dpi: int) -> Any:
        p = self.file[page]
        if column == "raw_text":
            return p.get_text()
        if column in ("width", "height"):
            return float(getattr(p.rect, column))
        if column == "blocks":
            return [(b[4].strip(), *map(float, b[:4])) for b in p.get_text("blocks") if b[4].strip()]
        if column == "areas":
            return [abs(float(box.width * box.height)) for image in p.get_images(full=True) for box in p.get_image_rects(image[0])]
        if column == "paths":
            return len(p.get_drawings())
        if column == "pdf_title":
            return (self.file.metadata or {}).get("title") or ""
        return p.get_pixmap(dpi=dpi).tobytes("png")

    def close(self) -> None:
        self.file.close()


@dataclass
class PageRange(InputPartition):
    """Pages [first, stop) of a file, counted from 0."""

    path: str
    first: int
    stop: int


def ranges(files: list[tuple[str, int]], of_a_task: int) -> list[PageRange]:
    return [PageRange(path, at, min(at + of_a_task, n)) for path, n in files for at in range(0, n, of_a_task)]


class PdfSource(DataSource):
    """Options: files (JSON list of [path, pages]), columns (names of COLUMNS, by commas), pages_of_a_task, dpi.  open makes a Pdf of a path."""

    open: Callable[[str], Pdf] = Pymupdf

    @classmethod
    def name(cls) -> str:
        return "docquarry_pdf"

    def columns(self) -> list[str]:
        asked = self.options.get("columns", ",".join(TEXT)).split(",")
        if unknown := set(asked) - set(COLUMNS):
            raise ValueError(f"no column {', '.join(sorted(unknown))} in a PDF's pages")
        return asked

    def schema(self) -> str:
        return "source_filename string, page int, " + ", ".join(f"{c} {COLUMNS[c]}" for c in self.columns())

    def reader(self, schema: StructType) -> DataSourceReader:
        return PdfReader(type(self).open, json.loads(self.options["files"]), self.columns(), int(self.options.get("pages_of_a_task", PAGES_OF_A_TASK)), int(self.options.get("dpi", DPI)))


class PdfReader(DataSourceReader):
    def __init__(self, open_: Callable[[str], Pdf], files: list, columns: list[str], of_a_task: int, dpi: int) -> None:
        self.open, self.files, self.columns, self.of_a_task, self.dpi = open_, files, columns, of_a_task, dpi

    def partitions(self) -> list[PageRange]:
        return ranges([tuple(x) for x in self.files], self.of_a_task)

    def read(self, partition: PageRange) -> Iterator[tuple]:
        pdf = self.open(local_path(partition.path))
        try:
            for page in range(partition.first, partition.stop):
                yield (partition.path.rpartition("/")[2], page + 1, *(pdf.value(page, c, self.dpi) for c in self.columns))
        finally:
            pdf.close()


def local_path(path: str) -> str:
    """A path that Python can open; one of a store that only Spark reads is an error."""
    scheme, _, rest = path.partition(":")
    if "/" not in scheme and rest and scheme != "file":
        raise ValueError(f"{path}: PDF files have to lie where every task can open them")
    return path if scheme != "file" else "/" + rest.lstrip("/")


def page_counts(files: DataFrame, source: type[PdfSource] = PdfSource) -> list[tuple[str, int]]:
    """(path, pages) of each file, counted by tasks."""
    open_ = source.open

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts = []
            for path in frame["path"]:
                pdf = open_(local_path(path))
                counts.append(pdf.n_pages)
                pdf.close()
            yield pd.DataFrame({"path": frame["path"], "n": counts})

    paths = files.select("path").repartition(files.sparkSession.sparkContext.defaultParallelism, "path")
    return sorted((r[0], r[1]) for r in paths.mapInPandas(of, "path string, n int").collect())  # a row per file


def read_pages(files: DataFrame, columns: tuple[str, ...] = TEXT, pages_of_a_task: int = PAGES_OF_A_TASK, dpi: int = DPI, source: type[PdfSource] = PdfSource) -> DataFrame:
    """(source_filename, page from 1, columns) of the files (path); a large file is read by many tasks."""
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(source)
    options = {"files": json.dumps(page_counts(files, source)), "columns": ",".join(columns), "pages_of_a_task": pages_of_a_task, "dpi": dpi}
    return spark.read.format(source.name()).options(**options).load()


def render_pages(files: DataFrame, path_of: Callable, dpi: int = DPI, source: type[PdfSource] = PdfSource) -> DataFrame:
    """(source_filename, page, page_image_path, image): a PNG of every page; path_of: of the two columns, its name."""
    found = read_pages(files, ("image",), dpi=dpi, source=source)
    return found.select("source_filename", "page", path_of(F.col("source_filename"), F.col("page")).alias("page_image_path"), "image")
