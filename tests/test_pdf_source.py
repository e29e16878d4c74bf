"""The PDF source with a made-up reader: plans by page range, asked columns only, rendered pages."""

import sys

import pytest
from docquarry.plans import engine
from docquarry.sources import pdf
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Made:
    """A file of as many pages as its bytes say; refuses what wasn't asked for."""

    def __init__(self, path: str) -> None:
        with open(path) as f:
            self.n_pages, self.may = (x for x in f.read().split())
        self.n_pages, self.name = int(self.n_pages), path.rpartition("/")[2]

    def value(self, page: int, column: str, dpi: int):
        if column not in self.may.split(","):
            raise AssertionError(f"{column} wasn't asked for")
        return {"raw_text": f"{self.name} page {page}", "width": 500.0, "height": 800.0, "blocks": [(f"line {page}", 1.0, 2.0, 3.0, 4.0)], "areas": [2.5], "paths": page, "pdf_title": "T", "image": f"{dpi}:{page}".encode()}[column]

    def close(self) -> None:
        pass


class MadeSource(pdf.PdfSource):
    open = Made

    @classmethod
    def name(cls) -> str:
        return "made_pdf"


@pytest.fixture
def files(spark, tmp_path):
    (tmp_path / "section-a.pdf").write_text("1000 raw_text,image")
    (tmp_path / "section-b.pdf").write_text("3 " + ",".join(pdf.COLUMNS))
    (tmp_path / "section-c.pdf").write_text("0 raw_text")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(str(tmp_path)).select("path", "length")


def test_ranges():
    assert [(x.path, x.first, x.stop) for x in pdf.ranges([("a", 5), ("b", 0), ("c", 2)], 2)] == [("a", 0, 2), ("a", 2, 4), ("a", 4, 5), ("c", 0, 2)]


def test_a_large_file_is_read_by_many_tasks(spark, files):
    assert [n for _, n in pdf.page_counts(files, MadeSource)] == [1000, 3, 0]
    got = pdf.read_pages(files, ("raw_text",), 32, source=MadeSource)
    assert got.rdd.getNumPartitions() == 32 + 1 and got.columns == ["source_filename", "page", "raw_text"]
    by = {(r["source_filename"], r["page"]): r["raw_text"] for r in got.collect()}
    assert len(by) == 1003 and by["section-a.pdf", 1000] == "section-a.pdf page 999" and by["section-b.pdf", 1] == "section-b.pdf page 0"


def test_all_columns(spark, files):
    (row,) = pdf.read_pages(files.where("path like '%section-b.pdf'"), tuple(pdf.COLUMNS), source=MadeSource).where("page = 3").collect()
    assert row.asDict(recursive=True) == {
        "source_filename": "section-b.pdf", "page": 3, "raw_text": "section-b.pdf page 2", "width": 500.0, "height": 800.0, "blocks": [{"text": "line 2", "x0": 1.0, "y0": 2.0, "x1": 3.0, "y1": 4.0}],
        "areas": [2.5], "paths": 2, "pdf_title": "T", "image": b"150:2",
    }
    with pytest.raises(Exception, match="no column nothing"):
        pdf.read_pages(files, ("nothing",), source=MadeSource)


def test_rendered_pages(spark, files):
    got = pdf.render_pages(files, engine.image_path, 72, MadeSource).where("page in (1, 1000)").orderBy("source_filename", "page").collect()
    assert [tuple(r) for r in got] == [("section-a.pdf", 1, "section-a/page-001.png", b"72:0"), ("section-a.pdf", 1000, "section-a/page-1000.png", b"72:999"), ("section-b.pdf", 1, "section-b/page-001.png", b"72:0")]


def test_paths_and_the_missing_package(spark, files):
    assert pdf.local_path("file:///a/b.pdf") == pdf.local_path("file:/a/b.pdf") == pdf.local_path("/a/b.pdf") == "/a/b.pdf"
    with pytest.raises(ValueError, match="every task can open"):
        pdf.local_path("hdfs://host/a.pdf")
    assert issubclass(pdf.PdfSource, DataSource)
    with pytest.raises(Exception, match="PyMuPDF"):
        pdf.read_pages(files).count()
    assert files.where(F.col("length") == 0).count() == 0
