"""Sources and sinks: corpus listing, front matter, JSON lines, the index layout and its manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import exprs as X

# ---- fixed values: patterns of the front matter
ISSUE, DATE, APPROVAL = r"(?i)Issue\s+(\d+)", r"(?i)Date:\s*(\d{2}/\d{2}/\d{4})", r"(?i)WMSC approval date:\s*(\d{2}/\d{2}/\d{4})"
FILE_SECTION, SECTION_HEADER = r"(?i)section-([a-f])", r"(?m)SECTION\s+([A-F]):\s+(.+?)(?:\s{2,}\S+)?$"


def list_corpus(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, name, length) of the files, without reading them; an empty folder is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    if not found.take(1):
        raise ValueError(f"no {pattern} in {folder}")
    return found


def corpus_hash(files: DataFrame, *by: str) -> DataFrame:
    """16 hex digits over the names and sizes in order of the names, for each group of `by`; contents aren't read.

    The hash runs over one string, so a group is a folder's listing, not a table of documents.
    """
    each = F.array_sort(F.collect_list(F.struct("name", "length")))
    return files.groupBy(*by).agg(F.substring(F.sha1(F.array_join(F.transform(each, lambda x: F.concat(x["name"], x["length"].cast("string"))), "")), 1, 16).alias("corpus_hash"))


def front_matter(text: Column) -> dict[str, Column]:
    """issue_number, publication_date and wmsc_approval_date of a first page."""
    return {"issue_number": X.extract(text, ISSUE).cast("int"), "publication_date": X.iso_date(X.extract(text, DATE)), "wmsc_approval_date": X.iso_date(X.extract(text, APPROVAL))}


def detect_section(name: Column, text: Column) -> Column:
    """By the file's name, else by the header line; null where neither tells."""
    return F.coalesce(F.upper(X.extract(name, FILE_SECTION)), X.extract(text, SECTION_HEADER))


def detect_title(name: Column, text: Column, pdf_title: Column) -> Column:
    header = F.concat(F.lit("SECTION "), X.extract(text, SECTION_HEADER), F.lit(": "), X.strip(X.extract(text, SECTION_HEADER, 2)))
    return F.coalesce(header, F.when(pdf_title != "", X.strip(pdf_title)), F.concat(F.lit("SECTION "), detect_section(name, text)))


def write_jsonl(df: DataFrame, path: str, by: str = "") -> None:
    """by: a column whose values get folders of their own; it stays in the lines, too."""
    if by:
        name = f"of_{by}"
        df = df.withColumn(name, F.col(by)).repartition(name)
    out = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (out.partitionBy(name) if by else out).json(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows that don't fit the schema are an error; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def check_sections(found: DataFrame) -> None:
    """found: (source_filename, section); a file whose section neither its name nor its first page tells is an error."""
    lost = [r[0] for r in found.where("section is null").select("source_filename").limit(5).collect()]
    if lost:
        raise ValueError(f"no section in {', '.join(lost)}")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def save_index(chunks: DataFrame, vectors: DataFrame, path: str, config: dict, more: dict[str, DataFrame] | None = None) -> None:
    """Parquet tables chunks, vectors and `more` in a folder of their own, then one more manifest row that names it.  As many vectors as chunks, and at least one, else an error.

    Readers follow the last manifest row, so a write that fails leaves the index before it as it was.
    """
    spark, at = chunks.sparkSession, uuid.uuid4().hex
    if not chunks.take(1):
        raise ValueError("no chunks: nothing to index")
    write_tables({"chunks": chunks, "vectors": vectors, **(more or {})}, f"{path}/{at}")
    n, m = (spark.read.parquet(f"{path}/{at}/{x}").count() for x in ("chunks", "vectors"))
    if n != m:
        raise ValueError(f"{n} chunks and {m} vectors")
    made = {"config": config, "n_chunks": n, "at": at, "tables": sorted(more or {}), "number": (_manifest(spark, path) or {"number": 0})["number"] + 1}
    spark.createDataFrame([(json.dumps(made, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str) -> dict | None:
    try:
        rows = spark.read.text(f"{path}/manifest").collect()  # a row per save
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return max((json.loads(r[0]) for r in rows), key=lambda x: x["number"])


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(chunks, vectors, the configuration with n_chunks); no index is an error."""
    held = _manifest(spark, path)
    if held is None:
        raise ValueError(f"no index in {path}")
    return spark.read.parquet(f"{path}/{held['at']}/chunks"), spark.read.parquet(f"{path}/{held['at']}/vectors"), held["config"] | {"n_chunks": held["n_chunks"]}


def load_more(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The index's further tables, by name; none for an index that was written without."""
    held = _manifest(spark, path)
    return read_tables(spark, f"{path}/{held['at']}", held.get("tables", ())) if held else {}


def is_current(spark: SparkSession, path: str, config: dict) -> bool:
    """Whether an index with exactly this configuration is there."""
    held = _manifest(spark, path)
    return held is not None and held["config"] == json.loads(json.dumps(config))


CASES = "case_id string, question string, expected_articles array<string>, expected_answer_terms array<string>, answerable boolean, notes string"


def save_cases(cases: DataFrame, path: str) -> None:
    """Evaluation cases as JSON lines."""
    write_jsonl(cases, path)


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines, or from one JSON document with a list `cases` whose ids are `id`; a case without an id or a question is an error."""
    whole = spark.read.option("multiLine", True).json(path)
    if "cases" in whole.columns:
        each = whole.select(F.explode("cases").alias("c")).select("c.*")
        each = each.withColumnRenamed("id", "case_id") if "id" in each.columns else each
        defaults = {"expected_articles": F.array().cast("array<string>"), "expected_answer_terms": F.array().cast("array<string>"), "answerable": F.lit(True), "notes": F.lit(None).cast("string")}
        filled = (F.coalesce(F.col(c), v) if c in each.columns else v for c, v in defaults.items())
        cases = each.select(F.col("case_id").cast("string").alias("case_id"), "question", *(v.alias(c) for c, v in zip(defaults, filled, strict=True)))
    else:
        cases = read_jsonl(spark, path, CASES)
    if cases.where("case_id is null or question is null").limit(1).count():
        raise ValueError(f"{path}: a case without an id or a question")
    return cases


#: An evaluation set to begin with, of our own questions: (id, question, expected articles, expected terms); without articles a question can't be answered.
SEED = (
    ("points", "How many points does the winner of a race get, and how many the others?", ("A2.2",), ("points", "first")),
    ("shutdown", "What may a competitor not do while its factory is shut down?", ("B",), ("shutdown",)),
    ("cost-cap", "Which costs count towards the cost cap?", ("D",), ("cost", "cap")),
    ("fillet", "What is a fillet radius?", ("C3.2.6",), ("fillet", "concave")),
    ("tappings", "How may pressure tappings be fitted?", ("C3.2.7",), ("pressure", "flush")),
    ("entry", "What does an application to enter the championship have to hold?", ("A3.1",), ("entry", "application")),
    ("doping", "Which duties do the anti-doping rules lay down?", ("A4.2",), ("anti-doping",)),
    ("tickets", "What does a ticket for the Monaco race cost?", (), ()),
    ("salary", "How much may a driver earn at most?", (), ()),
)


def seed_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, q, list(a), list(t), bool(a), None) for i, q, a, t in SEED], CASES)
