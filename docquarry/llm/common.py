"""Small helpers that several operators share: shared folders, Arrow batch limits, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch at most.  Texts can be long; a batch must stay small beside a worker's memory.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows; a session that asks for fewer keeps its own setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only on a single machine where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="docquarry-shared-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back, so lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held._stash = path
    return held


def drop_stash(held: DataFrame) -> None:
    """Deletes what stash() wrote, once everything that reads it has been written itself."""
    drop_path(held.sparkSession, held._stash)


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(doc_id: str, text: str) -> Column:
    """Tells apart rows that share a doc_id but not a text; equal rows share it and get equal results."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def pick(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Only id and text, under fixed names: further columns of the input can't clash with an operator's own."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
