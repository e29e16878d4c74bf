"""The cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only on a single machine where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="docquarry-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: computed once, whatever reads it and whichever executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one Arrow batch at most: what a batch's tables and texts take in a worker doesn't grow with the partition.
ARROW_ROWS = 1024


def arrow_limits(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows; a session that asks for fewer keeps its own setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
