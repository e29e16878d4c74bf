"""Incremental ingest: new document files are chunked as they arrive (beyond the batch engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docquarry.operators.chunking import chunk_regulation


def stream_chunks(spark: SparkSession, source: str, schema, sink: str, checkpoint: str) -> StreamingQuery:
    """Chunks of every new Parquet file of articles under `source`, appended to `sink`; exactly once by the checkpoint."""
    articles: DataFrame = spark.readStream.schema(schema).parquet(source)
    return chunk_regulation(articles).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink)
