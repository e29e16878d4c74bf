"""A corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, BPE token ids.

Each stage reads all that the stage before it kept, written as Parquet in the cluster's shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.bpe_stream import encode_checked
from docquarry.llm.common import drop_path, shared_dir, table
from docquarry.llm.decontam import drop_contaminated
from docquarry.llm.langid_hd import keep_identified, prototypes
from docquarry.llm.line_bitmaps import drop_repeated_lines
from docquarry.llm.simhash_golay import keep_one_of_each


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what op6 calls `und` (documents without a letter, and all where no language was learned) and long texts that are near no learned language; a null lang becomes the predicted one."""
    return keep_identified(docs, prototypes(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines of 40 characters or more that five documents share out of all but the last of them."""
    return drop_repeated_lines(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256)."""
    import public_tokenizers

    return encode_checked(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: SQL can express neither the language model nor the fingerprints' XXH64; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        if before:
            drop_path(spark, before)  # read by this stage alone
        before = f"{at}/{name}"
        docs = spark.read.parquet(before)
    return docs
