"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return
the columns of `documents`, and those of other names that the table may have.

Defined results: null and empty texts fail the base rules and go in the first stage; a null id, source or language is
kept; of repeated rows and near copies the row of the smallest id stays; a text of any length is one document; an empty
table gives no rows, from each stage and from all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, packing, pii, quality_rules, simhash
from tallyframe.llm.common import ensure_checkpoint_dir, read, release_memory


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id, rows without id last."""
    return simhash.dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, without their benchmark passages."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("decontamination", benchmark), ("pii", personal_data), ("packing", pack)]

#: SQL cannot express the models, fingerprints and packing; tests/llm/test_pipeline.py compares the stages with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. Each stage's result is written as Parquet in the shared folder and read again."""
    import uuid

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release_memory()
    return docs
