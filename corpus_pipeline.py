"""The training-data pipeline: five stages over ``documents``, each written and read again.

1. quality: documents that the quality classifier rejects go.
2. near_duplicates: one document of each group of near copies stays.
3. decontaminate: documents with benchmark passages go.
4. secrets: secrets are replaced in the texts; ``n_chars`` follows.
5. packing: the texts are packed into training sequences, one row per sequence.

All stages but the last return the columns of their input. Nothing here can be
said in SQL, so ORACLE_SQL is None; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from creditloom.llm import decontaminate, packing, quality_trees, secret_scan, setsketch
from creditloom.session import scratch_path


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_trees.keep_good(docs, spark.read.parquet(f"{sf_dir}/documents.parquet"),
                                   spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setsketch.keep_one(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", _quality),
    ("near_duplicates", _near_duplicates),
    ("decontaminate", _decontaminate),
    ("secrets", _secrets),
    ("packing", _packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table; what each returns is written and read by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        out = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir.rstrip("/")).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
