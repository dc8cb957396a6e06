"""Training-corpus pipeline: documents in, kept documents out.

Each stage is written as Parquet and read again, so a stage starts from what its
predecessor really kept and a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimgrid.llm import decontam, neardup, quality, secrets, transducer
from claimgrid.llm.shared import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules (operator 4)."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the least id (operator 2)."""
    return neardup.keep_one(docs)


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (operator 3)."""
    return decontam.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their live secrets masked and lengths brought up to date (operator 1)."""
    return secrets.masked(docs, length="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives its text back (operator 8)."""
    return transducer.round_trip(docs, ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", reject_poor),
    ("near_duplicates", keep_one_copy),
    ("benchmark_decontamination", drop_benchmarks),
    ("secret_scan", mask_secrets),
    ("bpe_encoding", encode),
]

# The learnt cutoffs, the signatures and the merges can't be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
