"""The registered queries over the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ball_codes, decontam, html_text, langid, licenses, neardup, packed, quality, ranking, secrets, token_counts, transducer, warc,
)
from .oracles import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.report(table(spark, sf_dir, "documents"))
    first = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    return found.select(*first, "n_owned", "n_live", "n_copied", "most_owners", "most_repositories")


def op2_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept", "class_size")


def op3_benchmark_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("reasons", ",").alias("reasons"),
    )


def op5_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.packed(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"))


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.round_trip(table(spark, sf_dir, "documents"))


def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op11_mask_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_codes.coded(table(spark, sf_dir, "embeddings"))


def op13_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_secret_ownership": op1_secret_ownership,
    "op2_bag_minhash": op2_bag_minhash,
    "op3_benchmark_simhash": op3_benchmark_simhash,
    "op4_quality_rules": op4_quality_rules,
    "op5_packed_ids": op5_packed_ids,
    "op6_html_extraction": op6_html_extraction,
    "op7_token_counts": op7_token_counts,
    "op8_bpe_transducer": op8_bpe_transducer,
    "op9_warc_zip": op9_warc_zip,
    "op10_language_id": op10_language_id,
    "op11_mask_ranking": op11_mask_ranking,
    "op12_ball_codes": op12_ball_codes,
    "op13_license_diagonals": op13_license_diagonals,
}
