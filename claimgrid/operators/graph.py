"""Conflict graph as node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.functions import fixed
from claimgrid.operators.reports import finding_severity


def tier(kind: Column) -> Column:
    chain = F.lit(None).cast("int")
    for name, row in fixed.NODE_TIER.items():
        chain = F.when(kind == name, F.lit(row)).otherwise(chain)
    return chain


def _sides() -> Column:
    """Both claims of a report as array entries."""
    return F.array(
        *(
            F.struct(
                F.concat("conflict_id", F.lit(f"::{mark}")).alias("id"),
                F.col(f"{side}_statement").alias("label"),
            )
            for side, mark in (("l", "a"), ("r", "b"))
        )
    )


def nodes(
    sessions: DataFrame, changes: DataFrame, shown: DataFrame, shown_files: DataFrame
) -> DataFrame:
    """Requirement, change, claim, conflict and file nodes, one row per id."""

    def node(df: DataFrame, id_: Column, kind: str, label: Column, severity: Column | None = None):
        severity = F.lit(None).cast("string") if severity is None else severity
        return df.select(
            "session_id", id_.alias("id"), F.lit(kind).alias("kind"), label.alias("label"),
            severity.alias("severity"),
        )

    claims = shown.select("session_id", F.inline(_sides()))
    files = shown_files.select("session_id", "file_path").distinct()
    parts = [
        node(sessions, F.lit("req-0"), "REQUIREMENT", F.lit("Requirement")),
        node(changes, F.col("change_id"), "CHANGE", F.col("label")),
        node(claims, F.col("id"), "ASSUMPTION", F.col("label")),
        node(shown, F.col("conflict_id"), "CONFLICT", F.col("affected_entity"), finding_severity()),
        node(files, F.concat(F.lit("file:"), "file_path"), "FILE", F.col("file_path")),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("tier", tier(F.col("kind")))


def edges(changes: DataFrame, shown: DataFrame, shown_files: DataFrame) -> DataFrame:
    """Requirement frames change; claim contradicts, file evidences conflict."""

    def edge(df: DataFrame, start: Column, end: Column, label: str) -> DataFrame:
        return df.select(
            "session_id", start.alias("from_id"), end.alias("to_id"), F.lit(label).alias("label")
        )

    claims = shown.select("session_id", "conflict_id", F.inline(_sides()))
    parts = [
        edge(changes, F.lit("req-0"), F.col("change_id"), "frames"),
        edge(claims, F.col("id"), F.col("conflict_id"), "contradicts"),
        edge(shown_files, F.concat(F.lit("file:"), "file_path"), F.col("conflict_id"), "evidences"),
    ]
    return reduce(DataFrame.unionByName, parts)
