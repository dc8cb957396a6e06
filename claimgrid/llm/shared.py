"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from claimgrid.session import written


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written once under the shared folder and read back; see ``claimgrid.session``."""
    return written(df, name)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
