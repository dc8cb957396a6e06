"""Keys that come more than once, told from all others by their hashes.

Where few keys come twice, the rows of all others need no shuffle: only hashes are
counted, and the few are sent to the rows. Two keys that share a hash are taken for one
that comes twice, so the step that follows must be right for any rows it gets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrid.session import stage

# Rows of keys (some numbers or short texts each) that are broadcast at most.
FEW = 500_000


def few(rows: DataFrame) -> bool:
    """Whether the counted rows may be broadcast."""
    return rows.limit(FEW + 1).count() <= FEW


def split(rows: DataFrame, key: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows that have their key alone, and those that may share it; None for a part without rows.

    ``rows`` are read up to three times, at once and later, so callers hand in what is
    stored. All rows are in the second part if more than ``FEW`` keys come twice, or if
    the session names no folder for staged tables and nothing is stored.
    """
    if not rows.sparkSession.conf.get("spark.checkpoint.dir", None):
        return None, rows
    key_hash = F.xxhash64(*key)
    counted = rows.groupBy(key_hash.alias("key_hash")).count().filter("count > 1").select("key_hash")
    repeated = stage(counted, "repeated")
    if repeated.isEmpty():
        return rows, None
    if not few(repeated):
        return None, rows
    hashed, marks = rows.withColumn("key_hash", key_hash), F.broadcast(repeated)
    return tuple(hashed.join(marks, "key_hash", how).drop("key_hash") for how in ("left_anti", "left_semi"))


def one_per_key(rows: DataFrame, key: list[str], pick: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``pick(rows)``, which leaves one row of each key as it is, run on the rows that may share their key only."""
    alone, shared = split(rows, key)
    if shared is None:
        return alone
    return pick(shared) if alone is None else alone.unionByName(pick(shared))
