"""Connected components of a link table, as a sequence of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "links") -> DataFrame:
    """(node, root) for every node of ``links``; the root is its component's least node.

    Large-star and small-star steps alternate: each points neighbours at the
    least node seen from one node, until every component is a star. A step is a
    combined minimum and a join on edges; no neighbour list is ever gathered, and
    adaptive execution splits the edges of a hot node. Every round is written
    under the shared folder, which cuts the lineage. Null nodes and links of a
    node to itself are ignored; repeated and reversed links count once.
    """
    edges = staged(
        links.dropna(subset=[a, b]).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct(),
        name,
    )
    while not _stars(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).withColumn("m", F.least("x", "m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, f"{name}-large")
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = (
            large.join(low, F.col("u") == F.col("x")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("x", "m")).distinct()
        )
        edges = staged(small, f"{name}-small")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every upper node has one edge and no node is both an upper and a lower one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
    return not nodes.where("up > 1 or (up > 0 and low > 0)").limit(1).count()
