"""Connected components of large edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, table



def _hook(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: (u, v) with u > v in, the same form out."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = both.join(low, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none: then that is the smallest of its component."""
    several = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
    chained = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
    return several.union(chained).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node that node reaches; every node of edges (src, dst) is there.

    Alternating large-star and small-star steps. Each step is a partial aggregation
    and a join on the node, whose hot keys Spark splits; no component is gathered.
    """
    now = table(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u > v").distinct(),
        "edges",
    )
    while not _settled(now):  # edges only ever get smaller ends, so this ends
        last, now = now, table(_hook(_hook(now, True), False), "edges")
        forget(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
