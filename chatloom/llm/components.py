"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Steps


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of the (u, v) edges; the label is the component's smallest node.

    Each round ties a node's larger neighbours to its smallest one, then its
    smaller ones; the number of rounds grows with the logarithm of the longest
    path. Every round is written, so a lost executor repeats one round at most.
    Loops and repeated edges are allowed; nulls are not nodes.
    """
    steps = Steps(edges.sparkSession)
    edges = edges.filter("u is not null and v is not null and u != v")
    edges = steps.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _fingerprint(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The least neighbours are a table of their own: so the join may split a hub's neighbourhood over tasks.
        lowest = steps.cut(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "large-low")
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u != v").distinct()
        large = steps.cut(large, "large-star")
        lowest = steps.cut(large.groupBy("u").agg(F.min("v").alias("low")), "small-low")
        small = large.join(lowest, "u").filter("v != low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(lowest.select("u", F.col("low").alias("v")))
        edges = steps.cut(small.distinct(), "small-star")
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    return steps.end(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "components")
