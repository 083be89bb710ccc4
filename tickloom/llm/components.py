"""Connected components by alternating stars; every round is a join with minima and a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import materialized


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the edges (u, v) that are not the smallest of their component."""
    edges = materialized(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = _mark(edges)
    while before[0]:
        # larger neighbours of a node move to its smallest neighbour (or to the node itself)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minima(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
        large = materialized(large.filter("u <> v").distinct(), "large")
        # a node and its smaller neighbours move to the smallest of them
        met = large.join(_minima(large), "u")
        small = met.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(met.select("u", F.col("least").alias("v")))
        edges = materialized(small.filter("u <> v").distinct(), "small")
        now = _mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
