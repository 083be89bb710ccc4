"""Top-k operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_n(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per group with their rank.

    The rank filter becomes a group limit that runs before the shuffle, so each input partition sends
    at most ``n`` rows per group.
    """
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def latest_rows(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The ``k`` first rows of a total order (a take-ordered, no global sort)."""
    return rows.orderBy(*order).limit(k)


def best_by(rows: DataFrame, keys: list[str], what: str, metric: str) -> DataFrame:
    """The entry with the highest metric per key; ties go to the smaller entry."""
    top = F.max_by(F.col(what), F.struct(F.col(metric), -F.col(what)))
    return rows.where(F.col(metric).isNotNull()).groupBy(*keys).agg(top.alias(what), F.max(metric).alias(metric))


def worst_contributions(jumps: DataFrame, before: Column, k: int = 25) -> DataFrame:
    """The ``k`` rows with the lowest contribution before a day, ties by date and name."""
    return latest_rows(jumps.where(F.col("date") < before), [F.asc("contribution"), F.asc("date"), F.asc("cid")], k)
