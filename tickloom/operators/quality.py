"""Data-quality checks; each returns its measure and a pass flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators.relations import pair_correlations, pair_rows


def known_relationships(returns: DataFrame, bounds: DataFrame, min_obs: int = 100) -> DataFrame:
    """Correlation of the pairs of a table (a, b, lo, hi) against its bounds; too few observations leave the flag null."""
    corr = pair_correlations(returns, bounds.select("a", "b").distinct(), min_obs=min_obs + 1)
    return bounds.join(corr, ["a", "b"]).select("a", "b", "n", "corr", F.col("corr").between(F.col("lo"), F.col("hi")).alias("ok"))


def derived_reconcile(returns: DataFrame, derived: DataFrame, tol: float = 1e-10) -> DataFrame:
    """Largest gap between a derived series' log return and the sum of its parts' on complete dates."""
    wanted = derived.select("derived", F.size("parts").alias("_need"), F.explode("parts").alias("cid"))
    parts = returns.join(wanted, "cid").groupBy("derived", "_need", "date").agg(F.count("*").alias("_n"), F.sum("ret").alias("_s")).where("_n = _need")
    own = returns.select(F.col("cid").alias("derived"), "date", "ret")
    worst = parts.join(own, ["derived", "date"]).groupBy("derived").agg(F.max(F.abs(F.col("ret") - F.col("_s"))).alias("residual"))
    return worst.withColumn("ok", F.col("residual") < tol)


def leaves_match_total(rows: DataFrame, total_route: str, subtotal_routes: list[str], tol: float = 0.5, value: str = "net") -> DataFrame:
    """Largest daily gap between leaf rows and the published total."""
    is_total, leaf = F.col("route") == total_route, ~F.col("route").isin(total_route, *subtotal_routes)
    day = rows.groupBy("date").agg(F.sum(F.when(is_total, F.col(value))).alias("_t"), F.sum(F.when(leaf, F.col(value))).alias("_l"))
    return day.where(F.col("_t").isNotNull()).agg(F.count("*").alias("days"), F.max(F.abs(F.coalesce("_l", F.lit(0.0)) - F.col("_t"))).alias("max_gap")).withColumn(
        "ok", F.col("max_gap") <= tol)


def freshness(rows: DataFrame, key: str, asof, limits: DataFrame | None = None, default: int = 7) -> DataFrame:
    """(key, newest, age, limit, ok): age in days of the newest row of each source, against the source's own limit (key, limit)."""
    newest = rows.groupBy(key).agg(F.max("date").alias("newest"))
    limit = F.lit(default)
    if limits is not None:
        newest, limit = newest.join(limits.select(key, F.col("limit").alias("_limit")), key, "left"), F.coalesce("_limit", F.lit(default))
    age = F.datediff(F.lit(asof).cast("date"), "newest").cast("long")
    return newest.select(key, "newest", age.alias("age"), limit.cast("long").alias("limit"), (age <= limit).alias("ok"))


def date_convention(flow: DataFrame, returns: DataFrame, margin: float = 0.10) -> DataFrame:
    """Does a flow follow the previous session's return rather than the same day's: (n, prev, same, ok)."""
    w = W.partitionBy("cid").orderBy("date")
    rows = returns.withColumn("_p", F.lag("ret").over(w)).join(flow, "date").where(F.col("_p").isNotNull())
    agg = rows.groupBy("cid").agg(F.count("*").alias("n"), F.corr("flow", "_p").alias("prev"), F.corr("flow", "ret").alias("same"))
    return agg.withColumn("ok", F.col("prev") - F.col("same") >= margin)


def buy_sell_net(rows: DataFrame, source: str = "source", tol: float = 0.05, strict_source: str = "nse") -> DataFrame:
    """Rows where buy - sell differs from net, per source, with the severity of the source."""
    bad = F.abs(F.col("buy") - F.col("sell") - F.col("net")) > tol
    agg = rows.groupBy(source).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    return agg.withColumn("severity", F.when(F.col("bad") == 0, "ok").when(F.col(source) == strict_source, "fail").otherwise("warn"))


def session_contamination(returns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Same-day, prior-day and next-day correlation of a with b on the common days of each pair (a, b)."""
    rows = pair_rows(returns, pairs, "ret")
    w = W.partitionBy("a", "b").orderBy("date")
    shifted = rows.withColumns({"_p": F.lag("y").over(w), "_n": F.lead("y").over(w)})
    return shifted.groupBy("a", "b").agg(F.corr("x", "y").alias("same_day"), F.corr("x", "_p").alias("prior_day"), F.corr("x", "_n").alias("next_day"))


def stray_months(rows: DataFrame, part: str = "part") -> DataFrame:
    """Rows per partition whose date lies outside the partition's month."""
    return rows.groupBy(part).agg(F.count("*").alias("n"), F.count_if(F.date_format("date", "yyyy-MM") != F.col(part)).alias("stray"))
