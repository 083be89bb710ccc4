"""Two-series statistics: correlations, regimes, lead-lag with robust errors.

The keys come from the data and may be many: sums of pairs are products of blocks of keys over stretches of dates,
and nothing is emitted per pair and day but where that is the answer.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators.series import full_window
from tickloom.session import materialized


BLOCK_KEYS, BLOCK_DATES = 64, 512
SUMS = "n", "x", "y", "xx", "yy", "xy"


def all_pairs(keys: DataFrame, key: str = "cid") -> DataFrame:
    """(a, b): every pair of a table's keys once, a before b.

    The number of pairs is that of the answer; a key meets the keys after it in blocks, not in one task."""
    spots = keys.select(F.col(key).alias("k")).distinct().withColumn("block", F.pmod(F.xxhash64("k"), F.lit(BLOCK_KEYS)).cast("int"))
    left = spots.select(F.col("k").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(BLOCK_KEYS - 1))).alias("block"))
    return left.join(spots.withColumnRenamed("k", "b"), "block").where("a < b").select("a", "b")


def _products(n_keys: int, n_dates: int):
    """Both blocks of keys over one stretch of dates -> the six sums of every pair of keys, each as one array."""

    def tile(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        values, present = np.zeros((n_dates, n_keys)), np.zeros((n_dates, n_keys))
        values[rows["at"], rows["spot"]] = rows["v"]
        present[rows["at"], rows["spot"]] = 1.0
        return values, present

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        left, has_left = tile(rows[rows["block"] == first["low"]])
        right, has_right = tile(rows[rows["block"] == first["high"]])
        sums = has_left.T @ has_right, left.T @ has_right, has_left.T @ right, (left * left).T @ has_right, has_left.T @ (right * right), left.T @ right
        return pd.DataFrame({"label": [first["label"]], "low": [first["low"]], "high": [first["high"]], "sums": [np.concatenate([s.ravel() for s in sums])]})

    return run


def _added(parts: pd.DataFrame) -> pd.DataFrame:
    first = parts.iloc[[0]][["label", "low", "high"]]
    return first.assign(sums=[np.sum(np.stack(parts["sums"].to_list()), axis=0)])


def pair_sums(series: DataFrame, value: str = "ret", pairs: DataFrame | list[tuple[str, str]] | None = None, by: DataFrame | None = None, key: str = "cid",
              block: tuple[int, int] = (BLOCK_KEYS, BLOCK_DATES)) -> DataFrame:
    """(label, a, b, n, x, y, xx, yy, xy): sums over the common dates of each pair, values taken from their key's mean.

    Blocked products: ``block`` says how many keys and dates a block and a stretch have; a task multiplies two
    blocks over one stretch, and the products of a pair of blocks are added up as arrays. Only the pairs of blocks that
    hold a requested pair are formed. ``label``: that of each date in ``by`` (date, regime), or null.
    """
    n_keys, n_dates = block
    found = series.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), "date", F.col(value).cast("double").alias("v"))
    # spots of the keys: dense numbers from a sort in ranges, not from one window over all keys
    keys = materialized(found.groupBy("k").agg(F.avg("v").alias("mean")), "keys")
    numbered = keys.select("k", "mean", F.pmod(F.xxhash64("k"), F.lit(1 << 20)).alias("h"))
    groups = numbered.groupBy("h").agg(F.count("*").alias("n"))
    groups = groups.select("h", (F.sum("n").over(W.orderBy("h")) - F.col("n")).alias("base"))  # at most 2^20 rows
    spots = numbered.join(groups, "h").withColumn("spot", F.col("base") + F.row_number().over(W.partitionBy("h").orderBy("k")) - 1)
    spots = materialized(spots.select("k", "mean", F.floor(F.col("spot") / n_keys).cast("int").alias("block"), (F.col("spot") % n_keys).cast("int").alias("spot")), "spots")
    dates = found.select("date").distinct() if by is None else by.select("date", F.col("regime").cast("string").alias("label")).where("label IS NOT NULL")
    dates = dates if by is not None else dates.withColumn("label", F.lit(None).cast("string"))
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    dates = dates.select("date", "label", F.floor(day / n_dates).alias("stretch"), F.pmod(day, F.lit(n_dates)).cast("int").alias("at"))
    rows = found.join(spots, "k").join(dates, "date").select("label", "stretch", "at", "block", "spot", (F.col("v") - F.col("mean")).alias("v"))
    if pairs is None:
        blocks = spots.select("block").distinct()
        wanted = blocks.select(F.col("block").alias("low"), F.explode(F.sequence("block", F.lit(blocks.agg(F.max("block")).scalar()))).alias("high"))
    else:
        of = spots.select("k", "block", "spot")
        asked = pair_table(series, pairs).join(of.select(F.col("k").alias("a"), F.col("block").alias("_ba"), F.col("spot").alias("_sa")), "a")
        asked = materialized(asked.join(of.select(F.col("k").alias("b"), F.col("block").alias("_bb"), F.col("spot").alias("_sb")), "b"), "asked")
        wanted = asked.select(F.least("_ba", "_bb").alias("low"), F.greatest("_ba", "_bb").alias("high")).distinct()
    sides = wanted.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    dealt = rows.join(sides, "block")
    shape = "label string, low int, high int, sums array<double>"
    parts = dealt.groupBy("label", "stretch", "low", "high").applyInPandas(_products(n_keys, n_dates), shape)
    # stretches of a pair of blocks are added in two steps, so that none holds all of them
    once = parts.withColumn("part", F.spark_partition_id() % 16).groupBy("label", "low", "high", "part").applyInPandas(_added, shape)
    total = once.groupBy("label", "low", "high").applyInPandas(_added, shape)
    size = n_keys * n_keys

    def at(i: int) -> Column:
        return F.element_at("sums", (F.lit(i * size + 1) + F.col("i") * n_keys + F.col("j")).cast("int")).alias(SUMS[i])

    if pairs is None:
        spot = F.sequence(F.lit(0), F.lit(n_keys - 1))
        cells = total.select("label", "low", "high", "sums", F.explode(spot).alias("i")).select("*", F.explode(spot).alias("j")).where("low < high OR i < j")
        cells = cells.select("label", "low", "high", "i", "j", *[at(i) for i in range(6)]).where("n > 0")
        name = lambda side, block, spot: spots.select(F.col("k").alias(side), F.col("block").alias(block), F.col("spot").alias(spot))
        cells = cells.join(name("a", "low", "i"), ["low", "i"]).join(name("b", "high", "j"), ["high", "j"])
    else:
        swap = F.col("_ba") > F.col("_bb")
        asked = asked.select("a", "b", swap.alias("swap"), F.least("_ba", "_bb").alias("low"), F.greatest("_ba", "_bb").alias("high"),
                             F.when(swap, F.col("_sb")).otherwise(F.col("_sa")).alias("i"), F.when(swap, F.col("_sa")).otherwise(F.col("_sb")).alias("j"))
        cells = asked.join(total, ["low", "high"]).select("label", "a", "b", "swap", *[at(i) for i in range(6)]).where("n > 0")
        turned = {p: F.when(F.col("swap"), F.col(q)).otherwise(F.col(p)) for p, q in (("x", "y"), ("y", "x"), ("xx", "yy"), ("yy", "xx"))}
        return cells.select("label", "a", "b", F.col("n").cast("long").alias("n"), *[turned.get(s, F.col(s)).alias(s) for s in SUMS[1:]])
    flip = F.col("a") > F.col("b")
    ends = [F.when(flip, F.col(q)).otherwise(F.col(p)).alias(p) for p, q in (("a", "b"), ("b", "a"), ("x", "y"), ("y", "x"), ("xx", "yy"), ("yy", "xx"))]
    return cells.select("label", *ends[:2], F.col("n").cast("long").alias("n"), *ends[2:], "xy")


def pair_correlations(series: DataFrame, pairs: DataFrame | list[tuple[str, str]] | None = None, value: str = "ret", by: DataFrame | None = None,
                      min_obs: int = 1, key: str = "cid", block: tuple[int, int] = (BLOCK_KEYS, BLOCK_DATES)) -> DataFrame:
    """(a, b, corr, n): pairwise-complete correlation of the pairs (a, b) of a table, of all pairs by default, optionally per
    label of ``by`` (date, regime). Pairs without a common date have no row; one that does not vary has no correlation."""
    s = pair_sums(series, value, pairs, by, key, block)
    vx, vy = (F.col(p + p) - F.col(p) * F.col(p) / F.col("n") for p in "xy")
    # what is left of a constant after rounding is no variation
    varies = (vx > 1e-13 * F.col("xx")) & (vy > 1e-13 * F.col("yy"))
    corr = F.when(varies & (F.col("n") >= max(2, min_obs)), (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(vx * vy))
    return s.select(*([F.col("label").alias("regime")] if by is not None else []), "a", "b", corr.alias("corr"), "n")


def pair_table(series: DataFrame, pairs: DataFrame | list[tuple[str, str]]) -> DataFrame:
    """Pairs (a, b) written by hand as a table."""
    return pairs if isinstance(pairs, DataFrame) else series.sparkSession.createDataFrame(pairs, "a string, b string")


def pair_rows(series: DataFrame, pairs: DataFrame | list[tuple[str, str]], value: str, key: str = "cid") -> DataFrame:
    """(a, b, date, x, y) on the common dates of each pair (a, b)."""
    rows = series.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), "date", F.col(value).alias("v"))
    left = pair_table(series, pairs).select("a", "b").join(rows.select(F.col("k").alias("a"), "date", F.col("v").alias("x")), "a")
    return left.join(rows.select(F.col("k").alias("b"), "date", F.col("v").alias("y")), ["b", "date"]).select("a", "b", "date", "x", "y")


def rolling_corr(series: DataFrame, pairs: DataFrame | list[tuple[str, str]], window: int = 60, value: str = "ret") -> DataFrame:
    """Correlation over the last ``window`` common observations of each pair."""
    w = W.partitionBy("a", "b").orderBy("date").rowsBetween(-(window - 1), 0)
    rows = pair_rows(series, pairs, value)
    out = rows.withColumn("corr", full_window(F.corr("x", "y"), F.col("x"), w, window))
    return out.where(F.col("corr").isNotNull()).select("a", "b", "date", "corr")


def shifted_pairs(pairs: DataFrame, lags: range, keys: list[str]) -> DataFrame:
    """(keys, lag, t, x, y): x at t against y ``lag`` observations later."""
    w = W.partitionBy(*keys).orderBy("date")
    ahead = [F.struct(F.lit(k).alias("lag"), F.lead("y", k).over(w).alias("y")) for k in lags]
    wide = pairs.select(*keys, "x", F.row_number().over(w).alias("t"), F.array(*ahead).alias("_s"))
    flat = wide.select(*keys, "t", "x", F.explode("_s").alias("s")).select(*keys, "t", "x", "s.lag", "s.y")
    return flat.where(F.col("y").isNotNull())


def newey_west(sample: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, corr, se_hac): Bartlett-kernel standard error of the standardised slope of y on x.

    Population moments standardise both sides; the lag length is floor(4 (n/100)^(2/9)).
    """
    stats = sample.groupBy(*keys).agg(
        F.count("*").alias("n"), F.corr("x", "y").alias("corr"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"),
        F.stddev_pop("x").alias("_sx"), F.stddev_pop("y").alias("_sy"),
    ).where("n > 2")
    # standardised with population moments: x'x = n and the slope equals the correlation
    zx, zy = (F.col("x") - F.col("_mx")) / F.col("_sx"), (F.col("y") - F.col("_my")) / F.col("_sy")
    scored = sample.join(stats, keys).select(*keys, "t", "n", (zx * (zy - F.col("corr") * zx)).alias("u"))
    lag_len = F.least(F.floor(4 * F.pow(F.col("n") / 100, F.lit(2.0 / 9.0))), F.col("n") - 1).cast("int")
    # each product u[t] u[t-l] is found by an equi-join on the shifted row number
    later = scored.withColumn("_L", lag_len).withColumn("l", F.explode(F.sequence(F.lit(0), F.col("_L"))))
    weight = F.when(F.col("l") == 0, F.lit(1.0)).otherwise(2 * (1 - F.col("l") / (F.col("_L") + 1)))
    earlier = scored.select(*keys, (F.col("t")).alias("_t"), F.col("u").alias("_u"))
    paired = later.withColumn("_t", F.col("t") - F.col("l")).join(earlier, [*keys, "_t"])
    s = paired.groupBy(*keys).agg(F.sum(weight * F.col("u") * F.col("_u")).alias("_s"))
    return stats.join(s, keys).select(
        *keys, "n", "corr", (F.sqrt(F.greatest(F.col("_s"), F.lit(0.0))) / F.col("n")).alias("se_hac")
    )


def lead_lag(pairs: DataFrame, keys: list[str], lags: range = range(-5, 6)) -> DataFrame:
    """corr(x[t], y[t+k]) with the naive band and the HAC band, t value included."""
    hac = newey_west(shifted_pairs(pairs, lags, keys), [*keys, "lag"])
    return hac.select(
        *keys, "lag", "n", "corr", (F.lit(1.96) / F.sqrt("n")).alias("band"), (F.col("se_hac") * 1.96).alias("band_hac"),
        F.try_divide(F.col("corr"), F.col("se_hac")).alias("t_hac"),
    )


def regime_stats(returns: DataFrame, regimes: DataFrame) -> DataFrame:
    """Days, mean, standard error, annual volatility, worst and best day per (key, regime)."""
    joined = returns.join(regimes.select("date", "regime"), "date")
    agg = joined.groupBy("cid", "regime").agg(
        F.count("ret").alias("days"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("_sd"),
        F.min("ret").alias("worst"), F.max("ret").alias("best"),
    )
    return agg.select("cid", "regime", "days", "mean", (F.col("_sd") / F.sqrt("days")).alias("std_err"),
                      (F.col("_sd") * math.sqrt(252)).alias("ann_vol"), "worst", "best")
