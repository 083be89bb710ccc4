"""Multiple-testing-aware statistics: probabilistic and deflated Sharpe, overfitting probability."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import normal_cdf, normal_quantile

EULER_GAMMA = 0.5772156649015329
TRADING_DAYS = 252


def sharpe_moments(returns: DataFrame, by: list[str], ret: str = "ret") -> DataFrame:
    """(by, n, sr, skew, kurt): per-period Sharpe, population skew and non-excess kurtosis."""
    r = F.col(ret)
    agg = returns.where(r.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"),
        F.skewness(r).alias("skew"), (F.kurtosis(r) + 3).alias("kurt"))
    return agg.select(*by, "n", F.when(F.col("_s") > 0, F.col("_m") / F.col("_s")).alias("sr"), "skew", "kurt")


def _spread(sr: Column) -> Column:
    return 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr


def psr(moments: DataFrame, benchmark: Column, out: str = "psr") -> DataFrame:
    """Probability that the true Sharpe exceeds the benchmark."""
    z = (F.col("sr") - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(F.greatest(_spread(F.col("sr")), F.lit(1e-12)))
    return moments.withColumn(out, normal_cdf(z))


def expected_max_sharpe(n_trials: Column, var_sr: Column) -> Column:
    """Expected best Sharpe of skill-less trials."""
    a = normal_quantile(1 - 1 / n_trials)
    b = normal_quantile(1 - 1 / (n_trials * math.e))
    return F.when(n_trials > 1, F.sqrt(var_sr) * ((1 - EULER_GAMMA) * a + EULER_GAMMA * b)).otherwise(0.0)


def deflated_sharpe(moments: DataFrame, n_trials: int | None = None) -> DataFrame:
    """PSR against the expected best of all trials; the trials' own Sharpes give the variance."""
    pool = moments.agg(F.var_samp("sr").alias("var_sr"), F.count("sr").alias("n_trials"))
    if n_trials is not None:
        pool = pool.withColumn("n_trials", F.lit(n_trials).cast("long"))
    bar = pool.select(F.struct(expected_max_sharpe(F.col("n_trials"), F.col("var_sr")).alias("sr0"), "var_sr", "n_trials"))
    rows = moments.withColumn("_b", bar.scalar())
    rows = rows.withColumns({"sr0": F.col("_b.sr0"), "var_sr": F.col("_b.var_sr"), "n_trials": F.col("_b.n_trials")}).drop("_b")
    return psr(rows.withColumn("sr0_ann", F.col("sr0") * math.sqrt(TRADING_DAYS)), F.col("sr0"), "dsr")


def min_track_record(moments: DataFrame, benchmark: Column, confidence: float = 0.95) -> DataFrame:
    """Observations needed to show the Sharpe beats the benchmark; null when it does not."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(confidence)
    need = 1 + _spread(F.col("sr")) * F.pow(F.try_divide(F.lit(z), F.col("sr") - benchmark), F.lit(2.0))
    return moments.withColumn("min_track_record", F.when(F.col("sr") > benchmark, need))


def haircut_sharpe(moments: DataFrame, n_tests: Column) -> DataFrame:
    """Bonferroni haircut of the annual Sharpe."""
    years = F.col("n") / F.lit(float(TRADING_DAYS))
    rows = moments.withColumns({"sr_ann": F.col("sr") * math.sqrt(TRADING_DAYS), "_y": years})
    rows = rows.withColumn("t_stat", F.col("sr_ann") * F.sqrt("_y"))
    rows = rows.withColumn("p", 2 * normal_cdf(-F.abs("t_stat")))
    rows = rows.withColumn("p_adj", F.least(F.lit(1.0), F.col("p") * F.greatest(n_tests, F.lit(1))))
    t_adj = F.when(F.col("p_adj") < 1, -normal_quantile(F.col("p_adj") / 2)).otherwise(0.0)
    rows = rows.withColumn("haircut_sr_ann", t_adj / F.sqrt("_y") * F.signum("sr_ann"))
    return rows.withColumns({
        "haircut_pct": 1 - F.try_divide(F.col("haircut_sr_ann"), F.col("sr_ann")), "passes_t3": F.col("t_stat") >= 3,
    }).drop("_y")


def pbo_splits(returns: DataFrame, n_blocks: int = 16, trial: str = "trial") -> DataFrame:
    """One row per symmetric split: the in-sample winner, its two Sharpes and its out-of-sample logit.

    Each trial is reduced to one (n, sum, sum of squares) per time block; a split is a bit mask over
    blocks, so a half's Sharpe is a sum over at most ``n_blocks`` entries. The winner's rank comes from
    two counts, which combine before the shuffle; no split is ever sorted.
    """
    if n_blocks % 2:
        raise ValueError("n_blocks must be even")
    seen = returns.where(F.col("ret").isNotNull())
    n_trials = seen.select(trial).distinct().agg(F.count("*")).scalar()
    full = seen.groupBy("date").agg(F.count("*").alias("_c")).where(F.col("_c") == n_trials).select("date")
    from tickloom.functions.calendar import number_sessions

    rows = number_sessions(full)
    # block b covers rows [floor(T b / B), floor(T (b + 1) / B))
    total = rows.agg(F.max("session_no") + 1).scalar()
    block = F.floor(((F.col("session_no") + 1) * n_blocks - 1) / total).cast("int")
    stats = seen.join(rows.withColumn("block", block), "date").groupBy(trial, "block").agg(
        F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    packed = stats.groupBy(trial).agg(F.collect_list(F.struct("block", "n", "s", "q")).alias("b"))
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << n_blocks) - 1)), lambda m: F.bit_count(m) == n_blocks // 2)
    split = packed.select(trial, "b", F.explode(masks).alias("split"))

    def half(inside: int) -> Column:
        part = F.filter("b", lambda x: F.getbit(F.col("split"), x["block"]) == inside)
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
        return F.aggregate(part, zero, lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), (a["s"] + x["s"]).alias("s"), (a["q"] + x["q"]).alias("q")))

    def sharpe(h: Column) -> Column:
        mean = h["s"] / h["n"]
        var = (h["q"] - h["s"] * mean) / (h["n"] - 1)
        # sums depend on the order of partial aggregates; differences that small are ties
        return F.when(var > 0, F.round(mean / F.sqrt(var), 12))

    halves = split.select(trial, "split", half(1).alias("i"), half(0).alias("o"))
    scored = halves.select(trial, "split", sharpe(F.col("i")).alias("is_sr"), sharpe(F.col("o")).alias("oos_sr"))
    # ties in sample go to the smaller trial
    best = scored.where(F.col("is_sr").isNotNull()).groupBy("split").agg(
        F.min_by(F.struct("is_sr", "oos_sr", trial), F.struct(-F.col("is_sr"), F.col(trial))).alias("w"))
    rank = scored.join(best, "split").groupBy("split", "w").agg(
        F.count_if(F.col("oos_sr") < F.col("w.oos_sr")).alias("below"), F.count_if(F.col("oos_sr") == F.col("w.oos_sr")).alias("same"),
        F.count("*").alias("n_trials"))
    w = (F.col("below") + (F.col("same") + 1) / 2) / (F.col("n_trials") + 1)
    return rank.select("split", F.col(f"w.{trial}").alias("best"), F.col("w.is_sr").alias("is_sr"), F.col("w.oos_sr").alias("oos_sr"),
                       F.log(w / (1 - w)).alias("logit"), "n_trials")


def pbo(returns: DataFrame, n_blocks: int = 16, trial: str = "trial") -> DataFrame:
    """Share of splits whose in-sample winner ranks in the lower half out of sample, and the slope."""
    return pbo_splits(returns, n_blocks, trial).agg(
        F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.count("*").alias("n_splits"),
        F.max("n_trials").alias("n_trials"), F.regr_slope("oos_sr", "is_sr").alias("degradation_slope"))
