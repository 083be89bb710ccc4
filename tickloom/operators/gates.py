"""Regime, sensitivity and capacity checks and the gate report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators.backtest import performance
from tickloom.operators.index import in_eras


def regime_table(returns: DataFrame, regimes: list[tuple[str, str, str]], by: str = "trial", min_obs: int = 20) -> DataFrame:
    """CAGR, Sharpe and deepest drawdown of each series inside each named span; null under ``min_obs`` days."""
    stats = performance(in_eras(returns.where(F.col("ret").isNotNull()), regimes), [by, "era"])
    enough = F.col("n") >= min_obs
    return stats.select(by, F.col("era").alias("regime"), "n", *[F.when(enough, F.col(c)).alias(c) for c in ("cagr", "sharpe", "max_dd")])


def sensitivity(metrics: DataFrame, by: str = "experiment", min_ratio: float = 0.8) -> DataFrame:
    """Worst neighbour of the best grid point over the best, share of positive points, plateau flag.

    metrics: (by, param, metric).
    """
    w = W.partitionBy(by).orderBy("param")
    rows = metrics.where(F.col("metric").isNotNull()).select(
        by, "param", "metric", F.least(F.lag("metric").over(w), F.lead("metric").over(w)).alias("_near"))
    agg = rows.groupBy(by).agg(
        F.count("*").alias("n"), F.max("metric").alias("_best"),
        F.min_by(F.struct("param", "_near"), F.struct(-F.col("metric"), F.col("param"))).alias("_b"),
        F.avg((F.col("metric") > 0).cast("double")).alias("share_positive"))
    usable = (F.col("n") >= 3) & (F.col("_best") > 0)
    ratio = F.when(usable, F.col("_b._near") / F.col("_best"))
    ok = F.when(usable, ratio >= min_ratio).when(F.col("n") >= 3, F.lit(False))
    return agg.select(by, ratio.alias("neighbour_ratio"), "share_positive", F.col("_b.param").alias("best_param"), ok.alias("ok"))


def capacity(gross_edge: Column, statutory: Column, turnover: Column, adv: Column, vol: Column, k: float = 0.7) -> Column:
    """Assets at which square-root impact eats the edge left after statutory costs; 0 when none is left."""
    edge = gross_edge - statutory
    per = F.try_divide(edge, turnover * k * vol)
    return F.when((edge > 0) & (turnover > 0), per * per * adv).otherwise(0.0)


# Gate number, name and threshold text of the report.
GATES = {
    5: "Multiple testing", 6: "Regime stress", 7: "Parameter sensitivity", 8: "Capacity", 9: "Min track record",
    10: "Unlock holdout",
}


def gate_report(measures: DataFrame, by: str = "experiment") -> DataFrame:
    """One row per gate with PASS / FAIL / INFO / NOT RUN and its number.

    measures: (by, dsr, pbo, neighbour_ratio, capacity, min_track_record); a null measure is NOT RUN.
    """

    def row(n: int, status: Column, value: Column) -> Column:
        return F.struct(F.lit(n).alias("n"), F.lit(GATES[n]).alias("gate"), status.alias("status"), value.cast("double").alias("value"))

    def judged(ok: Column, ran: Column) -> Column:
        return F.when(~ran, "NOT RUN").when(ok, "PASS").otherwise("FAIL")

    def info(c: str) -> Column:
        return F.when(F.col(c).isNull(), "NOT RUN").otherwise("INFO")

    ran5 = F.col("dsr").isNotNull() & F.col("pbo").isNotNull()
    rows = F.array(
        row(5, judged((F.col("dsr") >= 0.95) & (F.col("pbo") < 0.5), ran5), F.col("dsr")),
        row(7, judged(F.col("neighbour_ratio") >= 0.8, F.col("neighbour_ratio").isNotNull()), F.col("neighbour_ratio")),
        row(8, info("capacity"), F.col("capacity")), row(9, info("min_track_record"), F.col("min_track_record")),
        row(10, F.lit("NOT RUN"), F.lit(None)))
    return measures.select(by, F.explode(rows).alias("g")).select(by, "g.*")
