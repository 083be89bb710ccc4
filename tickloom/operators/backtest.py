"""Target-weight strategy returns for many trials at once, performance metrics, after-tax returns.

Between two executions everything has a closed form: asset value w * prod(1 + r), cash compounding,
drifted weight v / V. Only the account size, which the square-root impact needs, depends on earlier
executions; it is folded over the (few) executions of each trial.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import calendar as cal
from tickloom.functions import costs
from tickloom.session import materialized

TRADING_DAYS = 252


def _lagged_vol(rets: DataFrame, at: DataFrame, window: int = 63, need: int = 20) -> DataFrame:
    """(asset, no, vol): volatility of the ``window`` sessions before session ``no``.

    Sessions without a return count as zero. Executions in the first ``need`` sessions get the first
    known value (a look-ahead in the cost only). Points expand to their frames and equi-join.
    """
    points = at.select("asset", "no").distinct().withColumn("_at", F.greatest(F.col("no"), F.lit(need)))
    frame = points.withColumn("session_no", F.explode(F.sequence(F.greatest(F.col("_at") - window, F.lit(0)), F.col("_at") - 1)))
    joined = frame.join(rets, ["asset", "session_no"], "left").withColumn("_r", F.coalesce("ret", F.lit(0.0)))
    return joined.groupBy("asset", "no").agg(F.stddev_samp("_r").alias("vol"))


def target_weight_returns(prices: DataFrame, targets: DataFrame, segment: str = "delivery", lag: int = 1,
                          cash_rate: float | Column = 0.0, spread_bps: float = 2.0, impact_k: float = 0.7,
                          brokerage: float = 0.0, adv: DataFrame | None = None, capital: float = 1_000_000.0,
                          frozen_at: str | None = None) -> DataFrame:
    """Daily results of every trial: (trial, date, gross, net, statutory, spread, impact, turnover).

    prices: (asset, date, close); targets: (trial, decision_date, asset, weight) - a decision date
    present for a trial is a full rebalance, an absent one is a hold. adv: (asset, date, adv).
    Decisions on days without a session raise. A decision at close t executes at close t + lag (lag >= 1) and earns from the next session on.
    """
    if lag < 1:
        raise ValueError("lag must be at least 1: a decision at a close cannot trade at that close")
    spark = prices.sparkSession
    days = cal.session_table(prices)
    n_last = days.agg(F.max("session_no")).scalar()
    w = W.partitionBy("asset").orderBy("session_no")
    step = F.when(F.lag("session_no").over(w) == F.col("session_no") - 1, F.col("close") / F.lag("close").over(w) - 1)
    rets = materialized(prices.join(days, "date").select("asset", "session_no", step.alias("ret")).where("ret is not null"), "rets")

    if not targets.join(days.withColumnRenamed("date", "decision_date"), "decision_date", "left_anti").isEmpty():
        raise ValueError("there are decisions on days without a session")
    goal = targets.join(days.withColumnRenamed("date", "decision_date"), "decision_date")
    goal = goal.withColumn("e", F.col("session_no") + lag).where(F.col("e") <= n_last)
    goal = goal.select("trial", "e", "asset", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    trials = targets.select("trial").distinct()
    execs = goal.select("trial", "e").distinct()
    # segment 0 is all cash from the first session; each later one starts at an execution
    opens = execs.unionByName(trials.select("trial", F.lit(0).cast("long").alias("e")))
    o = W.partitionBy("trial").orderBy("e")
    spans = materialized(opens.select("trial", "e", F.lead("e").over(o).alias("nxt")), "segments")
    until = F.coalesce("nxt", F.lit(n_last) if isinstance(n_last, int) else n_last)

    held = spans.withColumn("_to", until).where(F.col("_to") > F.col("e"))
    grid = held.select("trial", "e", F.explode(F.sequence(F.col("e") + 1, "_to")).alias("session_no"))
    moves = goal.join(grid, ["trial", "e"]).join(rets, ["asset", "session_no"])
    g = W.partitionBy("trial", "e", "asset").orderBy("session_no")
    growth = F.product(1 + F.col("ret")).over(g.rowsBetween(W.unboundedPreceding, 0))
    moves = moves.withColumn("_g", growth)
    moves = materialized(moves.withColumn("_d", F.col("weight") * (F.col("_g") - F.coalesce(F.lag("_g").over(g), F.lit(1.0)))), "moves")

    daily_cash = F.pow(1 + (F.lit(cash_rate) if not isinstance(cash_rate, Column) else cash_rate), F.lit(1.0 / TRADING_DAYS))
    invested = goal.groupBy("trial", "e").agg(F.sum("weight").alias("_w0"))
    change = moves.groupBy("trial", "e", "session_no").agg(F.sum("_d").alias("_d"))
    path = grid.join(change, ["trial", "e", "session_no"], "left").join(invested, ["trial", "e"], "left").fillna(0.0, ["_d", "_w0"])
    s = W.partitionBy("trial", "e").orderBy("session_no")
    assets = F.col("_w0") + F.sum("_d").over(s.rowsBetween(W.unboundedPreceding, 0))
    value = assets + (1 - F.col("_w0")) * F.pow(daily_cash, F.col("session_no") - F.col("e"))
    path = path.withColumn("_v", value)
    path = materialized(path.withColumn("gross", F.col("_v") / F.coalesce(F.lag("_v").over(s), F.lit(1.0)) - 1), "path")

    # trades: the new target minus the drifted end weight of the segment before
    end_value = path.groupBy("trial", "e").agg(F.max_by("_v", "session_no").alias("_end"))
    grown = moves.groupBy("trial", "e", "asset").agg(F.max_by("_g", "session_no").alias("_g"))
    closing = goal.join(grown, ["trial", "e", "asset"], "left").join(end_value, ["trial", "e"], "left")
    drifted = closing.join(spans, ["trial", "e"]).where(F.col("nxt").isNotNull()).select(
        "trial", F.col("nxt").alias("e"), "asset",
        (-F.col("weight") * F.coalesce("_g", F.lit(1.0)) / F.coalesce("_end", F.lit(1.0))).alias("weight"))
    trades = goal.unionByName(drifted).groupBy("trial", "e", "asset").agg(F.sum("weight").alias("trade"))

    sized = trades.withColumn("no", F.col("e"))
    if adv is not None:
        vol = _lagged_vol(rets, sized.select("asset", "no"))
        known = adv.join(days, "date").select("asset", (F.col("session_no") + 1).alias("no"), "adv")
        sized = sized.join(vol, ["asset", "no"], "left").join(known, ["asset", "no"], "left")
        per = costs.sqrt_impact(F.abs("trade") * capital, F.col("adv"), F.col("vol"), impact_k)
        sized = sized.withColumn("_i", F.abs("trade") * F.coalesce(per, F.lit(0.0)))
    else:
        sized = sized.withColumn("_i", F.lit(0.0))
    dated = sized.join(days.withColumnRenamed("session_no", "no"), "no")
    rate = costs.side_costs(segment, F.lit(frozen_at).cast("date") if frozen_at else F.col("date"), brokerage)
    t = F.col("trade")
    bill = dated.groupBy("trial", "e").agg(
        F.sum(F.when(t > 0, t * rate["buy"]).otherwise(-t * rate["sell"])).alias("statutory"),
        (F.sum(F.abs(t)) * (spread_bps / 1e4)).alias("spread"), F.sum("_i").alias("_i"),
        (F.sum(F.abs(t)) / 2).alias("turnover"))

    # account size before each execution: a fold over the executions of a trial
    before = spans.where(F.col("nxt").isNotNull()).join(end_value, ["trial", "e"], "left").select(
        "trial", F.col("nxt").alias("e"), F.coalesce("_end", F.lit(1.0)).alias("_grow"))
    steps = bill.join(before, ["trial", "e"]).groupBy("trial").agg(
        F.array_sort(F.collect_list(F.struct("e", "_grow", "statutory", "spread", "_i", "turnover"))).alias("s"))
    entry = "array<struct<e:bigint,statutory:double,spread:double,impact:double,turnover:double>>"
    start = F.struct(F.lit(1.0).alias("eq"), F.array().cast(entry).alias("out"))

    def fold(acc: Column, x: Column) -> Column:
        eq = acc["eq"] * x["_grow"]
        impact = x["_i"] * F.sqrt(F.greatest(eq, F.lit(0.0)))
        row = F.struct(x["e"].alias("e"), x["statutory"].alias("statutory"), x["spread"].alias("spread"),
                       impact.alias("impact"), x["turnover"].alias("turnover"))
        return F.struct((eq * (1 - x["statutory"] - x["spread"] - impact)).alias("eq"), F.concat(acc["out"], F.array(row)).alias("out"))

    paid = steps.select("trial", F.explode(F.aggregate("s", start, fold, lambda a: a["out"])).alias("b")).select(
        "trial", F.col("b.e").alias("session_no"), "b.statutory", "b.spread", "b.impact", "b.turnover")
    calendar = trials.select("trial", F.lit(0).cast("long").alias("session_no"), F.lit(0.0).alias("gross"))
    daily = path.select("trial", "session_no", "gross").unionByName(calendar)
    out = daily.join(paid, ["trial", "session_no"], "left").fillna(0.0, ["statutory", "spread", "impact", "turnover"]).join(days, "session_no")
    total = F.col("statutory") + F.col("spread") + F.col("impact")
    return out.select("trial", "date", "gross", ((1 + F.col("gross")) * (1 - total) - 1).alias("net"),
                      "statutory", "spread", "impact", "turnover")


def max_drawdown(returns: DataFrame, by: list[str], ret: str = "ret") -> DataFrame:
    """(by, max_dd): deepest fall of the compounded path, the first value being the first day's."""
    w = W.partitionBy(*by).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    path = returns.withColumn("_eq", F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).over(w))
    path = path.withColumn("_dd", F.col("_eq") / F.max("_eq").over(w) - 1)
    return path.groupBy(*by).agg(F.min("_dd").alias("max_dd"))


def performance(returns: DataFrame, by: list[str], ret: str = "ret") -> DataFrame:
    """(by, n, cagr, vol, sharpe, max_dd) on 252-day years; a wiped-out path has CAGR -1."""
    r = F.col(ret)
    agg = returns.where(r.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.product(1 + r).alias("_t"), F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"))
    cagr = F.when(F.col("_t") > 0, F.pow("_t", F.lit(float(TRADING_DAYS)) / F.col("n")) - 1).otherwise(-1.0)
    stats = agg.select(*by, "n", cagr.alias("cagr"), (F.col("_s") * math.sqrt(TRADING_DAYS)).alias("vol"),
                       F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * math.sqrt(TRADING_DAYS)).alias("sharpe"))
    return stats.join(max_drawdown(returns.where(r.isNotNull()), by, ret), by)


def trial_summary(results: DataFrame) -> DataFrame:
    """Performance of the net series plus yearly turnover and cost."""
    net = performance(results, ["trial"], "net")
    years = F.count("*") / F.lit(float(TRADING_DAYS))
    paid = results.groupBy("trial").agg(
        (F.sum("turnover") / years).alias("turnover_per_yr"),
        (F.sum(F.col("statutory") + F.col("spread") + F.col("impact")) / years).alias("cost_per_yr"))
    return net.join(paid, "trial")


def after_tax(results: DataFrame, ret: str = "net", capital: float = 1_000_000.0, avg_holding_days: float = 180) -> DataFrame:
    """(trial, date, ret): gains taxed per financial year and debited on its last trading day.

    Days are compounded to one growth factor per (trial, financial year) first; only those rows - about
    twenty per trial - are folded, with losses carried forward eight years, oldest first.
    """
    days = results.select("trial", "date", F.coalesce(F.col(ret), F.lit(0.0)).alias("ret")).withColumn("fy", cal.financial_year("date"))
    years = days.groupBy("trial", "fy").agg(F.product(1 + F.col("ret")).alias("growth"), F.max("date").alias("date"))
    short, long_, exempt = costs.gains_rates(F.col("fy"))
    rate, free = (short, F.lit(0.0)) if avg_holding_days < 365 else (long_, exempt)
    years = years.withColumns({"rate": rate, "free": free})
    ordered = years.groupBy("trial").agg(F.array_sort(F.collect_list(F.struct("fy", "growth", "date", "rate", "free"))).alias("years"))
    none = F.array_repeat(F.lit(0.0), LOSS_YEARS)
    start = F.struct(F.lit(float(capital)).alias("equity"), none.alias("losses"), F.lit(0).cast("int").alias("fy"), F.array().cast("array<double>").alias("hits"))
    hits = ordered.select("trial", "years", F.aggregate("years", start, _taxed_year, lambda s: s["hits"]).alias("hits"))
    hits = hits.select("trial", F.explode(F.arrays_zip("years", "hits")).alias("x")).select("trial", F.col("x.years.date").alias("date"), F.col("x.hits").alias("hit"))
    joined = days.join(hits, ["trial", "date"], "left")
    return joined.select("trial", "date", ((1 + F.col("ret")) * (1 - F.coalesce("hit", F.lit(0.0))) - 1).alias("ret"))


#: Years for which a loss can be set against gains.
LOSS_YEARS = 8


def _taxed_year(state: Column, year: Column) -> Column:
    """One financial year of a trial. ``losses``: what is left of those of the last LOSS_YEARS years, oldest first."""
    # years without a session move the losses on as well
    skipped = F.when(state["fy"] == 0, 0).otherwise(F.least(year["fy"] - state["fy"] - 1, F.lit(LOSS_YEARS))).cast("int")
    losses = F.slice(F.concat(state["losses"], F.array_repeat(F.lit(0.0), skipped)), skipped + 1, LOSS_YEARS)
    closing = state["equity"] * year["growth"]
    gain = F.greatest(closing - state["equity"], F.lit(0.0))
    loss = F.greatest(state["equity"] - closing, F.lit(0.0))
    used = F.aggregate(losses, F.struct(gain.alias("open"), F.array().cast("array<double>").alias("kept")), lambda a, one: F.struct(
        F.greatest(a["open"] - one, F.lit(0.0)).alias("open"), F.concat(a["kept"], F.array(F.greatest(one - a["open"], F.lit(0.0)))).alias("kept")))
    tax = F.greatest(used["open"] - year["free"], F.lit(0.0)) * year["rate"]
    hit = F.when((tax > 0) & (closing > 0), tax / closing).otherwise(0.0)
    left = F.slice(F.concat(used["kept"], F.array(loss)), 2, LOSS_YEARS)
    return F.struct((closing * (1 - hit)).alias("equity"), left.alias("losses"), year["fy"].cast("int").alias("fy"), F.concat(state["hits"], F.array(hit)).alias("hits"))
