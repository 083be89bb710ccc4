"""Rule-based index construction: schedule, scores, buffered selection, capped weights, drift, tracking.

Reviews, scenarios and strategies are columns, so all of them run in one job. Date look-ups expand the
small schedule to days or sessions and equi-join; nothing is looped over and no prices are pivoted.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import calendar as cal
from tickloom.operators import series as ser
from tickloom.operators import temporal as tmp
from tickloom.operators.ranking import top_n
from tickloom.session import materialized

# Fixed values of the methodology.
TOP_N, MUST_IN, MUST_OUT = 30, 15, 45
CAP_ABS, CAP_MULT = 0.05, 5.0
UNIVERSE_N = 200


def review_schedule(days: DataFrame, first: str = "2005-06", months: tuple[int, ...] = (6, 12)) -> DataFrame:
    """(review, cutoff, p7, p13, effective): reviews whose three look-back months all have sessions."""
    ends = cal.month_end_sessions(days)
    base = ends.where(F.month("month").isin(*months) & (F.date_format("month", "yyyy-MM") >= first))
    out = base.select(F.date_format("month", "yyyy-MM").alias("review"), "month", F.col("session").alias("effective"))
    for name, back in (("cutoff", 1), ("p7", 7), ("p13", 13)):
        other = ends.select(F.add_months("month", back).alias("month"), F.col("session").alias(name))
        out = out.join(other, "month")
    return out.select("review", "cutoff", "p7", "p13", "effective")


def average_turnover_at(bars: DataFrame, schedule: DataFrame, sessions: DataFrame, window: int = 126,
                        min_periods: int = 100, value: str = "turnover", zero_fill: bool = True) -> DataFrame:
    """(review, cid, avg) over the ``window`` sessions ending at each cutoff.

    With ``zero_fill`` days without a trade count as zero; otherwise the mean is over observed days and
    needs ``min_periods`` of them.
    """
    at = schedule.join(sessions.withColumnRenamed("date", "cutoff"), "cutoff").select("review", F.col("session_no").alias("_c"))
    frame = at.where(F.col("_c") + 1 >= min_periods).select(
        "review", "_c", F.explode(F.sequence(F.greatest(F.col("_c") - (window - 1), F.lit(0)), "_c")).alias("session_no")
    )
    days = frame.join(sessions, "session_no")
    agg = bars.join(days, "date").groupBy("review", "cid").agg(
        F.sum(value).alias("_s"), F.count(value).alias("_n"), F.max("_c").alias("_c")
    )
    if zero_fill:
        return agg.select("review", "cid", (F.col("_s") / F.least(F.lit(window), F.col("_c") + 1)).alias("avg"))
    return agg.where(F.col("_n") >= min_periods).select("review", "cid", (F.col("_s") / F.col("_n")).alias("avg"))


def eligible(universe: DataFrame, bars: DataFrame, schedule: DataFrame, derivatives: DataFrame | None,
             seasoned_days: int = 365) -> DataFrame:
    """Universe names listed long enough and (when given) on the derivatives list of the cutoff day."""
    first = bars.groupBy("cid").agg(F.min("date").alias("_first"))
    rows = universe.join(schedule.select("review", "cutoff"), "review").join(first, "cid")
    rows = rows.where(F.col("_first") <= F.date_sub("cutoff", seasoned_days))
    if derivatives is not None:
        listed = derivatives.select(F.col("date").alias("cutoff"), F.col("symbol").alias("cid")).distinct()
        rows = rows.join(listed, ["cutoff", "cid"], "left_semi")
    return rows.select("review", "cid")


def still_trading(names: DataFrame, bars: DataFrame, schedule: DataFrame, within: int = 10) -> DataFrame:
    """Names whose last trade is no older than ``within`` days before the cutoff."""
    last = bars.groupBy("cid").agg(F.max("date").alias("_last"))
    rows = names.join(schedule.select("review", "cutoff"), "review").join(last, "cid")
    return rows.where(F.col("_last") >= F.date_sub("cutoff", within)).select(*names.columns)


def momentum_scores(adj: DataFrame, schedule: DataFrame, members: DataFrame, sessions: DataFrame, days: int = 365) -> DataFrame:
    """Methodology scores and ranks per review. adj: (cid, date, adj); members: (review, cid), and further columns that
    name a list of their own for each review, as those of several universes."""
    by = [c for c in members.columns if c != "cid"]
    marks = schedule.select("review", F.explode(F.array(*[
        F.struct(F.lit(t).alias("tag"), F.col(t).alias("date")) for t in ("cutoff", "p7", "p13")
    ])).alias("m")).select("review", "m.tag", "m.date")
    on = {t: F.max(F.when(F.col("tag") == t, F.col("adj"))).alias(t) for t in ("cutoff", "p7", "p13")}
    points = adj.join(marks, "date").groupBy("review", "cid").agg(*on.values())

    w = ser.by_date()
    numbered = adj.join(sessions, "date")
    step = F.when(F.lag("session_no").over(w) == F.col("session_no") - 1, F.log(F.col("adj") / F.lag("adj").over(w)))
    rets = numbered.select("cid", "date", F.lag("date").over(w).alias("_p"), step.alias("ret")).where("ret is not null")
    span = schedule.select("review", F.date_sub("cutoff", days - 1).alias("_lo"), F.explode(
        F.sequence(F.date_sub("cutoff", days - 1), "cutoff")).alias("date"))
    sigma = rets.join(span, "date").where(F.col("_p") >= F.col("_lo")).groupBy("review", "cid").agg(
        (F.stddev_samp("ret") * math.sqrt(252)).alias("sigma"))

    base = points.join(sigma, ["review", "cid"]).join(members.distinct(), ["review", "cid"]).select(
        *by, "cid", (F.col("cutoff") / F.col("p13") - 1).alias("ret12"),
        (F.col("cutoff") / F.col("p7") - 1).alias("ret6"), "sigma")
    base = base.where(F.col("ret12").isNotNull() & F.col("ret6").isNotNull() & (F.col("sigma") > 0))
    ratio = base.withColumns({"mr12": F.col("ret12") / F.col("sigma"), "mr6": F.col("ret6") / F.col("sigma")})
    cross = W.partitionBy(*by)

    def z(c: str) -> Column:
        return F.try_divide(F.col(c) - F.avg(c).over(cross), F.stddev_samp(c).over(cross))

    wz = ratio.withColumn("wz", 0.5 * z("mr12") + 0.5 * z("mr6")).withColumn("n_eligible", F.count("*").over(cross))
    scored = wz.withColumn("score", F.when(F.col("wz") >= 0, 1 + F.col("wz")).otherwise(1 / (1 - F.col("wz"))))
    order = cross.orderBy(F.desc("score"), F.asc("cid"))
    return scored.withColumn("rank", F.row_number().over(order))


def buffered_select(scores: DataFrame, n: int = TOP_N, must_in: int = MUST_IN, must_out: int = MUST_OUT,
                    by: str = "strategy") -> DataFrame:
    """Top ``n`` with a buffer: ranks up to ``must_in`` always in, then holders up to ``must_out``, then the best of
    the rest until there are ``n``.

    Each review depends on the previous picks, so reviews are folded in order; a strategy's state is at most
    (reviews x the larger of n and must_out) names, and strategies run in parallel.
    """
    top = scores.where(F.col("rank") <= max(n, must_out)).groupBy(by, "review").agg(
        F.array_sort(F.collect_list(F.struct("rank", "cid"))).alias("names"))
    ordered = top.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("review", "names"))).alias("reviews"))
    pick = "array<struct<rank:int,cid:string>>"
    start = F.struct(F.array().cast("array<string>").alias("prev"),
                     F.array().cast(f"array<struct<review:string,picks:{pick}>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        names, prev = r["names"], acc["prev"]
        held = lambda x: (x["rank"] <= must_out) & F.array_contains(prev, x["cid"])
        later = F.filter(names, lambda x: x["rank"] > must_in)
        kept, rest = F.filter(later, held), F.filter(later, lambda x: ~held(x))
        buffered = F.slice(F.concat(F.slice(names, 1, must_in), kept, rest), 1, n)
        chosen = F.when(F.size(prev) == 0, F.slice(names, 1, n)).otherwise(buffered)
        entry = F.struct(r["review"].alias("review"), chosen.cast(pick).alias("picks"))
        return F.struct(F.transform(chosen, lambda x: x["cid"]).alias("prev"), F.concat(acc["out"], F.array(entry)).alias("out"))

    folded = ordered.select(by, F.explode(F.aggregate("reviews", start, step, lambda acc: acc["out"])).alias("o"))
    flat = folded.select(by, "o.review", F.explode("o.picks").alias("p"))
    return flat.select(by, "review", F.col("p.cid").alias("cid"), F.col("p.rank").alias("rank"))


def capped_weights(picks: DataFrame, by: list[str], cap_abs: float | Column = CAP_ABS, cap_mult: float = CAP_MULT) -> DataFrame:
    """weight ~ size x score with each weight at most min(cap_abs, cap_mult x size share).

    Closed form of pro-rata redistribution: in the order of cap/raw, names before the first one whose
    share of what is left fits under its cap are capped, the rest share the remainder.
    """
    g = W.partitionBy(*by)
    rows = picks.withColumns({
        "_cap": F.least(F.lit(cap_abs), cap_mult * F.col("size") / F.sum("size").over(g)),
        "_raw": F.col("size") * F.col("score"),
    })
    o = g.orderBy(F.col("_cap") / F.col("_raw"), "cid")
    used = F.coalesce(F.sum("_cap").over(o.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_raw").over(o.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("_lam", (1 - used) / left)
    fits = F.col("_lam") * F.col("_raw") <= F.col("_cap")
    lam = F.first(F.when(fits, F.col("_lam")), ignorenulls=True).over(o.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.withColumn("_w", F.coalesce(F.least(F.col("_cap"), lam * F.col("_raw")), F.col("_cap")))
    return rows.withColumn("weight", F.col("_w") / F.sum("_w").over(g)).drop("_cap", "_raw", "_lam", "_w")


def _segments(days: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """(by, effective, date): the days each weight set is held, after its date up to the next one."""
    sets = weights.select(*by, "effective").distinct()
    last = days.agg(F.date_add(F.max("date"), 0)).scalar()
    w = W.partitionBy(*by).orderBy("effective") if by else W.orderBy("effective")
    spans = sets.withColumn("_end", F.coalesce(F.lead("effective").over(w), last))
    held = spans.where(F.col("_end") > F.col("effective")).select(
        *by, "effective", F.explode(F.sequence(F.date_add("effective", 1), "_end")).alias("date"))
    return held.join(days, "date", "left_semi")


def drifting_portfolio(tr: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """(by, date, ret): reset to the weights at each effective close, then drift.

    Only traded rows are touched: a day's value change is the sum of the held names' own changes, so
    no dense date x name grid is built. ``tr`` is (cid, date, ret); a null return is no change.
    """
    days = tr.select("date").distinct()
    held = _segments(days, weights, by)
    moves = tr.where(F.col("ret").isNotNull()).join(weights.join(held, [*by, "effective"]), ["cid", "date"])
    w = W.partitionBy(*by, "effective", "cid").orderBy("date")
    g = F.product(1 + F.col("ret")).over(w.rowsBetween(W.unboundedPreceding, 0))
    moves = moves.withColumn("_g", g)
    moves = moves.withColumn("_d", F.col("weight") * (F.col("_g") - F.coalesce(F.lag("_g").over(w), F.lit(1.0))))
    change = moves.groupBy(*by, "effective", "date").agg(F.sum("_d").alias("_d"))
    total = weights.groupBy(*by, "effective").agg(F.sum("weight").alias("_w0"))
    path = held.join(change, [*by, "effective", "date"], "left").join(total, [*by, "effective"])
    s = W.partitionBy(*by, "effective").orderBy("date")
    value = F.col("_w0") + F.sum(F.coalesce("_d", F.lit(0.0))).over(s.rowsBetween(W.unboundedPreceding, 0))
    path = path.withColumn("_v", value)
    return path.select(*by, "effective", "date", (F.col("_v") / F.coalesce(F.lag("_v").over(s), F.lit(1.0)) - 1).alias("ret"))


def start_holdings(tr: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """(by, date, cid, weight): start-of-day weights of the drifting portfolio."""
    held = _segments(tr.select("date").distinct(), weights, by)
    grid = weights.join(held, [*by, "effective"]).join(tr.select("cid", "date", "ret"), ["cid", "date"], "left")
    w = W.partitionBy(*by, "effective", "cid").orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    grown = F.col("weight") * F.coalesce(F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w), F.lit(1.0))
    rows = grid.withColumn("_v", grown)
    day = W.partitionBy(*by, "date")
    return rows.select(*by, "date", "cid", (F.col("_v") / F.sum("_v").over(day)).alias("weight"))


def tracking_stats(pairs: DataFrame, by: list[str], rep: str = "rep", bench: str = "bench") -> DataFrame:
    """Annualised returns (252 days), gap, tracking error and correlation per group."""
    a, b = F.col(rep), F.col(bench)
    agg = pairs.where(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days"),
        F.product(1 + a).alias("_a"), F.product(1 + b).alias("_b"),
        (F.stddev_samp(a - b) * math.sqrt(252)).alias("tracking_error"), F.corr(a, b).alias("corr"))
    years = F.lit(252.0) / F.col("days")
    out = agg.withColumns({"cagr_rep": F.pow("_a", years) - 1, "cagr_bench": F.pow("_b", years) - 1})
    return out.select(*by, "start", "end", "days", "cagr_rep", "cagr_bench",
                      (F.col("cagr_rep") - F.col("cagr_bench")).alias("gap_pa"), "tracking_error", "corr")


def in_eras(rows: DataFrame, eras: list[tuple[str, str, str | None]]) -> DataFrame:
    """Tag each row with every (overlapping) era its date falls in."""
    spans = F.array(*[F.struct(F.lit(n).alias("era"), F.lit(a).cast("date").alias("a"),
                               F.lit(b or "9999-12-31").cast("date").alias("b")) for n, a, b in eras])
    tagged = rows.withColumn("_e", F.explode(F.filter(spans, lambda e: (e["a"] <= F.col("date")) & (F.col("date") <= e["b"]))))
    return tagged.withColumn("era", F.col("_e.era")).drop("_e")


def shift_effective(weights: DataFrame, sessions: DataFrame, shifts: list[int]) -> DataFrame:
    """One copy of the weights per shift in sessions; sets moved off the calendar are dropped."""
    tagged = weights.join(sessions.withColumnRenamed("date", "effective"), "effective").withColumn(
        "shift", F.explode(F.array(*[F.lit(s) for s in shifts])))
    moved = tagged.withColumn("session_no", F.col("session_no") + F.col("shift")).drop("effective")
    return moved.join(sessions.withColumnRenamed("date", "effective"), "session_no").drop("session_no")


def review_turnover(weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Names changed and one-way turnover from each weight set to the next.

    Every row is sent to its own set and, negated, to the following set; one grouped sum gives all
    differences.
    """
    by = by or []
    sets = weights.select(*by, "effective").distinct()
    w = W.partitionBy(*by).orderBy("effective") if by else W.orderBy("effective")
    order = sets.select(*by, "effective", F.lead("effective").over(w).alias("_next"),
                        (F.row_number().over(w) == 1).alias("_first"))
    rows = weights.join(order, [*by, "effective"])
    both = F.array(
        F.struct(F.when(~F.col("_first"), F.col("effective")).alias("at"), F.col("weight").alias("w"), F.lit(1).alias("cur")),
        F.struct(F.col("_next").alias("at"), (-F.col("weight")).alias("w"), F.lit(0).alias("cur")))
    sent = rows.select(*by, "cid", F.explode(both).alias("s")).where(F.col("s.at").isNotNull())
    diff = sent.groupBy(*by, F.col("s.at").alias("effective"), "cid").agg(
        F.sum("s.w").alias("_d"), F.min("s.cur").alias("_new"))
    return diff.groupBy(*by, "effective").agg(
        F.sum("_new").alias("names_changed"), (F.sum(F.abs("_d")) * 0.5).alias("one_way_turnover"))


def market_cap_estimate(cross: DataFrame, shares: DataFrame, by: list[str]) -> DataFrame:
    """price x shares; unknown counts get turnover x the median cap/turnover ratio of the known, flagged.

    cross: (by, cid, price, adv); shares: (cid, shares).
    """
    rows = cross.where(F.col("price").isNotNull() & F.col("adv").isNotNull()).join(shares, "cid", "left")
    cap = F.col("price") * F.col("shares")
    known = cap.isNotNull() & (F.col("adv") > 0)
    rows = rows.withColumns({"_cap": F.when(known, cap), "imputed": ~known})
    ratio = rows.groupBy(*by).agg(F.median(F.col("_cap") / F.col("adv")).alias("_ratio"))
    return rows.join(ratio, by).select(*by, "cid", F.coalesce("_cap", F.col("adv") * F.col("_ratio")).alias("mcap"), "imputed")


Rule = Callable[[dict], DataFrame]


def turnover_universe(ctx: dict, n: int = UNIVERSE_N) -> DataFrame:
    """Most traded names that still trade: (review, cid)."""
    alive = still_trading(ctx["adv"], ctx["bars"], ctx["schedule"])
    return top_n(alive, ["review"], [F.desc("avg"), F.asc("cid")], n).select("review", "cid")


def turnover_size(ctx: dict) -> DataFrame:
    return ctx["adv"].select("review", "cid", F.col("avg").alias("size"))


def mcap_rules(shares: DataFrame, n: int = UNIVERSE_N, min_periods: int = 100) -> tuple[Rule, Rule]:
    """Universe and size rules on the estimated market cap."""

    def caps(ctx: dict) -> DataFrame:
        px = average_turnover_at(ctx["adj"], ctx["schedule"], ctx["sessions"], min_periods=min_periods,
                                 value="adj", zero_fill=False)
        cross = px.withColumnRenamed("avg", "price").join(ctx["adv"].withColumnRenamed("avg", "adv"), ["review", "cid"])
        return market_cap_estimate(still_trading(cross, ctx["bars"], ctx["schedule"]), shares, ["review"])

    def universe(ctx: dict) -> DataFrame:
        return top_n(caps(ctx), ["review"], [F.desc("mcap"), F.asc("cid")], n).select("review", "cid")

    def size(ctx: dict) -> DataFrame:
        return caps(ctx).select("review", "cid", F.col("mcap").alias("size"))

    return universe, size


def run_reviews(ctx: dict, universe: Rule = turnover_universe, size: Rule = turnover_size, n: int = TOP_N,
                must_in: int = MUST_IN, must_out: int = MUST_OUT, cap_abs: float = CAP_ABS,
                cap_mult: float = CAP_MULT, strategy: str = "tilt") -> DataFrame:
    """Selections with target weights at every review.

    ctx: bars, adj (cid, date, adj), schedule, sessions, adv (review, cid, avg), derivatives or None.
    """
    names = eligible(universe(ctx), ctx["bars"], ctx["schedule"], ctx.get("derivatives"))
    scores = momentum_scores(ctx["adj"], ctx["schedule"], names, ctx["sessions"])
    picks = buffered_select(scores.withColumn("strategy", F.lit(strategy)), n, must_in, must_out)
    detail = picks.drop("rank").join(scores, ["review", "cid"])
    sizes = size(ctx)
    middle = sizes.groupBy("review").agg(F.median("size").alias("_mid"))
    sized = detail.join(sizes, ["review", "cid"], "left").join(middle, "review", "left")
    sized = sized.withColumn("size", F.coalesce("size", "_mid")).drop("_mid")
    weighted = capped_weights(sized, ["strategy", "review"], cap_abs, cap_mult)
    equal = F.lit(1.0) / F.count("*").over(W.partitionBy("strategy", "review"))
    return weighted.withColumn("weight_ew", equal).join(ctx["schedule"].select("review", "cutoff", "effective"), "review")


def candidates(ctx: dict, shares: DataFrame, min_periods: int = 100) -> DataFrame:
    """(rule, review, cid, size, alive): the size of every name at every review by each rule, ``turnover`` and ``mcap``.

    The market cap is estimated over names that still trade; the others have a turnover only."""
    px = average_turnover_at(ctx["adj"], ctx["schedule"], ctx["sessions"], min_periods=min_periods, value="adj", zero_fill=False)
    adv = ctx["adv"].join(still_trading(ctx["adv"], ctx["bars"], ctx["schedule"]).select("review", "cid", F.lit(True).alias("alive")), ["review", "cid"], "left")
    adv = adv.withColumn("alive", F.coalesce("alive", F.lit(False)))
    cross = px.withColumnRenamed("avg", "price").join(adv.where("alive").withColumnRenamed("avg", "adv"), ["review", "cid"])
    caps = market_cap_estimate(cross, shares, ["review"]).select(F.lit("mcap").alias("rule"), "review", "cid", F.col("mcap").alias("size"), F.lit(True).alias("alive"))
    return caps.unionByName(adv.select(F.lit("turnover").alias("rule"), "review", "cid", F.col("avg").alias("size"), "alive"))


def run_scenarios(ctx: dict, scenarios: DataFrame, sizes: DataFrame, universe_n: int = UNIVERSE_N, n: int = TOP_N, must_in: int = MUST_IN,
                  must_out: int = MUST_OUT, cap_mult: float = CAP_MULT, seasoned_days: int = 365) -> DataFrame:
    """(scenario, effective, cid, weight) of every scenario in one plan.

    A scenario is a row: scenario, universe (rule), size (rule), weighting (tilt, equal, or universe for the whole universe by
    size), cap (largest weight), shift (sessions), derivatives (names must be on the list of the cutoff day). Scenarios with the
    same universe and filter share its scores and picks. ``sizes``: see ``candidates``; ctx as in ``run_reviews``, with
    ``derivatives`` where a scenario asks for them.
    """
    key = F.concat_ws("|", "universe", F.col("derivatives").cast("string"))
    scenarios = scenarios.withColumn("plan", F.when(F.col("weighting") != "universe", key))
    names = top_n(sizes.where("alive"), ["rule", "review"], [F.desc("size"), F.asc("cid")], universe_n).select("rule", "review", "cid", "size")
    plans = scenarios.where("plan IS NOT NULL").select("plan", F.col("universe").alias("rule"), "derivatives").distinct()
    first = ctx["bars"].groupBy("cid").agg(F.min("date").alias("_first"))
    members = names.join(plans, "rule").join(ctx["schedule"].select("review", "cutoff"), "review").join(first, "cid")
    members = members.where(F.col("_first") <= F.date_sub("cutoff", seasoned_days))
    if ctx.get("derivatives") is not None:
        listed = ctx["derivatives"].select(F.col("date").alias("cutoff"), F.col("symbol").alias("cid")).distinct().withColumn("_on", F.lit(True))
        members = members.join(listed, ["cutoff", "cid"], "left").where("NOT derivatives OR _on")
    scores = materialized(momentum_scores(ctx["adj"], ctx["schedule"], members.select("plan", "review", "cid"), ctx["sessions"]), "scores")
    picks = buffered_select(scores, n, must_in, must_out, by="plan").drop("rank").join(scores.select("plan", "review", "cid", "score"), ["plan", "review", "cid"])

    middle = sizes.groupBy("rule", "review").agg(F.median("size").alias("_mid"))
    own = picks.join(scenarios.withColumnRenamed("size", "rule"), "plan").join(sizes.select("rule", "review", "cid", "size"), ["rule", "review", "cid"], "left")
    own = own.join(middle, ["rule", "review"], "left").withColumn("size", F.coalesce("size", "_mid"))
    tilt = capped_weights(own.where("weighting = 'tilt'"), ["scenario", "review"], F.col("cap"), cap_mult).select("scenario", "shift", "review", "cid", "weight")
    equal = own.where("weighting = 'equal'").withColumn("weight", F.lit(1.0) / F.count("*").over(W.partitionBy("scenario", "review")))
    whole = names.join(scenarios.where("weighting = 'universe'").select("scenario", "shift", F.col("universe").alias("rule")), "rule")
    whole = whole.withColumn("weight", F.col("size") / F.sum("size").over(W.partitionBy("scenario", "review")))
    cols = ["scenario", "shift", "review", "cid", "weight"]
    weights = tilt.unionByName(equal.select(cols)).unionByName(whole.select(cols)).join(ctx["schedule"].select("review", "effective"), "review")
    placed = weights.join(ctx["sessions"].withColumnRenamed("date", "effective"), "effective").drop("effective")
    placed = placed.withColumn("session_no", F.col("session_no") + F.col("shift"))
    return placed.join(ctx["sessions"].withColumnRenamed("date", "effective"), "session_no").select("scenario", "effective", "cid", "weight")


def held_jumps(total: DataFrame, holdings: DataFrame, audited: DataFrame, limit: float = 0.2) -> DataFrame:
    """Held names with a raw move beyond +-limit: weight, contribution, clipped, unexplained."""
    unexplained = audited.where("status = 'unexplained'").select("cid", F.col("ex_date").alias("date"), F.lit(True).alias("_u"))
    moved = total.where(F.abs("raw_return") > limit)
    rows = holdings.where(F.col("weight") > 0).join(moved, ["cid", "date"]).join(unexplained.distinct(), ["cid", "date"], "left")
    return rows.select("date", "cid", F.col("raw_return").alias("raw_move"), "weight",
                       (F.col("weight") * F.col("ret")).alias("contribution"), (F.abs("raw_return") > 0.6).alias("clipped"),
                       F.coalesce("_u", F.lit(False)).alias("unexplained_gap"))


def dividend_yield_by_year(total: DataFrame, holdings: DataFrame) -> DataFrame:
    """Sum per year of weight x dividend / previous adjusted price."""
    paid = total.select("cid", "date", (F.col("dividend") / F.lag("adj").over(ser.by_date())).alias("_y"))
    return holdings.join(paid.where(F.col("_y") > 0), ["cid", "date"]).groupBy(
        F.year("date").cast("long").alias("year")).agg(F.sum(F.col("weight") * F.col("_y")).alias("dividend_yield"))


def turnover_means(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean names changed and mean one-way turnover over the reviews."""
    return changes.groupBy(*(by or [])).agg(F.count("*").alias("reviews"), F.avg("names_changed").alias("names_changed"), F.avg("one_way_turnover").alias("one_way_turnover"))


def era_pivot(stats: DataFrame, by: str, eras: list[str], values: tuple[str, ...] = ("gap_pa", "tracking_error")) -> DataFrame:
    """One row per experiment, one column per era and value."""
    return stats.groupBy(by).pivot("era", eras).agg(*[F.first(v).alias(v) for v in values])
