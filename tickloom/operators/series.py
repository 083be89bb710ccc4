"""Single-series operators on long ``(key, date, value)`` tables.

Every table here is unique on (key, date): the adapters and the keep-last dedupe reduce raw rows to
that grain with map-side partial aggregates. A window partition therefore never holds more rows than
the calendar has days, whatever share of the raw rows belongs to one key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import calendar as cal
from tickloom.functions import numeric as num

TRADING_DAYS = 252


def by_date(key: str = "cid") -> W:
    return W.partitionBy(key).orderBy("date")


def log_returns(bars: DataFrame, key: str = "cid", value: str = "close", calendar: str = "panel") -> DataFrame:
    """(key, date, ret). No fill: with ``calendar='panel'`` a return needs the previous panel day too.

    ``calendar='own'`` differences consecutive observations of the series itself.
    """
    px = bars.select(key, "date", F.when(F.col(value) > 0, F.col(value)).alias("_v"))
    w = by_date(key)
    if calendar == "own":
        out = px.where(F.col("_v").isNotNull()).withColumn("ret", F.log(F.col("_v") / F.lag("_v").over(w)))
    else:
        numbered = px.join(cal.session_table(bars), "date")
        consecutive = F.lag("session_no").over(w) == F.col("session_no") - 1
        out = numbered.withColumn("ret", F.when(consecutive, F.log(F.col("_v") / F.lag("_v").over(w))))
    return out.where(F.col("ret").isNotNull()).select(key, "date", "ret")


def simple_returns(bars: DataFrame, key: str = "cid", value: str = "close") -> DataFrame:
    """value / previous panel day's value - 1; null (dropped) where either day is missing."""
    w = by_date(key)
    numbered = bars.select(key, "date", F.col(value).alias("_v")).join(cal.session_table(bars), "date")
    step = F.when(F.lag("session_no").over(w) == F.col("session_no") - 1, F.col("_v") / F.lag("_v").over(w) - 1)
    return numbered.withColumn("ret", step).where(F.col("ret").isNotNull()).select(key, "date", "ret")


def traded_gap(bars: DataFrame, key: str = "cid", value: str = "close") -> DataFrame:
    """Log move since the previous traded close, across any gap: (key, date, gap, prev_close)."""
    w = by_date(key)
    prev = F.lag(value).over(w)
    return bars.select(key, "date", value, prev.alias("prev_close"), F.log(F.col(value) / prev).alias("gap"))


def drawdown(bars: DataFrame, key: str = "cid", value: str = "close") -> DataFrame:
    peak = F.max(value).over(by_date(key).rowsBetween(W.unboundedPreceding, 0))
    return bars.where(F.col(value).isNotNull()).select(key, "date", (F.col(value) / peak - 1).alias("drawdown"))


def full_window(agg: Column, counted: Column, w: W, need: int) -> Column:
    """A window aggregate that is null until the frame holds ``need`` observations."""
    return F.when(F.count(counted).over(w) >= need, agg.over(w))


def rolling_vol(returns: DataFrame, window: int = 21, key: str = "cid") -> DataFrame:
    """Annualised standard deviation over the last ``window`` returns, full windows only."""
    w = by_date(key).rowsBetween(-(window - 1), 0)
    vol = full_window(F.stddev_samp("ret"), F.col("ret"), w, window) * math.sqrt(TRADING_DAYS)
    return returns.withColumn("vol", vol).where(F.col("vol").isNotNull()).select(key, "date", "vol")


def trailing_percentile(series: DataFrame, value: str, window: int = 756, min_periods: int = 252,
                        key: str = "cid") -> DataFrame:
    """Share of the trailing window at or below the current value, the value itself included."""
    w = by_date(key).rowsBetween(-(window - 1), 0)
    seen = series.where(F.col(value).isNotNull()).select(
        key, "date", F.col(value).alias("_v"), F.collect_list(value).over(w).alias("_win")
    )
    below = F.size(F.filter("_win", lambda x: x <= F.col("_v")))
    return seen.where(F.size("_win") >= min_periods).select(key, "date", (below / F.size("_win")).alias("pct"))


def cumulative(series: DataFrame, value: str, key: str | None = None, out: str = "cum") -> DataFrame:
    """Running total per key; partial sums per year keep a long single series parallel."""
    keys = [key] if key else []
    days = series.where(F.col(value).isNotNull()).withColumn("_y", F.year("date"))
    inside = F.sum(value).over(W.partitionBy(*keys, "_y").orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    years = days.groupBy(*keys, "_y").agg(F.sum(value).alias("_s"))
    earlier = W.partitionBy(*keys).orderBy("_y").rowsBetween(W.unboundedPreceding, -1)
    carried = years.select(*keys, "_y", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    return (
        days.withColumn("_in", inside).join(carried, [*keys, "_y"])
        .withColumn(out, F.col("_in") + F.col("_before")).drop("_in", "_before", "_y")
    )


def weekly_bars(bars: DataFrame, key: str = "cid", value: str = "close") -> DataFrame:
    """Last observation of each week ending Friday."""
    return (
        bars.where(F.col(value).isNotNull())
        .groupBy(key, cal.week_ending_friday(F.col("date")).alias("week"))
        .agg(F.max_by(value, "date").alias(value))
    )


def weekly_sum(series: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return series.groupBy(*keys, cal.week_ending_friday(F.col("date")).alias("week")).agg(F.sum(value).alias(value))


def month_end_bars(bars: DataFrame, key: str = "cid", value: str = "close") -> DataFrame:
    """Last observation of each month with the session it came from."""
    return bars.groupBy(key, F.last_day("date").alias("month_end")).agg(
        F.max_by(value, "date").alias(value), F.max("date").alias("session")
    )


def rebase(bars: DataFrame, key: str = "cid", value: str = "close", start=None) -> DataFrame:
    """Every series scaled to 100 on the first date all of them have; incomplete dates are dropped."""
    seen = bars.where(F.col(value).isNotNull())
    n_keys = seen.select(key).distinct().agg(F.count("*")).scalar()
    if start is not None:
        seen = seen.where(F.col("date") >= F.lit(start))
    complete = seen.groupBy("date").agg(F.count("*").alias("_n")).where(F.col("_n") == n_keys).select("date")
    kept = seen.join(complete, "date", "left_semi")
    base = kept.groupBy(key).agg(F.min_by(value, "date").alias("_b"))
    return kept.join(base, key).select(key, "date", (F.col(value) / F.col("_b") * 100).alias("rebased"))


def period_returns(bars: DataFrame, key: str = "cid", value: str = "close") -> DataFrame:
    """Returns over 1D/1W/1M/3M/YTD/1Y, each series measured to its own last date."""
    seen = bars.where(F.col(value).isNotNull())
    ends = seen.groupBy(key).agg(F.max("date").alias("as_of"), F.count("*").alias("_n")).where("_n >= 2").drop("_n")
    d, end, v = F.col("date"), F.col("as_of"), F.col(value)
    marks = {
        "d1": d < end,
        "w1": d <= F.date_sub(end, 7),
        "m1": d <= F.add_months(end, -1),
        "m3": d <= F.add_months(end, -3),
        "ytd": d < F.trunc(end, "year"),
        "y1": d <= F.add_months(end, -12),
    }
    # one scan, one partial aggregate per key: the value at the latest date that satisfies each bound
    aggs = [F.max_by(v, F.when(cond, d)).alias(name) for name, cond in marks.items()]
    picked = seen.join(ends, key).groupBy(key, "as_of").agg(F.max_by(v, d).alias("last"), *aggs)
    return picked.select(key, "as_of", "last", *[(F.col("last") / F.col(m) - 1).alias(m) for m in marks])


def summary_stats(bars: DataFrame, key: str = "cid", value: str = "close") -> DataFrame:
    """Risk and distribution summary per series on its own calendar (365.25-day years)."""
    w = by_date(key)
    v = F.col(value)
    step = bars.where(v.isNotNull()).select(
        key, "date", v.alias("_v"),
        F.log(v / F.lag(v).over(w)).alias("ret"),
        (v / F.max(v).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).alias("_dd"),
    )
    agg = step.groupBy(key).agg(
        F.min("date").alias("from_date"), F.max("date").alias("to_date"), F.count("*").alias("n_obs"),
        F.min_by("_v", "date").alias("_a"), F.max_by("_v", "date").alias("_b"),
        F.stddev_samp("ret").alias("_sd"), F.skewness("ret").alias("_g1"), F.kurtosis("ret").alias("_g2"),
        F.count("ret").alias("_n"), F.max("ret").alias("best_day"), F.min("ret").alias("worst_day"),
        F.min("_dd").alias("max_drawdown"), F.avg((F.col("ret") < 0).cast("double")).alias("pct_down_days"),
    )
    years = F.datediff("to_date", "from_date") / F.lit(365.25)
    return agg.select(
        key, "from_date", "to_date", "n_obs",
        F.when(years > 0, F.pow(F.col("_b") / F.col("_a"), F.try_divide(F.lit(1.0), years)) - 1).alias("cagr"),
        (F.col("_sd") * math.sqrt(TRADING_DAYS)).alias("ann_vol"),
        num.corrected_skew(F.col("_g1"), F.col("_n")).alias("skew"),
        num.corrected_excess_kurtosis(F.col("_g2"), F.col("_n")).alias("excess_kurtosis"),
        "best_day", "worst_day", "max_drawdown", "pct_down_days",
    )


def coverage(bars: DataFrame, key: str = "cid", value: str = "close") -> DataFrame:
    """Rows, first, last and percent of the panel's days in the series' span."""
    seen = bars.where(F.col(value).isNotNull())
    per = seen.groupBy(key).agg(F.count("*").alias("n_rows"), F.min("date").alias("first"), F.max("date").alias("last"))
    days = cal.session_table(bars)
    a = days.select(F.col("date").alias("first"), F.col("session_no").alias("_a"))
    b = days.select(F.col("date").alias("last"), F.col("session_no").alias("_b"))
    span = F.col("_b") - F.col("_a") + 1
    return per.join(a, "first").join(b, "last").select(
        key, "n_rows", "first", "last", F.round(F.lit(100.0) * F.col("n_rows") / span, 1).alias("pct_of_span")
    )


def common_window(bars: DataFrame, key: str = "cid") -> DataFrame:
    """Latest first date and earliest last date over all series."""
    per = bars.groupBy(key).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    return per.agg(F.max("_a").alias("start_date"), F.min("_b").alias("end_date"))


def clip_lookback(bars: DataFrame, years: int) -> DataFrame:
    """Rows within ``years`` of the panel's last date."""
    start = bars.agg(F.add_months(F.max("date"), -12 * years)).scalar()
    return bars.where(F.col("date") >= start)


def break_gaps(bars: DataFrame, max_days: int = 10, key: str = "cid", value: str = "close") -> DataFrame:
    """A null row the day before a series resumes after more than ``max_days`` days."""
    w = by_date(key)
    gap = F.datediff("date", F.lag("date").over(w))
    # one pass: a row that ends a long gap is emitted twice, once as the null marker
    both = F.array(
        F.struct(F.date_sub("date", 1).alias("date"), F.lit(None).cast("double").alias(value), F.lit(True).alias("m")),
        F.struct(F.col("date"), F.col(value), F.lit(False).alias("m")),
    )
    rows = bars.select(key, "date", value, gap.alias("_gap")).select(key, "_gap", F.explode(both).alias("r"))
    return rows.where(~F.col("r.m") | (F.col("_gap") > max_days)).select(key, "r.date", f"r.{value}")


def add_derived(bars: DataFrame, derived: DataFrame, key: str = "cid", value: str = "close") -> DataFrame:
    """Product series for each (derived, parts) row, only on dates where every part exists."""
    wanted = derived.select("derived", F.size("parts").alias("_need"), F.explode("parts").alias(key))
    return (
        bars.join(wanted, key).groupBy("derived", "_need", "date")
        .agg(F.count(value).alias("_n"), F.product(value).alias(value))
        .where(F.col("_n") == F.col("_need")).select(F.col("derived").alias(key), "date", value)
    )


def keys_of(bars: DataFrame, key: str = "cid") -> list[str]:
    """The keys of a panel, sorted: the columns of its wide form, which a table can only have so many of."""
    return [r[0] for r in bars.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).collect()]


def align_wide(bars: DataFrame, keys: list[str], key: str = "cid", value: str = "close") -> DataFrame:
    """One row per date, one column per listed key; union of calendars, gaps stay null."""
    return bars.groupBy("date").pivot(key, list(keys)).agg(F.first(value))


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key. An aggregate, not a ranking: copies collapse before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def zero_return_share(returns: DataFrame, start, min_obs: int = 500, key: str = "cid") -> DataFrame:
    return (
        returns.where(F.col("date") >= F.lit(start).cast("date")).groupBy(key)
        .agg(F.count("ret").alias("n_obs"), F.avg((F.col("ret") == 0).cast("double")).alias("zero_share"))
        .where(F.col("n_obs") >= min_obs)
    )


def regime_labels(level: DataFrame, value: str, calm_q: float = 0.5, stress_q: float = 0.9,
                  key: str = "cid") -> DataFrame:
    """In-sample calm / elevated / stress labels from each series' own quantiles."""
    cut = level.groupBy(key).agg(F.percentile(value, calm_q).alias("lo"), F.percentile(value, stress_q).alias("hi"))
    return level.where(F.col(value).isNotNull()).join(cut, key).select(key, "date", label(F.col(value)).alias("regime"))


def label(v: Column) -> Column:
    return F.when(v >= F.col("hi"), "stress").when(v <= F.col("lo"), "calm").otherwise("elevated")


def expanding_ranks(rows: DataFrame, value: str, key: str = "cid") -> DataFrame:
    """(key, date, value, n, below, upto): how many values of the series' past, the day included, there are, are smaller,
    and are not larger.

    The past of a day is a union of blocks of 1, 2, 4, ... days, one for each bit of its number. On each level the days of
    a pair of blocks are sorted by value once, and a running count of those of the earlier block serves all days of
    the later one. That is one row per day and level, dealt by block, so a long series spreads over tasks.
    """
    numbered = rows.select(key, "date", F.col(value).alias("v")).where("v IS NOT NULL").withColumns({
        "t": F.row_number().over(by_date(key)) - 1, "equal": F.row_number().over(W.partitionBy(key, "v").orderBy("date")), "last": F.count("*").over(W.partitionBy(key)) - 1})
    level = F.explode(F.sequence(F.lit(0), F.greatest(F.floor(F.log2(F.greatest("last", F.lit(1)))), F.lit(0)).cast("int")))
    placed = numbered.select(key, "date", "v", "t", "equal", level.alias("level")).withColumn("half", F.expr("shiftright(t, level)"))
    placed = placed.withColumn("block", F.shiftright("half", 1)).withColumn("late", F.col("half") % 2).repartition(key, "level", "block")
    earlier = F.sum(1 - F.col("late")).over(W.partitionBy(key, "level", "block").orderBy("v").rangeBetween(W.unboundedPreceding, 0))
    counted = placed.select(key, "date", "v", "t", "equal", (F.col("late") * earlier).alias("c"))
    total = counted.groupBy(key, "date").agg(F.first("v").alias("v"), F.first("t").alias("t"), F.first("equal").alias("equal"), F.sum("c").alias("c"))
    return total.select(key, "date", F.col("v").alias(value), (F.col("t") + 1).alias("n"), (F.col("c") + 1 - F.col("equal")).alias("below"), (F.col("c") + 1).alias("upto"))


def regime_labels_expanding(level: DataFrame, value: str, calm_q: float = 0.5, stress_q: float = 0.9,
                            min_periods: int = 252, key: str = "cid") -> DataFrame:
    """Labels from the quantiles of each series' past, the day included, once it has ``min_periods`` values.

    A quantile lies between the order statistics around position q (n - 1); as the day's own value is one of them, its rank
    alone tells on which side of the quantile it is.
    """
    ranked = expanding_ranks(level, value, key).where(F.col("n") >= min_periods)
    stress = F.col("upto") - 1 >= F.ceil(F.lit(stress_q) * (F.col("n") - 1))
    calm = F.col("below") <= F.floor(F.lit(calm_q) * (F.col("n") - 1))
    return ranked.select(key, "date", F.when(stress, "stress").when(calm, "calm").otherwise("elevated").alias("regime"))


def lag_regime(regimes: DataFrame, key: str = "cid") -> DataFrame:
    """The label of the previous observation, so a day is never classified by its own move."""
    shifted = regimes.withColumn("regime", F.lag("regime").over(by_date(key)))
    return shifted.where(F.col("regime").isNotNull())


def since_first(marks: DataFrame, columns: list[str], key: str = "book") -> DataFrame:
    """Cumulative return of each column since the key's first mark."""
    base = marks.groupBy(key).agg(*[F.min_by(c, "date").alias(f"_{c}") for c in columns])
    rel = [(F.try_divide(F.col(c), F.col(f"_{c}")) - 1).alias(f"{c}_ret") for c in columns]
    return marks.join(base, key).select(*marks.columns, *rel)


def average_turnover(bars: DataFrame, window: int = 126, min_periods: int = 100, key: str = "cid") -> DataFrame:
    """Average daily turnover over the last ``window`` sessions, days without a trade counting as zero.

    The frame is a range on the session number, so missing days need no rows.
    """
    numbered = bars.select(key, "date", "turnover").join(cal.session_table(bars), "date")
    w = W.partitionBy(key).orderBy("session_no").rangeBetween(-(window - 1), 0)
    days = F.least(F.lit(window), F.col("session_no") + 1)
    return numbered.withColumn("adv", F.sum("turnover").over(w) / days).where(
        F.col("session_no") + 1 >= min_periods
    ).select(key, "date", "session_no", "adv")


def sma_signal(bars: DataFrame, lengths: list[int], key: str = "cid", value: str = "close") -> DataFrame:
    """Month-end decisions per average length: 1 when the close is above its own average, else 0."""
    w = by_date(key)
    month_last = F.lead("date").over(w)
    cols = [
        F.struct(F.lit(n).alias("n"), full_window(F.avg(value), F.col(value), w.rowsBetween(-(n - 1), 0), n).alias("sma"))
        for n in lengths
    ]
    rows = bars.select(key, "date", value, month_last.alias("_next"), F.array(*cols).alias("_s"))
    ends = rows.where(F.col("_next").isNull() | (F.trunc("_next", "month") != F.trunc("date", "month")))
    return (
        ends.select(key, "date", value, F.explode("_s").alias("s")).where(F.col("s.sma").isNotNull())
        .select(key, F.col("s.n").alias("n"), "date", (F.col(value) > F.col("s.sma")).cast("double").alias("on"))
    )
