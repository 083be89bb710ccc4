"""Strategy-statistics queries: costs, returns, metrics, overfitting, splits, gates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tickloom.functions import calendar as cal
from tickloom.functions import costs
from tickloom.functions import numeric as num
from tickloom.operators import backtest as bt
from tickloom.operators import gates, overfit, splits
from tickloom.operators import series as ser
from tickloom.operators.ranking import best_by
from tickloom.plans.catalog import BARS, BARS6, MARKET, SESS, SIMPLE, query, r, rnd, rounded_columns
from tickloom.session import materialized
from tickloom.sources import adapters as ad

# a schedule inside the sample, so that every row of it is used
SAMPLE = {"futures": [("1996-01-01", 0.0001, 0.0), ("1998-04-01", 0.000125, 0.0), ("2000-10-01", 0.0002, 0.00005)]}


@query("cost_rates", f"""WITH {MARKET}, s AS (SELECT *, coalesce(lead(f) OVER (ORDER BY f), DATE '9999-12-31') AS t FROM (VALUES
    (DATE '0001-01-01', 0.0001, 0.0), (DATE '1998-04-01', 0.000125, 0.0), (DATE '2000-10-01', 0.0002, 0.00005)) v(f, sell, buy))
  SELECT date, {r('buy + 0.00002 + (0.0000183 + 0.000001) * 1.18', 9)} AS buy, {r('sell + (0.0000183 + 0.000001) * 1.18', 9)} AS sell,
    {r('buy + sell + 0.00002 + 2 * (0.0000183 + 0.000001) * 1.18', 9)} AS round_trip FROM mkt JOIN s ON date >= f AND date < t""")
def _(spark, d):
    rate = costs.side_costs("futures", F.col("date"), schedule=SAMPLE)
    days = ad.market_close(spark, d).select("date")
    return rounded_columns(days.select("date", *[c.alias(k) for k, c in rate.items()]), 9)


@query("impact_cost", f"""WITH {BARS}, s AS (SELECT cid, date, turnover, close / lag(close) OVER w - 1 AS ret FROM bars WINDOW w AS (PARTITION BY cid ORDER BY date)),
  v AS (SELECT cid, stddev_samp(ret) AS vol, avg(turnover) AS adv FROM s GROUP BY 1)
  SELECT cid, date, {r('0.7 * vol * sqrt(turnover / adv)')} AS impact FROM bars JOIN v USING (cid)""")
def _(spark, d):
    bars = ad.bars_table(spark, d)
    step = bars.select("cid", "turnover", (F.col("close") / F.lag("close").over(ser.by_date()) - 1).alias("ret"))
    per = step.groupBy("cid").agg(F.stddev_samp("ret").alias("vol"), F.avg("turnover").alias("adv"))
    out = bars.join(per, "cid").select("cid", "date", costs.sqrt_impact(F.col("turnover"), F.col("adv"), F.col("vol")).alias("impact"))
    return rounded_columns(out)


def _trials(spark, d):
    return ser.simple_returns(ad.type_bars_table(spark, d)).withColumnRenamed("cid", "trial")


TRIALS = f"{BARS6}, {SESS}, {SIMPLE}, tr AS (SELECT cid AS trial, date, ret FROM rets)"
PATH = "pth AS (SELECT *, product(1 + ret) OVER (PARTITION BY trial ORDER BY date) AS eq FROM tr), dd AS (SELECT *, eq / max(eq) OVER (PARTITION BY trial ORDER BY date) - 1 AS dd FROM pth)"


@query("trial_metrics", f"""WITH {TRIALS}, {PATH} SELECT trial, count(*) AS n,
  {r('CASE WHEN product(1 + ret) > 0 THEN pow(product(1 + ret), 252.0 / count(*)) - 1 ELSE -1 END', 4)} AS cagr, {r('stddev_samp(ret) * sqrt(252)')} AS vol,
  {r('avg(ret) / stddev_samp(ret) * sqrt(252)')} AS sharpe, {r('min(dd)')} AS max_dd FROM dd GROUP BY 1""")
def _(spark, d):
    return rounded_columns(bt.performance(_trials(spark, d), ["trial"])).withColumn("cagr", rnd("cagr", 4))


@query("best_trial", f"WITH {TRIALS}, m AS (SELECT trial, avg(ret) / stddev_samp(ret) AS sr FROM tr GROUP BY 1) SELECT max_by(trial, sr) AS trial, {r('max(sr)')} AS sr FROM m")
def _(spark, d):
    m = overfit.sharpe_moments(_trials(spark, d), ["trial"])
    return rounded_columns(m.agg(F.max_by("trial", "sr").alias("trial"), F.max("sr").alias("sr")))


@query("sharpe_moments", f"""WITH {TRIALS}, s AS (SELECT trial, count(*) AS n, avg(ret) AS m, stddev_pop(ret) AS sp, stddev_samp(ret) AS sd, avg(ret*ret*ret) AS m3 FROM tr GROUP BY 1)
  SELECT trial, n, {r('m / sd')} AS sr, {r('(SELECT avg(pow((t.ret - s.m) / s.sp, 3)) FROM tr t WHERE t.trial = s.trial)', 5)} AS skew,
    {r('(SELECT kurtosis_pop(t.ret) + 3 FROM tr t WHERE t.trial = s.trial)', 5)} AS kurt FROM s""")
def _(spark, d):
    m = overfit.sharpe_moments(_trials(spark, d), ["trial"])
    return rounded_columns(m, 5, ("skew", "kurt")).withColumn("sr", rnd("sr"))


def _sum_of(coefficients, x: str) -> str:
    return "(" + " + ".join(f"{c!r}::DOUBLE * pow({x}, {len(coefficients) - 1 - i})" for i, c in enumerate(coefficients)) + ")"


def cdf_sql(z: str) -> str:
    x = f"abs({z})"
    below = f"exp(-{x} * {x} / 2) * CASE WHEN {x} < {num.TAIL_FROM} THEN {_sum_of(num.CDF_TOP, x)} / {_sum_of(num.CDF_BOTTOM, x)}"
    below += f" ELSE 1 / ({x} + 1 / ({x} + 2 / ({x} + 3 / ({x} + 4 / ({x} + 0.65))))) / sqrt(2 * pi()) END"
    return f"(CASE WHEN {z} > 0 THEN 1 - {below} ELSE {below} END)"


# the quantile as the limit of a bisection on the distribution function
QUANTILE = f"""qt AS (SELECT i, p, -40.0::DOUBLE AS lo, 40.0::DOUBLE AS hi, 0 AS k FROM probs UNION ALL
  SELECT i, p, CASE WHEN {cdf_sql('((lo + hi) / 2)')} < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {cdf_sql('((lo + hi) / 2)')} < p THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM qt WHERE k < 60),
  qv AS (SELECT i, (lo + hi) / 2 AS z FROM qt WHERE k = 60)"""
MOMENTS = """s0 AS (SELECT trial, count(*) AS n, avg(ret) AS m, stddev_pop(ret) AS sp, stddev_samp(ret) AS sd FROM tr GROUP BY 1),
  s1 AS (SELECT trial, avg(pow((ret - m) / sp, 3)) AS skew, avg(pow((ret - m) / sp, 4)) AS kurt FROM tr JOIN s0 USING (trial) GROUP BY 1),
  mo AS (SELECT trial, n, m / sd AS sr, skew, kurt, 1 - skew * (m / sd) + (kurt - 1) / 4 * (m / sd) * (m / sd) AS spread FROM s0 JOIN s1 USING (trial))"""


@query("psr_dsr", f"""WITH RECURSIVE {TRIALS}, {MOMENTS}, pool AS (SELECT var_samp(sr) AS var_sr, count(*) AS n_trials FROM mo),
  probs AS (SELECT 1 AS i, 1 - 1.0::DOUBLE / n_trials AS p FROM pool UNION ALL SELECT 2, 1 - 1 / (n_trials * exp(1.0::DOUBLE)) FROM pool), {QUANTILE},
  bar AS (SELECT var_sr, n_trials, sqrt(var_sr) * ((1 - 0.5772156649015329::DOUBLE) * (SELECT z FROM qv WHERE i = 1) + 0.5772156649015329::DOUBLE * (SELECT z FROM qv WHERE i = 2)) AS sr0 FROM pool),
  zs AS (SELECT *, sr * sqrt(n - 1) / sqrt(greatest(spread, 1e-12)) AS z1, (sr - sr0) * sqrt(n - 1) / sqrt(greatest(spread, 1e-12)) AS z2 FROM mo, bar)
  SELECT trial, n, {r('sr')} AS sr, {r('skew')} AS skew, {r('kurt')} AS kurt, {r(cdf_sql('z1'))} AS psr, {r('sr0')} AS sr0, {r('var_sr')} AS var_sr, n_trials,
    {r('sr0 * sqrt(252.0)')} AS sr0_ann, {r(cdf_sql('z2'))} AS dsr FROM zs""")
def _(spark, d):
    m = overfit.psr(overfit.sharpe_moments(_trials(spark, d), ["trial"]), F.lit(0.0))
    return rounded_columns(overfit.deflated_sharpe(m))


@query("haircut_mintrl", f"""WITH RECURSIVE {TRIALS}, {MOMENTS}, h AS (SELECT *, sr * sqrt(252.0) AS sr_ann, n / 252.0::DOUBLE AS y, sr * sqrt(252.0) * sqrt(n / 252.0::DOUBLE) AS t_stat FROM mo),
  hp AS (SELECT *, 2 * {cdf_sql('(-abs(t_stat))')} AS p, least(1.0, 6 * 2 * {cdf_sql('(-abs(t_stat))')}) AS p_adj FROM h),
  probs AS (SELECT trial AS i, p_adj / 2 AS p FROM hp UNION ALL SELECT 'z', 0.95::DOUBLE), {QUANTILE},
  hc AS (SELECT hp.*, CASE WHEN p_adj < 1 THEN -qv.z ELSE 0 END / sqrt(y) * sign(sr_ann) AS haircut_sr_ann FROM hp JOIN qv ON qv.i = hp.trial)
  SELECT trial, n, {r('sr')} AS sr, {r('skew')} AS skew, {r('kurt')} AS kurt, {r('sr_ann')} AS sr_ann, {r('t_stat')} AS t_stat, {r('p')} AS p, {r('p_adj')} AS p_adj,
    {r('haircut_sr_ann')} AS haircut_sr_ann, {r('1 - haircut_sr_ann / sr_ann')} AS haircut_pct, t_stat >= 3 AS passes_t3,
    CASE WHEN sr > 0 THEN {r("1 + spread * pow((SELECT z FROM qv WHERE i = 'z') / sr, 2)", 3)} END AS min_track_record FROM hc""")
def _(spark, d):
    m = overfit.haircut_sharpe(overfit.sharpe_moments(_trials(spark, d), ["trial"]), F.lit(6))
    return rounded_columns(overfit.min_track_record(m, F.lit(0.0)).withColumn("min_track_record", rnd("min_track_record", 3)))


def _pbo_sql(blocks: int) -> str:
    return f"""{TRIALS}, fd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS t FROM (SELECT date FROM tr GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT trial) FROM tr))),
  eb AS (SELECT b, CAST(floor(t * b / {blocks}.0) AS BIGINT) AS lo, CAST(floor(t * (b + 1) / {blocks}.0) AS BIGINT) AS hi FROM (SELECT DISTINCT t FROM fd), range(0, {blocks}) x(b)),
  bs AS (SELECT trial, b, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM tr JOIN fd USING (date) JOIN eb ON i >= lo AND i < hi GROUP BY 1, 2),
  mk AS (SELECT CAST(m AS BIGINT) AS split FROM range(0, {1 << blocks}) x(m) WHERE bit_count(m) = {blocks // 2}),
  hv AS (SELECT trial, split, (split >> b) & 1 AS side, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM bs JOIN mk ON true GROUP BY 1, 2, 3),
  sr AS (SELECT trial, split, side, (s / n) / sqrt((q - s * s / n) / (n - 1)) AS sr FROM hv),
  io AS (SELECT a.trial, a.split, a.sr AS i, b.sr AS o FROM sr a JOIN sr b USING (trial, split) WHERE a.side = 1 AND b.side = 0),
  rk AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY o) + (count(*) OVER (PARTITION BY split, o) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY split) AS nt,
    row_number() OVER (PARTITION BY split ORDER BY i DESC, trial) AS best FROM io),
  fin AS (SELECT split, trial AS best, i AS is_sr, o AS oos_sr, ln((rk / (nt + 1)) / (1 - rk / (nt + 1))) AS logit, nt AS n_trials FROM rk WHERE best = 1)"""


@query("pbo_cscv", f"""WITH {_pbo_sql(10)} SELECT {r('avg(CASE WHEN logit <= 0 THEN 1.0 ELSE 0.0 END)')} AS pbo, count(*) AS n_splits, max(n_trials) AS n_trials,
  {r('regr_slope(oos_sr, is_sr)')} AS degradation_slope FROM fin""")
def _(spark, d):
    return rounded_columns(overfit.pbo(_trials(spark, d), 10))


@query("pbo_splits", f"WITH {_pbo_sql(8)} SELECT split, best, {r('is_sr')} AS is_sr, {r('oos_sr')} AS oos_sr, {r('logit')} AS logit, n_trials FROM fin")
def _(spark, d):
    return rounded_columns(overfit.pbo_splits(_trials(spark, d), 8).withColumn("split", F.col("split").cast("long")))


def _numbered(spark, d):
    return cal.number_sessions(ad.market_close(spark, d)).select("session_no")


@query("walk_forward", f"""WITH {MARKET}, {SESS.replace('FROM bars', 'FROM mkt')}, n AS (SELECT count(*) AS n FROM sess),
  f AS (SELECT CAST(k AS BIGINT) AS fold FROM n, range(0, 100) x(k) WHERE 500 + 250 * k + 250 <= n)
  SELECT fold, CAST(session_no AS BIGINT) AS session_no, CASE WHEN session_no < 500 + fold * 250 THEN 'train' ELSE 'test' END AS role
  FROM f JOIN sess ON session_no < 750 + fold * 250""")
def _(spark, d):
    out = splits.walk_forward(_numbered(spark, d), 500, 250)
    return out.withColumn("fold", F.col("fold").cast("long"))


def _cv_sql(k: int, combos: str, horizon: int | str) -> str:
    """``horizon``: rows, or the row number of a label's end as an expression over i and n."""
    end = f"least(i + {horizon}, n - 1)" if isinstance(horizon, int) else horizon
    return f"""{MARKET}, {SESS.replace('FROM bars', 'FROM mkt')}, i AS (SELECT CAST(session_no AS BIGINT) AS i, date, count(*) OVER () AS n FROM sess),
  le AS (SELECT i, n, {end} AS le, CASE WHEN i < (n % {k}) * (n // {k} + 1) THEN i // (n // {k} + 1)
    ELSE n % {k} + (i - (n % {k}) * (n // {k} + 1)) // (n // {k}) END AS g FROM i),
  b AS (SELECT g, min(i) AS t0, max(i) AS t1, max(le) AS reach FROM le GROUP BY 1), {combos},
  cb AS (SELECT split, t0, t1, reach FROM co JOIN b USING (g)),
  lf AS (SELECT split, i, bool_or(i BETWEEN t0 AND t1) AS tst,
    bool_or((i < t0 AND le >= t0) OR (i > t1 AND i <= reach + round_even(n * 0.01, 0))) AS leak FROM le, cb GROUP BY 1, 2)
  SELECT split, i AS session_no, CASE WHEN tst THEN 'test' WHEN leak THEN 'purged' ELSE 'train' END AS role FROM lf"""


@query("purged_kfold", f"WITH {_cv_sql(5, 'co AS (SELECT CAST(k AS BIGINT) AS split, k AS g FROM range(0, 5) x(k))', 20)}")
def _(spark, d):
    rows = splits.with_horizon(_numbered(spark, d), 20)
    return splits.purged_kfold(rows, 5).withColumn("split", F.col("split").cast("long"))


CPCV = """pp AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS split FROM range(0, 6) x(a), range(0, 6) y(b) WHERE a < b),
  co AS (SELECT split, a AS g FROM pp UNION ALL SELECT split, b FROM pp)"""


@query("cpcv", f"WITH {_cv_sql(6, CPCV, 10)}")
def _(spark, d):
    rows = splits.with_horizon(_numbered(spark, d), 10)
    return splits.combinatorial(rows, 6, 2).withColumn("split", F.col("split").cast("long"))


# labels that end on dates of their own: some on no session, some before their row, some unknown
UNTIL = "CASE WHEN day(date) % 11 = 0 THEN NULL WHEN day(date) % 13 = 0 THEN date - 3 ELSE date + CAST(day(date) * 7 % 45 AS INTEGER) END"
BY_DATE = f"CASE WHEN ({UNTIL}) IS NULL THEN n - 1 ELSE greatest(i, (SELECT count(*) - 1 FROM sess s WHERE s.date <= ({UNTIL.replace('date', 'i.date').replace('i.date)', 'i.date)')}))) END"


def _labelled(spark, d):
    rows = materialized(cal.number_sessions(ad.market_close(spark, d)).select("session_no", "date"), "rows")
    day = F.day("date")
    until = F.when(day % 11 == 0, None).when(day % 13 == 0, F.date_sub("date", 3)).otherwise(F.date_add("date", day * 7 % 45))
    return splits.with_label_dates(rows, rows.select("date", until.alias("label_end")))


@query("purged_by_date", f"WITH {_cv_sql(5, 'co AS (SELECT CAST(k AS BIGINT) AS split, k AS g FROM range(0, 5) x(k))', BY_DATE)}")
def _(spark, d):
    return splits.purged_kfold(_labelled(spark, d), 5).withColumn("split", F.col("split").cast("long"))


@query("cpcv_by_date", f"WITH {_cv_sql(6, CPCV, BY_DATE)}")
def _(spark, d):
    return splits.combinatorial(_labelled(spark, d), 6, 2).withColumn("split", F.col("split").cast("long"))


GRID = [20, 50, 100, 150, 200]


def _sma_metrics(spark, d):
    """Mean excess of the close over its average, per series and length: the metric of a parameter grid."""
    w = ser.by_date()
    cols = [F.struct(F.lit(n).alias("param"), (F.col("close") / F.avg("close").over(w.rowsBetween(-(n - 1), 0)) - 1).alias("x")) for n in GRID]
    rows = ad.type_bars_table(spark, d).select("cid", F.array(*cols).alias("a")).select("cid", F.explode("a").alias("g"))
    return rows.groupBy(F.col("cid").alias("experiment"), F.col("g.param").cast("long").alias("param")).agg(F.avg("g.x").alias("metric"))


@query("sensitivity", f"""WITH {BARS6}, g AS ({' UNION ALL '.join(
    f"SELECT cid, CAST({n} AS BIGINT) AS param, close / avg(close) OVER (PARTITION BY cid ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) - 1 AS x FROM bars" for n in GRID)}),
  m AS (SELECT cid AS experiment, param, avg(x) AS metric FROM g GROUP BY 1, 2),
  nb AS (SELECT *, least(lag(metric) OVER w, lead(metric) OVER w) AS near, max(metric) OVER (PARTITION BY experiment) AS best,
    row_number() OVER (PARTITION BY experiment ORDER BY metric DESC, param) AS k FROM m WINDOW w AS (PARTITION BY experiment ORDER BY param)),
  sh AS (SELECT experiment, avg(CASE WHEN metric > 0 THEN 1.0 ELSE 0.0 END) AS sp FROM m GROUP BY 1)
  SELECT experiment, CASE WHEN best > 0 THEN {r('near / best')} END AS neighbour_ratio, {r('sp')} AS share_positive, param AS best_param,
    CASE WHEN best > 0 THEN near / best >= 0.8 ELSE false END AS ok FROM nb JOIN sh USING (experiment) WHERE k = 1""")
def _(spark, d):
    return rounded_columns(gates.sensitivity(_sma_metrics(spark, d)))


SPANS = [("first", "1995-01-01", "1996-12-31"), ("middle", "1996-07-01", "1999-06-30"), ("short", "2001-11-01", "2001-11-10"), ("last", "1999-07-01", "2099-12-31")]


@query("regime_table", f"""WITH {TRIALS}, sp AS (SELECT * FROM (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in SPANS)}) v(regime, a, b)),
  x AS (SELECT trial, regime, date, ret, product(1 + ret) OVER (PARTITION BY trial, regime ORDER BY date) AS eq FROM tr JOIN sp ON date BETWEEN a AND b),
  y AS (SELECT *, eq / max(eq) OVER (PARTITION BY trial, regime ORDER BY date) - 1 AS dd FROM x)
  SELECT trial, regime, count(*) AS n, CASE WHEN count(*) >= 20 THEN {r('pow(product(1 + ret), 252.0 / count(*)) - 1', 4)} END AS cagr,
    CASE WHEN count(*) >= 20 THEN {r('avg(ret) / stddev_samp(ret) * sqrt(252)')} END AS sharpe, CASE WHEN count(*) >= 20 THEN {r('min(dd)')} END AS max_dd FROM y GROUP BY 1, 2""")
def _(spark, d):
    return rounded_columns(gates.regime_table(_trials(spark, d), SPANS)).withColumn("cagr", rnd("cagr", 4))


@query("capacity", f"""WITH {TRIALS}, a AS (SELECT cid AS trial, avg(turnover) AS adv FROM bars GROUP BY 1), m AS (SELECT trial, avg(ret) * 252 AS edge, stddev_samp(ret) AS vol FROM tr GROUP BY 1)
  SELECT trial, {r('CASE WHEN edge - 0.002 > 0 THEN pow((edge - 0.002) / (12.0 * 0.7 * vol), 2) * adv ELSE 0 END', 2)} AS capacity FROM m JOIN a USING (trial)""")
def _(spark, d):
    bars = ad.type_bars_table(spark, d)
    adv = bars.groupBy(F.col("cid").alias("trial")).agg(F.avg("turnover").alias("adv"))
    m = ser.simple_returns(bars).groupBy(F.col("cid").alias("trial")).agg((F.avg("ret") * 252).alias("edge"), F.stddev_samp("ret").alias("vol"))
    cap = gates.capacity(F.col("edge"), F.lit(0.002), F.lit(12.0), F.col("adv"), F.col("vol"))
    return rounded_columns(m.join(adv, "trial").select("trial", cap.alias("capacity")), 2)


def _grid_results(spark, d, with_adv=True):
    bars = ad.type_bars_table(spark, d)
    signal = ser.sma_signal(bars, GRID)
    targets = signal.select(F.col("n").alias("trial"), F.col("date").alias("decision_date"), F.col("cid").alias("asset"), (F.col("on") / 6).alias("weight"))
    prices = bars.select(F.col("cid").alias("asset"), "date", "close")
    adv = ser.average_turnover(bars).select(F.col("cid").alias("asset"), "date", "adv") if with_adv else None
    return bt.target_weight_returns(prices, materialized(targets, "targets"), adv=adv)


@query("target_weight_returns")
def target_weight_returns(spark, d):
    return rounded_columns(_grid_results(spark, d))


def _rate_sql(i: int) -> str:
    first, *later = costs.GAINS_TAX
    return "CASE " + " ".join(f"WHEN fy >= {row[0]} THEN {row[i]}" for row in reversed(later)) + f" ELSE {first[i]} END"


def _after_tax_sql(rate: int, free: str) -> str:
    return f"""WITH RECURSIVE {TRIALS}, dy AS (SELECT trial, date, coalesce(ret, 0) AS ret, CASE WHEN month(date) >= 4 THEN year(date) + 1 ELSE year(date) END AS fy FROM tr),
  yr AS (SELECT trial, fy, product(1 + ret) AS growth, max(date) AS date, row_number() OVER (PARTITION BY trial ORDER BY fy) AS i, lag(fy) OVER (PARTITION BY trial ORDER BY fy) AS before,
    ({_rate_sql(rate)})::DOUBLE AS rate, ({free})::DOUBLE AS free FROM dy GROUP BY 1, 2),
  st AS (SELECT trial, 0::BIGINT AS i, 1000000.0::DOUBLE AS equity, list_transform(range(8), lambda k: 0.0::DOUBLE) AS losses, NULL::DATE AS date, 0.0::DOUBLE AS hit FROM yr GROUP BY 1
    UNION ALL SELECT trial, i, closing * (1 - hit), list_append(left_[2:], loss), date, hit FROM (
      SELECT *, CASE WHEN greatest(opened - free, 0) * rate > 0 AND closing > 0 THEN greatest(opened - free, 0) * rate / closing ELSE 0 END AS hit FROM (
        SELECT *, greatest(gain - list_sum(old), 0) AS opened, list_transform(old, lambda l, k: least(l, greatest(l - (gain - coalesce(list_sum(old[1:k - 1]), 0)), 0))) AS left_ FROM (
          SELECT yr.trial, yr.i, yr.date, yr.rate, yr.free, s.equity * growth AS closing, greatest(s.equity * growth - s.equity, 0) AS gain, greatest(s.equity - s.equity * growth, 0) AS loss,
            list_transform(range(8), lambda k: coalesce(s.losses[k + 1 + coalesce(yr.fy - yr.before - 1, 0)], 0)) AS old
          FROM st s JOIN yr ON yr.trial = s.trial AND yr.i = s.i + 1))))
  SELECT dy.trial, dy.date, {r('(1 + ret) * (1 - coalesce(hit, 0)) - 1')} AS ret FROM dy LEFT JOIN st ON st.trial = dy.trial AND st.date = dy.date"""


@query("after_tax", _after_tax_sql(1, "0"))
def _(spark, d):
    return rounded_columns(bt.after_tax(_trials(spark, d).withColumnRenamed("ret", "net"), avg_holding_days=120))


@query("after_tax_long", _after_tax_sql(2, _rate_sql(3)))
def _(spark, d):
    return rounded_columns(bt.after_tax(_trials(spark, d).withColumnRenamed("ret", "net"), avg_holding_days=400))


@query("gate_report")
def gate_report(spark, d):
    """A moving-average grid end to end: signals, costed returns, statistics and the gate table."""
    res = materialized(_grid_results(spark, d), "results")
    net = res.select("trial", "date", F.col("net").alias("ret"))
    dsr = overfit.deflated_sharpe(overfit.sharpe_moments(net, ["trial"]))
    top = overfit.min_track_record(dsr, F.lit(0.0)).agg(
        F.max_by("dsr", "sr").alias("dsr"), F.max_by("min_track_record", "sr").alias("min_track_record"))
    metric = dsr.select(F.lit("sma").alias("experiment"), F.col("trial").alias("param"), (F.col("sr") * math.sqrt(252)).alias("metric"))
    sens = gates.sensitivity(metric)
    one = sens.withColumns({
        "dsr": top.select("dsr").scalar(), "min_track_record": top.select("min_track_record").scalar(),
        "pbo": overfit.pbo(net, 10).select("pbo").scalar(), "capacity": F.lit(None).cast("double")})
    return rounded_columns(gates.gate_report(one))


@query("grid_summary")
def _(spark, d):
    return rounded_columns(bt.trial_summary(materialized(_grid_results(spark, d), "results")), 4)
