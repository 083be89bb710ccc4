"""Series, relation and temporal-join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import calendar as cal
from tickloom.operators import relations as rel
from tickloom.operators import series as ser
from tickloom.operators import temporal as tmp
from tickloom.plans.catalog import (BARS, BARS6, FLOW, LOGRET, MARKET, SESS, SIMPLE, query, r, rnd, rounded_columns)
from tickloom.session import materialized
from tickloom.sources import adapters as ad


@query("log_returns", f"WITH {BARS}, {SESS}, {LOGRET} SELECT cid, date, {r('ret')} AS ret FROM rets")
def _(spark, d):
    return rounded_columns(ser.log_returns(ad.bars_table(spark, d)))


@query("log_returns_own_calendar", f"""WITH {BARS} SELECT * FROM (SELECT cid, date,
  {r("ln(close / lag(close) OVER (PARTITION BY cid ORDER BY date))")} AS ret FROM bars) WHERE ret IS NOT NULL""")
def _(spark, d):
    return rounded_columns(ser.log_returns(ad.bars_table(spark, d), calendar="own"))


@query("simple_returns", f"WITH {BARS}, {SESS}, {SIMPLE} SELECT cid, date, {r('ret')} AS ret FROM rets")
def _(spark, d):
    return rounded_columns(ser.simple_returns(ad.bars_table(spark, d)))


@query("traded_gap", f"""WITH {BARS} SELECT cid, date, close, pc AS prev_close,
  {r('ln(close / pc)')} AS gap FROM (SELECT *, lag(close) OVER (PARTITION BY cid ORDER BY date) AS pc FROM bars)""")
def _(spark, d):
    g = ser.traded_gap(ad.bars(spark, d))
    return g.withColumn("gap", rnd("gap"))


WEEK = "(date + CAST((5 - dayofweek(date) + 7) % 7 AS INTEGER))"


@query("weekly_bars", f"""WITH {BARS} SELECT cid, CAST({WEEK} AS DATE) AS week, max_by(close, date) AS close
  FROM bars GROUP BY 1, 2""")
def _(spark, d):
    return ser.weekly_bars(ad.bars(spark, d))


@query("weekly_flow", f"""WITH {FLOW} SELECT CAST({WEEK} AS DATE) AS week, {r('sum(flow)', 2)} AS flow FROM flow GROUP BY 1""")
def _(spark, d):
    return rounded_columns(ser.weekly_sum(ad.daily_flow(spark, d), "flow"), 2)


@query("month_end_bars", f"""WITH {BARS} SELECT cid, CAST(last_day(date) AS DATE) AS month_end,
  max_by(close, date) AS close, max(date) AS session FROM bars GROUP BY 1, 2""")
def _(spark, d):
    return ser.month_end_bars(ad.bars(spark, d))


@query("drawdown", f"""WITH {BARS} SELECT cid, date,
  close / max(close) OVER (PARTITION BY cid ORDER BY date) - 1 AS drawdown FROM bars""")
def _(spark, d):
    return ser.drawdown(ad.bars(spark, d))


@query("rolling_vol", f"""WITH {BARS}, {SESS}, {LOGRET}
  SELECT cid, date, {r('vol')} AS vol FROM (SELECT cid, date, stddev_samp(ret) OVER w * sqrt(252) AS vol,
    count(ret) OVER w AS n FROM rets WINDOW w AS (PARTITION BY cid ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))
  WHERE n >= 21""")
def _(spark, d):
    return rounded_columns(ser.rolling_vol(ser.log_returns(ad.bars_table(spark, d))))


@query("trailing_percentile", f"""WITH {BARS}, win AS (SELECT cid, date, close, list(close) OVER
    (PARTITION BY cid ORDER BY date ROWS BETWEEN 755 PRECEDING AND CURRENT ROW) AS l FROM bars)
  SELECT cid, date, CAST(len(list_filter(l, lambda x: x <= close)) AS DOUBLE) / len(l) AS pct FROM win WHERE len(l) >= 252""")
def _(spark, d):
    return ser.trailing_percentile(ad.bars(spark, d), "close")


@query("rolling_corr", f"""WITH {BARS6}, {SESS}, {LOGRET}, pr AS (
    SELECT x.cid AS a, y.cid AS b, date, x.ret AS x, y.ret AS y FROM rets x JOIN rets y USING (date) WHERE x.cid < y.cid)
  SELECT a, b, date, {r('c', 5)} AS corr FROM (SELECT a, b, date, corr(x, y) OVER w AS c, count(*) OVER w AS n FROM pr
    WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) WHERE n >= 60""")
def _(spark, d):
    rets = ser.log_returns(ad.type_bars_table(spark, d))
    rets = materialized(rets, "rets")
    return rounded_columns(rel.rolling_corr(rets, rel.all_pairs(rets)), 5)


def _pairwise_sql(bars):
    return f"""WITH {bars}, {SESS}, {LOGRET} SELECT x.cid AS a, y.cid AS b, {r('corr(x.ret, y.ret)')} AS corr,
  count(*) AS n FROM rets x JOIN rets y USING (date) WHERE x.cid < y.cid GROUP BY 1, 2"""


@query("pairwise_corr", _pairwise_sql(BARS6))
def _(spark, d):
    return rounded_columns(rel.pair_correlations(ser.log_returns(ad.type_bars_table(spark, d))))


@query("pairwise_corr_brands", _pairwise_sql(BARS))
def _(spark, d):
    return rounded_columns(rel.pair_correlations(ser.log_returns(ad.bars_table(spark, d))))


@query("requested_corr", f"""WITH {BARS}, {SESS}, {LOGRET}, asked AS (SELECT DISTINCT x.p_brand AS a, y.p_brand AS b FROM part x JOIN part y
    ON y.p_partkey = x.p_partkey + 1 WHERE x.p_brand <> y.p_brand)
  SELECT a, b, CASE WHEN count(*) >= 500 THEN {r('corr(x.ret, y.ret)')} END AS corr, count(*) AS n
  FROM asked JOIN rets x ON x.cid = a JOIN rets y ON y.cid = b AND y.date = x.date GROUP BY 1, 2""")
def _(spark, d):
    """The pairs of a table: brands of neighbouring parts, either way round."""
    part = ad.table(spark, d, "part")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("b"))
    asked = part.select("p_partkey", F.col("p_brand").alias("a")).join(other, "p_partkey").where("a <> b").select("a", "b").distinct()
    return rounded_columns(rel.pair_correlations(ser.log_returns(ad.bars_table(spark, d)), asked, min_obs=500))


@query("aligned_panel", f"""WITH {BARS6} SELECT * FROM (PIVOT bars ON cid USING first(close) GROUP BY date)""")
def _(spark, d):
    """A column for every key that the table has."""
    bars = ad.type_bars_table(spark, d)
    return ser.align_wide(bars, ser.keys_of(bars))


@query("rebase100", f"""WITH {BARS6}, full_days AS (SELECT date FROM bars GROUP BY 1
    HAVING count(*) = (SELECT count(DISTINCT cid) FROM bars)), kept AS (SELECT * FROM bars WHERE date IN (FROM full_days))
  SELECT cid, date, {r('close / first_value(close) OVER (PARTITION BY cid ORDER BY date) * 100', 4)} AS rebased FROM kept""")
def _(spark, d):
    return rounded_columns(ser.rebase(ad.type_bars_table(spark, d)), 4)


@query("cumulative_flow", f"""WITH {FLOW} SELECT date, {r('flow', 2)} AS flow, {r('sum(flow) OVER (ORDER BY date)', 2)} AS cum FROM flow""")
def _(spark, d):
    return rounded_columns(ser.cumulative(ad.daily_flow(spark, d), "flow"), 2)


@query("period_returns", f"""WITH {BARS}, e AS (SELECT cid, max(date) AS as_of FROM bars GROUP BY 1 HAVING count(*) >= 2),
  m AS (SELECT cid, as_of, max_by(close, date) AS last,
    max_by(close, date) FILTER (date < as_of) AS d1,
    max_by(close, date) FILTER (date <= as_of - 7) AS w1,
    max_by(close, date) FILTER (date <= CAST(as_of - INTERVAL 1 MONTH AS DATE)) AS m1,
    max_by(close, date) FILTER (date <= CAST(as_of - INTERVAL 3 MONTH AS DATE)) AS m3,
    max_by(close, date) FILTER (date < date_trunc('year', as_of)) AS ytd,
    max_by(close, date) FILTER (date <= CAST(as_of - INTERVAL 12 MONTH AS DATE)) AS y1
    FROM bars JOIN e USING (cid) GROUP BY 1, 2)
  SELECT cid, as_of, last, {', '.join(f"{r(f'last / {k} - 1')} AS {k}" for k in ('d1', 'w1', 'm1', 'm3', 'ytd', 'y1'))} FROM m""")
def _(spark, d):
    out = ser.period_returns(ad.bars_table(spark, d))
    return rounded_columns(out, 6, ("d1", "w1", "m1", "m3", "ytd", "y1"))


@query("summary_stats", f"""WITH {BARS}, s AS (SELECT cid, date, close, ln(close / lag(close) OVER w) AS ret,
    close / max(close) OVER w - 1 AS dd FROM bars WINDOW w AS (PARTITION BY cid ORDER BY date))
  SELECT cid, min(date) AS from_date, max(date) AS to_date, count(*) AS n_obs,
    {r("pow(max_by(close, date) / min_by(close, date), 365.25 / date_diff('day', min(date), max(date))) - 1")} AS cagr,
    {r('stddev_samp(ret) * sqrt(252)')} AS ann_vol, {r('skewness(ret)', 5)} AS skew, {r('kurtosis(ret)', 5)} AS excess_kurtosis,
    {r('max(ret)')} AS best_day, {r('min(ret)')} AS worst_day, {r('min(dd)')} AS max_drawdown,
    {r('avg(CASE WHEN ret IS NULL THEN NULL WHEN ret < 0 THEN 1.0 ELSE 0.0 END)')} AS pct_down_days FROM s GROUP BY 1""")
def summary_stats(spark, d):
    out = ser.summary_stats(ad.bars(spark, d))
    return rounded_columns(rounded_columns(out, 5, ("skew", "excess_kurtosis")))


@query("coverage", f"""WITH {BARS}, {SESS}, p AS (SELECT cid, count(*) AS n, min(date) AS a, max(date) AS b FROM bars GROUP BY 1)
  SELECT cid, n AS n_rows, a AS first, b AS last,
    {r('100.0 * n / (SELECT count(*) FROM sess WHERE date BETWEEN a AND b)', 1)} AS pct_of_span FROM p""")
def _(spark, d):
    return ser.coverage(ad.bars_table(spark, d))


@query("common_window", f"""WITH {BARS}, p AS (SELECT min(date) AS a, max(date) AS b FROM bars GROUP BY cid)
  SELECT max(a) AS start_date, min(b) AS end_date FROM p""")
def _(spark, d):
    return ser.common_window(ad.bars(spark, d))


@query("zero_return_share", f"""WITH {BARS}, {SESS}, {LOGRET} SELECT cid, count(ret) AS n_obs,
  {r('avg(CASE WHEN ret = 0 THEN 1.0 ELSE 0.0 END)')} AS zero_share FROM rets WHERE date >= DATE '1996-01-01'
  GROUP BY 1 HAVING count(ret) >= 500""")
def _(spark, d):
    return rounded_columns(ser.zero_return_share(ser.log_returns(ad.bars_table(spark, d)), "1996-01-01"))


DERIVED = "SELECT 'ECO_X_LARGE' AS derived, array('ECONOMY', 'LARGE') AS parts UNION ALL " \
          "SELECT 'MED_X_SMALL', array('MEDIUM', 'SMALL') UNION ALL SELECT 'BROKEN', array('MEDIUM', 'ABSENT')"


@query("derived_product", f"""WITH {BARS6} SELECT 'ECO_X_LARGE' AS cid, date, x.close * y.close AS close
    FROM bars x JOIN bars y USING (date) WHERE x.cid = 'ECONOMY' AND y.cid = 'LARGE'
  UNION ALL SELECT 'MED_X_SMALL', date, x.close * y.close FROM bars x JOIN bars y USING (date)
    WHERE x.cid = 'MEDIUM' AND y.cid = 'SMALL'""")
def _(spark, d):
    return ser.add_derived(ad.type_bars(spark, d), spark.sql(DERIVED))


@query("clip_lookback", f"""WITH {BARS} SELECT cid, date, close FROM bars
  WHERE date >= (SELECT CAST(max(date) - INTERVAL 36 MONTH AS DATE) FROM bars)""")
def _(spark, d):
    return ser.clip_lookback(ad.bars_table(spark, d).select("cid", "date", "close"), 3)


@query("break_gaps", f"""WITH {BARS}, g AS (SELECT cid, date, close,
    date - lag(date) OVER (PARTITION BY cid ORDER BY date) AS gap FROM bars)
  SELECT cid, date, close FROM g
  UNION ALL SELECT cid, date - 1, NULL FROM g WHERE gap > 2""")
def _(spark, d):
    return ser.break_gaps(ad.bars(spark, d), 2)


# ---------------------------------------------------------------- as-of and interval joins

@query("flow_redate", f"""WITH {FLOW}, {MARKET}
  SELECT (SELECT max(m.date) FROM mkt m WHERE m.date < f.date) AS trade_date, {r('sum(flow)', 2)} AS flow FROM flow f
  WHERE f.date > (SELECT min(date) FROM mkt) GROUP BY 1""")
def _(spark, d):
    out = tmp.redate_flow(ad.daily_flow(spark, d), ad.market_close(spark, d))
    return rounded_columns(out, 2)


@query("next_session", f"""WITH {BARS}, o AS (SELECT p_brand AS cid, CAST(o_orderdate AS DATE) AS ex, count(*) AS n
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
  SELECT o.cid, o.ex, o.n, b.date AS session FROM o ASOF JOIN bars b ON o.cid = b.cid AND o.ex <= b.date""")
def _(spark, d):
    orders = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("ex"))
    items = ad.table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    parts = ad.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("cid"))
    marks = items.join(orders, "l_orderkey").join(parts, "p_partkey").groupBy("cid", "ex").agg(F.count("*").alias("n"))
    out = tmp.asof(marks, ad.bars(spark, d), ["cid"], "ex", "date", [], direction="forward", how="inner")
    return out.withColumnRenamed("matched_on", "session")


MEMBERS = """members AS (SELECT DISTINCT c_mktsegment AS idx, CAST(date_trunc('month', o_orderdate) AS DATE) AS snapshot,
  c_name AS symbol, CAST(c_nationkey AS VARCHAR) AS isin FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("asof_members", f"""WITH {MEMBERS}, snaps AS (SELECT idx, snapshot, count(*) AS n FROM members GROUP BY 1, 2),
  probe AS (SELECT DISTINCT c_mktsegment AS idx, CAST(o_orderdate AS DATE) AS date FROM orders JOIN customer ON o_custkey = c_custkey)
  SELECT p.idx AS index, p.date, s.snapshot, s.n AS members FROM probe p ASOF JOIN snaps s
    ON p.idx = s.idx AND p.date >= s.snapshot""")
def _(spark, d):
    snaps = ad.member_rows(spark, d).groupBy("index", "snapshot").agg(F.count("*").alias("members"))
    orders = ad.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("date"))
    seg = ad.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("index"))
    probes = orders.join(seg, "c_custkey").select("index", "date").distinct()
    out = tmp.asof(probes, snaps, ["index"], "date", "snapshot", ["members"], how="inner")
    return out.withColumnRenamed("matched_on", "snapshot")


RENAMES = """ren AS (SELECT p_brand || '/' || p_size AS old, p_brand || '/' || ((p_size * 7) % 50 + 1) AS new,
  DATE '1995-01-02' + CAST(p_partkey * 37 % 2499 AS INTEGER) AS date, p_partkey AS seq FROM part),
  num AS (SELECT *, row_number() OVER (ORDER BY date, seq) AS i FROM ren),
  nx AS (SELECT i, old, new, date, seq, (SELECT min(b.i) FROM num b WHERE b.old = a.new AND b.i > a.i) AS j FROM num a),
  walk AS (SELECT i, old, date, seq, new AS cid, j FROM nx
    UNION ALL SELECT w.i, w.old, w.date, w.seq, n.new, n.j FROM walk w JOIN nx n ON n.i = w.j),
  closed AS (SELECT i, old, date, seq, cid FROM walk WHERE j IS NULL)"""


@query("rename_closure", f"WITH RECURSIVE {RENAMES} SELECT old, date, CAST(seq AS BIGINT) AS seq, cid FROM closed")
def _(spark, d):
    return tmp.close_renames(ad.rename_rows(spark, d))


@query("rename_ids", f"""WITH RECURSIVE {RENAMES}, first AS (SELECT old, date, min_by(cid, seq) AS cid FROM closed GROUP BY 1, 2),
  rows_ AS (SELECT p_brand || '/' || p_size AS symbol, CAST(l_shipdate AS DATE) AS date, count(*) AS n,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
  mapped AS (SELECT coalesce(f.cid, t.symbol) AS cid, t.* EXCLUDE (date), t.date FROM rows_ t ASOF LEFT JOIN first f
    ON t.symbol = f.old AND t.date < f.date)
  SELECT cid, symbol, min(date) AS first_date, max(date) AS last_date, CAST(sum(n) AS BIGINT) AS n, CAST(sum(q) AS BIGINT) AS q
  FROM mapped GROUP BY 1, 2""")
def _(spark, d):
    parts = ad.table(spark, d, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("symbol"))
    items = ad.table(spark, d, "lineitem").select(
        "l_partkey", F.to_date("l_shipdate").alias("date"), F.col("l_quantity").cast("long").alias("q"))
    daily = items.join(parts, "l_partkey").groupBy("symbol", "date").agg(F.count("*").alias("n"), F.sum("q").alias("q"))
    mapped = tmp.canonical_ids(daily, ad.rename_rows(spark, d))
    return mapped.groupBy("cid", "symbol").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("n").alias("n"), F.sum("q").alias("q"))


@query("lost_days", f"""WITH {FLOW}, {MARKET} SELECT date FROM mkt
  WHERE date BETWEEN (SELECT min(date) FROM flow) AND (SELECT max(date) FROM flow) AND date NOT IN (SELECT date FROM flow)""")
def _(spark, d):
    return tmp.missing_between(ad.daily_flow(spark, d), ad.market_close(spark, d))


# ---------------------------------------------------------------- regimes and lead-lag

VOL6 = """vol AS (SELECT cid, date, v FROM (SELECT cid, date, stddev_samp(ret) OVER w * sqrt(252) AS v, count(*) OVER w AS n
  FROM rets WINDOW w AS (PARTITION BY cid ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) WHERE n >= 21)"""
LABEL = "CASE WHEN v >= hi THEN 'stress' WHEN v <= lo THEN 'calm' ELSE 'elevated' END"


@query("regime_insample", f"""WITH {BARS}, cut AS (SELECT cid, quantile_cont(close, 0.5) AS lo, quantile_cont(close, 0.9) AS hi
  FROM bars GROUP BY 1) SELECT cid, date, {LABEL.replace('v ', 'close ')} AS regime FROM bars JOIN cut USING (cid)""")
def _(spark, d):
    return ser.regime_labels(ad.bars_table(spark, d), "close")


@query("regime_expanding", f"""WITH {BARS6}, cut AS (SELECT cid, date, close AS v, quantile_cont(close, 0.5) OVER w AS lo,
    quantile_cont(close, 0.9) OVER w AS hi, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY cid ORDER BY date))
  SELECT cid, date, {LABEL} AS regime FROM cut WHERE n >= 252""")
def _(spark, d):
    return ser.regime_labels_expanding(ad.type_bars(spark, d), "close")


MKTREG = f"""{MARKET}, mcut AS (SELECT quantile_cont(close, 0.5) AS lo, quantile_cont(close, 0.9) AS hi FROM mkt),
  mreg AS (SELECT date, {LABEL.replace('v ', 'close ')} AS regime FROM mkt, mcut),
  reg AS (SELECT date, lag(regime) OVER (ORDER BY date) AS regime FROM mreg)"""


def _market_regime(spark, d):
    # read twice (cut-offs and labels), so it is written once
    level = materialized(ad.market_close(spark, d).withColumn("cid", F.lit("market")), "level")
    return ser.lag_regime(ser.regime_labels(level, "close"))


@query("regime_days", f"WITH {MKTREG} SELECT regime, count(*) AS days FROM reg WHERE regime IS NOT NULL GROUP BY 1")
def _(spark, d):
    return _market_regime(spark, d).groupBy("regime").agg(F.count("*").alias("days"))


@query("regime_stats", f"""WITH {BARS6}, {SESS}, {LOGRET}, {MKTREG} SELECT cid, regime, count(ret) AS days, {r('avg(ret)')} AS mean,
  {r('stddev_samp(ret) / sqrt(count(ret))')} AS std_err, {r('stddev_samp(ret) * sqrt(252)')} AS ann_vol,
  {r('min(ret)')} AS worst, {r('max(ret)')} AS best FROM rets JOIN reg USING (date) WHERE regime IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    return rounded_columns(rel.regime_stats(ser.log_returns(ad.type_bars_table(spark, d)), _market_regime(spark, d)))


@query("corr_by_regime", f"""WITH {BARS6}, {SESS}, {LOGRET}, {MKTREG} SELECT regime, x.cid AS a, y.cid AS b,
  CASE WHEN count(*) >= 60 THEN {r('corr(x.ret, y.ret)')} END AS corr, count(*) AS n
  FROM rets x JOIN rets y USING (date) JOIN reg USING (date) WHERE x.cid < y.cid AND regime IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, d):
    rets = ser.log_returns(ad.type_bars_table(spark, d))
    return rounded_columns(rel.pair_correlations(rets, by=_market_regime(spark, d), min_obs=60))


PAIRS = f"""{BARS6}, {SESS}, {LOGRET}, {FLOW}, prs AS (SELECT cid, date, flow AS x, ret AS y FROM rets JOIN flow USING (date)),
  shifted AS (SELECT * FROM (SELECT cid, k AS lag, t, x, CASE WHEN true THEN y2 END AS y FROM (
    SELECT a.cid, a.k, a.t, a.x, b.y AS y2 FROM
      (SELECT cid, x, row_number() OVER (PARTITION BY cid ORDER BY date) AS t, unnest(range(-5, 6)) AS k FROM prs) a
      JOIN (SELECT cid, y, row_number() OVER (PARTITION BY cid ORDER BY date) AS t FROM prs) b ON a.cid = b.cid AND b.t = a.t + a.k)))"""


def _flow_pairs(spark, d):
    rets = ser.log_returns(ad.type_bars_table(spark, d))
    return rets.join(ad.daily_flow(spark, d), "date").select("cid", "date", F.col("flow").alias("x"), F.col("ret").alias("y"))


@query("lead_lag", f"""WITH {PAIRS} SELECT cid, CAST(lag AS BIGINT) AS lag, count(*) AS n, {r('corr(x, y)')} AS corr,
  {r('1.96 / sqrt(count(*))')} AS band FROM shifted GROUP BY 1, 2""")
def _(spark, d):
    flat = rel.shifted_pairs(_flow_pairs(spark, d), range(-5, 6), ["cid"])
    agg = flat.groupBy("cid", F.col("lag").cast("long").alias("lag")).agg(F.count("*").alias("n"), F.corr("x", "y").alias("corr"))
    return rounded_columns(agg.withColumn("band", F.lit(1.96) / F.sqrt("n")))


@query("lead_lag_hac", f"""WITH {PAIRS}, st AS (SELECT cid, lag, count(*) AS n, corr(x, y) AS c, avg(x) AS mx, avg(y) AS my,
    stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM shifted GROUP BY 1, 2),
  us AS (SELECT cid, lag, t, n, c, (x - mx) / sx * ((y - my) / sy - c * (x - mx) / sx) AS u,
    CAST(least(floor(4 * pow(n / 100.0, 2.0 / 9.0)), n - 1) AS BIGINT) AS L FROM shifted JOIN st USING (cid, lag)),
  ss AS (SELECT a.cid, a.lag, a.n, a.c, sum((CASE WHEN a.t = b.t THEN 1.0 ELSE 2 * (1 - (a.t - b.t) / CAST(a.L + 1 AS DOUBLE)) END) * a.u * b.u) AS s
    FROM us a JOIN us b ON a.cid = b.cid AND a.lag = b.lag AND b.t <= a.t AND b.t >= a.t - a.L GROUP BY 1, 2, 3, 4)
  SELECT cid, CAST(lag AS BIGINT) AS lag, n, {r('c')} AS corr, {r('1.96 / sqrt(n)')} AS band,
    {r('1.96 * sqrt(greatest(s, 0)) / n')} AS band_hac, {r('c / (sqrt(greatest(s, 0)) / n)', 4)} AS t_hac FROM ss""")
def _(spark, d):
    out = rel.lead_lag(_flow_pairs(spark, d), ["cid"]).withColumn("lag", F.col("lag").cast("long"))
    return rounded_columns(out.withColumn("t_hac", rnd("t_hac", 4)))


# ---------------------------------------------------------------- liquidity and ranking

ADV = f"""{BARS}, {SESS}, adv AS (SELECT cid, date, session_no, adv FROM (SELECT cid, b.date, s.session_no,
    sum(turnover) OVER (PARTITION BY cid ORDER BY s.session_no RANGE BETWEEN 125 PRECEDING AND CURRENT ROW)
      / least(126, s.session_no + 1) AS adv FROM bars b JOIN sess s USING (date)) WHERE session_no >= 99)"""


@query("adv126", f"WITH {ADV} SELECT cid, date, {r('adv', 3)} AS adv FROM adv")
def _(spark, d):
    return rounded_columns(ser.average_turnover(ad.bars_table(spark, d)).drop("session_no"), 3)


@query("topn_turnover", f"""WITH {BARS} SELECT date, cid, {r('turnover', 2)} AS turnover, rk AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY turnover DESC, cid) AS rk FROM bars) WHERE rk <= 5""")
def _(spark, d):
    from tickloom.operators.ranking import top_n

    out = top_n(ad.bars(spark, d), ["date"], [F.desc("turnover"), F.asc("cid")], 5)
    return out.select("date", "cid", rnd("turnover", 2).alias("turnover"), F.col("rank").cast("long").alias("rank"))


@query("cross_section_median", f"""WITH {BARS}, g AS (SELECT date, ln(close / lag(close) OVER (PARTITION BY cid ORDER BY date)) AS gap FROM bars)
  SELECT date, {r('median(gap)')} AS market_move FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def _(spark, d):
    gaps = ser.traded_gap(ad.bars(spark, d)).where(F.col("gap").isNotNull())
    return rounded_columns(gaps.groupBy("date").agg(F.median("gap").alias("market_move")))


@query("sma_signal", f"""WITH {BARS6}, me AS (SELECT cid, date, close,
    {', '.join(f'CASE WHEN count(*) OVER (PARTITION BY cid ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {n} THEN avg(close) OVER (PARTITION BY cid ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS s{n}' for n in (50, 100, 200))},
    lead(date) OVER (PARTITION BY cid ORDER BY date) AS nd FROM bars),
  ends AS (SELECT * FROM me WHERE nd IS NULL OR date_trunc('month', nd) <> date_trunc('month', date))
  {' UNION ALL '.join(f'SELECT cid, CAST({n} AS BIGINT) AS n, date, CASE WHEN close > s{n} THEN 1.0 ELSE 0.0 END::DOUBLE AS "on" FROM ends WHERE s{n} IS NOT NULL' for n in (50, 100, 200))}""")
def _(spark, d):
    out = ser.sma_signal(ad.type_bars(spark, d), [50, 100, 200])
    return out.withColumn("n", F.col("n").cast("long"))


@query("business_calendar", f"""WITH {MARKET}, b AS (SELECT min(date) AS a, max(date) AS z FROM mkt)
  SELECT CAST(d AS DATE) AS date, CAST(CASE WHEN month(d) >= 4 THEN year(d) + 1 ELSE year(d) END AS BIGINT) AS fy,
    CAST(d + CAST((5 - dayofweek(d) + 7) % 7 AS INTEGER) AS DATE) AS week
  FROM (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS d FROM b) WHERE dayofweek(d) BETWEEN 1 AND 5""")
def _(spark, d):
    bounds = ad.market_close(spark, d).agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return cal.business_days(bounds).select(
        "date", cal.financial_year("date").cast("long").alias("fy"), cal.week_ending_friday(F.col("date")).alias("week"))
