"""Index-replication queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import calendar as cal
from tickloom.operators import index as ix
from tickloom.operators import series as ser
from tickloom.operators.ranking import worst_contributions
from tickloom.plans.action_queries import market_actions
from tickloom.plans.catalog import BARS, MARKET, SESS, SIMPLE, query, r, rnd, rounded_columns
from tickloom.operators import corpactions as ca
from tickloom.session import materialized
from tickloom.sources import adapters as ad

SCHED = """me AS (SELECT CAST(date_trunc('month', date) AS DATE) AS m, max(date) AS s FROM sess GROUP BY 1),
  sched AS (SELECT strftime(a.m, '%Y-%m') AS review, b.s AS cutoff, c.s AS p7, d.s AS p13, a.s AS effective FROM me a
    JOIN me b ON b.m = a.m - INTERVAL 1 MONTH JOIN me c ON c.m = a.m - INTERVAL 7 MONTH JOIN me d ON d.m = a.m - INTERVAL 13 MONTH
    WHERE month(a.m) IN (6, 12))"""
ADVAT = """adv AS (SELECT review, cid, sum(turnover) / least(126, any_value(c.session_no) + 1) AS avg FROM sched
    JOIN sess c ON c.date = cutoff JOIN sess s ON s.session_no BETWEEN c.session_no - 125 AND c.session_no
    JOIN bars b ON b.date = s.date WHERE c.session_no >= 99 GROUP BY 1, 2)"""
SCORES = f"""{BARS}, {SESS}, {SCHED}, {ADVAT},
  elig AS (SELECT a.review, a.cid FROM (SELECT review, cid FROM (SELECT *, row_number() OVER (PARTITION BY review ORDER BY avg DESC, cid) AS k
      FROM adv JOIN sched USING (review) JOIN (SELECT cid, max(date) AS ld FROM bars GROUP BY 1) USING (cid) WHERE ld >= cutoff - 10) WHERE k <= 20) a
    JOIN sched s ON s.review = a.review JOIN (SELECT cid, min(date) AS f FROM bars GROUP BY 1) f ON f.cid = a.cid WHERE f <= cutoff - 365),
  rr AS (SELECT cid, date, pd, ln(close / pc) AS ret FROM (SELECT b.cid, b.date, s.session_no AS no, close, lag(close) OVER w AS pc, lag(b.date) OVER w AS pd,
      lag(s.session_no) OVER w AS pn FROM bars b JOIN sess s ON s.date = b.date WINDOW w AS (PARTITION BY b.cid ORDER BY b.date)) WHERE pn = no - 1),
  sg AS (SELECT review, cid, stddev_samp(ret) * sqrt(252) AS sigma FROM rr JOIN sched ON date > cutoff - 365 AND date <= cutoff AND pd > cutoff - 365 GROUP BY 1, 2),
  mk AS (SELECT review, cutoff AS date, 0 AS k FROM sched UNION ALL SELECT review, p7, 7 FROM sched UNION ALL SELECT review, p13, 13 FROM sched),
  p3 AS (SELECT review, cid, max(CASE WHEN k = 0 THEN close END) AS a, max(CASE WHEN k = 7 THEN close END) AS b, max(CASE WHEN k = 13 THEN close END) AS c
    FROM mk JOIN bars USING (date) GROUP BY 1, 2),
  pts AS (SELECT review, cid, a / c - 1 AS ret12, a / b - 1 AS ret6, sigma FROM elig JOIN p3 USING (review, cid) JOIN sg USING (review, cid)
    WHERE sigma > 0 AND a / c IS NOT NULL AND a / b IS NOT NULL),
  zz AS (SELECT *, 0.5 * (ret12 / sigma - avg(ret12 / sigma) OVER p) / stddev_samp(ret12 / sigma) OVER p
    + 0.5 * (ret6 / sigma - avg(ret6 / sigma) OVER p) / stddev_samp(ret6 / sigma) OVER p AS wz, count(*) OVER p AS n_eligible FROM pts WINDOW p AS (PARTITION BY review)),
  sc AS (SELECT *, CASE WHEN wz >= 0 THEN 1 + wz ELSE 1 / (1 - wz) END AS score FROM zz),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY review ORDER BY score DESC, cid) AS rank FROM sc)"""
N, MIN_, MOUT, CAP = 3, 1, 4, 0.4
SELECT = f"""{SCORES}, lists AS (SELECT review, list(cid ORDER BY rank) FILTER (rank <= {MOUT}) AS names, row_number() OVER (ORDER BY review) AS k FROM ranked GROUP BY 1),
  sel(k, review, chosen) AS (SELECT k, review, names[1:{N}] FROM lists WHERE k = 1
    UNION ALL SELECT l.k, l.review, CASE WHEN len(s.chosen) = 0 THEN l.names[1:{N}] ELSE
      list_concat(list_concat(l.names[1:{MIN_}], list_filter(l.names[{MIN_ + 1}:{MOUT}], lambda x: list_contains(s.chosen, x))),
        list_filter(l.names[{MIN_ + 1}:{MOUT}], lambda x: NOT list_contains(s.chosen, x)))[1:{N}] END FROM sel s JOIN lists l ON l.k = s.k + 1),
  pk AS (SELECT review, unnest(chosen) AS cid FROM sel)"""
WEIGHTS = f"""{SELECT}, sz AS (SELECT p.review, p.cid, r.rank, r.score, coalesce(a.avg, m.mid) AS size, s.effective FROM pk p JOIN ranked r ON r.review = p.review AND r.cid = p.cid
    LEFT JOIN adv a ON a.review = p.review AND a.cid = p.cid LEFT JOIN (SELECT review, median(avg) AS mid FROM adv GROUP BY 1) m ON m.review = p.review
    JOIN sched s ON s.review = p.review),
  c1 AS (SELECT *, least({CAP}, 5.0 * size / sum(size) OVER (PARTITION BY review)) AS cap, size * score AS raw FROM sz),
  c2 AS (SELECT *, (1 - coalesce(sum(cap) OVER (PARTITION BY review ORDER BY cap / raw, cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(raw) OVER (PARTITION BY review ORDER BY cap / raw, cid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM c1),
  c3 AS (SELECT *, min_by(lam, cap / raw) FILTER (lam * raw <= cap) OVER (PARTITION BY review) AS l FROM c2),
  c4 AS (SELECT *, coalesce(least(cap, l * raw), cap) AS w0 FROM c3),
  wts AS (SELECT review, effective, cid, rank, score, w0 / sum(w0) OVER (PARTITION BY review) AS weight FROM c4)"""
DRIFT = f"""{WEIGHTS}, {SIMPLE}, sets AS (SELECT effective, coalesce(lead(effective) OVER (ORDER BY effective), (SELECT max(date) FROM rets)) AS e
    FROM (SELECT DISTINCT effective FROM wts)),
  dd AS (SELECT DISTINCT date FROM rets), held AS (SELECT effective, date FROM sets JOIN dd ON date > effective AND date <= e),
  grid AS (SELECT h.effective, h.date, w.cid, w.weight, coalesce(t.ret, 0) AS ret FROM held h JOIN wts w ON w.effective = h.effective
    LEFT JOIN rets t ON t.cid = w.cid AND t.date = h.date),
  gr AS (SELECT *, product(1 + ret) OVER (PARTITION BY effective, cid ORDER BY date) AS g,
    coalesce(product(1 + ret) OVER (PARTITION BY effective, cid ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS g0 FROM grid),
  val AS (SELECT effective, date, sum(weight * g) AS v FROM gr GROUP BY 1, 2),
  port AS (SELECT effective, date, v / coalesce(lag(v) OVER (PARTITION BY effective ORDER BY date), 1) - 1 AS ret FROM val),
  hold AS (SELECT date, cid, weight * g0 / sum(weight * g0) OVER (PARTITION BY date) AS weight FROM gr)"""
BENCH = f"""{MARKET}, bm AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS bench FROM mkt),
  pb AS (SELECT port.date, port.ret AS rep, bench FROM port JOIN bm USING (date) WHERE bench IS NOT NULL)"""


def _track(group: str) -> str:
    return f"""SELECT {group}, min(date) AS start, max(date) AS "end", count(*) AS days, {r('pow(product(1 + rep), 252.0 / count(*)) - 1', 3)} AS cagr_rep,
    {r('pow(product(1 + bench), 252.0 / count(*)) - 1', 3)} AS cagr_bench,
    {r('pow(product(1 + rep), 252.0 / count(*)) - pow(product(1 + bench), 252.0 / count(*))', 3)} AS gap_pa,
    {r('stddev_samp(rep - bench) * sqrt(252)')} AS tracking_error, {r('corr(rep, bench)')} AS corr"""


def _context(spark, d, adj=None, bars=None):
    bars = ad.bars_table(spark, d) if bars is None else bars
    sessions = cal.session_table(bars)
    schedule = materialized(ix.review_schedule(sessions, first="1995-01"), "schedule")
    adv = materialized(ix.average_turnover_at(bars, schedule, sessions), "adv")
    adj = bars.select("cid", "date", F.col("close").alias("adj")) if adj is None else adj
    return {"bars": bars, "sessions": sessions, "schedule": schedule, "adv": adv, "adj": adj}


def _scores(ctx):
    names = ix.eligible(ix.turnover_universe(ctx, 20), ctx["bars"], ctx["schedule"], None)
    return ix.momentum_scores(ctx["adj"], ctx["schedule"], names, ctx["sessions"])


def _reviews(ctx, **kw):
    kw = {"universe": lambda c: ix.turnover_universe(c, 20), "n": N, "must_in": MIN_, "must_out": MOUT, "cap_abs": CAP, **kw}
    return materialized(ix.run_reviews(ctx, **kw), "selections")


def _portfolio(ctx, sel):
    tr = materialized(ser.simple_returns(ctx["bars"]), "returns")
    return tr, ix.drifting_portfolio(tr, sel.select("effective", "cid", "weight", "strategy"), ["strategy"])


def _versus_market(port, spark, d):
    mk = ad.market_close(spark, d).withColumn("cid", F.lit("market"))
    w = ser.by_date()
    bench = mk.select("date", (F.col("close") / F.lag("close").over(w) - 1).alias("bench")).where("bench is not null")
    return port.withColumnRenamed("ret", "rep").join(bench, "date")


def _rounded_stats(df):
    return rounded_columns(rounded_columns(df, 3, ("cagr_rep", "cagr_bench", "gap_pa")), 6, ("tracking_error", "corr"))


@query("review_schedule", f"WITH {BARS}, {SESS}, {SCHED} SELECT * FROM sched")
def _(spark, d):
    return ix.review_schedule(ad.bars(spark, d), first="1995-01")


@query("adv_at_reviews", f"WITH {BARS}, {SESS}, {SCHED}, {ADVAT} SELECT review, cid, {r('avg', 3)} AS avg FROM adv")
def _(spark, d):
    bars = ad.bars_table(spark, d)
    sessions = cal.session_table(bars)
    return rounded_columns(ix.average_turnover_at(bars, ix.review_schedule(bars, first="1995-01"), sessions), 3)


@query("momentum_scores", f"""WITH {SCORES} SELECT review, cid, {r('ret12')} AS ret12, {r('ret6')} AS ret6, {r('sigma')} AS sigma, {r('score')} AS score,
  CAST(rank AS BIGINT) AS rank, n_eligible FROM ranked""")
def _(spark, d):
    out = _scores(_context(spark, d)).select("review", "cid", "ret12", "ret6", "sigma", "score", F.col("rank").cast("long").alias("rank"), "n_eligible")
    return rounded_columns(out)


@query("buffered_select", f"WITH RECURSIVE {SELECT} SELECT p.review, p.cid, CAST(r.rank AS BIGINT) AS rank FROM pk p JOIN ranked r ON r.review = p.review AND r.cid = p.cid")
def _(spark, d):
    scores = _scores(_context(spark, d)).withColumn("strategy", F.lit("tilt"))
    return ix.buffered_select(scores, N, MIN_, MOUT).select("review", "cid", F.col("rank").cast("long").alias("rank"))


@query("capped_weights", f"WITH RECURSIVE {WEIGHTS} SELECT review, effective, cid, CAST(rank AS BIGINT) AS rank, {r('score')} AS score, {r('weight')} AS weight FROM wts")
def _(spark, d):
    sel = ix.run_reviews(_context(spark, d), universe=lambda c: ix.turnover_universe(c, 20), n=N, must_in=MIN_, must_out=MOUT, cap_abs=CAP)
    return rounded_columns(sel.select("review", "effective", "cid", F.col("rank").cast("long").alias("rank"), "score", "weight"))


CHANGES = f"""{WEIGHTS}, o AS (SELECT effective, lag(effective) OVER (ORDER BY effective) AS pe FROM (SELECT DISTINCT effective FROM wts)),
  pr AS (SELECT o.effective, coalesce(a.cid, b.cid) AS cid, coalesce(a.weight, 0) - coalesce(b.weight, 0) AS dw, b.cid IS NULL AS new FROM
    (SELECT o.effective, o.pe, w.cid, w.weight FROM o JOIN wts w ON w.effective = o.effective WHERE pe IS NOT NULL) a
    FULL JOIN (SELECT o.effective, w.cid, w.weight FROM o JOIN wts w ON w.effective = o.pe) b ON a.effective = b.effective AND a.cid = b.cid
    JOIN o ON o.effective = coalesce(a.effective, b.effective))"""


@query("review_turnover", f"""WITH RECURSIVE {CHANGES}
  SELECT effective, count(*) FILTER (new) AS names_changed, {r('0.5 * sum(abs(dw))')} AS one_way_turnover FROM pr GROUP BY 1""")
def _(spark, d):
    sel = _reviews(_context(spark, d))
    return rounded_columns(ix.review_turnover(sel.select("strategy", "effective", "cid", "weight"), ["strategy"]).drop("strategy"))


@query("turnover_means", f"""WITH RECURSIVE {CHANGES}, t AS (SELECT effective, count(*) FILTER (new) AS c, 0.5 * sum(abs(dw)) AS o FROM pr GROUP BY 1)
  SELECT count(*) AS reviews, {r('avg(c)')} AS names_changed, {r('avg(o)')} AS one_way_turnover FROM t""")
def _(spark, d):
    sel = _reviews(_context(spark, d))
    changes = ix.review_turnover(sel.select("strategy", "effective", "cid", "weight"), ["strategy"])
    return rounded_columns(ix.turnover_means(changes))


@query("drifting_portfolio", f"WITH RECURSIVE {DRIFT} SELECT effective, date, {r('ret')} AS ret FROM port")
def _(spark, d):
    ctx = _context(spark, d)
    return rounded_columns(_portfolio(ctx, _reviews(ctx))[1].drop("strategy"))


@query("start_holdings", f"WITH RECURSIVE {DRIFT} SELECT date, cid, {r('weight')} AS weight FROM hold")
def _(spark, d):
    ctx = _context(spark, d)
    tr = ser.simple_returns(ctx["bars"])
    sel = _reviews(ctx).select("strategy", "effective", "cid", "weight")
    return rounded_columns(ix.start_holdings(tr, sel, ["strategy"]).drop("strategy"))


@query("tracking_stats", f"WITH RECURSIVE {DRIFT}, {BENCH} {_track('CAST(1 AS BIGINT) AS k')} FROM pb GROUP BY 1")
def _(spark, d):
    ctx = _context(spark, d)
    pairs = _versus_market(_portfolio(ctx, _reviews(ctx))[1], spark, d).withColumn("k", F.lit(1).cast("long"))
    return _rounded_stats(ix.tracking_stats(pairs, ["k"]))


@query("tracking_by_year", f"WITH RECURSIVE {DRIFT}, {BENCH} {_track('CAST(year(date) AS BIGINT) AS year')} FROM pb GROUP BY 1")
def _(spark, d):
    ctx = _context(spark, d)
    pairs = _versus_market(_portfolio(ctx, _reviews(ctx))[1], spark, d).withColumn("year", F.year("date").cast("long"))
    return _rounded_stats(ix.tracking_stats(pairs, ["year"]))


ERAS = [("early", "1996-07-01", "1998-12-31"), ("late", "1999-01-01", None), ("live", "2000-06-01", None)]


GAPS = f"""{WEIGHTS}, {SIMPLE}, sh AS (SELECT unnest([-10, -5, 0, 5]) AS shift),
  w2 AS (SELECT shift, t.date AS effective, w.cid, w.weight FROM wts w JOIN sess s ON s.date = w.effective JOIN sh ON true JOIN sess t ON t.session_no = s.session_no + shift),
  sets AS (SELECT shift, effective, coalesce(lead(effective) OVER (PARTITION BY shift ORDER BY effective), (SELECT max(date) FROM rets)) AS e FROM (SELECT DISTINCT shift, effective FROM w2)),
  dd AS (SELECT DISTINCT date FROM rets), held AS (SELECT shift, effective, date FROM sets JOIN dd ON date > effective AND date <= e),
  gr AS (SELECT h.shift, h.effective, h.date, w.weight * product(1 + coalesce(t.ret, 0)) OVER (PARTITION BY h.shift, h.effective, w.cid ORDER BY h.date) AS g
    FROM held h JOIN w2 w ON w.effective = h.effective AND w.shift = h.shift LEFT JOIN rets t ON t.cid = w.cid AND t.date = h.date),
  val AS (SELECT shift, effective, date, sum(g) AS v FROM gr GROUP BY 1, 2, 3),
  port AS (SELECT shift, date, v / coalesce(lag(v) OVER (PARTITION BY shift, effective ORDER BY date), 1) - 1 AS ret FROM val),
  {MARKET}, bm AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS bench FROM mkt),
  eras AS (SELECT * FROM (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b or '9999-12-31'}')" for n, a, b in ERAS)}) v(era, a, b)),
  pb AS (SELECT shift, era, p.date, p.ret AS rep, bench FROM port p JOIN bm USING (date) JOIN eras ON p.date BETWEEN a AND b WHERE bench IS NOT NULL)"""


def _gaps(spark, d):
    ctx = _context(spark, d)
    sel = _reviews(ctx).select("effective", "cid", "weight")
    shifted = materialized(ix.shift_effective(sel, ctx["sessions"], [-10, -5, 0, 5]), "shifted")
    tr = materialized(ser.simple_returns(ctx["bars"]), "returns")
    port = ix.drifting_portfolio(tr, shifted, ["shift"])
    pairs = ix.in_eras(_versus_market(port, spark, d), ERAS).withColumn("shift", F.col("shift").cast("long"))
    return _rounded_stats(ix.tracking_stats(pairs, ["shift", "era"]))


@query("gap_by_shift_and_era", f"""WITH RECURSIVE {GAPS} {_track('CAST(shift AS BIGINT) AS shift, era')} FROM pb GROUP BY 1, 2""")
def _(spark, d):
    return _gaps(spark, d)


@query("gap_pivot", f"""WITH RECURSIVE {GAPS}, st AS ({_track('CAST(shift AS BIGINT) AS shift, era')} FROM pb GROUP BY 1, 2)
  SELECT shift, {', '.join(f"max(CASE WHEN era = '{e}' THEN {v} END) AS {e}_{v}" for e, _, _ in ERAS for v in ('gap_pa', 'tracking_error'))} FROM st GROUP BY 1""")
def _(spark, d):
    return ix.era_pivot(_gaps(spark, d), "shift", [e for e, _, _ in ERAS])



SHARES = """shr AS (SELECT p_brand AS cid, CASE WHEN count(*) FILTER (p_size > 45) > 8 THEN CAST(sum(p_size) AS DOUBLE) END AS shares FROM part GROUP BY 1),
  px AS (SELECT review, cid, sum(close) / count(*) AS price FROM sched JOIN sess c ON c.date = cutoff JOIN sess s ON s.session_no BETWEEN c.session_no - 125 AND c.session_no
    JOIN bars b ON b.date = s.date WHERE c.session_no >= 99 GROUP BY 1, 2 HAVING count(*) >= 60),
  cr AS (SELECT review, cid, price, avg AS adv, price * shares AS cap FROM px JOIN adv USING (review, cid) LEFT JOIN shr USING (cid)),
  rt AS (SELECT review, median(cap / adv) AS ratio FROM cr WHERE cap IS NOT NULL AND adv > 0 GROUP BY 1)"""


def _shares(spark, d):
    big = F.count_if(F.col("p_size") > 45)
    return ad.table(spark, d, "part").groupBy(F.col("p_brand").alias("cid")).agg(
        F.when(big > 8, F.sum("p_size").cast("double")).alias("shares"))


@query("mcap_estimate", f"""WITH {BARS}, {SESS}, {SCHED}, {ADVAT}, {SHARES} SELECT review, cid, {r('coalesce(cap, adv * ratio)', 3)} AS mcap, cap IS NULL AS imputed
  FROM cr LEFT JOIN rt USING (review)""")
def _(spark, d):
    ctx = _context(spark, d)
    px = ix.average_turnover_at(ctx["bars"], ctx["schedule"], ctx["sessions"], min_periods=60, value="close", zero_fill=False)
    px = px.withColumnRenamed("avg", "price").join(ctx["adv"].withColumnRenamed("avg", "adv"), ["review", "cid"])
    return rounded_columns(ix.market_cap_estimate(px, _shares(spark, d), ["review"]), 3)


@query("index_replication")
def index_replication(spark, d):
    """Audited and adjusted prices, market-cap rules, both weightings, and tracking against the market."""
    bars = ad.bars_table(spark, d)
    acts = materialized(market_actions(spark, d), "actions")
    px = bars.select("cid", "date", "close")
    audited = materialized(ca.audit(px, acts), "audit")
    total = materialized(ca.total_returns(px, ca.adjustment_factors(px, audited), acts.where("kind = 'dividend'")), "total")
    ctx = _context(spark, d, total.select("cid", "date", "adj"), bars)
    universe, size = ix.mcap_rules(_shares(spark, d), 20, min_periods=60)
    sel = _reviews(ctx, universe=universe, size=size)
    tilt = sel.select("effective", "cid", "weight", F.lit("tilt").alias("strategy"))
    equal = sel.select("effective", "cid", F.col("weight_ew").alias("weight"), F.lit("equal").alias("strategy"))
    port = ix.drifting_portfolio(total.select("cid", "date", "ret"), tilt.unionByName(equal), ["strategy"])
    return _rounded_stats(ix.tracking_stats(_versus_market(port, spark, d), ["strategy"]))


@query("held_jumps")
def _(spark, d):
    bars = ad.bars_table(spark, d)
    acts = materialized(market_actions(spark, d), "actions")
    px = bars.select("cid", "date", "close")
    audited = materialized(ca.audit(px, acts), "audit")
    total = materialized(ca.total_returns(px, ca.adjustment_factors(px, audited), acts.where("kind = 'dividend'")), "total")
    ctx = _context(spark, d, total.select("cid", "date", "adj"), bars)
    sel = _reviews(ctx).select("strategy", "effective", "cid", "weight")
    hold = ix.start_holdings(total.select("cid", "date", "ret"), sel, ["strategy"])
    return rounded_columns(ix.held_jumps(total, hold, audited))


@query("worst_contributions", f"""WITH RECURSIVE {DRIFT} SELECT date, cid, {r('ret * weight')} AS contribution FROM hold JOIN rets USING (cid, date) WHERE date < DATE '1999-01-01' AND abs(ret) > 0.2
  ORDER BY ret * weight, date, cid LIMIT 25""")
def _(spark, d):
    """The 25 held moves beyond a fifth that cost most before 1999."""
    ctx = _context(spark, d)
    tr = materialized(ser.simple_returns(ctx["bars"]), "returns")
    hold = ix.start_holdings(tr, _reviews(ctx).select("strategy", "effective", "cid", "weight"), ["strategy"])
    moved = hold.join(tr.where(F.abs("ret") > 0.2), ["cid", "date"]).select("date", "cid", (F.col("weight") * F.col("ret")).alias("contribution"))
    return rounded_columns(worst_contributions(moved, F.lit("1999-01-01").cast("date")))


@query("dividend_yield", f"""WITH RECURSIVE {DRIFT}, dv AS (SELECT p_brand AS cid, DATE '1995-01-02' + CAST(p_partkey * 17 % 2499 AS INTEGER) AS date,
    CAST(sum(p_size) AS DOUBLE) AS dividend FROM part GROUP BY 1, 2),
  tt AS (SELECT b.cid, b.date, coalesce(dv.dividend, 0) / lag(close) OVER (PARTITION BY b.cid ORDER BY b.date) AS y FROM bars b LEFT JOIN dv ON dv.cid = b.cid AND dv.date = b.date)
  SELECT CAST(year(date) AS BIGINT) AS year, {r('sum(weight * y)')} AS dividend_yield FROM hold JOIN tt USING (cid, date) WHERE y > 0 GROUP BY 1""")
def _(spark, d):
    ctx = _context(spark, d)
    tr = ser.simple_returns(ctx["bars"])
    hold = ix.start_holdings(tr, _reviews(ctx).select("strategy", "effective", "cid", "weight"), ["strategy"])
    paid = ad.subjects(spark, d).groupBy(F.col("symbol").alias("cid"), F.col("ex_date").alias("date")).agg(F.sum("size").cast("double").alias("dividend"))
    total = ctx["bars"].join(paid, ["cid", "date"], "left").select("cid", "date", F.col("close").alias("adj"), F.coalesce("dividend", F.lit(0.0)).alias("dividend"))
    return rounded_columns(ix.dividend_yield_by_year(total, hold))


# name, universe, size, weighting, cap, shift, derivatives list
SCENARIOS = [
    ("turnover", "turnover", "turnover", "tilt", CAP, 0, True), ("turnover_equal", "turnover", "turnover", "equal", CAP, 0, True),
    ("mcap", "mcap", "mcap", "tilt", CAP, 0, True), ("mcap_equal", "mcap", "mcap", "equal", CAP, 0, True),
    ("mcap_10_before", "mcap", "mcap", "tilt", CAP, -10, True), ("mcap_5_before", "mcap", "mcap", "tilt", CAP, -5, True),
    ("mcap_5_after", "mcap", "mcap", "tilt", CAP, 5, True), ("mcap_any_name", "mcap", "mcap", "tilt", CAP, 0, False),
    ("universe_turnover", "turnover", "turnover", "universe", 1.0, 0, False), ("universe_mcap", "mcap", "mcap", "universe", 1.0, 0, False),
]
UNIVERSE = 15
SCENARIO_SQL = f"""{BARS}, {SESS}, {SCHED}, {ADVAT}, {SIMPLE},
  scen AS (SELECT *, CASE WHEN weighting <> 'universe' THEN universe || '|' || derivatives END AS plan FROM (VALUES {', '.join(map(str, SCENARIOS))}) v(scenario, universe, rule, weighting, cap, shift, derivatives)),
  fo AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, p_brand AS cid FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R'),
  alive AS (SELECT review, cid FROM sched JOIN (SELECT cid, max(date) AS ld FROM bars GROUP BY 1) ON ld >= cutoff - 10), {SHARES},
  cl AS (SELECT cr.* FROM cr JOIN alive USING (review, cid)), rl AS (SELECT review, median(cap / adv) AS ratio FROM cl WHERE cap IS NOT NULL AND adv > 0 GROUP BY 1),
  szs AS (SELECT 'turnover' AS rule, review, cid, avg AS size, (review, cid) IN (SELECT (review, cid) FROM alive) AS alive FROM adv
    UNION ALL SELECT 'mcap', review, cid, coalesce(cap, adv * ratio), true FROM cl LEFT JOIN rl USING (review)),
  uni AS (SELECT rule, review, cid, size FROM (SELECT *, row_number() OVER (PARTITION BY rule, review ORDER BY size DESC, cid) AS k FROM szs WHERE alive) WHERE k <= {UNIVERSE}),
  elig AS (SELECT plan, u.review, u.cid FROM uni u JOIN (SELECT DISTINCT plan, universe, derivatives FROM scen WHERE plan IS NOT NULL) p ON p.universe = u.rule JOIN sched s ON s.review = u.review
    JOIN (SELECT cid, min(date) AS f FROM bars GROUP BY 1) f ON f.cid = u.cid WHERE f <= cutoff - 365 AND (NOT derivatives OR (cutoff, u.cid) IN (SELECT (date, cid) FROM fo))),
  rr AS (SELECT cid, date, pd, ln(close / pc) AS ret FROM (SELECT b.cid, b.date, s.session_no AS no, close, lag(close) OVER w AS pc, lag(b.date) OVER w AS pd,
      lag(s.session_no) OVER w AS pn FROM bars b JOIN sess s ON s.date = b.date WINDOW w AS (PARTITION BY b.cid ORDER BY b.date)) WHERE pn = no - 1),
  sg AS (SELECT review, cid, stddev_samp(ret) * sqrt(252) AS sigma FROM rr JOIN sched ON date > cutoff - 365 AND date <= cutoff AND pd > cutoff - 365 GROUP BY 1, 2),
  mk AS (SELECT review, cutoff AS date, 0 AS k FROM sched UNION ALL SELECT review, p7, 7 FROM sched UNION ALL SELECT review, p13, 13 FROM sched),
  p3 AS (SELECT review, cid, max(CASE WHEN k = 0 THEN close END) AS a, max(CASE WHEN k = 7 THEN close END) AS b, max(CASE WHEN k = 13 THEN close END) AS c FROM mk JOIN bars USING (date) GROUP BY 1, 2),
  pts AS (SELECT plan, review, cid, a / c - 1 AS ret12, a / b - 1 AS ret6, sigma FROM elig JOIN p3 USING (review, cid) JOIN sg USING (review, cid) WHERE sigma > 0 AND a / c IS NOT NULL AND a / b IS NOT NULL),
  zz AS (SELECT *, 0.5 * (ret12 / sigma - avg(ret12 / sigma) OVER p) / stddev_samp(ret12 / sigma) OVER p + 0.5 * (ret6 / sigma - avg(ret6 / sigma) OVER p) / stddev_samp(ret6 / sigma) OVER p AS wz
    FROM pts WINDOW p AS (PARTITION BY plan, review)),
  sc AS (SELECT *, CASE WHEN wz >= 0 THEN 1 + wz ELSE 1 / (1 - wz) END AS score FROM zz),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY plan, review ORDER BY score DESC, cid) AS rank FROM sc),
  lists AS (SELECT plan, review, list(cid ORDER BY rank) FILTER (rank <= {MOUT}) AS names, row_number() OVER (PARTITION BY plan ORDER BY review) AS k FROM ranked GROUP BY 1, 2),
  sel(plan, k, review, chosen) AS (SELECT plan, k, review, names[1:{N}] FROM lists WHERE k = 1
    UNION ALL SELECT l.plan, l.k, l.review, CASE WHEN len(s.chosen) = 0 THEN l.names[1:{N}] ELSE
      list_concat(list_concat(l.names[1:{MIN_}], list_filter(l.names[{MIN_ + 1}:{MOUT}], lambda x: list_contains(s.chosen, x))),
        list_filter(l.names[{MIN_ + 1}:{MOUT}], lambda x: NOT list_contains(s.chosen, x)))[1:{N}] END FROM sel s JOIN lists l ON l.plan = s.plan AND l.k = s.k + 1),
  pk AS (SELECT plan, review, unnest(chosen) AS cid FROM sel),
  sz AS (SELECT scenario, weighting, cap AS most, p.review, p.cid, r.score, coalesce(z.size, m.mid) AS size FROM pk p JOIN ranked r ON r.plan = p.plan AND r.review = p.review AND r.cid = p.cid JOIN scen c ON c.plan = p.plan
    LEFT JOIN szs z ON z.rule = c.rule AND z.review = p.review AND z.cid = p.cid LEFT JOIN (SELECT rule, review, median(size) AS mid FROM szs GROUP BY 1, 2) m ON m.rule = c.rule AND m.review = p.review),
  c1 AS (SELECT *, least(most, 5.0 * size / sum(size) OVER (PARTITION BY scenario, review)) AS cap, size * score AS raw FROM sz),
  c2 AS (SELECT *, (1 - coalesce(sum(cap) OVER (PARTITION BY scenario, review ORDER BY cap / raw, cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(raw) OVER (PARTITION BY scenario, review ORDER BY cap / raw, cid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM c1),
  c3 AS (SELECT *, min_by(lam, cap / raw) FILTER (lam * raw <= cap) OVER (PARTITION BY scenario, review) AS l FROM c2),
  c4 AS (SELECT *, CASE WHEN weighting = 'equal' THEN 1 ELSE coalesce(least(cap, l * raw), cap) END AS w0 FROM c3 UNION ALL
    SELECT scenario, weighting, NULL, review, cid, NULL, size, NULL, NULL, NULL, NULL, size FROM uni JOIN scen c ON c.rule = uni.rule WHERE weighting = 'universe'),
  w2 AS (SELECT c4.scenario, t.date AS effective, cid, w0 / sum(w0) OVER (PARTITION BY c4.scenario, c4.review) AS weight FROM c4 JOIN scen USING (scenario)
    JOIN sched USING (review) JOIN sess s ON s.date = sched.effective LEFT JOIN sess t ON t.session_no = s.session_no + shift),
  sets AS (SELECT scenario, effective, coalesce(lead(effective) OVER (PARTITION BY scenario ORDER BY effective), (SELECT max(date) FROM rets)) AS e FROM (SELECT DISTINCT scenario, effective FROM w2 WHERE effective IS NOT NULL)),
  dd AS (SELECT DISTINCT date FROM rets), held AS (SELECT scenario, effective, date FROM sets JOIN dd ON date > effective AND date <= e),
  gr AS (SELECT h.scenario, h.effective, h.date, w.weight * product(1 + coalesce(t.ret, 0)) OVER (PARTITION BY h.scenario, h.effective, w.cid ORDER BY h.date) AS g
    FROM held h JOIN w2 w ON w.effective = h.effective AND w.scenario = h.scenario LEFT JOIN rets t ON t.cid = w.cid AND t.date = h.date),
  val AS (SELECT scenario, effective, date, sum(g) AS v FROM gr GROUP BY 1, 2, 3),
  port AS (SELECT scenario, date, v / coalesce(lag(v) OVER (PARTITION BY scenario, effective ORDER BY date), 1) - 1 AS ret FROM val),
  {MARKET}, bm AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS bench FROM mkt),
  eras AS (SELECT * FROM (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b or '9999-12-31'}')" for n, a, b in ERAS)}) v(era, a, b)),
  pb AS (SELECT scenario, era, p.date, p.ret AS rep, bench FROM port p JOIN bm USING (date) JOIN eras ON p.date BETWEEN a AND b WHERE bench IS NOT NULL)"""


@query("gap_by_scenario", f"""WITH RECURSIVE {SCENARIO_SQL} {_track('scenario, era')} FROM pb GROUP BY 1, 2""")
def _(spark, d):
    """Where the gap to the benchmark comes from: universes, sizes, weightings, timing, the derivatives filter, and the universe alone."""
    ctx = _context(spark, d)
    parts = ad.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    listed = ad.table(spark, d, "lineitem").where("l_returnflag <> 'R'").join(parts, "l_partkey").select(F.to_date("l_shipdate").alias("date"), "symbol").distinct()
    scenarios = spark.createDataFrame(SCENARIOS, "scenario string, universe string, size string, weighting string, cap double, shift int, derivatives boolean")
    sizes = materialized(ix.candidates(ctx, _shares(spark, d), min_periods=60), "sizes")
    weights = materialized(ix.run_scenarios({**ctx, "derivatives": listed}, scenarios, sizes, UNIVERSE, N, MIN_, MOUT), "weights")
    port = ix.drifting_portfolio(materialized(ser.simple_returns(ctx["bars"]), "returns"), weights, ["scenario"])
    return _rounded_stats(ix.tracking_stats(ix.in_eras(_versus_market(port, spark, d), ERAS), ["scenario", "era"]))
