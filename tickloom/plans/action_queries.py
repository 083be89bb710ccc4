"""Corporate-action queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import numeric as num
from tickloom.functions import parse as ps
from tickloom.operators import corpactions as ca
from tickloom.operators import series as ser
from tickloom.plans.catalog import BARS, SESS, query, r, rnd, rounded_columns
from tickloom.session import materialized
from tickloom.sources import adapters as ad

SUBJECTS = """subj AS (SELECT p_brand AS symbol, DATE '1995-01-02' + CAST(p_partkey * 17 % 2499 AS INTEGER) AS ex_date, p_size AS size, p_partkey AS pid,
  CASE p_type WHEN 'ECONOMY' THEN 'Bonus  ' || (p_size % 5 + 1) || ':' || (p_size % 3 + 1)
    WHEN 'LARGE' THEN 'Face Value Split (Sub-Division) - From Rs ' || (p_size % 9 + 2) || '/- To Rs 1/- Per Share'
    WHEN 'MEDIUM' THEN 'Interim Dividend - Rs ' || p_size || '.5 Per Share'
    WHEN 'PROMO' THEN 'bonus ' || (p_size % 5 + 1) || ':1/Dividend- Rs ' || p_size || ' Per Share/Special Dividend Re 1'
    WHEN 'SMALL' THEN 'Scheme of  Arrangement / Rights ' || (p_size % 5 + 1) || ':3'
    ELSE 'Consolidation From Rs ' || (p_size % 5 + 1) || ' To Rs ' || (p_size % 5 + 1 + p_size % 4 + 1) END AS raw FROM part),
  sq AS (SELECT symbol, ex_date, size, pid, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS s FROM subj)"""

# what each of the six subjects says, from the numbers that were written into it
ACTIONS = f"""{SUBJECTS}, p AS (SELECT sq.*, p_type AS t, p_size % 5 + 1 AS a, p_size % 3 + 1 AS b, p_size % 9 + 2 AS x, p_size % 4 + 1 AS more FROM sq JOIN part ON p_partkey = pid),
  acts AS (
    SELECT symbol, ex_date, size, pid, s, 'bonus' AS kind, CAST(b AS DOUBLE) / (a + b) AS value FROM p WHERE t = 'ECONOMY'
    UNION ALL SELECT symbol, ex_date, size, pid, s, 'bonus', CAST(1 AS DOUBLE) / (a + 1) FROM p WHERE t = 'PROMO'
    UNION ALL SELECT symbol, ex_date, size, pid, s, 'split', CAST(1 AS DOUBLE) / x FROM p WHERE t = 'LARGE'
    UNION ALL SELECT symbol, ex_date, size, pid, s, 'consolidation', CAST(a + more AS DOUBLE) / a FROM p WHERE t NOT IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL')
    UNION ALL SELECT symbol, ex_date, size, pid, s, unnest(['scheme', 'rights']), NULL FROM p WHERE t = 'SMALL'
    UNION ALL SELECT symbol, ex_date, size, pid, s, 'dividend', size + 0.5::DOUBLE FROM p WHERE t = 'MEDIUM'
    UNION ALL SELECT symbol, ex_date, size, pid, s, 'dividend', unnest([CAST(size AS DOUBLE), 1.0::DOUBLE]) FROM p WHERE t = 'PROMO'),
  dacts AS (SELECT symbol AS cid, ex_date, kind, value, min(s) AS subject FROM acts GROUP BY 1, 2, 3, 4)"""


def _parsed(spark, d):
    return ca.parse_actions(ad.subjects(spark, d))


def market_actions(spark, d):
    return ca.distinct_actions(_parsed(spark, d).withColumnRenamed("symbol", "cid"))


@query("action_parse", f"WITH {ACTIONS} SELECT symbol, ex_date, CAST(size AS BIGINT) AS size, kind, {r('value')} AS value, s AS subject FROM acts")
def _(spark, d):
    return rounded_columns(_parsed(spark, d).withColumn("size", F.col("size").cast("long")))


@query("feed_actions", f"""WITH {ACTIONS} SELECT symbol, ex_date, kind, {r('value')} AS value, count(*) AS n FROM (
    SELECT symbol, ex_date, kind, value FROM acts WHERE kind <> 'dividend'
    UNION ALL SELECT symbol, ex_date, 'dividend', sum(value) FROM acts WHERE kind = 'dividend' GROUP BY symbol, ex_date, size, s, pid
    UNION ALL SELECT symbol, ex_date, 'split', 1.0 / (size + 1) FROM sq
      WHERE NOT EXISTS (SELECT 1 FROM acts a WHERE a.symbol = sq.symbol AND a.ex_date = sq.ex_date AND a.s = sq.s
        AND a.kind IN ('bonus', 'split', 'consolidation'))) GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    subj = ca.with_actions(ad.subjects(spark, d), "got")
    feed = ps.fed_actions(F.col("got"), F.lit("Split"), F.lit(1.0) / (F.col("size") + 1))
    rows = subj.select("symbol", "ex_date", F.explode(feed).alias("a")).select("symbol", "ex_date", "a.kind", "a.value")
    return rounded_columns(rows).groupBy("symbol", "ex_date", "kind", "value").agg(F.count("*").alias("n"))


@query("accounting_number", f"""WITH t AS (SELECT c_custkey, c_acctbal AS v FROM customer)
  SELECT c_custkey, v AS parsed, v AS plain FROM t""")
def _(spark, d):
    # balances written the way the source prints them: thousands separators, brackets for negatives
    v = F.col("c_acctbal")
    digits = F.format_number(F.abs(v), 2)
    text = F.when(v < 0, F.concat(F.lit(" ("), digits, F.lit(")"))).otherwise(F.concat(F.lit("Rs."), digits, F.lit(" ")))
    rows = ad.table(spark, d, "customer").select("c_custkey", text.alias("t"), F.format_number(v, 2).alias("p"))
    return rows.select("c_custkey", ps.accounting_number("t").alias("parsed"), ps.plain_number("p").alias("plain"))


DAUDIT = f"""{BARS}, {SESS}, {ACTIONS},
  comb AS (SELECT cid, ex_date, string_agg(DISTINCT kind, '+' ORDER BY kind) AS kind, product(value) AS announced,
    substring(string_agg(DISTINCT subject, ' | ' ORDER BY subject), 1, 160) AS subject
    FROM dacts WHERE kind IN ('bonus', 'split', 'consolidation', 'scheme') GROUP BY 1, 2),
  gp AS (SELECT cid, b.date, s.session_no AS no, ln(close / lag(close) OVER (PARTITION BY cid ORDER BY b.date)) AS gap
    FROM bars b JOIN sess s USING (date)),
  mk AS (SELECT date, median(gap) AS mkt FROM gp WHERE gap IS NOT NULL GROUP BY 1),
  pl AS (SELECT c.*, s.date AS exs, s.session_no AS pos, coalesce(mkt, 0) AS mkt FROM comb c ASOF JOIN sess s ON c.ex_date <= s.date
    LEFT JOIN mk ON mk.date = s.date WHERE c.cid IN (SELECT cid FROM bars)),
  nr AS (SELECT p.*, g.date AS gd, g.gap, g.no, abs(g.gap - ln(announced)) AS dist FROM pl p LEFT JOIN gp g
    ON g.cid = p.cid AND g.no BETWEEN p.pos - 5 AND p.pos + 5),
  pk AS (SELECT cid, ex_date, kind, announced, subject, exs, mkt, max(CASE WHEN no = pos THEN gap END) AS gx,
    min(CASE WHEN dist < ln(1.35) THEN struct_pack(d := dist, day := gd, gap := gap) END) AS tight,
    min(CASE WHEN dist < ln(2.0) AND sign(gap) = sign(ln(announced)) AND abs(gap) > abs(ln(announced)) / 2
        THEN struct_pack(d := dist, day := gd, gap := gap) END) AS loose FROM nr GROUP BY 1, 2, 3, 4, 5, 6, 7),
  st AS (SELECT *, CASE WHEN announced IS NULL AND abs(gx - mkt) > 0.02 THEN 'scheme_market_implied'
    WHEN announced IS NULL THEN 'scheme_no_gap' WHEN abs(gx - ln(announced)) < ln(1.35) THEN 'applied'
    WHEN tight IS NOT NULL THEN 'applied_shifted' WHEN loose IS NOT NULL AND abs(ln(announced)) > ln(2.0) / 2 THEN 'applied_loose'
    ELSE 'no_gap' END AS status FROM pk),
  an AS (SELECT cid, ex_date, kind, announced, subject, status, exs,
    CASE status WHEN 'applied' THEN exs WHEN 'scheme_market_implied' THEN exs WHEN 'applied_shifted' THEN tight.day
      WHEN 'applied_loose' THEN loose.day END AS applied_date,
    exp(CASE status WHEN 'applied_shifted' THEN tight.gap WHEN 'applied_loose' THEN loose.gap ELSE gx END) AS observed,
    CASE WHEN status = 'scheme_market_implied' THEN exp(gx - mkt) WHEN status LIKE 'applied%' THEN announced END AS factor FROM st),
  ex AS (SELECT DISTINCT cid, CASE WHEN status LIKE 'scheme%' THEN exs ELSE applied_date END AS date FROM an),
  aud AS (SELECT cid, ex_date, kind, announced, subject, status, applied_date, observed, factor FROM an
    UNION ALL SELECT g.cid, g.date, 'none', NULL, '', 'unexplained', NULL, exp(gap), NULL FROM gp g
      WHERE abs(gap) > ln(1 / 0.6) AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.cid = g.cid AND ex.date = g.date)),
  fac AS (SELECT b.cid, b.date, coalesce(product(coalesce(f.m, 1.0)) OVER (PARTITION BY b.cid ORDER BY b.date DESC
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS factor
    FROM bars b LEFT JOIN (SELECT cid, applied_date AS date, product(factor) AS m FROM aud
      WHERE applied_date IS NOT NULL AND factor IS NOT NULL GROUP BY 1, 2) f ON f.cid = b.cid AND f.date = b.date),
  dv AS (SELECT cid, s.date, sum(value) AS dividend FROM (SELECT cid, ex_date, sum(value) AS value FROM dacts WHERE kind = 'dividend'
      GROUP BY 1, 2) d ASOF JOIN sess s ON d.ex_date <= s.date GROUP BY 1, 2),
  tot AS (SELECT b.cid, b.date, b.close * f.factor AS adj, coalesce(dv.dividend, 0) * f.factor AS dividend
    FROM bars b JOIN fac f ON f.cid = b.cid AND f.date = b.date LEFT JOIN dv ON dv.cid = b.cid AND dv.date = b.date),
  trr AS (SELECT *, (adj + dividend) / lag(adj) OVER (PARTITION BY cid ORDER BY date) - 1 AS raw FROM tot),
  tr AS (SELECT cid, date, adj, dividend, raw AS raw_return, CASE WHEN raw IS NOT NULL THEN greatest(-0.6, least(1.5, raw)) END AS ret,
    abs(raw) > 0.6 AS wild FROM trr)"""


def audited(spark, d):
    return ca.audit(ad.bars_table(spark, d).select("cid", "date", "close"), materialized(market_actions(spark, d), "actions"))


@query("action_audit", f"""WITH {DAUDIT} SELECT cid, ex_date, kind, {r('ln(announced)')} AS log_announced, subject, status, applied_date,
  {r('observed')} AS observed, {r('factor')} AS factor FROM aud""")
def _(spark, d):
    # the product is compared in logs: a last digit of it must not decide a rounding
    return rounded_columns(audited(spark, d).withColumn("announced", F.log("announced")).withColumnRenamed("announced", "log_announced"))


@query("audit_status_counts", f"WITH {DAUDIT} SELECT status, count(*) AS n FROM aud GROUP BY 1")
def _(spark, d):
    return audited(spark, d).groupBy("status").agg(F.count("*").alias("n"))


SPLITS = """spl AS (SELECT p_brand AS cid, CASE WHEN p_type <> 'SMALL' THEN DATE '1995-01-02' + CAST(p_partkey * 17 % 2499 + p_size % 7 AS INTEGER) END AS date,
  CASE WHEN p_type <> 'SMALL' THEN (p_size % 10 + 2) / 2.0 END AS ratio FROM part)"""


def _splits(spark, d):
    known = F.col("p_type") != "SMALL"
    day = F.date_add(F.lit("1995-01-02").cast("date"), (F.col("p_partkey") * 17 % 2499 + F.col("p_size") % 7).cast("int"))
    return ad.table(spark, d, "part").select(
        F.col("p_brand").alias("cid"), F.when(known, day).alias("date"),
        F.when(known, (F.col("p_size") % 10 + 2) / F.lit(2.0)).alias("ratio"))


@query("second_source", f"""WITH {DAUDIT}, {SPLITS}, ds AS (SELECT cid, date, max(ratio) AS ratio FROM spl WHERE date IS NOT NULL GROUP BY 1, 2),
  nr2 AS (SELECT a.cid, a.ref, min_by(ds.ratio, struct_pack(g := abs(ds.date - a.ref), dd := ds.date)) AS ratio
    FROM (SELECT DISTINCT cid, coalesce(applied_date, ex_date) AS ref FROM aud) a JOIN ds ON ds.cid = a.cid
      AND ds.date BETWEEN a.ref - 8 AND a.ref + 8 GROUP BY 1, 2),
  j AS (SELECT aud.*, n.ratio, aud.cid IN (SELECT cid FROM spl) AS asked FROM aud LEFT JOIN nr2 n ON n.cid = aud.cid AND n.ref = coalesce(applied_date, ex_date)),
  k AS (SELECT *, status = 'unexplained' AND ratio IS NOT NULL AND abs(ln(observed) - ln(1 / ratio)) < ln(2.0)
    AND sign(ln(observed)) = sign(ln(1 / ratio)) AS fix, status IN ('applied', 'applied_shifted', 'applied_loose') AS ap FROM j)
  SELECT cid, ex_date, CASE WHEN fix THEN 'yahoo_split' ELSE kind END AS kind, CASE WHEN fix THEN 'applied_yf' ELSE status END AS status,
    CASE WHEN fix THEN ex_date ELSE applied_date END AS applied_date, {r('CASE WHEN fix THEN 1 / ratio ELSE factor END')} AS factor,
    CASE WHEN ap AND ratio IS NULL AND asked THEN 'no_record' WHEN ap AND ratio IS NULL THEN 'not_asked'
      WHEN ap AND abs(ln(1 / ratio) - ln(factor)) < ln(1.05) THEN 'agree' WHEN ap THEN 'disagree' WHEN fix THEN 'yahoo_only'
      WHEN status = 'unexplained' AND ratio IS NOT NULL THEN 'disagree' ELSE '' END AS yf_check FROM k""")
def _(spark, d):
    out = ca.second_source(materialized(audited(spark, d), "audit"), _splits(spark, d))
    return rounded_columns(out.select("cid", "ex_date", "kind", "status", "applied_date", "factor", "yf_check"))


@query("adjust_factors", f"WITH {DAUDIT} SELECT cid, date, {r('ln(factor)')} AS log_factor FROM fac")
def _(spark, d):
    bars = ad.bars_table(spark, d).select("cid", "date", "close")
    return ca.adjustment_factors(bars, ca.audit(bars, materialized(market_actions(spark, d), "actions"))).select("cid", "date", rnd(F.log("factor")).alias("log_factor"))


def total_return_rows(spark, d):
    bars = ad.bars_table(spark, d).select("cid", "date", "close")
    acts = materialized(market_actions(spark, d), "actions")
    factors = ca.adjustment_factors(bars, ca.audit(bars, acts))
    return ca.total_returns(bars, factors, acts.where("kind = 'dividend'"))


@query("total_return", f"WITH {DAUDIT} SELECT cid, date, {r('raw_return')} AS raw_return, {r('ret')} AS ret, wild FROM tr")
def _(spark, d):
    return rounded_columns(total_return_rows(spark, d).select("cid", "date", "raw_return", "ret", "wild"))


@query("wild_moves", f"WITH {DAUDIT} SELECT cid, count(*) FILTER (wild) AS wild, count(ret) AS n FROM tr GROUP BY 1")
def _(spark, d):
    return total_return_rows(spark, d).groupBy("cid").agg(F.count_if("wild").alias("wild"), F.count("ret").alias("n"))


@query("gap_vs_median", f"""WITH {BARS}, g AS (SELECT cid, date, ln(close / lag(close) OVER (PARTITION BY cid ORDER BY date)) AS gap FROM bars),
  m AS (SELECT date, median(gap) AS mkt FROM g WHERE gap IS NOT NULL GROUP BY 1)
  SELECT cid, date, {r('gap - mkt')} AS net_gap FROM g JOIN m USING (date) WHERE gap IS NOT NULL""")
def _(spark, d):
    gaps = ser.traded_gap(ad.bars(spark, d)).where(F.col("gap").isNotNull())
    mkt = gaps.groupBy("date").agg(F.median("gap").alias("mkt"))
    return gaps.join(mkt, "date").select("cid", "date", num.rounded(F.col("gap") - F.col("mkt")).alias("net_gap"))
