"""Books, membership, flow and quality queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import calendar as cal
from tickloom.operators import books as bk
from tickloom.operators import flows as fl
from tickloom.operators import membership as mb
from tickloom.operators import quality as qa
from tickloom.operators import series as ser
from tickloom.operators import temporal as tmp
from tickloom.operators.ranking import latest_rows
from tickloom.plans.action_queries import ACTIONS, market_actions
from tickloom.plans.catalog import BARS, BARS6, FLOW, LEDGER, LOGRET, MARKET, SESS, query, r, rnd, rounded_columns
from tickloom.plans.series_queries import DERIVED, MEMBERS
from tickloom.session import materialized
from tickloom.sources import adapters as ad
from tickloom.sources import normalise as nz

POS = f"""{LEDGER}, dpos AS (SELECT book, symbol, date, CAST(sum(CASE side WHEN 'SELL' THEN -qty ELSE qty END) AS BIGINT) AS traded FROM ledger GROUP BY 1, 2, 3),
  pos AS (SELECT *, CAST(sum(traded) OVER (PARTITION BY book, symbol ORDER BY date) AS BIGINT) AS position FROM dpos)"""


@query("positions", f"WITH {POS} SELECT * FROM pos")
def _(spark, d):
    return bk.positions(ad.ledger(spark, d))


PRICE_ACTS = f"{ACTIONS}, pa AS (SELECT cid AS symbol, ex_date, kind, value FROM dacts)"


@query("held_on_exdate", f"""WITH {POS}, {PRICE_ACTS}, pr AS (SELECT b.book, a.* FROM pa a JOIN (SELECT DISTINCT book, symbol FROM pos) b USING (symbol))
  SELECT p.book, p.symbol, p.ex_date, p.kind, {r('p.value')} AS value, q.position AS held FROM pr p ASOF JOIN pos q ON p.book = q.book AND p.symbol = q.symbol AND q.date < p.ex_date""")
def _(spark, d):
    acts = market_actions(spark, d).select(F.col("cid").alias("symbol"), "ex_date", "kind", rnd("value").alias("value"))
    return bk.held_on(ad.ledger(spark, d), acts)


@query("pending_actions", f"""WITH {ACTIONS}, done AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, p_brand AS symbol, CASE l_returnflag WHEN 'R' THEN 'SPLIT' WHEN 'A' THEN 'BONUS' ELSE 'DIVIDEND' END AS k
    FROM lineitem JOIN part ON l_partkey = p_partkey)
  SELECT cid AS symbol, ex_date, kind, {r('value')} AS value FROM dacts WHERE ex_date <= DATE '1999-12-31' AND kind IN ('dividend', 'split', 'bonus', 'consolidation')
    AND NOT EXISTS (SELECT 1 FROM done WHERE done.date = ex_date AND done.symbol = cid AND done.k = upper(kind))""")
def _(spark, d):
    flag = F.col("l_returnflag")
    kind = F.when(flag == "R", "SPLIT").when(flag == "A", "BONUS").otherwise("DIVIDEND")
    parts = ad.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    booked = ad.table(spark, d, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("date"), kind.alias("side")).join(parts, "l_partkey")
    acts = market_actions(spark, d).select(F.col("cid").alias("symbol"), "ex_date", "kind", "value")
    return rounded_columns(bk.pending(acts, booked, F.lit("1999-12-31").cast("date")))


def _ledger(spark, d):
    led = ad.ledger(spark, d)
    return led.withColumns({"value_cents": ad.cents(F.col("price") * F.col("qty")), "cost_cents": ad.cents("cost")})


CASH = """cash AS (SELECT book, date, CAST(sum(sum((CASE side WHEN 'SELL' THEN 1 ELSE -1 END) * CAST(round(price * qty * 100) AS BIGINT) - CAST(round(cost * 100) AS BIGINT)))
    OVER (PARTITION BY book ORDER BY date) AS BIGINT) AS c FROM ledger GROUP BY 1, 2)"""
MARKS = f"""{POS}, {CASH}, {BARS}, {MARKET}, md AS (SELECT max(date) AS date FROM mkt GROUP BY date_trunc('month', date)),
  pr AS (SELECT f.book, f.symbol, md.date FROM (SELECT book, symbol, min(date) AS f FROM pos GROUP BY 1, 2) f JOIN md ON md.date >= f.f),
  hp AS (SELECT p.book, p.symbol, p.date, q.position FROM pr p ASOF JOIN pos q ON p.book = q.book AND p.symbol = q.symbol AND p.date >= q.date),
  wo AS (SELECT h.book, h.date, sum(position * close) AS v, count(*) FILTER (close IS NULL) AS n_missing, coalesce(string_agg(CASE WHEN close IS NULL THEN symbol END, ';' ORDER BY symbol), '') AS missing
    FROM hp h LEFT JOIN bars b ON b.cid = h.symbol AND b.date = h.date WHERE position <> 0 GROUP BY 1, 2),
  -- a book is marked on every mark day since its first trade, whether it holds anything or not
  bd AS (SELECT f.book, md.date FROM (SELECT book, min(date) AS f FROM ledger GROUP BY 1) f JOIN md ON md.date >= f.f),
  marks AS (SELECT bd.book, bd.date, CASE WHEN coalesce(n_missing, 0) = 0 THEN coalesce(v, 0) + c.c / 100.0 + 1000000 END AS nav, coalesce(n_missing, 0) AS n_missing, coalesce(missing, '') AS missing
    FROM bd ASOF JOIN cash c ON c.book = bd.book AND bd.date >= c.date LEFT JOIN wo w ON w.book = bd.book AND w.date = bd.date)"""


def _marks(spark, d):
    led = materialized(bk.netted(_ledger(spark, d)), "ledger")
    prices = ad.bars_table(spark, d).select(F.col("cid").alias("symbol"), "date", "close")
    days = cal.month_end_sessions(ad.market_close(spark, d)).select(F.col("session").alias("date"))
    return led, prices, bk.marks(led, prices, materialized(days, "days"), 1_000_000.0)


@query("nav_marks", f"WITH {MARKS} SELECT book, date, {r('nav', 1)} AS nav, n_missing, missing FROM marks")
def _(spark, d):
    return rounded_columns(_marks(spark, d)[2], 1)


@query("late_restate", f"""WITH {MARKS}, ef AS (SELECT l_suppkey AS book, p_brand AS symbol, CAST(l_shipdate AS DATE) AS ex_date, CAST(sum(l_linenumber) AS BIGINT) AS added,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS cash FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
  rn AS (SELECT book, symbol, ex_date, sum(added) OVER w AS added, sum(cash) OVER w AS cash FROM ef WINDOW w AS (PARTITION BY book, symbol ORDER BY ex_date)),
  dl AS (SELECT m.book, m.date, sum(rn.cash + rn.added * coalesce(b.close, 0)) AS d FROM (SELECT m.book, m.date, s.symbol FROM marks m JOIN (SELECT DISTINCT book, symbol FROM rn) s USING (book)) m
    ASOF JOIN rn ON rn.book = m.book AND rn.symbol = m.symbol AND m.date >= rn.ex_date LEFT JOIN bars b ON b.cid = m.symbol AND b.date = m.date GROUP BY 1, 2)
  SELECT m.book, m.date, {r('nav + coalesce(d, 0)', 1)} AS nav FROM marks m LEFT JOIN dl USING (book, date)""")
def _(spark, d):
    led, prices, marked = _marks(spark, d)
    items = ad.table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("book"), F.to_date("l_shipdate").alias("ex_date"),
                                                  F.col("l_linenumber").cast("long").alias("added"), F.col("l_quantity").alias("cash"))
    parts = ad.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    effects = items.join(parts, "l_partkey").drop("l_partkey")
    out = bk.restate(materialized(marked, "marks"), effects, prices)
    return rounded_columns(out.select("book", "date", "nav"), 1)


@query("settled_actions")
def _(spark, d):
    """Dividends and consolidations applied to every book in order, whole shares and cash fractions."""
    acts = market_actions(spark, d).where(F.col("kind").isin("consolidation", "dividend"))
    acts = acts.select(F.col("cid").alias("symbol"), "ex_date", "kind", "value")
    close = ad.bars(spark, d).select(F.col("cid").alias("symbol"), F.col("date").alias("ex_date"), "close")
    priced = materialized(acts.join(close, ["symbol", "ex_date"], "left"), "actions")
    out = bk.settle(materialized(bk.netted(ad.ledger(spark, d)), "ledger"), priced)
    return out.groupBy("symbol", "kind").agg(F.count("*").alias("n"), F.sum("added").alias("added"), rnd(F.sum("cash"), 1).alias("cash"))


@query("order_sizing", f"""WITH {POS}, {BARS}, {CASH}, q AS (SELECT book, symbol, max_by(position, date) AS q FROM pos GROUP BY 1, 2),
  px AS (SELECT cid AS symbol, max_by(close, date) AS price, CAST(max_by(volume, date) AS DOUBLE) AS vol FROM bars GROUP BY 1),
  tg AS (SELECT book, symbol, CAST(sum(qty) AS DOUBLE) / sum(sum(qty)) OVER (PARTITION BY book) AS w FROM ledger WHERE side = 'BUY' GROUP BY 1, 2),
  ln AS (SELECT book, symbol, coalesce(q, 0) AS q, w, price FROM tg FULL JOIN q USING (book, symbol) JOIN px USING (symbol)),
  nv AS (SELECT book, sum(q * price) + 50000000 AS nav FROM ln GROUP BY 1)
  SELECT book, symbol, CAST(floor(w * nav * (1 - 2 * 0.001::DOUBLE) / price) - q AS BIGINT) AS delta,
    CAST(floor(w * nav * (1 - 2 * 0.001::DOUBLE) / price) - q > 0 AS BIGINT) AS side_order, {r('abs(floor(w * nav * (1 - 2 * 0.001::DOUBLE) / price) - q) * price / 2 / nav', 5)} AS turnover, price IS NULL AS unpriced
  FROM ln JOIN nv USING (book) WHERE floor(w * nav * (1 - 2 * 0.001::DOUBLE) / price) - q <> 0""")
def _(spark, d):
    bars = ad.bars_table(spark, d)
    held = bk.positions(ad.ledger(spark, d)).groupBy("book", "symbol").agg(F.max_by("position", "date").alias("position"))
    held = materialized(held, "held")
    px = bars.groupBy(F.col("cid").alias("symbol")).agg(F.max_by("close", "date").alias("price"), F.max_by("volume", "date").cast("double").alias("vol"))
    # a book's model are its own purchases by shares
    bought = bk.netted(ad.ledger(spark, d)).where("side = 'BUY'").groupBy("book", "symbol").agg(F.sum("qty").alias("q"))
    targets = bought.select("book", "symbol", (F.col("q").cast("double") / F.sum("q").over(Window.partitionBy("book"))).alias("weight"))
    cash = held.select("book").distinct().withColumn("cash", F.lit(50_000_000.0))
    return rounded_columns(bk.order_sizing(held, targets, px.select("symbol", "price"), cash), 5)


@query("ledger_totals", f"WITH {LEDGER} SELECT side, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty, {r('sum(CAST(round(cost * 100) AS BIGINT)) / 100.0', 2)} AS cost FROM ledger GROUP BY 1")
def _(spark, d):
    led = ad.ledger(spark, d)
    return led.groupBy("side").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), (F.sum(ad.cents("cost")) / 100).alias("cost"))


@query("mark_returns", f"""WITH {MARKET} SELECT date, {r('close / first_value(close) OVER (ORDER BY date) - 1')} AS close_ret FROM mkt""")
def _(spark, d):
    m = materialized(ad.market_close(spark, d).withColumn("book", F.lit("market")), "marks")
    return rounded_columns(ser.since_first(m, ["close"]).select("date", "close_ret"))


# ---------------------------------------------------------------- membership

# a list holds every customer of its segment from their first order on, as published at the end of each month
STANDING = """born AS (SELECT c_mktsegment AS idx, c_name AS symbol, CAST(c_nationkey AS VARCHAR) AS isin, CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS since FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
  months AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS snapshot FROM orders),
  sn AS (SELECT idx, snapshot, count(*) AS members FROM born JOIN months ON since <= snapshot GROUP BY 1, 2)"""


def _standing(spark, d):
    orders = ad.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.trunc("o_orderdate", "month").alias("month"))
    first = orders.groupBy("c_custkey").agg(F.min("month").alias("since"))
    cust = ad.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("index"), F.col("c_name").alias("symbol"), F.col("c_nationkey").cast("string").alias("isin"))
    last = orders.agg(F.max("month")).scalar()
    published = orders.select(F.col("month").alias("snapshot")).distinct()
    born = first.join(cust, "c_custkey").select("index", "symbol", "isin", F.explode(F.sequence("since", last, F.expr("interval 1 month"))).alias("snapshot"))
    return born.join(published, "snapshot", "left_semi").select("index", "snapshot", "symbol", "isin")


@query("snapshot_on_change", f"""WITH {STANDING} SELECT idx AS index, snapshot, members FROM (SELECT *, lag(members) OVER (PARTITION BY idx ORDER BY snapshot) AS before FROM sn) WHERE before IS NULL OR members <> before""")
def _(spark, d):
    return mb.changed_snapshots(materialized(_standing(spark, d), "members"), ["symbol", "isin"])


@query("backdated_snapshots", f"""WITH {STANDING}, kept AS (SELECT *, lag(members) OVER (PARTITION BY idx ORDER BY snapshot) AS before FROM sn WHERE month(snapshot) % 2 = 0),
  stored AS (SELECT idx, snapshot, members FROM kept WHERE before IS NULL OR members <> before), late AS (SELECT idx, snapshot, members FROM sn WHERE month(snapshot) % 2 = 1),
  both_ AS (SELECT *, lag(members) OVER (PARTITION BY idx ORDER BY snapshot) AS before FROM (SELECT *, false AS new FROM stored UNION ALL SELECT *, true FROM late))
  SELECT idx AS index, snapshot, members, new AS inserted, before IS NOT DISTINCT FROM members AS redundant FROM both_ WHERE NOT new OR before IS NULL OR members <> before""")
def _(spark, d):
    """Lists of even months are stored on change; those of odd months come later and find their place among them."""
    digests = materialized(mb.set_digests(_standing(spark, d), ["symbol", "isin"]), "digests")
    even = F.month("snapshot") % 2 == 0
    stored = materialized(mb.new_versions(digests.limit(0), digests.where(even)), "stored")
    late = mb.new_versions(stored, digests.where(~even))
    now = stored.withColumn("inserted", F.lit(False)).unionByName(late.withColumn("inserted", F.lit(True)))
    twice = mb.redundant_versions(now).withColumn("redundant", F.lit(True))
    return now.join(twice, ["index", "snapshot"], "left").select("index", "snapshot", "members", "inserted", F.coalesce("redundant", F.lit(False)).alias("redundant"))


@query("candidate_union", f"""WITH {MEMBERS} SELECT DISTINCT symbol FROM members WHERE month(snapshot) IN (6, 12) UNION SELECT c_name FROM customer WHERE c_acctbal > 5000""")
def _(spark, d):
    """Every name of a half-yearly review, and the current members."""
    reviews = ad.member_rows(spark, d).where(F.month("snapshot").isin(6, 12))
    return mb.candidate_union(reviews, ad.table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_name").alias("symbol")))


@query("set_subset", f"""WITH {MEMBERS}, top AS (SELECT DISTINCT c_mktsegment AS idx, c_name AS symbol FROM customer WHERE c_acctbal > 0)
  SELECT count(*) AS outside, count(*) = 0 AS ok FROM (SELECT DISTINCT symbol FROM members WHERE idx = 'BUILDING') m WHERE symbol NOT IN (SELECT symbol FROM top WHERE idx = 'BUILDING')""")
def _(spark, d):
    """Are all members of a list on the broader one."""
    broad = ad.table(spark, d, "customer").where("c_acctbal > 0 AND c_mktsegment = 'BUILDING'").select(F.lit("BROAD").alias("index"), F.col("c_name").alias("symbol"))
    own = ad.member_rows(spark, d).where("index = 'BUILDING'").select("index", "symbol")
    return mb.subset(own.unionByName(broad), "BUILDING", "BROAD")


@query("entries_and_exits", f"""WITH {MEMBERS}, o AS (SELECT idx, snapshot, lag(snapshot) OVER (PARTITION BY idx ORDER BY snapshot) AS prev FROM (SELECT DISTINCT idx, snapshot FROM members))
  SELECT o.idx AS index, o.snapshot, (SELECT count(*) FROM members m WHERE m.idx = o.idx AND m.snapshot = o.snapshot AND NOT EXISTS (SELECT 1 FROM members p WHERE p.idx = o.idx AND p.snapshot = o.prev AND p.symbol = m.symbol)) AS entered,
    (SELECT count(*) FROM members m WHERE m.idx = o.idx AND m.snapshot = o.prev AND NOT EXISTS (SELECT 1 FROM members p WHERE p.idx = o.idx AND p.snapshot = o.snapshot AND p.symbol = m.symbol)) AS left
  FROM o WHERE prev IS NOT NULL""")
def _(spark, d):
    return mb.entries_and_exits(materialized(ad.member_rows(spark, d), "members"))


@query("list_overlap", f"""WITH {MEMBERS}, a AS (SELECT DISTINCT idx, symbol FROM members WHERE snapshot < DATE '1998-01-01'), b AS (SELECT DISTINCT idx, symbol FROM members WHERE snapshot >= DATE '1998-01-01')
  SELECT coalesce(a.idx, b.idx) AS index, count(*) FILTER (a.symbol IS NOT NULL AND b.symbol IS NOT NULL) AS overlap, count(*) FILTER (b.symbol IS NULL) AS left_only,
    count(*) FILTER (a.symbol IS NULL) AS right_only FROM a FULL JOIN b ON a.idx = b.idx AND a.symbol = b.symbol GROUP BY 1""")
def _(spark, d):
    m = ad.member_rows(spark, d)
    cut = F.lit("1998-01-01").cast("date")
    return mb.overlap(m.where(F.col("snapshot") < cut), m.where(F.col("snapshot") >= cut), ["index"])


@query("set_identities", """WITH n AS (SELECT c_mktsegment AS idx, c_nationkey AS s FROM customer JOIN orders ON o_custkey = c_custkey),
  x AS (SELECT s, max(CAST(idx = 'BUILDING' AS INT)) AS w, max(CAST(idx IN ('MACHINERY', 'FURNITURE') AS INT)) AS p FROM n WHERE idx IN ('BUILDING', 'MACHINERY', 'FURNITURE') GROUP BY 1)
  SELECT count(*) FILTER (w = 0 AND p = 1) AS missing, count(*) FILTER (w = 1 AND p = 0) AS extra, count(*) FILTER (w <> p) = 0 AS ok FROM x""")
def _(spark, d):
    return mb.identity(ad.member_rows(spark, d).withColumn("symbol", F.col("isin")), "BUILDING", ["MACHINERY", "FURNITURE"])


LISTED = """t AS (SELECT c_mktsegment AS idx, c_name AS symbol, CASE WHEN c_acctbal < 0 THEN 'BAD' ELSE 'IN' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS isin FROM customer)"""
# the size each list should have: that of the customers in good standing, but for one segment, which must have all
SIZES = "want AS (SELECT c_mktsegment AS idx, count(*) FILTER (c_acctbal >= 0 OR c_mktsegment = 'MACHINERY') AS size FROM customer GROUP BY 1)"


def _isin():
    return F.when(F.col("c_acctbal") < 0, "BAD").otherwise(F.concat(F.lit("IN"), F.lpad(F.col("c_custkey").cast("string"), 10, "0")))


def _sizes(spark, d):
    good = (F.col("c_acctbal") >= 0) | (F.col("c_mktsegment") == "MACHINERY")
    return ad.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("index")).agg(F.count_if(good).alias("size"))


@query("list_validation", f"""WITH {LISTED}, {SIZES} SELECT idx AS index, count(*) AS n, reason = '' AS ok, reason FROM (SELECT t.idx, CASE WHEN count(*) OVER p <> size THEN 'size'
    WHEN count(*) FILTER (NOT regexp_full_match(isin, 'IN[A-Z0-9]{{10}}')) OVER p > 0 THEN 'malformed ISINs' ELSE '' END AS reason FROM t JOIN want USING (idx)
    WHERE idx <> 'FURNITURE' OR isin <> 'BAD' WINDOW p AS (PARTITION BY t.idx)) GROUP BY 1, 4""")
def _(spark, d):
    rows = ad.table(spark, d, "customer").select(F.col("c_mktsegment").alias("index"), F.col("c_name").alias("symbol"), _isin().alias("isin"))
    return mb.validate_lists(rows.where("index <> 'FURNITURE' OR isin <> 'BAD'"), _sizes(spark, d))


def _list_files(spark, d):
    """One text per segment: columns in either order, one file that is a page, one without a heading, one of a wrong size."""
    isin, name = _isin(), F.col("c_name")
    seg = F.col("c_mktsegment")
    line = F.when(seg == "BUILDING", F.concat(F.lit('"Firm, '), name, F.lit('", x ,'), name, F.lit(",EQ, "), isin)).otherwise(F.concat(isin, F.lit(","), name, F.lit(",Firm of "), name))
    # the Company Name heading comes first in every list
    line = F.when(seg == "BUILDING", line).otherwise(F.concat(F.lit("Firm "), name, F.lit(","), isin, F.lit(" , "), name))
    head = (F.when(seg == "BUILDING", "Company Name,Industry,Symbol,Series,ISIN Code").when(seg == "HOUSEHOLD", "<html>Company Name").when(seg == "MACHINERY", "Company Name,ISIN Code,Ticker")
            .otherwise(" Company Name,ISIN Code , Symbol"))
    rows = ad.table(spark, d, "customer").where("c_acctbal >= 0").select(seg.alias("index"), head.alias("head"), F.col("c_custkey").alias("k"), line.alias("line"))
    text = F.concat(F.col("head"), F.lit("\r\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\r\n"), F.lit("\n\n"))
    return rows.groupBy("index", "head").agg(text.alias("text")).select("index", "text")


def _lists(spark, d):
    sizes = _sizes(spark, d).withColumn("size", F.when(F.col("index") == "AUTOMOBILE", F.col("size") + 1).otherwise(F.col("size")))
    return nz.constituent_lists(_list_files(spark, d), sizes)


@query("list_rows", f"""WITH {LISTED} SELECT idx AS index, CASE WHEN idx = 'BUILDING' THEN 'Firm, ' || symbol ELSE 'Firm ' || symbol END AS company, CASE WHEN idx = 'BUILDING' THEN 'x' END AS industry, symbol,
  CASE WHEN idx = 'BUILDING' THEN 'EQ' END AS series, isin FROM t WHERE isin <> 'BAD' AND idx IN ('BUILDING', 'FURNITURE')""")
def _(spark, d):
    return _lists(spark, d)[0]


@query("list_rejects", """SELECT c_mktsegment AS index, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'not a constituent file' WHEN 'MACHINERY' THEN 'unexpected columns'
    ELSE count(*) || ' constituents, expected ' || (count(*) + 1) END AS reason FROM customer WHERE c_acctbal >= 0 AND c_mktsegment IN ('HOUSEHOLD', 'MACHINERY', 'AUTOMOBILE') GROUP BY 1""")
def _(spark, d):
    return _lists(spark, d)[1]


# ---------------------------------------------------------------- flows and quality

NET = "(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) * CAST(round(o_totalprice * 100) AS BIGINT)"


@query("flows_panel", f"""SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum({NET}) AS BIGINT) AS equity, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN {NET} END) AS BIGINT) AS equity_exchange
  FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority NOT IN ('5-LOW') GROUP BY 1""")
def _(spark, d):
    return fl.flows_panel(ad.flow_rows(spark, d), "O", "1-URGENT", ["5-LOW"], "net_cents")


def _positioning(spark, d):
    seg = F.element_at(F.create_map(*[x for k, v in {"MACHINERY": "Client", "BUILDING": "DII", "AUTOMOBILE": "FII", "FURNITURE": "Pro", "HOUSEHOLD": "TOTAL"}.items() for x in (F.lit(k), F.lit(v))]), F.col("c_mktsegment"))
    cust = ad.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), seg.alias("participant"))
    orders = ad.table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), "o_orderstatus", ad.cents("o_totalprice").alias("c"))
    long = F.sum(F.when(F.col("o_orderstatus") != "F", F.col("c")).otherwise(0))
    short = F.sum(F.when(F.col("o_orderstatus") == "F", F.col("c")).otherwise(0))
    return orders.join(cust, "o_custkey").groupBy("date", "participant").agg(long.alias("long"), short.alias("short"))


PLEGS = """pl AS (SELECT CAST(o_orderdate AS DATE) AS date, CASE c_mktsegment WHEN 'MACHINERY' THEN 'Client' WHEN 'BUILDING' THEN 'DII' WHEN 'AUTOMOBILE' THEN 'FII' WHEN 'FURNITURE' THEN 'Pro' ELSE 'TOTAL' END AS participant,
    CAST(sum(CASE WHEN o_orderstatus <> 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS long, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS short
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""


@query("positioning_panel", f"""WITH {PLEGS} SELECT date, {', '.join(f"CAST(sum(CASE WHEN participant = '{p}' THEN long - short END) AS BIGINT) AS {p.lower()}_net" for p in fl.PARTICIPANTS)},
  {r("sum(CASE WHEN participant = 'FII' THEN long END) / CAST(nullif(sum(CASE WHEN participant = 'FII' THEN long + short END), 0) AS DOUBLE)")} AS long_ratio FROM pl GROUP BY 1""")
def _(spark, d):
    return rounded_columns(fl.positioning_panel(_positioning(spark, d)))


SIX = range(len(fl.PAIRS))
# on every fifth day one participant reports too much short, on every seventh the total is off, on every eleventh it lacks a value
OFF = {"client": "CASE WHEN day(date) % 5 = 0 AND i = 2 THEN v // 500 ELSE 0 END", "total": "CASE WHEN day(date) % 7 = 0 AND i = 4 THEN s // 200 ELSE 0 END"}
BALANCE = f"""v AS (SELECT CAST(o_orderdate AS DATE) AS date, CASE c_mktsegment WHEN 'MACHINERY' THEN 'Client' WHEN 'BUILDING' THEN 'DII' WHEN 'AUTOMOBILE' THEN 'FII' ELSE 'Pro' END AS participant,
    o_orderkey % 6 AS i, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
  legs AS (SELECT date, i, sum(v) AS l, sum(v + CASE WHEN participant = 'Client' THEN {OFF['client']} ELSE 0 END) AS s FROM v GROUP BY 1, 2),
  tot AS (SELECT date, i, l, s, CASE WHEN day(date) % 11 <> 0 OR i <> 5 THEN l END AS tl, s + {OFF['total']} AS ts FROM legs)"""


def _six_pairs(spark, d):
    seg = F.element_at(F.create_map(*[x for k, v in {"MACHINERY": "Client", "BUILDING": "DII", "AUTOMOBILE": "FII", "FURNITURE": "Pro", "HOUSEHOLD": "Pro"}.items() for x in (F.lit(k), F.lit(v))]), F.col("c_mktsegment"))
    cust = ad.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), seg.alias("participant"))
    orders = ad.table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), (F.col("o_orderkey") % 6).alias("i"), ad.cents("o_totalprice").alias("c"))
    v = materialized(orders.join(cust, "o_custkey").groupBy("date", "participant", "i").agg(F.sum("c").alias("v")), "legs")
    v = v.withColumn("s", F.col("v") + F.when(F.col("participant") == "Client", F.expr(OFF["client"].replace("//", "div"))).otherwise(0))
    day, names = F.day("date"), {i: pair for i, pair in enumerate(fl.PAIRS)}
    own = v.groupBy("date", "participant").agg(*[F.coalesce(F.sum(F.when(F.col("i") == i, F.col(c))), F.lit(0)).alias(n) for i, p in names.items() for n, c in zip(p, ("v", "s"), strict=True)])
    legs = v.groupBy("date", "i").agg(F.sum("v").alias("l"), F.sum("s").alias("s")).withColumn("s", F.col("s") + F.expr(OFF["total"].replace("//", "div")))
    legs = legs.withColumn("l", F.when((day % 11 != 0) | (F.col("i") != 5), F.col("l")))
    total = legs.groupBy("date").agg(*[(F.coalesce(F.sum(F.when(F.col("i") == i, F.col(c))), F.when(F.count_if(F.col("i") == i) == 0, F.lit(0)))).alias(n) for i, p in names.items() for n, c in zip(p, ("l", "s"), strict=True)])
    return own.unionByName(total.withColumn("participant", F.lit("TOTAL")))


@query("balance_checks", f"""WITH {BALANCE}, y AS (SELECT date, bool_or(abs(l - s) > greatest(l, 1) * 0.001) AS odd, bool_or(tl IS NULL OR abs(l - tl) > greatest(l, 1) * 0.001 OR abs(s - ts) > greatest(l, 1) * 0.001) AS unsummed FROM tot GROUP BY 1)
  SELECT date, NOT odd AND NOT unsummed AS ok, CASE WHEN odd THEN 'long and short differ' WHEN unsummed THEN 'participants do not sum to TOTAL' ELSE '' END AS reason FROM y""")
def _(spark, d):
    return fl.balance_failures(_six_pairs(spark, d))


@query("leaf_total_check", f"""WITH x AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN {NET} END) / 100.0 AS t, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '5-LOW') THEN {NET} END) / 100.0 AS l FROM orders GROUP BY 1)
  SELECT count(*) AS days, {r('max(abs(coalesce(l, 0) - t))', 1)} AS max_gap, max(abs(coalesce(l, 0) - t)) <= 0.5 AS ok FROM x WHERE t IS NOT NULL""")
def _(spark, d):
    rows = ad.flow_rows(spark, d).withColumn("net", F.col("net_cents") / 100)
    return rounded_columns(qa.leaves_match_total(rows, "1-URGENT", ["5-LOW"]), 1)


@query("freshness", f"""WITH {BARS}, lim AS (SELECT p_brand AS cid, CASE min(p_size) WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 14 END AS days FROM part WHERE p_size < 4 GROUP BY 1)
  SELECT cid, max(date) AS newest, CAST(DATE '2001-11-08' - max(date) AS BIGINT) AS age, CAST(coalesce(max(days), 7) AS BIGINT) AS limit, DATE '2001-11-08' - max(date) <= coalesce(max(days), 7) AS ok FROM bars LEFT JOIN lim USING (cid) GROUP BY 1""")
def _(spark, d):
    """Each source by its own limit, a week where it has none."""
    least = F.min("p_size")
    limits = ad.table(spark, d, "part").where("p_size < 4").groupBy(F.col("p_brand").alias("cid")).agg(F.when(least == 1, 1).when(least == 2, 4).otherwise(14).alias("limit"))
    return qa.freshness(ad.bars(spark, d), "cid", "2001-11-08", limits)


@query("date_convention", f"""WITH {BARS6}, {SESS}, {LOGRET}, {FLOW}, x AS (SELECT cid, date, ret, lag(ret) OVER (PARTITION BY cid ORDER BY date) AS p FROM rets)
  SELECT cid, count(*) AS n, {r('corr(flow, p)')} AS prev, {r('corr(flow, ret)')} AS same, corr(flow, p) - corr(flow, ret) >= 0.1 AS ok FROM x JOIN flow USING (date) WHERE p IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return rounded_columns(qa.date_convention(ad.daily_flow(spark, d), ser.log_returns(ad.type_bars_table(spark, d))))


@query("session_contamination", f"""WITH {BARS6}, {SESS}, {LOGRET}, x AS (SELECT a.cid AS a, b.cid AS b, date, a.ret AS x, b.ret AS y, lag(b.ret) OVER w AS p, lead(b.ret) OVER w AS n FROM rets a JOIN rets b USING (date)
    WHERE a.cid = 'ECONOMY' AND b.cid IN ('LARGE', 'SMALL') WINDOW w AS (PARTITION BY b.cid ORDER BY date))
  SELECT a, b, {r('corr(x, y)')} AS same_day, {r('corr(x, p)')} AS prior_day, {r('corr(x, n)')} AS next_day FROM x GROUP BY 1, 2""")
def _(spark, d):
    pairs = spark.createDataFrame([("ECONOMY", "LARGE"), ("ECONOMY", "SMALL")], "a string, b string")
    return rounded_columns(qa.session_contamination(ser.log_returns(ad.type_bars_table(spark, d)), pairs))


KNOWN = [("ECONOMY", "LARGE", -0.2, 0.2), ("ECONOMY", "MEDIUM", -0.2, 0.2), ("ECONOMY", "PROMO", -0.2, 0.2), ("LARGE", "SMALL", 0.1, 0.6),
         ("LARGE", "STANDARD", -0.9, -0.05), ("MEDIUM", "PROMO", 0.5, 0.9), ("MEDIUM", "SMALL", -0.2, 0.2), ("PROMO", "STANDARD", -0.15, 1.0)]


@query("known_relationships", f"""WITH {BARS6}, {SESS}, {LOGRET}, b AS (SELECT * FROM (VALUES {', '.join(map(str, KNOWN))}) v(a, b, lo, hi))
  SELECT b.a, b.b, count(*) AS n, {r('corr(x.ret, y.ret)')} AS corr, corr(x.ret, y.ret) BETWEEN any_value(lo) AND any_value(hi) AS ok FROM b JOIN rets x ON x.cid = b.a JOIN rets y ON y.cid = b.b AND y.date = x.date GROUP BY 1, 2""")
def _(spark, d):
    bounds = spark.createDataFrame(KNOWN, "a string, b string, lo double, hi double")
    return rounded_columns(qa.known_relationships(ser.log_returns(ad.type_bars_table(spark, d)), bounds))


@query("derived_reconcile", f"""WITH {BARS6}, {SESS}, dr AS (SELECT * FROM (VALUES ('ECO_X_LARGE', 'ECONOMY', 'LARGE'), ('MED_X_SMALL', 'MEDIUM', 'SMALL')) v(derived, a, b)),
  pn AS (SELECT derived, s.session_no AS no, x.close AS xa, y.close AS xb FROM dr JOIN bars x ON x.cid = a JOIN bars y ON y.cid = b AND y.date = x.date JOIN sess s ON s.date = x.date),
  rt AS (SELECT p.derived, abs(ln(p.xa * p.xb / (q.xa * q.xb)) - ln(p.xa / q.xa) - ln(p.xb / q.xb)) AS e FROM pn p JOIN pn q ON q.derived = p.derived AND q.no = p.no - 1)
  SELECT derived, max(e) < 1e-10 AS ok FROM rt GROUP BY 1""")
def _(spark, d):
    bars = ad.type_bars_table(spark, d).select("cid", "date", "close")
    full = materialized(bars.unionByName(ser.add_derived(bars, spark.sql(DERIVED))), "panel")
    return qa.derived_reconcile(ser.log_returns(full), spark.sql(DERIVED)).select("derived", "ok")


@query("buy_sell_net", """SELECT o_orderpriority AS source, count(*) AS n, count(*) FILTER (o_orderstatus = 'P' AND abs(round(o_totalprice) - o_totalprice) > 0.05) AS bad,
  CASE WHEN count(*) FILTER (o_orderstatus = 'P' AND abs(round(o_totalprice) - o_totalprice) > 0.05) = 0 THEN 'ok' WHEN o_orderpriority = '1-URGENT' THEN 'fail' ELSE 'warn' END AS severity FROM orders GROUP BY 1""")
def _(spark, d):
    # partly filled orders publish a net rounded to whole units, the others an exact one
    v = F.col("o_totalprice")
    net = F.when(F.col("o_orderstatus") == "P", F.rint(v)).otherwise(v)
    rows = ad.table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), v.alias("buy"), F.lit(0.0).alias("sell"), net.alias("net"))
    return qa.buy_sell_net(rows, strict_source="1-URGENT")


@query("stray_months", "SELECT strftime(l_shipdate + INTERVAL 3 DAY, '%Y-%m') AS part, count(*) AS n, count(*) FILTER (strftime(l_shipdate, '%Y-%m') <> strftime(l_shipdate + INTERVAL 3 DAY, '%Y-%m')) AS stray FROM lineitem GROUP BY 1")
def _(spark, d):
    day = F.to_date("l_shipdate")
    rows = ad.table(spark, d, "lineitem").select(day.alias("date"), F.date_format(F.date_add(day, 3), "yyyy-MM").alias("part"))
    return qa.stray_months(rows)


@query("latest_flows", f"WITH {FLOW} SELECT date, flow FROM flow ORDER BY date DESC LIMIT 15")
def _(spark, d):
    return latest_rows(ad.daily_flow(spark, d), [F.desc("date")], 15)


@query("first_capture_wins", """WITH e AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem), c AS (SELECT CAST(o_orderdate AS DATE) AS date, min(o_orderkey) AS captured_at, min_by(o_totalprice, o_orderkey) AS amount FROM orders GROUP BY 1)
  SELECT * FROM c WHERE date NOT IN (SELECT date FROM e)""")
def _(spark, d):
    have = ad.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    new = ad.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("captured_at"), F.col("o_totalprice").alias("amount"))
    return fl.first_capture(have, new)


@query("upcoming_actions", f"""WITH {POS}, {ACTIONS}, h AS (SELECT symbol, max_by(position, date) AS q FROM (SELECT symbol, date, CAST(sum(traded) OVER (PARTITION BY symbol ORDER BY date) AS BIGINT) AS position FROM
    (SELECT symbol, date, sum(traded) AS traded FROM dpos GROUP BY 1, 2)) GROUP BY 1)
  SELECT cid AS symbol, ex_date, kind, {r('value')} AS value FROM dacts WHERE ex_date > DATE '2000-06-30' AND cid IN (SELECT symbol FROM h WHERE q > 0)""")
def _(spark, d):
    held = ad.ledger(spark, d).groupBy("symbol").agg(F.sum(bk.signed_qty(F.col("side"), F.col("qty"))).alias("q")).where("q > 0")
    acts = market_actions(spark, d).select(F.col("cid").alias("symbol"), "ex_date", "kind", "value")
    return rounded_columns(bk.upcoming(acts, held, F.lit("2000-06-30").cast("date")))


@query("holdings_vs_list", """WITH h AS (SELECT DISTINCT o_custkey AS book, l_partkey AS symbol FROM orders JOIN lineitem ON l_orderkey = o_orderkey), f AS (SELECT p_partkey AS symbol FROM part WHERE p_retailprice > 950),
  b AS (SELECT book, count(*) AS held, count(*) FILTER (symbol IN (SELECT symbol FROM f)) AS overlap FROM h GROUP BY 1)
  SELECT book, overlap, held - overlap AS held_not_in_index, (SELECT count(*) FROM f) - overlap AS in_index_not_held FROM b""")
def _(spark, d):
    orders = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("book"))
    held = ad.table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("symbol")).join(orders, "l_orderkey").select("book", "symbol")
    official = ad.table(spark, d, "part").where("p_retailprice > 950").select(F.col("p_partkey").alias("symbol"))
    return mb.holdings_against_list(held, official)


@query("marks_with_benchmark", f"""WITH {MARKS}, b AS (SELECT m.book, m.date, m.nav, k.close AS benchmark, min_by(k.close, m.date) OVER (PARTITION BY m.book) AS f
    FROM marks m LEFT JOIN mkt k ON k.date = m.date)
  SELECT book, date, {r('nav', 1)} AS nav, {r('benchmark')} AS benchmark, {r('nav / 1000000 - 1', 5)} AS growth, {r('benchmark / f - 1')} AS benchmark_growth FROM b""")
def _(spark, d):
    marked = _marks(spark, d)[2].select("book", "date", "nav")
    out = rounded_columns(bk.attach_benchmark(marked, ad.market_close(spark, d), 1_000_000.0))
    return out.withColumns({"nav": rnd("nav", 1), "growth": rnd("growth", 5)})
