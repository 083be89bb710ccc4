"""Normalisers, stores, exports and streams over text and tables derived from the driver's data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import flows as fl
from tickloom.plans.catalog import BARS, BARS6, query, r, rnd, rounded_columns
from tickloom.session import materialized, scratch_path
from tickloom.sources import adapters as ad
from tickloom.sources import export as ex
from tickloom.sources import normalise as nz
from tickloom.sources import registry as rg
from tickloom.sources import store as st
from tickloom.streaming import jobs


def _padded(c):
    return F.concat(F.lit(" "), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("  "))


@query("price_files", """SELECT CAST(l_shipdate AS DATE) AS date, 'S' || l_partkey AS symbol, CASE l_returnflag WHEN 'A' THEN 'EQ' ELSE 'BE' END AS series,
  CASE WHEN l_linestatus = 'O' THEN 'IN' || l_orderkey END AS isin, l_extendedprice AS close, CAST(l_quantity AS BIGINT) AS volume, l_discount AS turnover
  FROM lineitem WHERE l_returnflag IN ('A', 'R')""")
def _(spark, d):
    """Two daily price layouts, padded and with foreign series, as one schema."""
    series = F.when(F.col("l_returnflag") == "A", "EQ").when(F.col("l_returnflag") == "R", "BE").otherwise("GB")
    items = ad.table(spark, d, "lineitem").select(
        F.to_date("l_shipdate").alias("date"), _padded(F.concat(F.lit("S"), "l_partkey")).alias("sym"), _padded(series).alias("ser"),
        F.concat(F.lit("IN"), "l_orderkey").alias("isin"), _padded("l_extendedprice").alias("px"),
        F.col("l_quantity").cast("long").cast("string").alias("q"), F.col("l_discount").cast("string").alias("t"), "l_linestatus")
    price = [("open", "px"), ("high", "px"), ("low", "px"), ("close", "px"), ("prevclose", "px"), ("volume", "q"), ("turnover", "t")]
    old = {"symbol": "SYMBOL", "series": "SERIES", "open": "OPEN", "high": "HIGH", "low": "LOW", "close": "CLOSE", "prevclose": "PREVCLOSE", "volume": "TOTTRDQTY", "turnover": "TOTTRDVAL"}
    new = {"symbol": "TckrSymb", "series": "SctySrs", "open": "OpnPric", "high": "HghPric", "low": "LwPric", "close": "ClsPric", "prevclose": "PrvsClsgPric", "volume": "TtlTradgVol", "turnover": "TtlTrfVal"}

    def layout(names, extra=()):
        return [F.col("sym").alias(names["symbol"]), F.col("ser").alias(names["series"]), *extra, *[F.col(s).alias(names[c]) for c, s in price]]

    legacy = items.where("l_linestatus = 'F'").select("date", *layout(old))
    modern = items.where("l_linestatus = 'O'").select("date", *layout(new, [F.col("isin").alias("ISIN")]))
    return nz.union_layouts([legacy, modern]).select("date", "symbol", "series", "isin", "close", "volume", "turnover")


@query("derivative_symbols", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, 'S' || l_suppkey AS symbol FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, d):
    raw = ad.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), _padded(F.concat(F.lit("S"), "l_suppkey")).alias("TckrSymb"),
                                                _padded(F.when(F.col("l_returnflag") == "R", "STF").otherwise("STO")).alias("FinInstrmTp"))
    return nz.derivative_symbols(raw)


SIGNED = "CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END"


def _money(v):
    text = F.format_number(F.abs(v), 2)
    return F.when(v < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


@query("investment_files", f"SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS date, 'Equity' AS asset, o_orderpriority AS route, o_totalprice AS gross_buy, {SIGNED} AS net FROM orders WHERE o_orderstatus <> 'P'")
def _(spark, d):
    o = ad.table(spark, d, "orders")
    v = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    day = F.when(F.col("o_orderstatus") == "P", "Total for the month").otherwise(F.date_format("o_orderdate", "dd-MMM-yyyy"))
    raw = o.select(F.col("o_orderkey").cast("string").alias("net_usd_mn"), day.alias("date"), F.lit(" Equity ").alias("asset"), _padded("o_orderpriority").alias("route"),
                   _money(F.col("o_totalprice")).alias("gross_buy"), _money(v).alias("net"))
    return nz.investments(raw).select(F.col("net_usd_mn").cast("long").alias("k"), "date", "asset", "route", "gross_buy", "net")


@query("derivative_activity", f"SELECT CAST(o_orderdate AS DATE) AS date, CASE o_orderstatus WHEN 'F' THEN 'Index Futures' ELSE 'Stock Options' END AS product, o_totalprice AS buy_contracts, {SIGNED} AS oi_cr FROM orders")
def _(spark, d):
    o = ad.table(spark, d, "orders")
    v = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    name = F.when(F.col("o_orderstatus") == "F", " INDEX FUTURES").otherwise("stock options ")
    raw = o.select(F.date_format("o_orderdate", "dd-MMM-yyyy").alias("date"), name.alias("product"), *[_money(F.col("o_totalprice")).alias(c) for c in nz.DERIVATIVE_COLS[1:-1]], _money(v).alias("oi_cr"))
    return nz.derivatives(raw).select("date", "product", "buy_contracts", "oi_cr")


@query("two_sided_captures", """WITH c AS (SELECT CAST(o_orderdate AS DATE) AS capture, o_orderstatus AS s, max(o_totalprice) AS buy, min(o_totalprice) AS sell FROM orders GROUP BY 1, 2)
  SELECT f.capture, f.capture AS date, f.buy AS fii_buy, f.sell AS fii_sell, round(f.buy - f.sell, 2) AS fii_net, x.buy AS dii_buy, x.sell AS dii_sell, round(x.buy - x.sell, 2) AS dii_net
  FROM c f JOIN c x ON x.capture = f.capture AND x.s = 'P' WHERE f.s = 'O' AND f.capture NOT IN (SELECT capture FROM c WHERE s = 'F')""")
def _(spark, d):
    """Captures of two lines each; days with a third category are rejected."""
    cat = F.when(F.col("o_orderstatus") == "O", " fii/fpi *").when(F.col("o_orderstatus") == "P", "DII **").otherwise("Other")
    rows = ad.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("capture"), cat.alias("category")).agg(F.max("o_totalprice").alias("buy"), F.min("o_totalprice").alias("sell"))
    rows = rows.withColumns({"date": F.col("capture"), "net": F.round(F.col("buy") - F.col("sell"), 2)})
    return fl.two_sided_row(rows)


@query("participant_files", """WITH l AS (SELECT CAST(o_orderdate AS DATE) AS date, c_mktsegment AS seg, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
  w AS (SELECT date FROM l GROUP BY 1 HAVING count(*) = 5)
  SELECT date, CASE seg WHEN 'MACHINERY' THEN 'Client' WHEN 'BUILDING' THEN 'DII' WHEN 'AUTOMOBILE' THEN 'FII' WHEN 'FURNITURE' THEN 'Pro' ELSE 'TOTAL' END AS participant,
    CAST(n * 1000 AS DOUBLE) AS "long", CAST(n AS DOUBLE) AS "short" FROM l JOIN w USING (date)""")
def _(spark, d):
    """Whole positioning files as text, titled on their own line, and days with fewer than five rows rejected."""
    seg = {"MACHINERY": "Client", "BUILDING": "DII", "AUTOMOBILE": "FII ", "FURNITURE": "pro", "HOUSEHOLD": "TOTAL"}
    label = F.element_at(F.create_map(*[x for k, v in seg.items() for x in (F.lit(k), F.lit(v))]), F.col("c_mktsegment"))
    cust = ad.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    lines = ad.table(spark, d, "orders").join(cust, "o_custkey").groupBy(F.to_date("o_orderdate").alias("day"), label.alias("p")).agg(F.count("*").alias("n"))
    line = F.concat(F.col("p"), F.lit(',"'), F.format_number(F.col("n") * 1000, 0), F.lit('",'), F.col("n"))
    # at most five labels exist per day
    body = lines.groupBy("day").agg(F.array_join(F.collect_list(line), "\n").alias("b"))
    title = F.concat(F.lit("Participant wise Open Interest as on "), F.date_format("day", "MMM d, yyyy"))
    files = body.select("day", F.concat(title, F.lit("\nClient Type,Future Index Long ,Future Index Short\n"), "b").alias("text"))
    return nz.participant_files(files).select("date", "participant", F.col("m")["Future Index Long"].alias("long"), F.col("m")["Future Index Short"].alias("short"))


@query("daily_observations", """SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS date, max_by(o_totalprice, o_orderkey) AS close FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2""")
def _(spark, d):
    o = ad.table(spark, d, "orders")
    value = F.when(F.col("o_orderstatus") == "P", ".").otherwise(F.col("o_totalprice").cast("string"))
    raw = o.select(F.col("o_orderpriority").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), value.alias("value"), F.col("o_orderkey").alias("seq"))
    return nz.observations(raw)


@query("ohlcv_rows", """WITH x AS (SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS date, max_by(o_totalprice, o_orderkey) AS close, max_by(CASE WHEN o_orderpriority = '5-LOW' THEN 0.0 ELSE o_totalprice END, o_orderkey) AS volume FROM orders GROUP BY 1, 2)
  SELECT key, date, close, CAST(CASE WHEN max(volume) OVER (PARTITION BY key) > 0 THEN volume END AS DOUBLE) AS volume FROM x""")
def _(spark, d):
    v = F.when(F.col("o_orderpriority") == "5-LOW", 0.0).otherwise(F.col("o_totalprice"))
    raw = ad.table(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("close"), v.alias("volume"), F.col("o_orderkey").alias("seq"))
    return nz.ohlcv(raw).select("key", "date", "close", "volume")


ZONES = [("click", "Pacific/Auckland"), ("view", "America/New_York"), ("error", "Asia/Kolkata"), ("purchase", None), ("signup", "Pacific/Honolulu")]
ZONE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{z}'" for k, z in ZONES if z) + " ELSE 'UTC' END"


@query("ohlcv_local", f"""WITH x AS (SELECT event_type AS key, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE ({ZONE_SQL}) AS DATE) AS date, max_by(value, event_id) AS close, max_by(CASE WHEN event_type = 'view' THEN 0.0 ELSE value END, event_id) AS volume FROM events GROUP BY 1, 2)
  SELECT key, date, close, CAST(CASE WHEN max(volume) OVER (PARTITION BY key) > 0 THEN volume END AS DOUBLE) AS volume FROM x""")
def _(spark, d):
    """Moments in UTC cut into days by each series' own clock, over the date line and over clock changes."""
    v = F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value"))
    raw = ad.table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("date"), F.col("value").alias("close"), v.alias("volume"), F.col("event_id").alias("seq"), "props")
    return nz.ohlcv(raw, zones=spark.createDataFrame(ZONES, "key string, zone string")).select("key", "date", "close", "volume")


@query("tri_payloads", "SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS date, o_totalprice AS tri FROM orders WHERE o_orderstatus <> 'P'")
def _(spark, d):
    o = ad.table(spark, d, "orders")
    v = F.when(F.col("o_orderstatus") == "P", "-").otherwise(F.format_number("o_totalprice", 2))
    rec = F.array(F.struct(F.col("o_orderpriority").alias("Index Name"), F.date_format("o_orderdate", "dd MMM yyyy").alias("Date"), v.alias("TotalReturnsIndex")))
    text = F.to_json(rec)
    wrapped = F.when(F.col("o_orderstatus") == "F", F.to_json(F.struct(text.alias("d")))).otherwise(text)
    return nz.tri_payload(o.select(F.col("o_orderkey").alias("k"), wrapped.alias("payload")), keys=("k",))


@query("rename_lines", "SELECT p_brand AS old, p_type AS new, DATE '1995-01-02' + CAST(p_partkey * 37 % 2499 AS INTEGER) AS date FROM part WHERE p_size <> 13")
def _(spark, d):
    day = F.date_add(F.lit("1995-01-02").cast("date"), (F.col("p_partkey") * 37 % 2499).cast("int"))
    when = F.when(F.col("p_size") == 13, "not known").otherwise(F.date_format(day, "dd-MMM-yyyy"))
    lines = ad.table(spark, d, "part").select(F.concat(F.lit("Some, Company, "), "p_name", F.lit(", "), "p_brand", F.lit(" ,"), "p_type", F.lit(","), when).alias("value"))
    return nz.rename_lines(lines)


REGISTRY = """reg AS (SELECT c_name AS key, CASE WHEN c_nationkey < 3 THEN 'moon' WHEN c_nationkey < 12 THEN 'ist_close' ELSE 'us_session' END AS session,
  CASE WHEN c_acctbal < 0 THEN 'derived' WHEN c_acctbal < 3000 THEN 'fred' ELSE 'nse' END AS source, CASE WHEN c_nationkey = 20 THEN '' ELSE 'T' END AS ticker, c_mktsegment AS klass FROM customer)"""


def _registry(spark, d):
    c = ad.table(spark, d, "customer")
    nat, bal = F.col("c_nationkey"), F.col("c_acctbal")
    return c.select(
        F.col("c_name").alias("key"), F.when(nat < 3, "moon").when(nat < 12, "ist_close").otherwise("us_session").alias("session"),
        F.when(bal < 0, "derived").when(bal < 3000, "fred").otherwise("nse").alias("source"), F.when(nat == 20, "").otherwise("T").alias("ticker"),
        F.col("c_mktsegment").alias("klass"), F.lit("subject").alias("role"), F.lit("ok").alias("status"),
        F.array(F.when(nat < 6, "C1").otherwise("D3")).alias("answers"), F.array(F.lit("Customer#000000001"), F.when(nat == 7, "Absent").otherwise("Customer#000000002")).alias("derived_from"))


@query("registry_problems", f"""WITH {REGISTRY} SELECT key, 'bad session' AS problem FROM reg WHERE session = 'moon' UNION ALL SELECT key, 'no ticker' FROM reg WHERE source = 'fred' AND ticker = ''
  UNION ALL SELECT c_name, 'unknown input' FROM customer WHERE c_acctbal < 0 AND c_nationkey = 7""")
def _(spark, d):
    return rg.problems(_registry(spark, d))


@query("registry_select", f"""WITH {REGISTRY} SELECT key FROM reg JOIN customer ON c_name = key WHERE source = 'fred' AND ticker <> '' AND session <> 'ist_close' AND c_nationkey < 6""")
def _(spark, d):
    return rg.select(_registry(spark, d), fetchable=True, contaminates_same_day=True, answering="C1").select("key")


@query("settled_bars", f"""WITH {BARS} SELECT cid, date FROM bars WHERE date <= CASE WHEN cid < 'Brand#2' THEN DATE '2001-10-14' ELSE DATE '2001-10-13' END""")
def _(spark, d):
    """Bars final at noon UTC on 14 October 2001: India's of that day are, New York's are not yet."""
    rows = ad.bars(spark, d).select("cid", "date", F.when(F.col("cid") < "Brand#2", "ist_close").otherwise("us_session").alias("session"))
    return rg.drop_unsettled(rows, F.lit("2001-10-14 12:00:00").cast("timestamp")).select("cid", "date")


@query("latest_targets", f"""WITH s AS (SELECT p_type AS review, 'S' || p_partkey AS symbol, CAST(p_size AS DOUBLE) AS w FROM part), m AS (SELECT * FROM s WHERE review = (SELECT max(review) FROM s))
  SELECT symbol, {r('w / (SELECT sum(w) FROM m)', 9)} AS weight FROM m""")
def _(spark, d):
    sel = ad.table(spark, d, "part").select(F.col("p_type").alias("review"), F.concat(F.lit("S"), "p_partkey").alias("symbol"), F.col("p_size").cast("double").alias("weight_tilt"))
    return rounded_columns(nz.latest_targets(sel), 9)


@query("eq_closes", "SELECT CAST(l_shipdate AS DATE) AS date, 'S' || l_partkey AS symbol, l_extendedprice AS close FROM lineitem WHERE l_returnflag = 'A'")
def _(spark, d):
    series = F.when(F.col("l_returnflag") == "A", " EQ").otherwise("BE")
    rows = ad.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), _padded(F.concat(F.lit("S"), "l_partkey")).alias("symbol"), series.alias("series"), F.col("l_extendedprice").cast("string").alias("close"))
    return nz.eq_closes(rows)


# ---------------------------------------------------------------- stores

VINT = """raw AS (SELECT o_orderpriority AS key, CAST(date_trunc('month', o_orderdate) AS DATE) AS snapshot, o_orderkey AS k, o_totalprice AS v FROM orders)"""


def _vintages(spark, d):
    return ad.table(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.to_date(F.trunc("o_orderdate", "month")).alias("snapshot"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))


@query("asof_vintage", f"WITH {VINT} SELECT * FROM raw WHERE snapshot = (SELECT max(snapshot) FROM raw r WHERE r.key = raw.key AND r.snapshot <= DATE '1998-03-17')")
def _(spark, d):
    return st.read_vintage(_vintages(spark, d), F.lit("1998-03-17").cast("date"))


@query("snapshot_store", f"WITH {VINT} SELECT key, snapshot, count(*) AS n FROM raw WHERE snapshot = (SELECT max(snapshot) FROM raw r WHERE r.key = raw.key) GROUP BY 1, 2")
def _(spark, d):
    """Write every vintage, rewrite one of them, and read the newest of each key back."""
    root = scratch_path(spark, "snapshots")
    rows = _vintages(spark, d)
    st.write_snapshot(rows, root)
    st.write_snapshot(rows.where(F.col("snapshot") == F.lit("1999-05-01").cast("date")), root)
    stored = st.read_snapshots(spark, root)
    return st.read_vintage(stored).groupBy("key", "snapshot").agg(F.count("*").alias("n"))


@query("year_store", f"WITH {BARS} SELECT cid AS symbol, date, close FROM bars WHERE date BETWEEN DATE '1996-06-15' AND DATE '1998-02-10'")
def _(spark, d):
    root = scratch_path(spark, "years")
    rows = ad.bars(spark, d).select(F.col("cid").alias("symbol"), F.lit("EQ").alias("series"), "date", "close")
    st.write_years(rows, root)
    return st.scan_years(spark, root, "1996-06-15", "1998-02-10", ["symbol", "date", "close"])


@query("year_upsert", f"""WITH {BARS6}, old AS (SELECT *, volume AS c FROM bars WHERE day(date) <= 20), span AS (SELECT * FROM bars WHERE date BETWEEN DATE '1996-06-01' AND DATE '1998-03-31'),
  new AS (SELECT cid, date, 7 + volume AS c FROM span WHERE dayofweek(date) BETWEEN 1 AND 5 AND day(date) <> 28 AND date NOT IN (SELECT date FROM old))
  SELECT CAST(year(date) AS BIGINT) AS year, count(*) AS n, CAST(sum(c) AS BIGINT) AS volume FROM (SELECT cid, date, c FROM old UNION ALL SELECT * FROM new) GROUP BY 1""")
def _(spark, d):
    """Days up to the 20th are stored; a fetch of two years brings all its days, with other values, and is merged twice."""
    root = scratch_path(spark, "upsert")
    bars = ad.type_bars_table(spark, d).select(F.col("cid").alias("symbol"), F.lit("EQ").alias("series"), "date", "volume")
    st.write_years(bars.where(F.day("date") <= 20), root)
    fetched = bars.where("date BETWEEN DATE '1996-06-01' AND DATE '1998-03-31'").withColumn("volume", F.col("volume") + 7)
    holidays = bars.where(F.day("date") == 28).select("date").distinct()
    bounds = spark.sql("SELECT DATE '1996-06-01' AS start, DATE '1998-03-31' AS end")
    for _ in range(2):
        st.upsert_years(root, fetched, holidays, bounds)
    return spark.read.parquet(root).groupBy(F.col("year").cast("long").alias("year")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query("rebuild_on_change", """WITH o AS (SELECT year(o_orderdate) AS y, CAST(round(o_totalprice * 100) AS BIGINT) AS c, o_orderstatus AS st FROM orders)
  SELECT CAST(y AS BIGINT) AS year, count(*) AS n, CAST(sum(c) AS BIGINT) AS cents, CAST(CASE WHEN y = 1996 THEN 2 ELSE 1 END AS BIGINT) AS builds FROM o WHERE st = 'F' OR y = 1996 GROUP BY 1, 4""")
def _(spark, d):
    """A folder of raw files by year is curated; then a file lands in one year, and the third run finds nothing to do."""
    raw, curated = scratch_path(spark, "raw"), scratch_path(spark, "curated")
    rows = ad.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), ad.cents("o_totalprice").alias("cents"), "o_orderstatus")
    build = lambda df: df.groupBy("year").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    builds = []
    for landed in (rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus <> 'F' AND year = 1996"), None):
        if landed is not None:
            landed.write.mode("append").partitionBy("year").parquet(raw)
        builds += st.rebuild_changed(spark, raw, curated, "year", build)
    count = spark.createDataFrame([(int(y),) for y in builds], "year int").groupBy("year").agg(F.count("*").alias("builds"))
    return spark.read.parquet(curated).join(count, "year").select(F.col("year").cast("long").alias("year"), "n", "cents", "builds")


@query("log_returns_curated", f"""WITH {BARS} SELECT cid, date, {r("ln(close / lag(close) OVER (PARTITION BY cid ORDER BY date))")} AS ret FROM bars
  QUALIFY ret IS NOT NULL""")
def _(spark, d):
    """From a named table, bucketed by key: the window needs no exchange."""
    from tickloom.operators import series as ser

    st.save_curated(ad.bars(spark, d).select("cid", "date", "close"), "curated_bars", buckets=8)
    return rounded_columns(ser.log_returns(st.read_curated(spark, "curated_bars", ["cid", "date", "close"]), calendar="own"))


@query("reference_scan", """SELECT CAST(o_orderdate AS DATE) AS date, CAST(max(CAST(round(o_totalprice) AS BIGINT)) AS DOUBLE) AS tri FROM orders WHERE o_orderdate < DATE '1997-01-01' GROUP BY 1""")
def _(spark, d):
    """A reference index kept as CSV, cut at the start of a holdout."""
    root = scratch_path(spark, "reference")
    day = F.to_date("o_orderdate").alias("date")
    ad.table(spark, d, "orders").groupBy(day).agg(F.max(F.round("o_totalprice").cast("long")).cast("double").alias("tri")).write.option("header", True).csv(root)
    return st.dev_slice(st.scan_reference(spark, root), F.lit("1997-01-01").cast("date"))


@query("action_scan", """SELECT 'S' || p_partkey AS symbol, CAST(p_size AS DOUBLE) AS value, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'Dividend, Rs ' || p_size END AS subject,
  DATE '1995-01-02' + CAST(p_partkey % 900 AS INTEGER) AS ex_date FROM part WHERE DATE '1995-01-02' + CAST(p_partkey % 900 AS INTEGER) BETWEEN DATE '1995-06-01' AND DATE '1996-05-31'""")
def _(spark, d):
    """Actions kept as CSV, a third of them without a subject, in a window of a year."""
    root = scratch_path(spark, "actions")
    rows = ad.table(spark, d, "part").select(
        F.concat(F.lit("S"), "p_partkey").alias("symbol"), F.lit("EQ").alias("series"), F.lit(None).cast("string").alias("isin"),
        F.date_add(F.lit("1995-01-02").cast("date"), (F.col("p_partkey") % 900).cast("int")).alias("ex_date"), F.lit("dividend").alias("kind"), F.col("p_size").cast("double").alias("value"),
        F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("Dividend, Rs "), F.col("p_size").cast("string"))).alias("subject"))
    rows.write.option("header", True).csv(root)
    found = st.window_slice(st.scan_actions(spark, root).withColumn("date", F.col("ex_date")), F.lit("1995-06-01").cast("date"), F.lit("1996-05-31").cast("date"))
    return found.select("symbol", "value", "subject", "ex_date")


@query("csv_store", f"WITH {BARS6} SELECT cid, date, volume FROM bars")
def _(spark, d):
    root = scratch_path(spark, "csv")
    st.write_csv_by_year(ad.type_bars(spark, d).select("cid", "date", "volume"), root)
    return st.read_csv_by_year(spark, root, "cid STRING, date DATE, volume BIGINT, year INT")


@query("missing_days", """WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderpriority = '1-URGENT'), h AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderpriority = '5-LOW')
  SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY)) AS d) WHERE dayofweek(d) BETWEEN 1 AND 5 AND CAST(d AS DATE) NOT IN (FROM o) AND CAST(d AS DATE) NOT IN (FROM h)""")
def _(spark, d):
    o = ad.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), "o_orderpriority")
    bounds = o.agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return st.missing_days(o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderpriority = '5-LOW'"), bounds)


@query("splice_overlap", """WITH c AS (SELECT o_orderpriority AS name, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS tri FROM orders GROUP BY 1, 2), cur AS (SELECT * FROM c WHERE date <= DATE '1999-06-30'),
  l AS (SELECT name, max(date) AS ld, max_by(tri, date) AS lv FROM cur GROUP BY 1)
  SELECT c.name, c.date, CASE WHEN c.name = '5-LOW' THEN tri * 2 ELSE tri END AS tri FROM c JOIN l USING (name) WHERE c.date > ld AND c.name <> '5-LOW'""")
def _(spark, d):
    full = ad.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("tri"))
    cut = F.lit("1999-06-30").cast("date")
    fetched = full.withColumn("tri", F.when(F.col("name") == "5-LOW", F.col("tri") * 2).otherwise(F.col("tri")))
    return st.splice(full.where(F.col("date") <= cut), fetched)[0]


@query("refresh_window", """WITH a AS (SELECT p_brand AS symbol, DATE '1995-01-02' + CAST(p_partkey * 17 % 2499 AS INTEGER) AS ex_date, p_type AS kind, min(p_size) AS value FROM part GROUP BY 1, 2, 3),
  k AS (SELECT symbol, ex_date, kind, value FROM a WHERE NOT (symbol < 'Brand#2' AND ex_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'))
  SELECT symbol, ex_date, kind, CAST(value AS BIGINT) AS value FROM k UNION ALL SELECT symbol, ex_date, kind, CAST(value + 1 AS BIGINT) FROM a WHERE symbol < 'Brand#2' AND ex_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'""")
def _(spark, d):
    day = F.date_add(F.lit("1995-01-02").cast("date"), (F.col("p_partkey") * 17 % 2499).cast("int"))
    cache = ad.table(spark, d, "part").groupBy(F.col("p_brand").alias("symbol"), day.alias("ex_date"), F.col("p_type").alias("kind")).agg(F.min("p_size").cast("long").alias("value"))
    a, b = F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date")
    fresh = cache.where((F.col("symbol") < "Brand#2") & F.col("ex_date").between(a, b)).withColumn("value", F.col("value") + 1)
    return st.refresh_window(cache, fresh, cache.where(F.col("symbol") < "Brand#2"), a, b)


@query("months_to_scan", """WITH m AS (SELECT strftime(CAST(d AS DATE), '%Y-%m') AS part FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS d)),
  done AS (SELECT strftime(o_orderdate, '%Y-%m') AS part FROM orders GROUP BY 1 HAVING count(*) > 185) SELECT part FROM m WHERE part >= '2001-07' OR part NOT IN (SELECT part FROM done)""")
def _(spark, d):
    o = ad.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    done = o.groupBy(F.date_format("date", "yyyy-MM").alias("part")).agg(F.count("*").alias("n")).where("n > 185")
    return st.months_to_scan(o.agg(F.min("date").alias("start"), F.max("date").alias("end")), done)


@query("trial_gate", """WITH t AS (SELECT o_orderkey AS trial, o_custkey AS e, CAST(o_orderdate AS DATE) AS data_end FROM orders), g AS (SELECT c_custkey AS e FROM customer WHERE c_acctbal > 0), u AS (SELECT c_custkey AS e FROM customer WHERE c_mktsegment = 'BUILDING')
  SELECT trial, CASE WHEN e NOT IN (FROM g) THEN 'not registered' ELSE 'touches the sealed holdout' END AS reason FROM t WHERE e NOT IN (FROM g) OR (data_end >= DATE '1999-10-01' AND e NOT IN (FROM u))""")
def _(spark, d):
    t = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("trial"), F.col("o_custkey").alias("experiment"), F.to_date("o_orderdate").alias("data_end"))
    c = ad.table(spark, d, "customer")
    reg = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("experiment"), F.lit("1999-10-01").cast("date").alias("holdout_start"))
    unlocked = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("experiment"))
    return st.gate_trials(t, reg, unlocked)[1].select("trial", "reason")


@query("trial_counts", "SELECT CASE WHEN grouping(o_custkey) = 1 THEN -1 ELSE o_custkey END AS experiment, count(*) AS trials FROM orders GROUP BY ROLLUP (o_custkey)")
def _(spark, d):
    t = ad.table(spark, d, "orders").select(F.col("o_custkey").alias("experiment"))
    agg = t.rollup("experiment").agg(F.count("*").alias("trials"), F.grouping("experiment").alias("_g"))
    return agg.select(F.when(F.col("_g") == 1, -1).otherwise(F.col("experiment")).alias("experiment"), "trials")


@query("delta_encode", f"""WITH {BARS6} SELECT cid, date, {r('ln(close)', 4)} AS close, CAST(volume AS DOUBLE) AS volume FROM bars""")
def _(spark, d):
    """Every series encoded and decoded again: all of its days and both of its columns, prices on a log scale."""
    bars = ad.type_bars(spark, d).withColumns({"volume": F.col("volume").cast("double"), "close": F.log("close")})
    return rounded_columns(ex.decode_series(ex.delta_series(bars, ["close", "volume"], "cid"), ["close", "volume"], "cid"), 4)


@query("table_export", """SELECT '["' || n_name || '",' || n_nationkey || ',' || '"1995-01-02"' || ',null]' AS row FROM nation""")
def _(spark, d):
    t = ad.table(spark, d, "nation").select("n_name", "n_nationkey", F.lit("1995-01-02").cast("date").alias("d"), (F.col("n_nationkey") * float("nan")).alias("x"))
    return ex.table_json(t)


@query("last_dates", "SELECT 'prices' AS source, CAST(max(l_shipdate) AS DATE) AS last_date FROM lineitem UNION ALL SELECT 'flows', CAST(max(o_orderdate) AS DATE) FROM orders UNION ALL SELECT 'events', CAST(max(ts) AS DATE) FROM events")
def _(spark, d):
    return ex.last_dates({"prices": ad.table(spark, d, "lineitem").select(F.col("l_shipdate").alias("date")),
                          "flows": ad.table(spark, d, "orders").select(F.col("o_orderdate").alias("date")),
                          "events": ad.table(spark, d, "events").select(F.col("ts").alias("date"))})


# ---------------------------------------------------------------- streams

@query("stream_daily_bars", """WITH b AS (SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n, min(value) AS low, max(value) AS high, max_by(value, ts) AS close FROM events GROUP BY 1, 2)
  SELECT * FROM b WHERE date + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def _(spark, d):
    return jobs.run_to_table(jobs.settled_bars(jobs.event_stream(spark, d)), "bars")


@query("stream_weekly_bars", """WITH e AS (SELECT *, CAST(ts AS DATE) AS d FROM events), w AS (SELECT CAST(d - CAST((date_diff('day', DATE '1970-01-01', d) - 2 + 7000) % 7 AS INTEGER) AS DATE) AS from_date, event_type, value, ts FROM e)
  SELECT from_date, CAST(from_date + 7 AS DATE) AS to_date, event_type, count(*) AS n, max_by(value, ts) AS close FROM w GROUP BY 1, 2, 3 HAVING from_date + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def _(spark, d):
    """Weeks that end with Friday: tumbling windows starting on Saturday."""
    return jobs.run_to_table(jobs.rolling_bars(jobs.event_stream(spark, d), "7 days", start="2 days"), "weeks")


@query("stream_sliding_bars", """WITH s AS (SELECT CAST(ts AS DATE) - CAST(k AS INTEGER) AS from_date, event_type, value, ts FROM events, range(0, 21) x(k))
  SELECT from_date, CAST(from_date + 21 AS DATE) AS to_date, event_type, count(*) AS n, max_by(value, ts) AS close FROM s GROUP BY 1, 2, 3 HAVING from_date + INTERVAL 21 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def _(spark, d):
    return jobs.run_to_table(jobs.rolling_bars(jobs.event_stream(spark, d), "21 days", "1 day"), "slides")


@query("stream_first_capture", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS date FROM events")
def _(spark, d):
    days = jobs.event_stream(spark, d, "60 days").withColumn("date", F.to_date("ts"))
    first = jobs.first_captures(days, ["user_id", "event_type", "date"])
    return jobs.run_to_table(first, "captures").select("user_id", "event_type", "date")


@query("stream_positions", "SELECT user_id AS book, event_type AS symbol, CAST(sum(CASE WHEN value >= 10 THEN CAST(round(value) AS BIGINT) ELSE -CAST(round(value) AS BIGINT) END) AS BIGINT) AS position FROM events GROUP BY 1, 2")
def _(spark, d):
    side = F.when(F.col("value") >= 10, "BUY").otherwise("SELL")
    trades = jobs.event_stream(spark, d).select(F.col("user_id").alias("book"), F.col("event_type").alias("symbol"), side.alias("side"), F.round("value").cast("long").alias("qty"))
    path = jobs.run_batches(jobs.running_positions(trades), "positions", jobs.write_batch, "update")
    return jobs.latest_state(spark, path, ["book", "symbol"])


@query("stream_changes", "WITH x AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) SELECT CAST(user_id AS VARCHAR) AS k, event_type AS v, count(*) AS n FROM x WHERE p IS NULL OR p <> event_type GROUP BY 1, 2")
def _(spark, d):
    out = jobs.changes_only(jobs.event_stream(spark, d), "user_id", "event_type")
    return out.groupBy("k", "v").agg(F.count("*").alias("n"))


@query("stream_restatement", """WITH m AS (SELECT DISTINCT user_id AS book, CAST(ts AS DATE) AS date FROM events), a AS (SELECT user_id AS book, CAST(ts AS DATE) AS ex_date, sum(CAST(round(value * 100) AS BIGINT)) AS c FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
  SELECT m.book, m.date, CAST(sum(c) AS BIGINT) AS cash FROM m JOIN a ON a.book = m.book AND m.date >= a.ex_date GROUP BY 1, 2""")
def _(spark, d):
    """Purchases arrive late as a stream; each batch restates the marks on and after its dates."""
    marks = ad.table(spark, d, "events").select(F.col("user_id").alias("book"), F.to_date("ts").alias("date")).distinct().withColumn("nav", F.lit(0).cast("long"))
    marks = jobs.by_slot(marks, "book", "marks")
    late = jobs.event_stream(spark, d).where("event_type = 'purchase'").select(F.col("user_id").alias("book"), F.to_date("ts").alias("ex_date"), ad.cents("value").alias("cash"))

    def step(batch, i, path):
        jobs.restate_marks(marks, batch, i, path)

    path = jobs.run_batches(late, "restated", step)
    return jobs.restated(spark, path).select("book", "date", F.col("nav").alias("cash"))


# ---------------------------------------------------------------- period partitions and the trial log

@query("period_store", """SELECT CAST(year(o_orderdate) AS BIGINT) AS part, count(*) AS n, CAST(sum(CASE WHEN year(o_orderdate) = 1996 THEN 2 ELSE 1 END * CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
    (SELECT count(DISTINCT o_orderstatus) FROM orders) AS n_keys FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def _(spark, d):
    """Rows by key and year; one year of one key is replaced and the others stay."""
    root = scratch_path(spark, "periods")
    rows = ad.table(spark, d, "orders").select(F.col("o_orderstatus").alias("key"), F.year("o_orderdate").alias("part"), ad.cents("o_totalprice").alias("cents"))
    st.write_partition(rows, root, ["key", "part"])
    st.write_partition(rows.where("key = 'F' AND part = 1996").withColumn("cents", 2 * F.col("cents")), root, ["key", "part"])
    keys = st.available_keys(st.read_partitions(spark, root)).agg(F.count("*").alias("n_keys"))
    parts = st.read_partitions(spark, root, "F").groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    return parts.withColumn("n_keys", keys.scalar())


@query("trial_log", f"""WITH t AS (SELECT 'e' || c_nationkey AS experiment, CAST(c_custkey AS BIGINT) AS period, c_acctbal AS sharpe, DATE '1995-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS data_end FROM customer WHERE c_custkey % 3 = 0),
  a AS (SELECT *, experiment IN (SELECT 'e' || n_nationkey FROM nation WHERE n_regionkey <> 2) AS known, experiment IN (SELECT 'e' || n_nationkey FROM nation WHERE n_regionkey = 1) AS free FROM t)
  SELECT experiment, period, {r('sharpe', 2)} AS sharpe, data_end FROM a WHERE known AND (data_end < DATE '1999-01-01' OR free)""")
def _(spark, d):
    """A log of JSON lines: nations register an experiment, a region unlocks its own, a third of the customers are trials."""
    nation, customer = ad.table(spark, d, "nation"), ad.table(spark, d, "customer")
    name = F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("experiment")

    def logged(df, kind, *cols):
        return df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *cols)).alias("value"))

    ended = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 2000).cast("int")).alias("data_end")
    trial = [F.concat(F.lit("e"), F.col("c_nationkey").cast("string")).alias("experiment"), ended,
             F.struct(F.col("c_custkey").alias("period")).alias("params"), F.struct(F.col("c_acctbal").alias("sharpe")).alias("metrics")]
    lines = logged(nation.where("n_regionkey <> 2"), "registration", name, F.lit("1999-01-01").alias("holdout_start"))
    lines = lines.unionByName(logged(nation.where("n_regionkey = 1"), "unlock", name)).unionByName(logged(customer.where("c_custkey % 3 = 0"), "trial", *trial))
    log = st.trial_log(lines, "period bigint", "sharpe double")
    good, _ = st.gate_trials(log["trials"], log["registrations"], log["unlocks"])
    return rounded_columns(good.select("experiment", "period", "sharpe", "data_end"), 2)
