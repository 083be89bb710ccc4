"""Market-shaped views over the star-schema tables.

Money is summed in whole cents (BIGINT), which is exact in any order, so partial aggregation before
the shuffle cannot change a digit. All aggregates are map-side combinable: a hot brand or day is
reduced to one row per (key, date) in each input partition before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import materialized


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: Column | str) -> Column:
    c = F.col(amount) if isinstance(amount, str) else amount
    return F.rint(c * 100).cast("long")


def _priced(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    # the planner broadcasts `part` only when its files are under the size threshold; beyond it the
    # sort-merge join is split by AQE where one part is hot
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"),
        F.to_date("l_shipdate").alias("date"),
        cents("l_extendedprice").alias("c"),
        F.col("l_quantity").cast("long").alias("q"),
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col(key).alias("cid"))
    return items.join(parts, "p_partkey")


def bars(spark: SparkSession, sf_dir: str, key: str = "p_brand") -> DataFrame:
    """Daily bars per brand (or another part column): (cid, date, close, turnover, volume)."""
    grouped = _priced(spark, sf_dir, key).groupBy("cid", "date").agg(F.sum("c").alias("c"), F.sum("q").alias("q"))
    return grouped.select(
        "cid",
        "date",
        (F.col("c") / F.lit(100.0) / F.col("q")).alias("close"),
        (F.col("c") / F.lit(100.0)).alias("turnover"),
        F.col("q").alias("volume"),
    )


def bars_table(spark: SparkSession, sf_dir: str, key: str = "p_brand") -> DataFrame:
    """The curated panel: daily bars written once, for queries that read them in several branches."""
    return materialized(bars(spark, sf_dir, key), "bars")


def type_bars_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_table(spark, sf_dir, "p_type")


def type_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by part type: a handful of long series."""
    return bars(spark, sf_dir, "p_type")


def market_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One market-wide price per day: (date, close)."""
    items = table(spark, sf_dir, "lineitem")
    g = items.groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.sum(cents("l_extendedprice")).alias("c"), F.sum(F.col("l_quantity").cast("long")).alias("q")
    )
    return g.select("date", (F.col("c") / F.lit(100.0) / F.col("q")).alias("close"))


def flow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed order values: (date, route, asset, net_cents). Status F sells, others buy."""
    sign = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    return table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("route"),
        F.col("o_orderstatus").alias("asset"),
        (cents("o_totalprice") * sign).alias("net_cents"),
    )


def daily_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net flow per reporting date: (date, flow)."""
    g = flow_rows(spark, sf_dir).groupBy("date").agg(F.sum("net_cents").alias("c"))
    return g.select("date", (F.col("c") / F.lit(100.0)).alias("flow"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades: (book, symbol, date, side, qty, price, cost). Return flag R sells, others buy."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    items = table(spark, sf_dir, "lineitem").select(
        "l_partkey",
        F.col("l_suppkey").alias("book"),
        F.to_date("l_shipdate").alias("date"),
        F.when(F.col("l_returnflag") == "R", F.lit("SELL")).otherwise(F.lit("BUY")).alias("side"),
        F.col("l_quantity").cast("long").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_discount").alias("cost"),
    )
    return items.join(parts, "l_partkey").drop("l_partkey")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text action subjects, one per part: (symbol, ex_date, size, subject)."""
    n = F.col("p_size")
    low = n % 5 + 1
    text = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("Bonus  "), low, F.lit(":"), n % 3 + 1))
        .when(
            F.col("p_type") == "LARGE",
            F.concat(F.lit("Face Value Split (Sub-Division) - From Rs "), n % 9 + 2, F.lit("/- To Rs 1/- Per Share")),
        )
        .when(F.col("p_type") == "MEDIUM", F.concat(F.lit("Interim Dividend - Rs "), n, F.lit(".5 Per Share")))
        .when(
            F.col("p_type") == "PROMO",
            F.concat(F.lit("bonus "), low, F.lit(":1/Dividend- Rs "), n, F.lit(" Per Share/Special Dividend Re 1")),
        )
        .when(F.col("p_type") == "SMALL", F.concat(F.lit("Scheme of  Arrangement / Rights "), low, F.lit(":3")))
        .otherwise(F.concat(F.lit("Consolidation From Rs "), low, F.lit(" To Rs "), low + n % 4 + 1))
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("symbol"),
        F.date_add(F.lit("1995-01-02").cast("date"), (F.col("p_partkey") * 17 % 2499).cast("int")).alias("ex_date"),
        n.alias("size"),
        text.alias("subject"),
    )


def rename_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol changes, one per part: (old, new, date, seq)."""
    return table(spark, sf_dir, "part").select(
        F.concat_ws("/", F.col("p_brand"), F.col("p_size").cast("string")).alias("old"),
        F.concat_ws("/", F.col("p_brand"), ((F.col("p_size") * 7) % 50 + 1).cast("string")).alias("new"),
        F.date_add(F.lit("1995-01-02").cast("date"), (F.col("p_partkey") * 37 % 2499).cast("int")).alias("date"),
        F.col("p_partkey").alias("seq"),
    )


def member_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly membership lists: every customer that ordered in a month, per market segment."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.trunc("o_orderdate", "month").alias("snapshot")
    ).distinct()
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("index"), F.col("c_name").alias("symbol"), "c_nationkey"
    )
    return orders.join(customers, "c_custkey").select(
        "index", "snapshot", "symbol", F.col("c_nationkey").cast("string").alias("isin")
    )
