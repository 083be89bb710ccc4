"""Catalogue of named queries: a Spark callable and, where SQL can say it, a reference statement."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def keep_steps(sql: str) -> str:
    """Ask the reference engine to evaluate every named step once."""
    return re.sub(r"(\w+) AS \((\s*)SELECT", r"\1 AS MATERIALIZED (\2SELECT", sql)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = keep_steps(sql)
        return fn

    return add


def rnd(expr: Column | str, digits: int = 6) -> Column:
    """Round for output; turns -0.0 into 0.0."""
    c = F.col(expr) if isinstance(expr, str) else expr
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded_columns(df: DataFrame, digits: int = 6, only: tuple[str, ...] | None = None) -> DataFrame:
    """Round every double column (or the named ones)."""
    names = only or tuple(n for n, t in df.dtypes if t == "double")
    return df.withColumns({n: rnd(n, digits) for n in names})


def r(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def bars_cte(name: str = "bars", key: str = "p_brand") -> str:
    return f"""{name} AS (
  SELECT cid, date, CAST(c AS DOUBLE) / CAST(100 AS DOUBLE) / CAST(q AS DOUBLE) AS close,
         CAST(c AS DOUBLE) / CAST(100 AS DOUBLE) AS turnover, CAST(q AS BIGINT) AS volume
  FROM (SELECT {key} AS cid, CAST(l_shipdate AS DATE) AS date,
               sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS c, sum(CAST(l_quantity AS BIGINT)) AS q
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))"""


def sessions_cte(source: str = "bars", name: str = "sess") -> str:
    return f"""{name} AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS session_no
  FROM (SELECT DISTINCT date FROM {source}))"""


BARS = bars_cte()
BARS6 = bars_cte("bars", "p_type")
SESS = sessions_cte()
# panel-calendar log and simple returns over `bars`
LOGRET = """rets AS (SELECT cid, date, ln(close / pc) AS ret FROM (
  SELECT cid, b.date, close, s.session_no, lag(close) OVER w AS pc, lag(s.session_no) OVER w AS ps
  FROM bars b JOIN sess s USING (date) WINDOW w AS (PARTITION BY cid ORDER BY b.date)) WHERE ps = session_no - 1)"""
SIMPLE = LOGRET.replace("ln(close / pc)", "close / pc - 1")
MARKET = """mkt AS (SELECT CAST(l_shipdate AS DATE) AS date,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE)
    / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS close FROM lineitem GROUP BY 1)"""
FLOW = """flow AS (SELECT CAST(o_orderdate AS DATE) AS date,
  CAST(sum((CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) * CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE)
    / CAST(100 AS DOUBLE) AS flow FROM orders GROUP BY 1)"""
LEDGER = """ledger AS (SELECT l_suppkey AS book, p_brand AS symbol, CAST(l_shipdate AS DATE) AS date,
  CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, CAST(l_quantity AS BIGINT) AS qty,
  l_extendedprice / l_quantity AS price, l_discount AS cost FROM lineitem JOIN part ON l_partkey = p_partkey)"""
