"""Compact exports: delta-encoded series and JSON tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import rounded


def _field(name: str):
    return lambda x: x[name]


def delta_series(series: DataFrame, columns: list[str], key: str, digits: int = 4) -> DataFrame:
    """(key, d0, payload): first date, day gaps and rounded values per key as JSON; missing values are null.

    One key is one exported chart; its list is as long as its calendar, whatever produced the series.
    """
    row = F.struct("date", *[rounded(c, digits).alias(c) for c in columns])
    packed = series.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("r"))
    gaps = F.transform(F.sequence(F.lit(1), F.size("r") - 1), lambda i: F.datediff(F.col("r")[i]["date"], F.col("r")[i - 1]["date"]))
    dd = F.when(F.size("r") > 1, gaps).otherwise(F.array().cast("array<int>"))
    values = F.struct(*[F.transform("r", _field(c)).alias(c) for c in columns])
    body = F.to_json(F.struct(F.date_format(F.col("r")[0]["date"], "yyyy-MM-dd").alias("d0"), dd.alias("dd"), values.alias("c")), {"ignoreNullFields": "false"})
    return packed.select(key, F.col("r")[0]["date"].alias("d0"), F.size("r").cast("long").alias("n"), body.alias("payload"))


def decode_series(encoded: DataFrame, columns: list[str], key: str) -> DataFrame:
    """The inverse: (key, date, columns)."""
    inner = ", ".join(f"`{c}`: ARRAY<DOUBLE>" for c in columns)
    parsed = encoded.select(key, F.from_json("payload", f"d0 DATE, dd ARRAY<INT>, c STRUCT<{inner}>").alias("p"))
    steps = F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("p.dd")).alias("gap"), *[F.col(f"p.c.{c}").alias(c) for c in columns])
    flat = parsed.select(key, F.col("p.d0").alias("d0"), F.posexplode(steps).alias("i", "r"))
    off = F.sum("r.gap").over(Window.partitionBy(key).orderBy("i")).cast("int")
    return flat.select(key, F.date_add("d0", off).alias("date"), *[F.col(f"r.{c}").alias(c) for c in columns])


def table_json(rows: DataFrame, digits: int = 4) -> DataFrame:
    """One JSON array per row: numbers rounded, NaN and infinities null, dates as text."""
    cells = []
    for name, kind in rows.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.to_json(F.struct(rounded(c, digits).alias("v")), {"ignoreNullFields": "false"})
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            c = F.to_json(F.struct(F.date_format(c, "yyyy-MM-dd").alias("v")), {"ignoreNullFields": "false"})
        else:
            c = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        cells.append(F.regexp_extract(c, r"^\{\"v\":(.*)\}$", 1))
    return rows.select(F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")).alias("row"))


def last_dates(tables: dict[str, DataFrame], date: str = "date") -> DataFrame:
    """(source, last_date) over several tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.max(date).cast("date").alias("last_date")).select(F.lit(name).alias("source"), "last_date")
        out = one if out is None else out.unionByName(one)
    return out
