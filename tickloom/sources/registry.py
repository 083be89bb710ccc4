"""The instrument registry: validation and selectors over a small dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The allowed entries of the enumerated columns.
SESSIONS = ["ist_close", "us_session", "global_24h", "noon_et"]
SOURCES = ["yfinance", "fred", "nse", "nsdl", "derived", "unresolved"]
FETCHABLE = ["yfinance", "fred"]
ROLES = ["subject", "context"]
STATUSES = ["ok", "verify", "unresolved"]
# Time zone and local time at which a session's bar is final.
SETTLES = {"ist_close": ("Asia/Kolkata", "16:00"), "us_session": ("America/New_York", "17:30"), "global_24h": ("America/New_York", "17:30")}


def problems(registry: DataFrame) -> DataFrame:
    """(key, problem): bad enumeration values, missing tickers, derived series without known inputs."""
    empty = F.coalesce(F.size("derived_from"), F.lit(0)) <= 0
    checks = {
        "bad session": ~F.col("session").isin(*SESSIONS), "bad source": ~F.col("source").isin(*SOURCES),
        "bad role": ~F.col("role").isin(*ROLES), "bad status": ~F.col("status").isin(*STATUSES),
        "no ticker": F.col("source").isin(*FETCHABLE) & (F.coalesce("ticker", F.lit("")) == ""),
        "no inputs": (F.col("source") == "derived") & empty,
    }
    found = registry.select("key", F.explode(F.filter(F.array(*[F.when(c, n) for n, c in checks.items()]), lambda x: x.isNotNull())).alias("problem"))
    inputs = registry.where(F.col("source") == "derived").select("key", F.explode("derived_from").alias("_in"))
    dangling = inputs.join(registry.select(F.col("key").alias("_in")), "_in", "left_anti").select("key", F.lit("unknown input").alias("problem"))
    return found.unionByName(dangling.distinct())


def is_fetchable() -> Column:
    return F.col("source").isin(*FETCHABLE) & (F.coalesce("ticker", F.lit("")) != "")


def select(registry: DataFrame, klass: list[str] | None = None, source: list[str] | None = None, fetchable: bool | None = None,
           derived: bool | None = None, unresolved: bool | None = None, answering: str | None = None,
           contaminates_same_day: bool | None = None) -> DataFrame:
    """Rows that meet every given criterion."""
    tests = {
        "klass": F.col("klass").isin(*klass) if klass else None, "source": F.col("source").isin(*source) if source else None,
        "fetchable": None if fetchable is None else is_fetchable() == fetchable,
        "derived": None if derived is None else (F.col("source") == "derived") == derived,
        "unresolved": None if unresolved is None else (F.col("status") == "unresolved") == unresolved,
        "answering": F.array_contains("answers", answering) if answering else None,
        "contaminates": None if contaminates_same_day is None else (F.col("session") != "ist_close") == contaminates_same_day,
    }
    out = registry
    for t in tests.values():
        out = out if t is None else out.where(t)
    return out


def drop_unsettled(bars: DataFrame, now: Column, session: str = "session") -> DataFrame:
    """Bars whose session was final at ``now`` (a UTC timestamp); sessions without a cutoff pass.

    A bar can only be unsettled within days of ``now``, so the test trims just the end of a series.
    """
    final = F.lit(None).cast("timestamp")
    for name, (zone, at) in SETTLES.items():
        local = F.to_timestamp(F.concat_ws(" ", F.date_format("date", "yyyy-MM-dd"), F.lit(at + ":00")))
        final = F.when(F.col(session) == name, F.to_utc_timestamp(local, zone)).otherwise(final)
    return bars.where(final.isNull() | (final <= now))
