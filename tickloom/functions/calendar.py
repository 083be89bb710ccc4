"""Calendars: sessions, weeks, months, financial years.

A calendar holds one row per trading day, so its size is bounded by the number of days in the
archive, not by the number of rows in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import materialized


def number_sessions(dates: DataFrame, date: str = "date") -> DataFrame:
    """Distinct dates with a 0-based ``session_no``.

    The distinct runs in parallel with map-side combine; only the calendar itself (one entry per day
    of history) is put in order.
    """
    days = dates.select(F.col(date).alias("date")).where(F.col("date").isNotNull()).distinct()
    ordered = days.agg(F.array_sort(F.collect_list("date")).alias("_d"))
    return ordered.select(F.posexplode("_d").alias("session_no", "date")).select(
        "date", F.col("session_no").cast("long").alias("session_no")
    )


def session_table(dates: DataFrame, date: str = "date") -> DataFrame:
    """The numbered calendar as a written table.

    Its size is then known to the planner, which broadcasts it while it is under the threshold: rows
    joined to their session number are not shuffled for it.
    """
    return materialized(number_sessions(dates, date), "sessions")


def week_ending_friday(day: Column | str) -> Column:
    """The Friday on or after a date; Saturday and Sunday belong to the next Friday."""
    return F.next_day(F.date_sub(day, 1), "FRI")


def month_start(day: Column | str) -> Column:
    return F.trunc(day, "month")


def financial_year(day: Column | str) -> Column:
    """Label of the April-March year: the calendar year in which it ends."""
    return F.year(F.add_months(day, 9))


def is_weekday(day: Column) -> Column:
    return F.dayofweek(day).between(2, 6)


def business_days(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Weekdays between two date columns of each row, as ``date`` rows."""
    return bounds.select(F.explode(F.sequence(F.col(start), F.col(end))).alias("date")).where(is_weekday(F.col("date")))


def month_end_sessions(dates: DataFrame, date: str = "date") -> DataFrame:
    """Last trading day of each calendar month: (month, session)."""
    return dates.groupBy(F.trunc(date, "month").alias("month")).agg(F.max(date).alias("session"))
