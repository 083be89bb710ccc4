"""As-of, interval, band and nearest joins, all built from equi-joins and bounded windows.

* As-of joins resolve *distinct* probe points, split by (key, time bucket). A hot key is therefore
  spread over its buckets, and only one carry row per (key, bucket) travels between them.
* Band and nearest joins expand the event side by the fixed width of the band and then equi-join.
No side is ever broadcast by hint; the planner and AQE broadcast only what they have measured.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import calendar as cal
from tickloom.session import checkpointed, materialized


def asof(left: DataFrame, right: DataFrame, on: list[str], left_on: str, right_on: str, values: list[str],
         direction: str = "backward", strict: bool = False, how: str = "left",
         bucket: Callable[[Column], Column] = F.year) -> DataFrame:
    """Attach to each left row the right values at the nearest time in one direction.

    ``strict`` excludes equal times. ``right`` must be unique on (on, right_on).
    """
    back = direction == "backward"
    packed = F.struct(F.col(right_on).alias("_at"), *[F.col(v) for v in values])
    facts = right.select(*on, F.col(right_on).alias("_t"), packed.alias("_f"), F.lit(True).alias("_is_fact"))
    nothing = F.lit(None).cast(facts.schema["_f"].dataType)
    probes = left.select(*on, F.col(left_on).alias("_t")).distinct().select(
        "*", nothing.alias("_f"), F.lit(False).alias("_is_fact")
    )
    both = facts.unionByName(probes).withColumn("_b", bucket(F.col("_t")))

    time = F.col("_t").asc() if back else F.col("_t").desc()
    # at equal times a fact must be seen first, unless the comparison is strict
    tie = F.col("_is_fact").asc() if strict else F.col("_is_fact").desc()
    inside = W.partitionBy(*on, "_b").orderBy(time, tie).rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("_hit", F.last("_f", ignorenulls=True).over(inside)).where(~F.col("_is_fact"))

    fact_time = F.when(F.col("_is_fact"), F.col("_t"))
    edge = F.max_by("_f", fact_time) if back else F.min_by("_f", fact_time)
    per_bucket = both.groupBy(*on, "_b").agg(edge.alias("_edge"))
    order = F.col("_b").asc() if back else F.col("_b").desc()
    across = W.partitionBy(*on).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    carry = per_bucket.select(*on, "_b", F.last("_edge", ignorenulls=True).over(across).alias("_carry"))

    hits = seen.join(carry, [*on, "_b"]).select(*on, "_t", F.coalesce("_hit", "_carry").alias("_m"))
    out = left.withColumn("_t", F.col(left_on)).join(hits, [*on, "_t"], "left")
    if how == "inner":
        out = out.where(F.col("_m").isNotNull())
    cols = [F.col("_m._at").alias("matched_on"), *[F.col(f"_m.{v}").alias(v) for v in values]]
    return out.select(*left.columns, *cols)


def session_map(sessions: DataFrame, side: str) -> DataFrame:
    """(day, session, session_no) for every calendar day, so any date finds its session by equi-join.

    ``on_or_after``: each session covers the days since the previous one, itself included.
    ``before``: each session covers the days after it up to the next session, that one included.
    """
    other = sessions.select((F.col("session_no") + (1 if side == "on_or_after" else -1)).alias("session_no"),
                            F.col("date").alias("_o"))
    joined = sessions.join(other, "session_no", "left")
    d = F.col("date")
    if side == "on_or_after":
        span = F.sequence(F.coalesce(F.date_add("_o", 1), d), d)
    else:
        span = F.sequence(F.date_add(d, 1), F.coalesce("_o", F.date_add(d, 1)))
    return joined.select(F.explode(span).alias("_day"), d.alias("session"), "session_no")


def to_session(rows: DataFrame, date: str, sessions: DataFrame, side: str = "on_or_after") -> DataFrame:
    """Place dated rows on trading sessions; rows with no such session are dropped.

    The map holds one row per calendar day, so the row side is neither sorted nor regrouped.
    """
    if side == "on_or_after":
        edge = sessions.agg(F.min("date")).scalar()
        day = F.greatest(F.col(date), edge)
    else:
        edge = sessions.agg(F.date_add(F.max("date"), 1)).scalar()
        day = F.least(F.col(date), edge)
    return rows.withColumn("_day", day).join(materialized(session_map(sessions, side), "days"), "_day").drop("_day")


def redate_flow(flow: DataFrame, trading_days: DataFrame, value: str = "flow") -> DataFrame:
    """Move each flow to the last trading day strictly before its reporting date; collisions add up."""
    daily = flow.groupBy("date").agg(F.sum(value).alias(value))
    moved = to_session(daily, "date", cal.session_table(trading_days), "before")
    return moved.groupBy(F.col("session").alias("trade_date")).agg(F.sum(value).alias(value))


def close_renames(renames: DataFrame) -> DataFrame:
    """Follow every rename to the last name of its chain: (old, date, seq, cid).

    Links are doubled each round, so a chain of length n needs log2(n) rounds.
    """
    r = renames.select("old", "new", "date", "seq", F.struct("date", "seq").alias("at"))
    nxt = asof(r, r.select(F.col("old").alias("new"), "at", F.col("new").alias("_n")), ["new"], "at", "at", [],
               direction="forward", strict=True, bucket=lambda c: F.year(c["date"]))
    links = checkpointed(nxt.select("old", "date", "seq", "at", F.col("new").alias("cid"), F.col("matched_on").alias("nxt")))
    while not links.where(F.col("nxt").isNotNull()).isEmpty():
        target = links.select(F.col("at").alias("_at"), F.col("cid").alias("_cid"), F.col("nxt").alias("_nxt"))
        joined = links.join(target, F.col("nxt") == F.col("_at"), "left")
        links = checkpointed(joined.select(
            "old", "date", "seq", "at", F.coalesce("_cid", "cid").alias("cid"), F.col("_nxt").alias("nxt")
        ))
    return links.select("old", "date", "seq", "cid")


def canonical_ids(rows: DataFrame, renames: DataFrame, symbol: str = "symbol", date: str = "date") -> DataFrame:
    """Add ``cid``: the name a symbol's rows trade under today; reused symbols keep themselves.

    A row takes the first rename after its day, found by the as-of join, so a symbol's renames are never gathered.
    """
    closed = close_renames(renames)
    # several renames of one symbol on one day: the first one applies
    first = closed.groupBy("old", "date").agg(F.min_by("cid", "seq").alias("_cid"))
    first = first.select(F.col("old").alias(symbol), F.col("date").alias(date), "_cid")
    met = asof(rows, first, [symbol], date, date, ["_cid"], direction="forward", strict=True)
    return met.withColumn("cid", F.coalesce("_cid", symbol)).drop("_cid", "matched_on")


def band_on_sessions(events: DataFrame, facts: DataFrame, on: list[str], width: int, event_pos: str, fact_pos: str,
                     how: str = "left") -> DataFrame:
    """Pair events with facts whose session number is within +-width: expand the events, then equi-join."""
    spread = events.withColumn("_p", F.explode(F.sequence(F.col(event_pos) - width, F.col(event_pos) + width)))
    return spread.join(facts.withColumn("_p", F.col(fact_pos)), [*on, "_p"], how).drop("_p")


def nearest_in_days(events: DataFrame, facts: DataFrame, on: list[str], event_date: str, fact_date: str,
                    value: str, days: int, event_keys: list[str]) -> DataFrame:
    """Closest fact within +-days of each event; ties go to the earlier fact."""
    near = events.select(*on, *[k for k in event_keys if k not in on], F.col(event_date).alias("_e")).distinct()
    spread = near.withColumn("_d", F.explode(F.sequence(F.date_sub("_e", days), F.date_add("_e", days))))
    hit = spread.join(facts.select(*on, F.col(fact_date).alias("_d"), F.col(value).alias("_v")), [*on, "_d"])
    gap = F.abs(F.datediff("_d", "_e"))
    keys = list(dict.fromkeys([*on, *event_keys]))
    best = hit.groupBy(*keys).agg(F.min_by("_v", F.struct(gap, F.col("_d"))).alias(value))
    return events.join(best, keys, "left")


def missing_between(captured: DataFrame, trading_days: DataFrame) -> DataFrame:
    """Trading days between the first and the last capture on which nothing was captured."""
    got = captured.select("date").distinct()
    lo, hi = got.agg(F.min("date")).scalar(), got.agg(F.max("date")).scalar()
    days = trading_days.select("date").distinct().where((F.col("date") >= lo) & (F.col("date") <= hi))
    return days.join(got, "date", "left_anti")
