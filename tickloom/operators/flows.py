"""Flow and positioning panels, captures and accounting identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The reporting categories and the long/short column pairs of the positioning file.
PARTICIPANTS = ["Client", "DII", "FII", "Pro"]
PAIRS = [("Future Index Long", "Future Index Short"), ("Future Stock Long", "Future Stock Short"),
         ("Option Index Call Long", "Option Index Call Short"), ("Option Index Put Long", "Option Index Put Short"),
         ("Option Stock Call Long", "Option Stock Call Short"), ("Option Stock Put Long", "Option Stock Put Short")]
IMBALANCE_TOL = 0.001


def flows_panel(rows: DataFrame, asset: str, exchange_route: str, subtotal_routes: list[str], net: str = "net") -> DataFrame:
    """(date, equity, equity_exchange): net per date over leaf routes, and over the exchange route alone."""
    leaf = rows.where((F.col("asset") == asset) & ~F.col("route").isin(*subtotal_routes))
    return leaf.groupBy("date").agg(F.sum(net).alias("equity"), F.sum(F.when(F.col("route") == exchange_route, F.col(net))).alias("equity_exchange"))


def positioning_panel(rows: DataFrame, participants: list[str] = PARTICIPANTS, long: str = "long", short: str = "short",
                      ratio_of: str = "FII") -> DataFrame:
    """(date, net per participant, long ratio of one): conditional sums, one shuffle by date."""

    def leg(p: str, c: str) -> Column:
        return F.sum(F.when(F.col("participant") == p, F.col(c)))

    agg = rows.groupBy("date").agg(*[(leg(p, long) - leg(p, short)).alias(f"{p.lower()}_net") for p in participants],
                                   leg(ratio_of, long).alias("_l"), leg(ratio_of, short).alias("_s"))
    return agg.withColumn("long_ratio", F.try_divide(F.col("_l"), F.col("_l") + F.col("_s"))).drop("_l", "_s")


def two_sided_row(rows: DataFrame) -> DataFrame:
    """FII and DII lines of a capture as one wide row; captures with an unknown category, mixed dates or
    a missing side are rejected. rows: (capture, category, date, buy, sell, net)."""
    cat = F.upper(F.trim("category"))
    tag = F.when(cat.startswith("FII"), "fii").when(cat.startswith("DII"), "dii")
    tagged = rows.withColumn("tag", tag)
    wide = [F.max(F.when(F.col("tag") == t, F.col(c))).alias(f"{t}_{c}") for t in ("fii", "dii") for c in ("buy", "sell", "net")]
    agg = tagged.groupBy("capture").agg(F.min("date").alias("date"), F.max("date").alias("_b"), F.count_if(F.col("tag").isNull()).alias("_u"), *wide)
    good = (F.col("date") == F.col("_b")) & (F.col("_u") == 0) & F.col("fii_net").isNotNull() & F.col("dii_net").isNotNull()
    return agg.where(good).drop("_b", "_u")


def balance_failures(rows: DataFrame, pairs: list[tuple[str, str]] = PAIRS, participants: list[str] = PARTICIPANTS,
                     tol: float = IMBALANCE_TOL) -> DataFrame:
    """(date, ok, reason): longs equal shorts and participants add up to TOTAL within ``tol`` of size."""
    four = F.col("participant").isin(*participants)
    total = F.col("participant") == "TOTAL"
    aggs, names = [], [c for p in pairs for c in p]
    for c in names:
        aggs += [F.sum(F.when(four, F.col(f"`{c}`"))).alias(f"s_{c}"), F.max(F.when(total, F.col(f"`{c}`"))).alias(f"t_{c}"),
                 F.count_if(four & F.col(f"`{c}`").isNull()).alias(f"n_{c}")]
    day = rows.groupBy("date").agg(*aggs)
    missing = sum((F.col(f"`n_{c}`") for c in names), F.lit(0)) > 0
    unbalanced, unsummed = F.lit(False), F.lit(False)
    for a, b in pairs:
        size = F.greatest(F.col(f"`s_{a}`"), F.lit(1)) * tol
        unbalanced = unbalanced | (F.abs(F.col(f"`s_{a}`") - F.col(f"`s_{b}`")) > size)
        for c in (a, b):
            unsummed = unsummed | F.col(f"`t_{c}`").isNull() | (F.abs(F.col(f"`s_{c}`") - F.col(f"`t_{c}`")) > size)
    reason = F.when(missing, "missing values").when(unbalanced, "long and short differ").when(unsummed, "participants do not sum to TOTAL")
    return day.select("date", reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"))


def first_capture(existing: DataFrame, incoming: DataFrame, order: str = "captured_at") -> DataFrame:
    """Rows to append: dates not stored yet, the earliest capture of each."""
    rest = [c for c in incoming.columns if c != "date"]
    first = incoming.groupBy("date").agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return first.select("date", *[F.col(f"_r.{c}").alias(c) for c in rest]).join(existing.select("date").distinct(), "date", "left_anti")
