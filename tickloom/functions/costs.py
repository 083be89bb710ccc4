"""Transaction costs, impact and tax rates as column expressions over effective-dated schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (effective from, sell-side rate, buy-side rate) of the transaction tax per segment.
TAX_SCHEDULE = {
    "delivery": [("2004-10-01", 0.001, 0.001)],
    "intraday": [("2004-10-01", 0.00025, 0.0)],
    "futures": [("2008-06-01", 0.0001, 0.0), ("2023-04-01", 0.000125, 0.0), ("2024-10-01", 0.0002, 0.0),
                ("2026-04-01", 0.0005, 0.0)],
    "options": [("2016-06-01", 0.0005, 0.0), ("2023-04-01", 0.000625, 0.0), ("2024-10-01", 0.001, 0.0),
                ("2026-04-01", 0.0015, 0.0)],
}
# Exchange charge, buy-side stamp duty, regulator fee and service tax on fees.
EXCHANGE = {"delivery": 0.0000307, "intraday": 0.0000307, "futures": 0.0000183, "options": 0.0003553}
STAMP_BUY = {"delivery": 0.00015, "intraday": 0.00003, "futures": 0.00002, "options": 0.00003}
REGULATOR = 10 / 1e7
SERVICE_TAX = 0.18
# Fixed values: (from financial year, short-term rate, long-term rate, long-term exemption).
GAINS_TAX = [(0, 0.15, 0.0, 0.0), (2019, 0.15, 0.10, 100_000.0), (2025, 0.20, 0.125, 125_000.0)]


def in_force(schedule: list[tuple[str, float, float]], day: Column) -> Column:
    """Struct (sell, buy) in force on a day; the first row also covers everything before it."""
    first, *later = schedule
    out = F.struct(F.lit(first[1]).alias("sell"), F.lit(first[2]).alias("buy"))
    for start, sell, buy in later:
        row = F.struct(F.lit(sell).alias("sell"), F.lit(buy).alias("buy"))
        out = F.when(day >= F.lit(start).cast("date"), row).otherwise(out)
    return out


def side_costs(segment: str, day: Column, brokerage: float = 0.0, schedule: dict | None = None) -> dict[str, Column]:
    """Statutory and broker cost of one side as a fraction of traded value, and the round trip."""
    tax = in_force((schedule or TAX_SCHEDULE)[segment], day)
    fees = (EXCHANGE[segment] + REGULATOR + brokerage) * (1 + SERVICE_TAX)
    buy = tax["buy"] + F.lit(STAMP_BUY[segment]) + F.lit(fees)
    sell = tax["sell"] + F.lit(fees)
    return {"buy": buy, "sell": sell, "round_trip": buy + sell}


def sqrt_impact(traded: Column, adv: Column, vol: Column, k: float = 0.7) -> Column:
    """k x volatility x sqrt(traded value / average daily value); null where the latter is unknown."""
    return F.lit(k) * vol * F.sqrt(F.try_divide(F.abs(traded), adv))


def gains_rates(fy: Column) -> tuple[Column, Column, Column]:
    """(short-term, long-term, exemption) for a financial year."""
    out = []
    for i in range(1, 4):
        value = F.lit(float(GAINS_TAX[0][i]))
        for row in GAINS_TAX[1:]:
            value = F.when(fy >= row[0], F.lit(float(row[i]))).otherwise(value)
        out.append(value)
    return tuple(out)
