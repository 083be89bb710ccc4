"""Small builders shared by the test modules."""

import datetime as dt


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def days_from(start: str, n: int) -> list[dt.date]:
    return [day(start) + dt.timedelta(i) for i in range(n)]


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).collect()]
