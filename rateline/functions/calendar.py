"""Periods: a ``period_start`` date for arithmetic and a label for output (TS1-TS3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = {"monthly": "month", "weekly": "week", "daily": "day"}


def period_start(date: Column, granularity: str) -> Column:
    return F.to_date(F.date_trunc(UNIT[granularity], date))


def period_label(start: Column, granularity: str) -> Column:
    """2024-01, 2024-01-01/2024-01-07 or 2024-01-01."""
    if granularity == "monthly":
        return F.date_format(start, "yyyy-MM")
    day = F.date_format(start, "yyyy-MM-dd")
    return day if granularity == "daily" else F.concat(day, F.lit("/"), F.date_format(F.date_add(start, 6), "yyyy-MM-dd"))


def days_in_period(start: Column, granularity: str) -> Column:
    return F.day(F.last_day(start)) if granularity == "monthly" else F.lit({"weekly": 7, "daily": 1}[granularity])


def period_add(start: Column, n: Column | int, granularity: str) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.add_months(start, n) if granularity == "monthly" else F.date_add(start, (n * {"weekly": 7, "daily": 1}[granularity]).cast("int"))


def period_range(first: Column, last: Column, granularity: str) -> Column:
    """All period starts from ``first`` to ``last``, both included."""
    return F.sequence(first, last, F.expr(f"interval 1 {UNIT[granularity]}"))


def period_index(start: Column, granularity: str) -> Column:
    """A number that grows by one each period."""
    if granularity == "monthly":
        return F.year(start) * 12 + F.month(start)
    return F.floor(F.datediff(start, F.lit("1970-01-05").cast("date")) / {"weekly": 7, "daily": 1}[granularity]).cast("int")


def parsed_period(text: Column, granularity: str) -> Column:
    """The period start that a written period means (2024-03, a date, a timestamp), or null."""
    parsed = F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy-MM", "yyyy/MM/dd")])
    return period_start(parsed, granularity)
