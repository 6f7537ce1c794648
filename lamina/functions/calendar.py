"""Timestamps, shifts and accounting dates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.constants import INTERVAL_MINUTES

_DAY_FIRST = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{1,2})\s*$"


def try_parse_day_first(raw: Column) -> Column:
    """``dd/MM/yyyy HH:mm`` as a zone-free timestamp; anything else is NULL.

    The text is put in ISO order and cast, so no session time zone is involved.
    """
    part = [F.lpad(F.regexp_extract(raw, _DAY_FIRST, g), 2, "0") for g in (1, 2, 4, 5)]
    year = F.regexp_extract(raw, _DAY_FIRST, 3)
    day, month, hour, minute = part
    iso = F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), hour, F.lit(":"), minute)
    return F.when(raw.rlike(_DAY_FIRST), F.concat(iso, F.lit(":00")).try_cast("timestamp_ntz"))


def parse_day_first(raw: Column) -> Column:
    """As ``try_parse_day_first``, but a non-null text that does not parse fails the job."""
    message = F.concat(F.lit("not a day-first timestamp: "), raw)
    bad = F.raise_error(message).cast("timestamp_ntz")
    return F.when(raw.isNotNull(), F.coalesce(try_parse_day_first(raw), bad))


def interval_start(ts: Column) -> Column:
    """Start of the 15-minute interval that ends at ``ts``."""
    return ts - F.expr(f"INTERVAL {INTERVAL_MINUTES} MINUTES")


def shift_of(ts: Column) -> Column:
    """Shift code M (6-14), A (14-22) or N (22-6), from the stamp's own hour."""
    hour = F.hour(ts)
    return (
        F.when((hour >= 6) & (hour < 14), "M")
        .when((hour >= 14) & (hour < 22), "A")
        .when(hour.isNotNull(), "N")
    )


def shift_date(ts: Column) -> Column:
    """Accounting date: the hours before 06:00 belong to the day before."""
    day = F.to_date(ts)
    return F.when(F.hour(ts) < 6, F.date_sub(day, 1)).otherwise(day)


def month_start(ts: Column) -> Column:
    """First instant of the month, still zone-free."""
    return F.date_trunc("month", ts).cast("timestamp_ntz")


def month_bounds(year: int, month: int) -> tuple[datetime, datetime]:
    """First instant of a month and of the next one."""
    return datetime(year, month, 1), datetime(year + month // 12, month % 12 + 1, 1)


def in_month(ts: Column, year: int, month: int) -> Column:
    """Half-open month test that reaches the scan as two pushed range filters."""
    first, after = (F.lit(bound).cast("timestamp_ntz") for bound in month_bounds(year, month))
    return (ts >= first) & (ts < after)
