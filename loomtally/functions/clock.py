"""Epoch milliseconds to local days, hours and weekdays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local(ms: Column, tz: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(ms), tz)


def local_day(ms: Column, tz: str) -> Column:
    return F.date_format(local(ms, tz), "yyyy-MM-dd")


def local_month(ms: Column, tz: str) -> Column:
    return F.date_format(local(ms, tz), "yyyy-MM")


def local_hour(ms: Column, tz: str) -> Column:
    return F.hour(local(ms, tz))


def local_weekday(ms: Column, tz: str) -> Column:
    """Monday is 0."""
    return F.weekday(local(ms, tz))


def parse_ms(text: Column) -> Column:
    """ISO text of 10 to 40 characters to milliseconds; anything else is null."""
    ok = F.length(text).between(10, 40)
    return F.when(ok, F.unix_millis(F.try_to_timestamp(text)))
