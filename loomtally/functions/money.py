"""Exact money: integer nanodollars."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WEB_SEARCH_NANO = 10_000_000


def big(c: Column) -> Column:
    """Room for sums of any number of nanodollar values."""
    return c.cast("decimal(20,0)")


def sum_big(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(big(c)), F.lit(0)).cast("decimal(38,0)")


def share(num: Column, den: Column) -> Column:
    """num / den floored to twelve decimals, from 0 to 1; 0 where either is not positive."""
    exact = F.floor(num.cast("decimal(26,0)") * F.lit(Decimal(10**12)) / den.cast("decimal(26,0)"))
    ok = (num > 0) & (den > 0)
    return F.when(ok, F.least(exact.cast("double") / F.lit(1e12), F.lit(1.0))).otherwise(F.lit(0.0))


def share_of(num: int, den: int) -> float:
    if num <= 0 or den <= 0:
        return 0.0
    return min(1.0, (num * 10**12 // den) / 1e12)


def at_least(num: int, den: int, p: int, q: int) -> bool:
    return num * q >= den * p


def usd6(nano: int) -> str:
    """Dollars with six decimals, cut towards zero."""
    sign, n = ("-", -nano) if nano < 0 else ("", nano)
    return f"{sign}{n // 10**9}.{n % 10**9 // 1000:06d}"


def cents(nano: int) -> int:
    """Nearest cent; halves away from zero."""
    return (abs(nano) + 5_000_000) // 10_000_000 * (-1 if nano < 0 else 1)


def usd(nano: int) -> str:
    c = cents(nano)
    return f"{'-' if c < 0 else ''}${abs(c) // 100:,}.{abs(c) % 100:02d}"


def usd_floor2(nano: int) -> str:
    """Two significant figures, never more than there is; below a hundred dollars whole dollars."""
    dollars = nano // 10**9
    if dollars < 100:
        return f"${dollars}"
    unit = 10 ** (len(str(dollars)) - 2)
    return f"${dollars // unit * unit:,}"
