"""Strict reads of VARIANT fields: a value of another type is not converted but missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE = (1 << 53) - 1


def get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}" if path else "$", kind)


def kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(get(v, path))


def is_object(v: Column, path: str) -> Column:
    return F.coalesce(kind(v, path).startswith("OBJECT"), F.lit(False))


def has(v: Column, path: str) -> Column:
    """Whether the key is there, be its value null."""
    return get(v, path).isNotNull()


def text(v: Column, path: str, most: int) -> Column:
    """A string that is neither empty nor longer than ``most`` UTF-16 units."""
    s = get(v, path, "string")
    size = F.octet_length(F.encode(s, "UTF-16BE"))
    return F.when((kind(v, path) == "STRING") & size.between(2, 2 * most), s)


def any_text(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "STRING", get(v, path, "string"))


def token(v: Column, path: str) -> Column:
    s = any_text(v, path)
    return F.when(s.rlike(r"^[A-Za-z0-9_.:\-]{1,64}$"), s)


def number(v: Column, path: str) -> Column:
    return F.when(kind(v, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), get(v, path, "double"))


def count_or_null(v: Column, path: str) -> Column:
    """A whole number from 0 to 2**53 - 1, however it is written."""
    x = number(v, path)
    return F.when((x >= 0) & (x <= SAFE) & (x == F.floor(x)), x.cast("long"))


def count(v: Column, path: str) -> Column:
    return F.coalesce(count_or_null(v, path), F.lit(0).cast("long"))


def is_true(v: Column, path: str) -> Column:
    return F.coalesce((kind(v, path) == "BOOLEAN") & get(v, path, "boolean"), F.lit(False))


def truthy(v: Column, path: str) -> Column:
    """What a loosely typed test takes for true: neither null, false, zero nor empty."""
    k = kind(v, path)
    plain = (
        F.when(k == "BOOLEAN", get(v, path, "boolean"))
        .when(k == "STRING", get(v, path, "string") != "")
        .when(k == "VOID", F.lit(False))
        .when(k.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), get(v, path, "double") != 0)
        .otherwise(k.isNotNull())
    )
    return F.coalesce(plain, F.lit(False))
