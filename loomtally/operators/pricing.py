"""Tokens to nanodollars: billed parts, rates, buckets and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtally.functions.money import WEB_SEARCH_NANO
from loomtally.functions.text import normalize_model
from loomtally.sources.prices import BUCKETS

TOKENS = ("input", "output", "cw5m", "cw1h", "cache_read")


def ttl(total: Column, split: Column) -> tuple[Column, Column]:
    """Five-minute writes of a total, and whether that is a guess.

    A split that doesn't add up is rescaled in whole tokens, rounded down.
    """
    s5, s1 = split["m5"], split["h1"]
    whole = (total.cast("decimal(38,0)") * s5).cast("decimal(38,0)")
    scaled = F.floor(whole / (s5 + s1)).cast("long")
    known = split.isNotNull() & (s5 + s1 > 0)
    five = F.when(total == 0, 0).when(~known, total).when(s5 + s1 == total, s5).otherwise(scaled)
    return five.cast("long"), (total > 0) & ~known


def billed_parts(df: DataFrame) -> DataFrame:
    """One row per billed attempt (``pos``): the whole usage, or its iterations if there are several.

    An attempt that put nothing out and wasn't the last is free.
    """
    own = F.struct(
        F.col("raw_model").alias("model"), "input", "output", "cache_read", "cache_write", "split"
    )
    several = F.filter(
        F.transform("iterations", lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda p: (p["x"]["output"] != 0) | (p["i"] == F.size("iterations") - 1),
    )
    listed = F.transform(
        several,
        lambda p: F.struct(
            F.coalesce(p["x"]["model"], F.col("raw_model")).alias("model"), p["x"]["input"].alias("input"),
            p["x"]["output"].alias("output"), p["x"]["cache_read"].alias("cache_read"),
            p["x"]["cache_write"].alias("cache_write"), p["x"]["split"].alias("split"),
        ),
    )
    parts = F.when(F.coalesce(F.size("iterations"), F.lit(0)) > 1, listed).otherwise(F.array(own))
    rows = df.withColumn("parts", parts).select(*df.columns, F.posexplode("parts").alias("pos", "part"))
    five, guess = ttl(F.col("part.cache_write"), F.col("part.split"))
    return rows.select(
        *(c for c in df.columns if c not in ("input", "output", "cache_read", "cache_write", "split", "iterations")),
        "pos", normalize_model(F.col("part.model")).alias("model"), F.col("part.input").alias("input"),
        F.col("part.output").alias("output"), five.alias("cw5m"), (F.col("part.cache_write") - five).alias("cw1h"),
        F.col("part.cache_read").alias("cache_read"), guess.alias("ttl_estimated"),
    )


def price_parts(parts: DataFrame, prices: DataFrame, multiplier: int | None = None, all_5m: bool = False) -> DataFrame:
    """Adds priced, fast_part, geo_part, nano_* buckets and nano of every part; unpriced parts are worth 0."""
    if all_5m:
        parts = parts.withColumn("cw5m", F.col("cw5m") + F.col("cw1h")).withColumn("cw1h", F.lit(0).cast("long"))
    rows = parts.join(F.broadcast(prices), "model", "left")  # a row per priced model
    fast = F.coalesce((F.col("speed") == "fast") & F.col("has_fast"), F.lit(False))
    geo = F.coalesce((parts["geo"] == "us") & prices["geo"], F.lit(False))
    rows = rows.withColumns({"fast_part": fast, "geo_part": geo})

    def value(bucket: str) -> Column:
        rate = F.when(F.col("fast_part"), F.col(f"fast_{bucket}")).otherwise(F.col(f"std_{bucket}"))
        rate = F.when(F.col("geo_part"), F.floor(rate * 11 / 10).cast("long")).otherwise(rate)
        nano = F.coalesce(F.col(bucket) * rate, F.lit(0).cast("long"))
        if multiplier is not None:
            exact = nano.cast("decimal(28,0)") * F.lit(multiplier).cast("decimal(10,0)") + 500
            nano = F.floor(exact / 1000).cast("long")
        return nano

    rows = rows.withColumns({f"nano_{b}": value(b) for b in BUCKETS}).withColumn("priced", F.col("own").isNotNull())
    total = sum((F.col(f"nano_{b}") for b in BUCKETS[1:]), F.col(f"nano_{BUCKETS[0]}"))
    drop = [c for c in prices.columns if c not in ("model", "display_name", "own", "geo")]
    return rows.withColumn("nano", total).drop(prices["geo"]).drop(*drop)


def web_nano(multiplier: int | None = None) -> Column:
    nano = F.col("web_searches") * WEB_SEARCH_NANO
    return nano if multiplier is None else F.floor((nano * multiplier + 500) / 1000).cast("long")


def price_responses(
    df: DataFrame, keys: list[str], prices: DataFrame, multiplier: int | None = None, all_5m: bool = False
) -> DataFrame:
    """``df`` with tokens, nano_* buckets, nano (web searches once), priced, fast, geo_us, ttl_estimated, parts.

    ``keys`` tell the rows of ``df`` apart.
    """
    parts = price_parts(billed_parts(df), prices, multiplier, all_5m)
    other = [c for c in df.columns if c not in (*keys, *TOKENS, "cache_write", "split", "iterations")]
    kept = F.struct(
        "pos", "model", "display_name", "priced", *TOKENS, *(f"nano_{b}" for b in BUCKETS), "nano", "fast_part", "geo_part"
    )
    out = parts.groupBy(*keys).agg(
        *(F.any_value(c).alias(c) for c in other),
        *(F.sum(t).alias(t) for t in TOKENS),
        *(F.sum(f"nano_{b}").alias(f"nano_{b}") for b in BUCKETS),
        F.sum("nano").alias("nano"),
        F.bool_and("priced").alias("priced"),
        F.bool_or("ttl_estimated").alias("ttl_estimated"),
        F.array_sort(F.collect_list(kept)).alias("parts"),
    )
    web = web_nano(multiplier)
    top = prices.select(
        F.col("model").alias("top_model"), F.col("has_fast").alias("top_fast"), F.col("geo").alias("top_geo")
    )
    flagged = out.withColumn("model", normalize_model(F.col("raw_model"))).join(
        F.broadcast(top), F.col("model") == F.col("top_model"), "left"
    )
    return flagged.withColumns({
        "nano_web": web,
        "nano": F.col("nano") + web,
        "fast": F.coalesce((F.col("speed") == "fast") & F.col("top_fast"), F.lit(False)),
        "geo_us": F.coalesce((F.col("geo") == "us") & F.col("top_geo"), F.lit(False)),
    }).drop("top_model", "top_fast", "top_geo")


def observation_nano(responses: DataFrame, prices: DataFrame, multiplier: int | None = None) -> DataFrame:
    """What each line would be worth by itself: the line's columns and obs_nano."""
    parts = price_parts(billed_parts(responses), prices, multiplier)
    summed = parts.groupBy("file_idx", "line_no").agg(F.sum("nano").alias("part_nano"))
    return (
        responses.join(summed, ["file_idx", "line_no"])
        .withColumn("obs_nano", F.col("part_nano") + web_nano(multiplier))
        .drop("part_nano")
    )
