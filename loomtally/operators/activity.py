"""Time: active spans, work blocks, streaks, hours of the day, idle gaps, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtally.functions import clock

GAP_5M, GAP_60M = 5 * 60_000, 60 * 60_000
FULL_MISS_TOKENS = 20_000
EPISODE_GAP, LOOKBACK = 30 * 60_000, 5 * 60 * 60_000
NIGHT_HOURS = (20, 21, 22, 23, 0, 1, 2, 3, 4)


def gaps(df: DataFrame, key: str, ts: str = "ts_ms") -> DataFrame:
    """Adds gap_ms to the row before it within ``key``; null keys are a group of their own."""
    w = Window.partitionBy(key).orderBy(ts)
    return df.withColumn("gap_ms", F.col(ts) - F.lag(ts).over(w))


def active_ms(idle_ms: int) -> Column:
    return F.sum(F.when(F.col("gap_ms") <= idle_ms, F.col("gap_ms")).otherwise(0))


def work_blocks(activity: DataFrame, key: str, idle_ms: int) -> DataFrame:
    """key, block (from 0), first_ms, last_ms, duration_ms, n: a gap over the idle time starts a new block."""
    started = F.coalesce((F.col("gap_ms") > idle_ms).cast("long"), F.lit(0))
    w = Window.partitionBy(key).orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    return (
        gaps(activity, key)
        .withColumn("block", F.sum(started).over(w))
        .groupBy(key, "block")
        .agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("n"))
        .withColumn("duration_ms", F.col("last_ms") - F.col("first_ms"))
    )


def session_activity(activity: DataFrame, idle_ms: int) -> DataFrame:
    """One row per session: active time, blocks, first and last time."""
    new = F.count_if(F.col("gap_ms").isNull() | (F.col("gap_ms") > idle_ms))
    return gaps(activity, "session_id").groupBy("session_id").agg(
        active_ms(idle_ms).alias("active_ms"), new.alias("work_blocks"),
        F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
    )


def agent_time(activity: DataFrame, idle_ms: int) -> DataFrame:
    """Active time added up over files, by class of file; the three classes are always there."""
    found = gaps(activity, "file_idx").groupBy("file_class").agg(active_ms(idle_ms).alias("ms"))
    spark = activity.sparkSession
    classes = spark.sql("SELECT explode(array('main', 'subagent', 'workflow_agent')) AS file_class")
    return classes.join(found, "file_class", "left").select("file_class", F.coalesce("ms", F.lit(0)).alias("agent_ms"))


def coverage(activity: DataFrame) -> DataFrame:
    main = F.when(F.col("file_class") == "main", F.col("ts_ms"))
    return activity.agg(F.min(main).alias("earliest_main"), F.min("ts_ms").alias("earliest_any"), F.max("ts_ms").alias("latest"))


def prompt_days(prompts: DataFrame, tz: str) -> DataFrame:
    return prompts.groupBy(clock.local_day(F.col("ts_ms"), tz).alias("day")).agg(F.count("*").alias("prompts"))


def streak(days: DataFrame) -> DataFrame:
    """Longest run of days one after another: islands of day number minus rank."""
    nth = F.row_number().over(Window.orderBy("day"))
    runs = days.select(F.date_sub(F.to_date("day"), nth.cast("int")).alias("island")).groupBy("island").count()
    return runs.agg(F.coalesce(F.max("count"), F.lit(0)).alias("longest_streak"))


def prompt_hours(prompts: DataFrame, tz: str) -> DataFrame:
    ms = F.col("ts_ms")
    return prompts.groupBy(clock.local_weekday(ms, tz).alias("weekday"), clock.local_hour(ms, tz).alias("hour")).agg(
        F.count("*").alias("prompts")
    )


def heatmap(prompts: DataFrame, tz: str) -> DataFrame:
    """All 168 weekday hours, Monday first, those without prompts too."""
    every = prompts.sparkSession.range(168).select(
        F.expr("int(id div 24)").alias("weekday"), F.expr("int(id % 24)").alias("hour")
    )
    return every.join(prompt_hours(prompts, tz), ["weekday", "hour"], "left").select(
        "weekday", "hour", F.coalesce("prompts", F.lit(0)).alias("prompts")
    )


def peak_hour(prompts: DataFrame, tz: str) -> DataFrame:
    by_hour = prompt_hours(prompts, tz).groupBy("hour").agg(F.sum("prompts").alias("n"))
    return by_hour.agg(F.max_by("hour", F.struct("n", -F.col("hour"))).alias("peak_hour"))


def idle_buckets(priced: DataFrame) -> DataFrame:
    """Each response with the bucket of the gap before it in its file, its write value, and full misses."""
    w = Window.partitionBy("file_idx").orderBy(F.col("ts_start").asc_nulls_first(), "final_key")
    gap = F.col("ts_start") - F.lag("ts_start").over(w)
    bucket = (
        F.when(gap.isNull(), "first")
        .when(~F.col("model").eqNullSafe(F.lag("model").over(w)), "modelSwitch")
        .when(gap <= GAP_5M, "le5m")
        .when(gap <= GAP_60M, "m5to60")
        .otherwise("gt60m")
    )
    miss = (F.col("cache_read") == 0) & (F.col("cw5m") + F.col("cw1h") > FULL_MISS_TOKENS)
    return priced.select(
        "final_key", "file_idx", bucket.alias("bucket"), (F.col("nano_cw5m") + F.col("nano_cw1h")).alias("write_nano"),
        miss.alias("full_miss"),
    )


def episodes(limited: DataFrame, tz: str = "UTC") -> DataFrame:
    """Starts of runs of refusals with pauses of at most half an hour: ts_ms and local hour.

    Times are compared within their hour; the first one of an hour with the last
    one of the hour before that has any. Only hours, not refusals, meet in one task.
    """
    times = limited.where("ts_ms is not null").select("ts_ms").distinct().withColumn("cell", F.expr("ts_ms div 3600000"))
    hours = times.groupBy("cell").agg(F.max("ts_ms").alias("last"))
    before = hours.select("cell", F.lag("last").over(Window.orderBy("cell")).alias("last"))
    own = times.withColumn("own", F.lag("ts_ms").over(Window.partitionBy("cell").orderBy("ts_ms"))).join(before, "cell")
    starts = own.withColumn("gap", F.col("ts_ms") - F.coalesce("own", "last")).where(F.col("gap").isNull() | (F.col("gap") > EPISODE_GAP))
    return starts.select("ts_ms", clock.local_hour(F.col("ts_ms"), tz).alias("hour"))


def merged_spans(windows: DataFrame) -> DataFrame:
    """The lookback spans before first rejections, overlapping ones merged: from_ms (in), to_ms (out)."""
    spans = windows.where("first_reject_ms is not null").select(
        (F.col("first_reject_ms") - LOOKBACK).alias("a"), F.col("first_reject_ms").alias("b")
    )
    order = Window.orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reach.isNull() | (F.col("a") > reach)).cast("int")
    marked = spans.withColumn("fresh", fresh)
    island = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("i", island).groupBy("i").agg(F.min("a").alias("from_ms"), F.max("b").alias("to_ms")).drop("i")


def in_spans(df: DataFrame, spans: DataFrame, ts: str) -> DataFrame:
    """Rows whose time is in one of the disjoint spans, once each.

    Spans and rows meet by the hour: a span goes to every hour it touches, so
    this is an equi-join however many spans there are.
    """
    hour = 3_600_000
    cells = spans.select("from_ms", "to_ms", F.explode(F.sequence(F.expr(f"from_ms div {hour}"), F.expr(f"(to_ms - 1) div {hour}"))).alias("cell"))
    held = df.where(F.col(ts).isNotNull()).withColumn("cell", F.expr(f"{ts} div {hour}"))
    inside = (held["cell"] == cells["cell"]) & (F.col(ts) >= F.col("from_ms")) & (F.col(ts) < F.col("to_ms"))
    return held.join(cells, inside, "left_semi").drop("cell")


def active_by_day(activity: DataFrame, key: str, idle_ms: int, tz: str) -> DataFrame:
    """Active time of each key by local day; a gap counts for the day of its end."""
    distinct = activity.select(key, "ts_ms").distinct()
    return (
        gaps(distinct, key)
        .where(F.col("gap_ms") <= idle_ms)
        .groupBy(key, clock.local_day(F.col("ts_ms"), tz).alias("day"))
        .agg(F.sum("gap_ms").alias("active_ms"))
    )


def fill_days(by_day: DataFrame, value: str, most: int = 1000) -> DataFrame:
    """Every day from the first to the last, with 0 where there was nothing; at most ``most`` days, the last ones."""
    ends = by_day.agg(F.min(F.to_date("day")).alias("a"), F.max(F.to_date("day")).alias("b")).where("a is not null")
    first = F.greatest(F.col("a"), F.date_sub("b", most - 1))
    days = ends.select(F.explode(F.sequence(first, F.col("b"))).alias("d"))
    return days.select(F.date_format("d", "yyyy-MM-dd").alias("day")).join(by_day, "day", "left").select(
        "day", F.coalesce(value, F.lit(0)).alias(value)
    )


def orphan_days(activity: DataFrame, prompts: DataFrame, tz: str) -> DataFrame:
    """Days of side work on which no main thread was active and nothing was asked."""
    own = activity.select("file_class", clock.local_day(F.col("ts_ms"), tz).alias("day"))
    main = own.where("file_class = 'main'").select("day").union(prompts.select(clock.local_day(F.col("ts_ms"), tz)))
    return own.where("file_class <> 'main'").select("day").distinct().join(main.distinct(), "day", "left_anti")
