"""The history ledger: numbers only, by day and session, kept as Parquet by month."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, StringType, StructField, StructType

from loomtally.functions import clock
from loomtally.functions.money import sum_big
from loomtally.operators import activity as A
from loomtally.operators.pricing import TOKENS

KEYS = ("day", "session16")
UNIT = ("day", "session16", "responses", "nano", "calls", "failed_calls", "prompts", "active_ms", "month")


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, 16)


def ledger_model(model: Column, listed: Column) -> Column:
    """A model of the price table by name, any other by a hash of its name."""
    return F.when(listed, model).otherwise(F.concat(F.lit("other:"), short_hash(model)))


def ledger_rows(priced: DataFrame, tz: str) -> DataFrame:
    """Counts and sums by day, session, model, class, fast, geo and project; one count for each billed part.

    Web searches go to the first part of a response.
    """
    web = F.when(F.col("pos") == 0, F.col("nano_web")).otherwise(F.lit(0))
    parts = priced.where("ts_start is not null").select(
        clock.local_day(F.col("ts_start"), tz).alias("day"), short_hash(F.col("session_id")).alias("session16"),
        short_hash(F.col("project_key")).alias("project16"), "file_class", "fast", "geo_us", "complete", "nano_web",
        F.inline("parts"),
    )
    return (
        parts.withColumn("nano", F.col("nano") + web)
        .withColumn("model", ledger_model(F.col("model"), F.col("display_name").isNotNull()))
        .groupBy(*KEYS, "model", "file_class", "fast", "geo_us", "project16")
        .agg(
            F.count("*").alias("responses"), F.count_if(~F.col("complete")).alias("incomplete"),
            *(F.sum(t).alias(t) for t in TOKENS), sum_big("nano").alias("nano"),
        )
    )


def ledger_units(
    priced: DataFrame, calls: DataFrame, prompts: DataFrame, activity: DataFrame, idle_ms: int, tz: str
) -> DataFrame:
    """One row per day and session: responses, value, prompts, calls, failed calls, active time."""

    def place(ts: str) -> list[Column]:
        return [clock.local_day(F.col(ts), tz).alias("day"), short_hash(F.col("session_id")).alias("session16")]

    # Sums over the rows of ``ledger_rows``, without what tells those of one unit apart.
    parts = priced.where("ts_start is not null").select(*place("ts_start"), "nano_web", F.inline(F.expr("transform(parts, p -> struct(p.pos, p.nano))")))
    web = F.when(F.col("pos") == 0, F.col("nano_web")).otherwise(F.lit(0))
    rows = parts.groupBy(*KEYS).agg(F.count("*").alias("responses"), sum_big(F.col("nano") + web).alias("nano"))
    failed = F.count_if(F.col("status").isin("failed", "shell_exit"))
    used = calls.where("ts_ms is not null").groupBy(*place("ts_ms")).agg(F.count("*").alias("calls"), failed.alias("failed_calls"))
    asked = prompts.where("ts_ms is not null").groupBy(*place("ts_ms")).agg(F.count("*").alias("prompts"))
    spent = A.active_by_day(activity, "session_id", idle_ms, tz).select(
        "day", short_hash(F.col("session_id")).alias("session16"), "active_ms"
    )
    out = rows
    for more in (used, asked, spent):
        out = out.join(more, list(KEYS), "full_outer")
    counts = [c for c in out.columns if c not in KEYS]
    return out.select(*KEYS, *(F.coalesce(c, F.lit(0)).alias(c) for c in counts)).withColumn("month", F.substring("day", 1, 7))


def merge_units(held: DataFrame, new: DataFrame) -> DataFrame:
    """The unit with more responses of each day and session; the new one on ties."""
    own = [c for c in new.columns if c not in KEYS]
    a = held.select(*KEYS, F.struct(*own).alias("a"))
    b = new.select(*KEYS, F.struct(*own).alias("b"))
    best = F.when(F.col("a").isNull() | (F.col("b.responses") >= F.col("a.responses")), F.col("b")).otherwise(F.col("a"))
    return a.join(b, list(KEYS), "full_outer").select(*KEYS, best.alias("u")).select(*KEYS, "u.*")


def _held_month(spark: SparkSession, path: str, month: str, schema) -> tuple[str, DataFrame | None]:
    """What a month of the ledger is: absent, valid (with its units) or broken (unreadable, or against a rule)."""
    from loomtally.operators.checks import ledger_problems

    try:
        found = spark.read.parquet(f"{path.rstrip('/')}/month={month}").withColumn("month", F.lit(month))
        units = found.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
        return ("broken", None) if ledger_problems(units).limit(1).count() else ("valid", units)
    except Exception as e:  # files that can't be read, or columns that aren't there
        return ("absent", None) if "PATH_NOT_FOUND" in str(e) else ("broken", None)


def remember(spark: SparkSession, units: DataFrame, path: str) -> DataFrame:
    """Merges ``units`` into the ledger at ``path`` and returns those that it refused, with the reason.

    Refused are units against a rule of ``checks.ledger_problems``, and all units of a
    month whose stored part is invalid or unreadable: such a month stays as it is. Only
    the months of ``units`` are read and written, each looked at by itself, as months are few. The
    merged months are written beside the ledger first, so no file is read while it
    is replaced; that folder is removed again.
    """
    from loomtally.operators.checks import ledger_problems
    from loomtally.session import shared_folder

    kept_at, beside = shared_folder(spark, "units"), f"{path.rstrip('/')}.new-{uuid4().hex}"
    units.write.parquet(kept_at)
    units = spark.read.schema(units.schema).parquet(kept_at)
    reason = F.array_join(F.array_sort(F.collect_set("rule")), " ").alias("reason")
    rules = ledger_problems(units).groupBy(*(F.col(k).alias(f"{k}_of") for k in KEYS)).agg(reason)
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in KEYS]
    marked = units.join(rules, reduce(lambda x, y: x & y, same), "left").select(*units.columns, "reason")
    good = marked.where("reason is null").drop("reason")
    months = [r["month"] for r in good.select("month").distinct().collect()]  # calendar months
    states = {m: _held_month(spark, path, m, units.schema) for m in months}
    broken = [m for m, (state, _) in states.items() if state == "broken"]
    new = good.where(~F.col("month").isin(broken)) if broken else good
    held = [df for state, df in states.values() if state == "valid"]
    merged = merge_units(reduce(DataFrame.unionByName, held), new) if held else new
    if len(broken) < len(months):
        merged.write.parquet(beside)
        ready = spark.read.schema(merged.schema).parquet(beside)
        ready.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
        _remove(spark, beside)
    in_broken = F.col("month").isin(broken) if broken else F.lit(False)
    return marked.withColumn("reason", F.coalesce("reason", F.when(in_broken, F.lit("month_invalid")))).where("reason is not null")


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def recall(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The units of all valid months of a ledger, and (month, state) of every month; invalid ones are told, not read."""
    schema = StructType([StructField(n, StringType() if n in (*KEYS, "month") else DecimalType(38, 0) if n == "nano" else LongType()) for n in UNIT])
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in system.listStatus(folder)] if system.exists(folder) else []
    states = {m: _held_month(spark, path, m, schema) for n in sorted(names) if (m := n.removeprefix("month=")) != n}
    valid = [df for state, df in states.values() if state == "valid"]
    units = reduce(DataFrame.unionByName, valid) if valid else spark.createDataFrame([], schema)
    return units, spark.createDataFrame([(m, s) for m, (s, _) in states.items()], "month string, state string")


def ledger_totals(units: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("responses", "prompts", "calls", "failed_calls", "active_ms")]
    return units.agg(
        F.countDistinct("day").alias("days"), F.countDistinct("session16").alias("sessions"), *sums, sum_big("nano").alias("nano")
    )
