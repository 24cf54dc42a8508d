"""Ordered tables and exports of a report; each is a DataFrame that Spark writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtally.functions import text as T
from loomtally.operators import aggregate as G
from loomtally.operators.dedup import SEVERITY
from loomtally.operators.pricing import TOKENS
from loomtally.plans.accounting import Accounting

BY = ("day", "month", "model", "project")
# Fixed value: what a spreadsheet would take for a formula.
_FORMULA = r"^[=+\-@\t\r]"


def responses(priced: DataFrame) -> DataFrame:
    """By start, those without a time first, then key."""
    return priced.orderBy(F.col("ts_start").asc_nulls_first(), "final_key")


def calls(paired: DataFrame) -> DataFrame:
    """By time, those without one first, then id."""
    return paired.orderBy(F.col("ts_ms").asc_nulls_first(), "tool_use_id")


def sessions(by_session: DataFrame) -> DataFrame:
    """By first time, those without one last, then id."""
    return by_session.orderBy(F.col("first_ms").asc_nulls_last(), "session_id")


def by_value(table: DataFrame, key: str) -> DataFrame:
    """Projects or models by value, the dearest first, then key."""
    return table.orderBy(F.desc("nano"), key)


def findings(secrets: DataFrame) -> DataFrame:
    """By severity, then the newest (those without a time last), then fingerprint."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("severity"))
    return secrets.orderBy(rank, F.col("newest_ms").desc_nulls_last(), "fingerprint12")


def top_tool(paired: DataFrame) -> DataFrame:
    """The display name with most calls; of several the first in display order."""
    order = F.array_position(F.array(*map(F.lit, T.DISPLAY_NAMES)), F.col("tool"))
    counts = paired.groupBy(T.tool_display(F.col("name")).alias("tool")).agg(F.count("*").alias("calls"))
    best = F.struct("calls", (-order).alias("order"))
    return counts.agg(F.max_by("tool", best).alias("tool"), F.max("calls").alias("calls"))


def top_model(by_model: DataFrame) -> DataFrame:
    """The model of most value, the first by name of several; no row where none has any."""
    return by_model.where("nano > 0").orderBy(F.desc("nano"), "model").limit(1).select("model", "nano")


def agent_versions(activity: DataFrame) -> DataFrame:
    """The versions of agents that wrote the transcripts, sorted."""
    return activity.where("agent_version is not null").select("agent_version").distinct().orderBy("agent_version")


def ratio_summary(ratios: DataFrame) -> DataFrame:
    """Of our value over the reported one, by window: how many, median, least and largest."""
    own = ratios.where("ratio is not null")
    return own.agg(
        F.count("*").alias("windows"), F.median("ratio").alias("median_ratio"), F.min("ratio").alias("least_ratio"), F.max("ratio").alias("largest_ratio")
    )


def deleted_days(stats_days: DataFrame, coverage: DataFrame, tz: str) -> DataFrame:
    """How many days that a stats cache lists lie before the first main thread that is still there."""
    from loomtally.functions import clock

    first = coverage.select(clock.local_day(F.col("earliest_main"), tz).alias("first"))
    return stats_days.select("day").distinct().join(F.broadcast(first)).agg(F.count_if(F.col("day") < F.col("first")).alias("deleted_days"))  # one row


def dollars(nano: Column) -> Column:
    """Whole nanodollars as dollars with six decimals, halves away from zero."""
    exact = nano.cast("decimal(28,0)") * F.lit("0.000000001").cast("decimal(9,9)")
    return F.round(exact, 6).cast("decimal(28,6)").cast("string")


def _cell(c: Column) -> Column:
    """Text that no spreadsheet takes for a formula."""
    return F.when(c.rlike(_FORMULA), F.concat(F.lit("'"), c)).otherwise(c)


def export(a: Accounting, by: str, tz: str = "UTC") -> DataFrame:
    """Rows of one grouping: its key, responses, tokens and dollars; days and months by key, others by value."""
    if by not in BY:
        raise ValueError(f"not one of {BY}: {by}")
    table = {"day": lambda: G.by_day(a.priced, tz), "month": lambda: G.by_month(a.priced, tz), "model": lambda: G.by_model(a.priced), "project": lambda: a.by_project}[by]()
    key = {"project": "project_label"}.get(by, by)
    tie = "project_key" if by == "project" else key
    ordered = table.orderBy(key) if by in ("day", "month") else by_value(table, tie)
    return ordered.select(_cell(F.col(key)).alias(by), "responses", *TOKENS, dollars(F.col("nano")).alias("usd"))


def write_csv(a: Accounting, by: str, path: str, tz: str = "UTC") -> None:
    """One CSV file in the folder ``path``; a table of groups is small beside the transcripts."""
    export(a, by, tz).coalesce(1).write.mode("overwrite").csv(path, header=True, lineSep="\r\n")


def write_json(a: Accounting, by: str, path: str, tz: str = "UTC") -> None:
    export(a, by, tz).coalesce(1).write.mode("overwrite").json(path)


def markdown(a: Accounting, by: str, tz: str = "UTC") -> DataFrame:
    """Lines of a Markdown table, in order: column ``line``."""
    table = export(a, by, tz)
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in table.columns]
    head = [f"| {' | '.join(table.columns)} |", f"|{'|'.join(' --- ' for _ in table.columns)}|"]
    first = a.spark.createDataFrame([(x,) for x in head], "line string").coalesce(1)
    return first.unionByName(table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")))


def secret_locations(secrets: DataFrame, files: DataFrame) -> DataFrame:
    """Where each secret stands, without the secret: type, fingerprint, path and line numbers, worst severity first."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("severity"))
    found = secrets.join(files.select("file_idx", "rel_path"), "file_idx")
    return (
        found.groupBy("secret_type", "fingerprint12", "rel_path")
        .agg(F.min(rank).alias("rank"), F.array_sort(F.collect_set("line_no")).alias("lines"))
        .orderBy("rank", "secret_type", "fingerprint12", "rel_path")
        .drop("rank")
    )
