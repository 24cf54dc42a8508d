"""Tool calls: pairing with results, status, failure runs, churn, receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtally.functions import text as T
from loomtally.operators.dedup import file_order, pick, with_files

USE = (
    "file_idx", "line_no", "file_class", "ts_ms", "session_id", "name", "path_hash", "path_label", "edit_lines",
    "write_lines", "intents",
)
RESULT = ("ts_ms", "is_error", "denial_kind", "error_category")
CHURN = (*T.EDIT_TOOLS, *T.WRITE_TOOLS)
HOT_EDITS, TOP_FILES = 10, 10
FLAG_CALLS, FLAG_RATE, FLAG_TOP = 50, 0.05, 3
FAILED = ("shell_exit", "failed")


def pair(uses: DataFrame, results: DataFrame, files: DataFrame) -> DataFrame:
    """One row per call: the use, and its result wherever that is; ``uses`` is already limited in time."""
    u = pick(with_files(uses, files), ["tool_use_id"], file_order(), list(USE))
    r = pick(with_files(results, files), ["tool_use_id"], file_order(), list(RESULT))
    r = r.withColumnRenamed("ts_ms", "result_ms").withColumn("paired", F.lit(True))
    status = (
        F.when(F.col("paired").isNull(), "unpaired")
        .when(F.col("denial_kind").isNotNull(), "denied")
        .when(F.col("is_error"), F.when(F.col("name").isin(*T.SHELL_TOOLS), "shell_exit").otherwise("failed"))
        .otherwise("ok")
    )
    ok = F.col("status") == "ok"
    return (
        u.join(r, "tool_use_id", "left")
        .withColumn("status", status)
        .withColumns({
            "edit_lines": F.when(ok, F.col("edit_lines")), "write_lines": F.when(ok, F.col("write_lines")),
            "display_name": T.tool_display(F.col("name")), "name_class": T.tool_class(F.col("name")),
        })
        .drop("paired")
    )


def orphan_results(results: DataFrame, uses: DataFrame, files: DataFrame) -> DataFrame:
    """Results without a use, one per id; limit them in time by ts_ms."""
    r = pick(with_files(results, files), ["tool_use_id"], file_order(), list(RESULT))
    return r.join(uses.select("tool_use_id").distinct(), "tool_use_id", "left_anti")


def duplicates(uses: DataFrame) -> DataFrame:
    return uses.agg((F.count("tool_use_id") - F.countDistinct("tool_use_id")).alias("duplicate_tool_use_ids"))


def fail_runs(calls: DataFrame) -> DataFrame:
    """Longest run of failures of each tool within one file; unpaired calls don't break a run."""
    order = Window.partitionBy("file_idx", "name").orderBy(F.col("ts_ms").asc_nulls_first(), "tool_use_id")
    known = calls.where("status <> 'unpaired'").withColumn("bad", F.col("status").isin(*FAILED))
    island = F.sum((~F.col("bad")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = known.withColumn("island", island).where("bad").groupBy("file_idx", "name", "island").count()
    return runs.groupBy("name").agg(F.max("count").alias("longest_fail_run"))


def tool_table(calls: DataFrame) -> DataFrame:
    """One row per tool: calls by status, failure rate, longest run, and whether it needs a look."""

    def n(*status: str):
        return F.count_if(F.col("status").isin(*status))

    table = calls.groupBy("name", "display_name", "name_class").agg(
        F.count("*").alias("calls"), n("ok", "denied", *FAILED).alias("paired"), n("ok").alias("ok"),
        n("denied").alias("denied"), n("shell_exit").alias("shell_exit"), n("failed").alias("failed"),
        n("unpaired").alias("unpaired"),
    )
    fails = F.col("shell_exit") + F.col("failed")
    rate = F.when(F.col("paired") > 0, fails / F.col("paired")).otherwise(F.lit(0.0))
    by_fails = F.row_number().over(Window.orderBy(fails.desc(), "name"))  # a row per tool
    return (
        table.join(fail_runs(calls), "name", "left")
        .withColumn("longest_fail_run", F.coalesce("longest_fail_run", F.lit(0)))
        .withColumn("failure_rate", rate)
        .withColumn("nth", by_fails)
        .withColumn("flagged", ((F.col("calls") >= FLAG_CALLS) & (rate >= FLAG_RATE)) | ((fails > 0) & (F.col("nth") <= FLAG_TOP)))
        .drop("nth")
    )


def session_blocks(calls: DataFrame, priced: DataFrame, idle_ms: int) -> DataFrame:
    """Each call with the number of the work block of its session that it falls in.

    Blocks come from all times of the session: calls, and starts and ends of responses.
    """
    times = calls.select("session_id", "ts_ms", "tool_use_id")
    for c in ("ts_start", "ts_end"):
        times = times.unionByName(priced.select("session_id", F.col(c).alias("ts_ms"), F.lit(None).cast("string").alias("tool_use_id")))
    placed = times.where("session_id is not null and ts_ms is not null")
    order = Window.partitionBy("session_id").orderBy("ts_ms")
    new = F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(order) > idle_ms).cast("int"), F.lit(0))
    block = F.sum("new").over(order.rangeBetween(Window.unboundedPreceding, 0))
    found = placed.withColumn("new", new).withColumn("block", block).where("tool_use_id is not null").select("tool_use_id", "block")
    return calls.join(found, "tool_use_id", "left")


def churn(calls: DataFrame) -> DataFrame:
    """One row per file that calls changed: edits, most edits in one block, label."""
    done = calls.where((F.col("status") == "ok") & F.col("name").isin(*CHURN) & F.col("path_hash").isNotNull())
    spot = F.when(F.col("block").isNull(), F.lit("none")).otherwise(F.concat_ws(":", "session_id", "block"))
    per = done.groupBy("path_hash", spot.alias("spot")).agg(
        F.count("*").alias("n"), F.min_by("path_label", F.struct(F.col("path_label").isNull(), F.col("ts_ms").isNotNull(), "ts_ms", "tool_use_id")).alias("label"),
        F.min(F.struct(F.col("path_label").isNull(), F.col("ts_ms").isNotNull(), "ts_ms", "tool_use_id")).alias("o"),
    )
    return per.groupBy("path_hash").agg(
        F.sum("n").alias("edits"), F.max("n").alias("most_in_block"), F.min_by("label", "o").alias("label")
    )


def first_touches(calls: DataFrame) -> DataFrame:
    """One row per changed file: the tool of the first ok change, and whether it was edited at all."""
    done = calls.where((F.col("status") == "ok") & F.col("name").isin(*CHURN) & F.col("path_hash").isNotNull())
    order = F.struct(F.col("ts_ms").isNotNull(), "ts_ms", "tool_use_id")
    return done.groupBy("path_hash").agg(
        F.min_by("name", order).alias("first_tool"), F.bool_or(F.col("name").isin(*T.EDIT_TOOLS)).alias("edited")
    )


def intent_counts(calls: DataFrame) -> DataFrame:
    each = calls.select("status", F.explode("intents").alias("intent"))
    return each.groupBy("intent").agg(F.count("*").alias("count"), F.count_if(F.col("status").isin(*FAILED)).alias("failures"))
