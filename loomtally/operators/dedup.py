"""Picks under a total order: the same row wins however the input is cut or ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtally.functions.text import order_key

PAYLOAD = (
    "file_idx", "line_no", "session_id", "is_sidechain", "raw_model", "final", "input", "output", "cache_read",
    "cache_write", "split", "thinking", "speed", "geo", "tier", "web_searches", "iterations", "cwd", "agent", "skill",
    "mcp_server", "plugin", "effort", "file_class",
)


def with_files(df: DataFrame, files: DataFrame) -> DataFrame:
    """Adds what the order of files needs; the file dimension is a row per file and is broadcast while small."""
    dim = files.where("file_class is not null").select(
        "file_idx", "file_class", "depth", "root_idx", order_key(F.col("rel_path")).alias("rel_path_k")
    )
    return df.join(dim, "file_idx")


def file_order(later_line_first: bool = True) -> list[Column]:
    """Shallower class, smaller path, smaller root, then the later (or earlier) line."""
    line = -F.col("line_no") if later_line_first else F.col("line_no")
    return [F.col("depth"), F.col("rel_path_k"), F.col("root_idx"), line]


def pick(df: DataFrame, keys: list[str], order: list[Column], payload: list[str], *more: Column) -> DataFrame:
    """The first row by ``order`` for each key, with further aggregates."""
    best = F.min_by(F.struct(*payload), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).alias("best")
    out = df.groupBy(*keys).agg(best, *more)
    rest = [c for c in out.columns if c not in (*keys, "best")]
    return out.select(*keys, *(F.col(f"best.{c}").alias(c) for c in payload if c not in keys), *rest)


def response_keys(responses: DataFrame) -> DataFrame:
    """Adds pk, the primary key of a response, and final_key, which splits ids that gateways reused.

    One message id with several request ids is several responses; lines without a
    request id belong to the smallest one.
    """
    line = F.concat_ws(":", F.lit("line"), "file_idx", "line_no")
    keyed = responses.withColumn("pk", F.coalesce("message_id", "request_id", "uuid", line))
    w = Window.partitionBy("pk")
    low, high = F.min("request_id").over(w), F.max("request_id").over(w)
    from_id = F.max(F.coalesce(F.col("message_id") == F.col("pk"), F.lit(False))).over(w)
    split = keyed.withColumns({"low": low, "conflict": from_id & F.coalesce(low != high, F.lit(False))})
    own = F.concat(F.col("pk"), F.lit("|"), F.coalesce("request_id", "low"))
    return split.withColumn("final_key", F.when(F.col("conflict"), own).otherwise(F.col("pk"))).drop("low")


def dedup_responses(responses: DataFrame, files: DataFrame) -> DataFrame:
    """One row per response: the line with most output (then file order), and what its lines agree on.

    One shuffle on pk serves the key split and the pick.
    """
    order = [-F.col("output"), *file_order()]
    same = F.struct("input", "cache_write", "cache_read")
    # Per uuid the longest count of visible characters; lines without a uuid are all added.
    chars = F.struct(F.coalesce("uuid", F.concat_ws(":", F.lit("line"), "file_idx", "line_no")).alias("u"), "visible_chars")
    found = pick(
        response_keys(with_files(responses, files)),
        ["pk", "final_key"],
        order,
        list(PAYLOAD),
        F.min("ts_ms").alias("ts_start"),
        F.max("ts_ms").alias("ts_end"),
        F.count("*").alias("observations"),
        F.size(F.collect_set("file_idx")).alias("files"),
        (F.min(same) != F.max(same)).alias("violated"),
        F.max("conflict").alias("conflict"),
        F.count_if(F.col("conflict") & F.col("request_id").isNull()).alias("attached"),
        F.collect_list(chars).alias("chars"),
    )
    longest = F.aggregate(
        F.array_sort("chars"),
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit("").alias("u"), F.lit(0).cast("long").alias("last")),
        lambda a, x: F.struct(
            (a["sum"] + x["visible_chars"] - F.when(a["u"] == x["u"], a["last"]).otherwise(0)).alias("sum"),
            x["u"].alias("u"),
            x["visible_chars"].cast("long").alias("last"),
        ),
        lambda a: a["sum"],
    )
    return found.withColumn("visible_chars", longest).drop("chars").withColumnRenamed("final", "complete")


def dedup_stats(deduped: DataFrame) -> DataFrame:
    once = deduped.groupBy("pk").agg(
        F.sum("observations").alias("observations"), F.count("*").alias("keys"), F.max("conflict").alias("conflict"),
        F.sum("attached").alias("attached"), F.count_if("violated").alias("violated"), F.count_if(F.col("files") > 1).alias("forked"),
    )
    return once.agg(
        F.sum("observations").alias("observations"), F.sum("keys").alias("keys"),
        F.count_if("conflict").alias("gateway_conflicts"), F.sum("attached").alias("ambiguous_attach"),
        F.sum("violated").alias("invariant_violations"), F.sum("forked").alias("forked_keys"),
    )


def in_window(df: DataFrame, ts: str, since: int | None, until: int | None) -> DataFrame:
    """Rows in [since, until); a row without a time stays."""
    t = F.col(ts)
    if since is not None:
        df = df.where(t.isNull() | (t >= since))
    return df if until is None else df.where(t.isNull() | (t < until))


def by_uuid(df: DataFrame, files: DataFrame, columns: list[str]) -> DataFrame:
    """One row per uuid by file order; rows without a uuid all stay."""
    placed = with_files(df, files)
    kept = [*columns, "file_idx", "line_no", "file_class"]
    named = pick(placed.where("uuid is not null"), ["uuid"], file_order(), kept)
    return named.select(*kept).unionByName(placed.where("uuid is null").select(*kept))


def quota_windows(quota: DataFrame) -> DataFrame:
    """One row per reset time of rejected requests: first rejection, and its type (smallest on ties)."""
    rejected = quota.where("status = 'rejected' and resets_at is not null")
    first = F.struct(F.col("ts_ms").isNull(), F.col("ts_ms"), F.coalesce("limit_type", F.lit("")))
    return rejected.groupBy("resets_at").agg(F.min_by("limit_type", first).alias("limit_type"), F.min("ts_ms").alias("first_reject_ms"))


def synthetic_429(synthetic: DataFrame) -> DataFrame:
    return (
        synthetic.where("api_error_status = 429")
        .select(F.coalesce("session_id", F.lit("")).alias("session_id"), "ts_ms")
        .distinct()
    )


def cost_windows(cost_state: DataFrame, files: DataFrame) -> DataFrame:
    """The last snapshot of each session and start."""
    late = [F.col("ts_ms").isNotNull(), F.col("ts_ms"), *file_order(False)]
    order = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(late)))
    return with_files(cost_state, files).groupBy("session_id", "start_ms").agg(
        F.max_by("ts_ms", order).alias("last_ms"), F.max_by("reported_nano", order).alias("reported_nano")
    )


SEVERITY = ("critical", "likely_fixture", "third_party_public")


def secret_findings(secrets: DataFrame, files: DataFrame) -> DataFrame:
    """One row per type and fingerprint: copies, files, newest time, worst severity, whether expired."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("severity"))
    order = F.struct(rank.alias("o"), *(c.alias(f"o{i}") for i, c in enumerate(file_order(False))))
    expired = F.when(F.bool_or(~F.col("expired")), False).when(F.bool_and(F.coalesce("expired", F.lit(False))), True)
    return with_files(secrets, files).groupBy("secret_type", "fingerprint12").agg(
        F.min_by("severity", order).alias("severity"), F.min_by("source", order).alias("source"),
        F.count("*").alias("copies"), F.size(F.collect_set("file_idx")).alias("files"), F.max("ts_ms").alias("newest_ms"),
        expired.alias("expired"), F.array_sort(F.collect_set("session_id")).alias("sessions"),
    )
