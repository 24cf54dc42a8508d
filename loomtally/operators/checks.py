"""Checks of tables: rules as conditions, broken ones as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtally.functions import text as T
from loomtally.functions.variant import SAFE
from loomtally.operators.dedup import SEVERITY
from loomtally.operators.parse import WORKFLOW_EVENTS

TOKEN = r"^[A-Za-z0-9_.:\-]{1,64}$"
HASH = "^[0-9a-f]{64}$"


def whole(name: str) -> Column:
    return F.col(name).isNull() | F.col(name).between(0, SAFE)


def at_most(name: str, n: int) -> Column:
    return F.col(name).isNull() | (T.utf16_length(F.col(name)) <= n)


def one_of(name: str, *values: str) -> Column:
    return F.col(name).isNull() | F.col(name).isin(*values)


def like(name: str, pattern: str) -> Column:
    return F.col(name).isNull() | F.col(name).rlike(pattern)


def event_rules(kind: str, columns: list[str]) -> dict[str, Column]:
    """Rule by name for the columns that an event table has."""
    rules: dict[str, Column] = {"line_no": F.col("line_no") >= 1, "file_idx": F.col("file_idx") >= 0}
    rules |= {c: F.col(c).isNotNull() & whole(c) for c in ("input", "output", "cache_read", "cache_write", "web_searches", "visible_chars") if c in columns}
    rules |= {c: whole(c) for c in ("ts_ms", "thinking", "reported_nano", "edit_lines", "write_lines", "api_error_status") if c in columns}
    rules |= {c: at_most(c, 256) for c in ("session_id", "uuid", "message_id", "request_id", "tool_use_id", "agent", "skill", "mcp_server", "plugin") if c in columns}
    rules |= {c: like(c, TOKEN) for c in ("speed", "geo", "tier", "effort", "agent_version", "limit_type", "denial_kind") if c in columns}
    own = {
        "response": {"final": F.col("final").isNotNull(), "raw_model_length": at_most("raw_model", 128), "cwd": at_most("cwd", 4096)},
        "tool_use": {"id": F.col("tool_use_id").isNotNull(), "name": F.col("name").isNotNull(), "path_hash": like("path_hash", HASH), "path_label": at_most("path_label", 512)},
        "tool_result": {"id": F.col("tool_use_id").isNotNull(), "is_error": F.col("is_error").isNotNull()},
        "activity": {"time": F.col("ts_ms").isNotNull(), "record_type": one_of("record_type", "assistant", "user")},
        "workflow": {"event": F.col("event").isNotNull() & one_of("event", *WORKFLOW_EVENTS)},
        "secret": {"severity": F.col("severity").isNotNull() & one_of("severity", *SEVERITY), "fingerprint12": F.coalesce(F.col("fingerprint12").rlike("^[0-9a-f]{12}$"), F.lit(False))},
    }
    return rules | own.get(kind, {})


def broken(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """keys and rule: a row for each rule that a row breaks; one pass, whatever the number of rules."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(failed).alias("rule"))


def event_problems(tables: dict[str, DataFrame]) -> DataFrame:
    """Event table, place and rule of every value that is not what it must be; empty when all is well."""
    each = [broken(t, event_rules(k, t.columns), ["file_idx", "line_no"]).select(F.lit(k).alias("event"), "file_idx", "line_no", "rule") for k, t in sorted(tables.items())]
    return reduce(DataFrame.unionByName, each)


def price_problems(prices: DataFrame) -> DataFrame:
    """model and rule: rates that don't follow from the input rate, names and ids that aren't plain. A user's own rates are free."""
    i = F.col("std_input")
    fast = F.col("fast_input")
    rules = {
        "id": F.col("model").rlike(r"^[a-z0-9][a-z0-9.\-]*$") & ~F.col("model").rlike(r"-[0-9]{8}$"),
        "display_name": F.col("display_name").rlike("^[A-Za-z0-9 .]+$"),
        "steps": reduce(lambda a, b: a & b, (F.col(f"{k}_{b}") % 10 == 0 for k in ("std", "fast") for b in ("input", "cw5m", "cw1h", "cache_read", "output"))),
        "cw5m": (F.col("std_cw5m") * 4 == i * 5) & (F.col("fast_cw5m") * 4 == fast * 5),
        "cw1h": (F.col("std_cw1h") == i * 2) & (F.col("fast_cw1h") == fast * 2),
        "cache_read": (F.col("std_cache_read") * 10 == i) | (F.col("std_cache_read") * 40 == i),
    }
    twice = prices.groupBy("model").count().where("count > 1").select("model", F.lit("repeated").alias("rule"))
    return broken(prices.where("not own"), rules, ["model"]).unionByName(twice)


def ledger_problems(units: DataFrame) -> DataFrame:
    """day, session16 and rule: what may not be merged into a ledger."""
    numbers = {c: F.col(c).isNotNull() & whole(c) for c in ("responses", "prompts", "calls", "failed_calls", "active_ms")}
    rules = numbers | {
        "day": F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col("day").try_cast("date").isNotNull(),
        "month": F.col("month") == F.substring("day", 1, 7), "session16": F.col("session16").rlike("^[0-9a-f]{16}$"),
        "nano": F.col("nano") >= 0, "failed_of_calls": F.col("failed_calls") <= F.col("calls"),
    }
    twice = units.groupBy("day", "session16").count().where("count > 1").select("day", "session16", F.lit("repeated").alias("rule"))
    return broken(units, rules, ["day", "session16"]).unionByName(twice)


def secret_folders(secrets: DataFrame, launch: DataFrame) -> DataFrame:
    """Launch folders of the sessions in which a secret was found, sorted; findings without a known one have an empty list."""
    keys = ["secret_type", "fingerprint12"]
    each = secrets.select(*keys, F.explode_outer("sessions").alias("session_id")).join(launch, "session_id", "left")
    return each.groupBy(*keys).agg(F.array_sort(F.collect_set("launch")).alias("folders"))


def ledger_labels(units: DataFrame, labels: DataFrame) -> DataFrame:
    """Units with the label of their month (month, label); null where a month has none."""
    return units.join(labels.groupBy("month").agg(F.max("label").alias("label")), "month", "left")
