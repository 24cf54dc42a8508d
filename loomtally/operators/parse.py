"""Records to typed event tables: projections of one VARIANT column, no Python rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtally.functions import text as T
from loomtally.functions import variant as V
from loomtally.sources.store import CONTENTS, TEXT_BEARING

# Kinds of records.
NO_USAGE = (
    "mode", "permission-mode", "bridge-session", "file-history-snapshot", "file-history-delta", "atis-latch",
    "fork-context-ref", "system", "attachment", "summary",
)
WORKFLOW_EVENTS = ("launched", "started", "result", "failed")
SYNTHETIC = "<synthetic>"
INTERRUPT = "[Request interrupted by user"


def _usage(u: Column) -> list[Column]:
    def split(of: Column, path: str) -> Column:
        pair = F.struct(
            V.count(of, f"{path}.ephemeral_5m_input_tokens").alias("m5"),
            V.count(of, f"{path}.ephemeral_1h_input_tokens").alias("h1"),
        )
        return F.when(V.is_object(of, path), pair)

    def step(it: Column) -> Column:
        model = V.any_text(it, "model")
        return F.struct(
            F.when(model != "", F.substring(model, 1, 128)).alias("model"),
            V.count(it, "input_tokens").alias("input"),
            V.count(it, "output_tokens").alias("output"),
            V.count(it, "cache_read_input_tokens").alias("cache_read"),
            V.count(it, "cache_creation_input_tokens").alias("cache_write"),
            split(it, "cache_creation").alias("split"),
        )

    steps = V.get(u, "iterations", "array<variant>")
    objects = F.filter(steps, lambda it: F.schema_of_variant(it).startswith("OBJECT"))
    return [
        V.count(u, "input_tokens").alias("input"),
        V.count(u, "output_tokens").alias("output"),
        V.count(u, "cache_read_input_tokens").alias("cache_read"),
        V.count(u, "cache_creation_input_tokens").alias("cache_write"),
        split(u, "cache_creation").alias("split"),
        V.count_or_null(u, "output_tokens_details.thinking_tokens").alias("thinking"),
        V.token(u, "speed").alias("speed"),
        V.token(u, "inference_geo").alias("geo"),
        V.token(u, "service_tier").alias("tier"),
        V.count(u, "server_tool_use.web_search_requests").alias("web_searches"),
        F.transform(objects, step).alias("iterations"),
    ]


def events(found: DataFrame, files: DataFrame | None, carry: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The event tables of a scan; each has file_idx and line_no.

    ``found`` holds the records of ``sources.lines.records`` with the heads of
    ``sources.store.with_heads``. Texts are looked at only to count, sort and classify
    them; none is projected. Without ``files`` the records have a file_class of their own; ``carry`` names columns
    of theirs that every table has as well.
    """
    r = F.col("r")
    objects = found.where("fate = 'object'")
    if files is not None:
        objects = objects.join(F.broadcast(files.select("file_idx", "file_class")), "file_idx")
    base = objects.select(
        *dict.fromkeys(("file_idx", "line_no", "file_class", *carry)), "r", "kind", "type", "ts_ms", V.text(r, "sessionId", 256).alias("session_id"),
        V.text(r, "uuid", 256).alias("uuid"), V.is_true(r, "isSidechain").alias("is_sidechain"),
        V.text(r, "cwd", 4096).alias("cwd"),
    )
    journal = base.where("kind = 'journal'")
    log = base.where("kind <> 'journal'")
    place = ["file_idx", "line_no", *carry]
    who = [*place, "ts_ms", "session_id"]
    talk = base.where("kind in ('assistant', 'user')")

    activity = talk.where("ts_ms is not null").select(
        *who, "uuid", "is_sidechain", F.col("type").alias("record_type"), "cwd", V.token(r, "version").alias("agent_version")
    )
    status = V.token(r, "quotaLimits.status")
    quota = talk.where(status.isNotNull()).select(
        *who, status.alias("status"), V.token(r, "quotaLimits.rateLimitType").alias("limit_type"),
        V.number(r, "quotaLimits.resetsAt").alias("resets_at"),
    )

    model = V.any_text(r, "message.model")
    assistant = base.where("kind = 'assistant'")
    made_up = F.coalesce(model == SYNTHETIC, F.lit(False))
    synthetic = assistant.where(made_up).select(*who, V.count_or_null(r, "apiErrorStatus").alias("api_error_status"))
    real = assistant.where(~made_up)
    blocks = F.filter(
        F.coalesce(V.get(r, "message.content", "array<variant>"), F.array().cast("array<variant>")),
        lambda b: F.schema_of_variant(b).startswith("OBJECT"),
    )

    def shown(b: Column) -> Column:
        kind = V.any_text(b, "type")
        spoken = F.when(kind == "text", T.utf16_length(V.any_text(b, "text")))
        called = F.when(kind == "tool_use", T.utf16_length(F.to_json(V.get(b, "input"))))
        return F.coalesce(spoken, called, F.lit(0)).cast("long")

    visible = F.aggregate(F.transform(blocks, shown), F.lit(0).cast("long"), lambda a, x: a + x)
    usage = V.get(r, "message.usage")
    response = real.where(V.is_object(r, "message.usage")).select(
        *who, "uuid", "is_sidechain", "cwd", V.text(r, "message.id", 256).alias("message_id"),
        V.text(r, "requestId", 256).alias("request_id"),
        F.when(model != "", F.substring(model, 1, 128)).alias("raw_model"),
        (
            (V.has(r, "message.stop_reason") & (V.kind(r, "message.stop_reason") != "VOID")) | V.has(r, "message.usage.speed")
        ).alias("final"),
        *_usage(usage),
        V.text(r, "attributionAgent", 256).alias("agent"), V.text(r, "attributionSkill", 256).alias("skill"),
        V.text(r, "attributionMcpServer", 256).alias("mcp_server"), V.text(r, "attributionPlugin", 256).alias("plugin"),
        V.token(r, "effort").alias("effort"), visible.alias("visible_chars"),
    )

    b = F.col("b")
    use = real.select(*who, "is_sidechain", F.explode(blocks).alias("b")).where(V.any_text(b, "type") == "tool_use")
    name = F.coalesce(F.substring(V.any_text(b, "name"), 1, 256), F.lit(""))
    first_path = F.coalesce(*(F.when(V.any_text(b, f"input.{k}") != "", V.any_text(b, f"input.{k}")) for k in ("file_path", "notebook_path")))
    path = F.when(F.length(first_path) <= 4096, first_path)
    edits = F.filter(
        F.coalesce(V.get(b, "input.edits", "array<variant>"), F.array().cast("array<variant>")),
        lambda e: F.schema_of_variant(e).startswith("OBJECT"),
    )
    many = F.aggregate(
        F.transform(edits, lambda e: T.count_lines(V.any_text(e, "new_string"))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    command = F.when(name.isin(*T.SHELL_TOOLS), V.any_text(b, "input.command"))
    tool_use = use.where(V.text(b, "id", 256).isNotNull()).select(
        *who, "is_sidechain", V.text(b, "id", 256).alias("tool_use_id"), name.alias("name"),
        F.sha2(T.normalize_path(path), 256).alias("path_hash"),
        F.substring(F.nullif(T.path_label(path), F.lit("")), 1, 512).alias("path_label"),
        F.when(name == "Edit", T.count_lines(V.any_text(b, "input.new_string"))).when(name == "MultiEdit", many).alias("edit_lines"),
        F.when(name == "Write", T.count_lines(V.any_text(b, "input.content"))).alias("write_lines"),
        T.command_intents(F.nullif(command, F.lit(""))).alias("intents"),
    )

    user = base.where("kind = 'user'")
    denied = V.has(r, "toolDenialKind") & (V.kind(r, "toolDenialKind") != "VOID")
    denial = F.when(denied, F.coalesce(V.token(r, "toolDenialKind"), F.lit("other")))
    texts = F.filter(
        F.coalesce(V.get(b, "content", "array<variant>"), F.array().cast("array<variant>")),
        lambda x: (V.any_text(x, "type") == "text") & V.any_text(x, "text").isNotNull(),
    )
    said = F.coalesce(V.any_text(b, "content"), F.array_join(F.transform(texts, lambda x: V.any_text(x, "text")), "\n"))
    is_error = V.is_true(b, "is_error")
    result = user.select(*who, denial.alias("denial_kind"), F.explode(blocks).alias("b")).where(
        (V.any_text(b, "type") == "tool_result") & V.text(b, "tool_use_id", 256).isNotNull()
    )
    tool_result = result.select(
        *who, V.text(b, "tool_use_id", 256).alias("tool_use_id"), is_error.alias("is_error"), "denial_kind",
        F.when(is_error | F.col("denial_kind").isNotNull(), T.error_category(F.col("denial_kind"), said, T.ERROR_CHARS)).alias("error_category"),
    )

    spoken = F.filter(blocks, lambda x: V.any_text(x, "type") == "text")
    first = F.coalesce(
        V.any_text(r, "message.content"),
        F.when(F.size(spoken) > 0, F.coalesce(V.any_text(F.get(spoken, F.lit(0)), "text"), F.lit(""))),
    )
    answers = F.exists(blocks, lambda x: V.any_text(x, "type") == "tool_result")
    own = (
        ~V.truthy(r, "isSidechain") & ~V.truthy(r, "isMeta") & ~V.truthy(r, "isCompactSummary")
        & ~F.coalesce(V.any_text(r, "promptSource") == "system", F.lit(False)) & F.col("ts_ms").isNotNull() & ~answers
    )
    asked = user.where(own & first.isNotNull()).select(*who, "uuid", first.startswith(INTERRUPT).alias("interrupt"))

    dollars = V.number(r, "totalCostUSD")
    nano = F.floor(dollars * 1e9 + 0.5)
    snapshot = base.where("kind = 'cost-state'").select(
        *place, F.lit(None).cast("long").alias("ts_ms"), "session_id", V.number(r, "startTime").cast("long").alias("start_ms"),
        F.when((dollars >= 0) & (nano <= V.SAFE), nano.cast("long")).alias("reported_nano"), F.lit(True).alias("snapshot"),
    )
    # A snapshot has the time last seen above it; only times of files that have one are sorted with it.
    timed = base.where("kind in ('assistant', 'user', 'rest') and ts_ms is not null").select(*place, "ts_ms")
    timed = timed.join(snapshot.select("file_idx").distinct(), "file_idx", "left_semi")
    seen = Window.partitionBy("file_idx").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    noted = snapshot.unionByName(timed, True).withColumn("ts_ms", F.last("ts_ms", True).over(seen))
    cost_state = noted.where("snapshot").drop("snapshot")

    flow = F.coalesce(F.col("type").isin(*WORKFLOW_EVENTS), F.lit(False))
    workflow = journal.where(flow).select(*place, F.col("type").alias("event"))
    known = (*TEXT_BEARING, *NO_USAGE, *CONTENTS)
    label = F.when(F.col("type").isin(*known), F.col("type")).otherwise("other").alias("record_type")
    reason = F.when(F.col("type").isin(*TEXT_BEARING), "text_bearing").when(F.col("type").isin(*NO_USAGE), "no_usage_type").otherwise("unknown_type")
    skipped = log.where("kind in ('text', 'rest')").select(*place, reason.alias("reason"), label).unionByName(
        journal.where(~flow).select(*place, F.lit("unknown_type").alias("reason"), label)
    )
    return {
        "response": response, "tool_use": tool_use, "tool_result": tool_result,
        "prompt": asked.where("not interrupt").drop("interrupt"), "interrupt": asked.where("interrupt").drop("interrupt"),
        "activity": activity, "synthetic": synthetic, "quota": quota, "workflow": workflow, "cost_state": cost_state,
        "skipped": skipped,
    }
