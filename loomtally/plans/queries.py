"""The registered queries of the accounting, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from loomtally.functions import text as T
from loomtally.operators import activity as A
from loomtally.operators import aggregate as G
from loomtally.operators import ledger as L
from loomtally.operators import pricing as P
from loomtally.operators import checks, projects, tools
from loomtally.operators import secrets as S
from loomtally.plans import outputs as O
from loomtally.plans import summary as R
from loomtally.plans.accounting import Accounting
from loomtally.plans.bridge import IDLE_MINUTES, ORACLE, accounting

IDLE = IDLE_MINUTES * 60_000
RULES = (("/w/p1", "one"), ("/w/p2/sub", ""), ("/w/p2", "two"))
TOKENS = ", ".join(f"CAST(sum({t}) AS BIGINT) AS {t}" for t in P.TOKENS)
NANO = ", ".join(
    f"CAST(sum({v}) AS BIGINT) AS {k}"
    for k, v in (
        ("nano_input", "nano_input"), ("nano_output", "nano_output"), ("nano_cw5m", "nano_cw5m"), ("nano_cw1h", "nano_cw1h"),
        ("nano_cache_read", "nano_read"), ("nano_web", "web * 10000000"), ("nano", "nano"),
    )
)
MEASURES = f"count(*) AS responses, count(*) FILTER (NOT complete) AS incomplete, {TOKENS}, {NANO}"


def day(ms: str, form: str = "%Y-%m-%d") -> str:
    return f"strftime(make_timestamp({ms} * 1000), '{form}')"


def share(num: str, den: str) -> str:
    return f"CASE WHEN {num} > 0 AND {den} > 0 THEN least(CAST(CAST({num} AS HUGEINT) * 1000000000000 // {den} AS DOUBLE) / 1e12, 1.0) ELSE 0.0 END"


def plain(df: DataFrame) -> DataFrame:
    """Exact sums as BIGINT, for comparison; the tables of the tests stay far below its bounds."""
    return df.select(*(F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f.name) for f in df.schema))


FOUND: dict[str, Callable[[Accounting], DataFrame]] = {}
TWINS: dict[str, str] = {}


def on(name: str, sql: str):
    """Registers a query over the accounting and its twin, which goes on from the views of the bridge."""

    def add(f: Callable[[Accounting], DataFrame]) -> Callable[[Accounting], DataFrame]:
        FOUND[name], TWINS[name] = f, f"{ORACLE} {sql}"
        return f

    return add


DEDUPED = """, d AS (
  SELECT *, min(row(k, k * 10, k * 100)) OVER w <> max(row(k, k * 10, k * 100)) OVER w AS violated,
    count(*) FILTER (conflict AND rid IS NULL) OVER w AS attached FROM keyed
  WINDOW w AS (PARTITION BY final_key)),
f AS (SELECT final_key, count(DISTINCT file_idx) AS files FROM keyed GROUP BY 1),
v AS (SELECT DISTINCT final_key, violated, attached FROM d)"""

on("dedup_winner", f"""{DEDUPED}
SELECT final_key, pk, line_no, CAST(outp AS BIGINT) AS output, observations, CAST(files AS INT) AS files, ts_start, ts_end, violated, conflict,
  CAST(visible_chars AS BIGINT) AS visible_chars
FROM resp JOIN f USING (final_key) JOIN v USING (final_key)""")(
    lambda a: a.deduped.select(
        "final_key", "pk", "line_no", "output", "observations", "files", "ts_start", "ts_end", "violated", "conflict", "visible_chars"
    )
)
on("dedup_a2_split", "SELECT pk, count(*) AS keys, CAST(sum(observations) AS BIGINT) AS observations FROM resp WHERE conflict GROUP BY 1")(
    lambda a: a.deduped.where("conflict").groupBy("pk").agg(F.count("*").alias("keys"), F.sum("observations").alias("observations"))
)
on("dedup_stats", f"""{DEDUPED}, once AS (
  SELECT pk, sum(observations) AS o, count(*) AS n, max(conflict) AS c, sum(attached) AS t, count(*) FILTER (violated) AS x, count(*) FILTER (files > 1) AS g
  FROM resp JOIN f USING (final_key) JOIN v USING (final_key) GROUP BY 1)
SELECT CAST(sum(o) AS BIGINT) AS observations, CAST(sum(n) AS BIGINT) AS keys, count(*) FILTER (c) AS gateway_conflicts,
  CAST(sum(t) AS BIGINT) AS ambiguous_attach, CAST(sum(x) AS BIGINT) AS invariant_violations, CAST(sum(g) AS BIGINT) AS forked_keys FROM once""")(
    lambda a: a.stats
)
on("methods_totals", """, m AS (
  SELECT 'correct' AS method, sum(nano) AS n FROM resp
  UNION ALL SELECT 'sumEveryLine', sum(nano) FROM line
  UNION ALL SELECT 'keepFirstLine', sum(nano) FROM (SELECT final_key, arg_min(event_id, row(ms, depth, rel_path, line_no)) AS event_id FROM keyed GROUP BY 1) JOIN line USING (event_id)
  UNION ALL SELECT 'dedupPerFile', sum(nano) FROM (SELECT file_idx, pk, arg_max(event_id, row(outp, line_no)) AS event_id FROM keyed GROUP BY 1, 2) JOIN line USING (event_id)
  UNION ALL SELECT 'allWritesAt5m', sum(nano_all5) FROM resp
  UNION ALL SELECT 'mainFilesOnly', sum(nano) FROM (SELECT pk, arg_min(event_id, row(-outp, depth, rel_path, -line_no)) AS event_id FROM keyed WHERE file_class = 'main' GROUP BY 1) JOIN line USING (event_id))
SELECT method, CAST(coalesce(n, 0) AS BIGINT) AS nano,
  CAST(CAST(n AS HUGEINT) * 1000000 // (SELECT n FROM m WHERE method = 'correct') AS DOUBLE) / 1e6 AS ratio FROM m""")(lambda a: a.methods)
on("responses_priced", """
SELECT final_key, nano, nano_web, priced, fast, geo_us, ttl_estimated, project_key FROM (
  SELECT final_key, CAST(nano AS BIGINT) AS nano, CAST(web * 10000000 AS BIGINT) AS nano_web, all_priced AS priced, fast, geo_us, ttl_estimated, project_key FROM resp)""")(
    lambda a: a.priced.select("final_key", "nano", "nano_web", "priced", "fast", "geo_us", "ttl_estimated", "project_key")
)
on("price_parts", """
SELECT final_key, pos, model, priced, t_in AS input, t_out AS output, CAST(w5 AS BIGINT) AS cw5m, CAST(w1 AS BIGINT) AS cw1h, t_read AS cache_read,
  CAST(n_part AS BIGINT) AS nano FROM wparts""")(
    lambda a: G.parts_of(a.priced).select("final_key", "pos", "model", "priced", *P.TOKENS, "nano")
)
on("value_total", f"SELECT {MEASURES} FROM resp")(lambda a: G.totals(a.priced))
on("value_by_class", f"SELECT file_class, {MEASURES} FROM resp GROUP BY 1")(lambda a: G.by_class(a.priced))
on("value_by_day", f"SELECT {day('ts_start')} AS day, {MEASURES} FROM resp GROUP BY 1")(lambda a: G.by_day(a.priced, "UTC"))
on("value_by_month", f"SELECT {day('ts_start', '%Y-%m')} AS month, {MEASURES} FROM resp GROUP BY 1")(lambda a: G.by_month(a.priced, "UTC"))
on("value_by_project", f"SELECT project_key, count(DISTINCT session_id) AS sessions, {MEASURES} FROM resp GROUP BY 1")(
    lambda a: a.by_project.drop("project_label")
)
on("value_by_model", """
SELECT model, bool_or(priced) AS priced, count(DISTINCT event_id) AS responses, count(DISTINCT CASE WHEN NOT complete THEN event_id END) AS incomplete,
  CAST(sum(t_in) AS BIGINT) AS input, CAST(sum(t_out) AS BIGINT) AS output, CAST(sum(w5) AS BIGINT) AS cw5m, CAST(sum(w1) AS BIGINT) AS cw1h,
  CAST(sum(t_read) AS BIGINT) AS cache_read, CAST(sum(n_part) AS BIGINT) AS nano FROM wparts GROUP BY 1""")(
    lambda a: G.by_model(a.priced).select("model", "priced", "responses", "incomplete", *P.TOKENS, "nano")
)
on("value_by_session", f""", own AS (SELECT session_id, {MEASURES} FROM resp GROUP BY 1),
g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY session_id ORDER BY ms) AS gap FROM act),
spent AS (SELECT session_id, CAST(sum(CASE WHEN gap <= {IDLE} THEN gap ELSE 0 END) AS BIGINT) AS active_ms,
  count(*) FILTER (gap IS NULL OR gap > {IDLE}) AS work_blocks FROM g GROUP BY 1)
SELECT session_id, coalesce(responses, 0) AS responses, nano, coalesce(active_ms, 0) AS active_ms, coalesce(work_blocks, 0) AS work_blocks
FROM own FULL JOIN spent USING (session_id)""")(
    lambda a: G.by_session(a.priced, a.sessions).select("session_id", "responses", "nano", "active_ms", "work_blocks")
)
on("unpriced_models", """, u AS (SELECT * FROM wparts WHERE NOT priced),
fst AS (SELECT event_id, arg_min(model, pos) AS model FROM u GROUP BY 1), n AS (SELECT model, count(*) AS responses FROM fst GROUP BY 1)
SELECT model, coalesce(responses, 0) AS responses, tokens FROM (
  SELECT model, CAST(sum(t_in + t_out + w5 + w1 + t_read) AS BIGINT) AS tokens FROM u GROUP BY 1) LEFT JOIN n USING (model)""")(
    lambda a: G.unpriced(a.priced)
)
on("ttl_rescale", """
SELECT final_key, CAST(cw5m AS BIGINT) AS cw5m, CAST(cw1h AS BIGINT) AS cw1h, ttl_estimated FROM resp""")(
    lambda a: a.priced.select("final_key", "cw5m", "cw1h", "ttl_estimated")
)
on("token_coverage", f""", s AS (SELECT CAST(sum(t_in + t_out + w5 + w1 + t_read) FILTER (priced) AS BIGINT) AS p,
  CAST(sum(t_in + t_out + w5 + w1 + t_read) AS BIGINT) AS n FROM wparts)
SELECT p AS priced_tokens, n AS all_tokens, {share('p', 'n')} AS priced_share FROM s""")(lambda a: G.token_coverage(a.priced))
on("modifiers", """
SELECT count(*) FILTER (fast) AS fast, count(*) FILTER (geo_us) AS geo_us, count(*) FILTER (event_id % 19 = 0) AS non_standard_tier,
  count(*) FILTER (ttl_estimated) AS ttl_estimated, CAST(sum(web) AS BIGINT) AS web_searches FROM resp""")(lambda a: G.modifiers(a.priced))
GAPS = ", g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY session_id ORDER BY ms) AS gap FROM act)"
BLOCKS = f"""{GAPS},
b AS (SELECT *, sum(CASE WHEN gap > {IDLE} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ms) AS block FROM g),
bl AS (SELECT session_id, CAST(block AS BIGINT) AS block, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS n, max(ms) - min(ms) AS duration_ms FROM b GROUP BY 1, 2)"""
on("active_time_by_session", f"""{GAPS}
SELECT session_id, CAST(sum(CASE WHEN gap <= {IDLE} THEN gap ELSE 0 END) AS BIGINT) AS active_ms,
  count(*) FILTER (gap IS NULL OR gap > {IDLE}) AS work_blocks, min(ms) AS first_ms, max(ms) AS last_ms FROM g GROUP BY 1""")(lambda a: a.sessions)
on("agent_time_by_class", f""", g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY file_idx ORDER BY ms) AS gap FROM act)
SELECT file_class, CAST(sum(CASE WHEN gap <= {IDLE} THEN gap ELSE 0 END) AS BIGINT) AS agent_ms FROM g GROUP BY 1""")(
    lambda a: A.agent_time(a.activity, IDLE)
)
on("work_blocks", f"{BLOCKS} SELECT * FROM bl")(lambda a: A.work_blocks(a.activity, "session_id", IDLE))
on("block_percentiles", f"""{BLOCKS} SELECT count(*) AS blocks, max(duration_ms) AS longest, CAST(median(duration_ms) AS DOUBLE) AS median_ms,
  quantile_disc(duration_ms, 0.9) AS p90 FROM bl""")(
    lambda a: A.work_blocks(a.activity, "session_id", IDLE).agg(
        F.count("*").alias("blocks"), F.max("duration_ms").alias("longest"), F.median("duration_ms").alias("median_ms"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY duration_ms)").cast("long").alias("p90"),
    )
)
on("session_window_blocks", f"{BLOCKS} SELECT session_id, first_ms, duration_ms, n FROM bl")(
    lambda a: a.activity.select("session_id", "ts_ms", F.timestamp_millis("ts_ms").alias("t"))
    .groupBy("session_id", F.session_window("t", f"{IDLE_MINUTES} minutes 1 milliseconds"))
    .agg(F.min("ts_ms").alias("first_ms"), (F.max("ts_ms") - F.min("ts_ms")).alias("duration_ms"), F.count("*").alias("n"))
    .drop("session_window")
)
on("coverage", "SELECT min(ms) FILTER (file_class = 'main') AS earliest_main, min(ms) AS earliest_any, max(ms) AS latest FROM act")(
    lambda a: A.coverage(a.activity)
)
on("prompt_days", f"SELECT {day('ms')} AS day, count(*) AS prompts FROM prm GROUP BY 1")(lambda a: A.prompt_days(a.prompts, "UTC"))
on("streak", f""", d AS (SELECT DISTINCT CAST({day('ms')} AS DATE) AS d FROM prm),
i AS (SELECT d - CAST(row_number() OVER (ORDER BY d) AS INT) AS island FROM d), n AS (SELECT count(*) AS c FROM i GROUP BY island)
SELECT coalesce(max(c), 0) AS longest_streak FROM n""")(lambda a: A.streak(A.prompt_days(a.prompts, "UTC")))
HOURS = """, h AS (SELECT CAST((isodow(make_timestamp(ms * 1000)) - 1) AS INT) AS weekday, CAST(hour(make_timestamp(ms * 1000)) AS INT) AS hour FROM prm)"""
on("heatmap", f"""{HOURS}, e AS (SELECT CAST(range // 24 AS INT) AS weekday, CAST(range % 24 AS INT) AS hour FROM range(168)),
n AS (SELECT weekday, hour, count(*) AS c FROM h GROUP BY 1, 2)
SELECT weekday, hour, coalesce(c, 0) AS prompts FROM e LEFT JOIN n USING (weekday, hour)""")(lambda a: A.heatmap(a.prompts, "UTC"))
on("peak_hour", f"{HOURS}, n AS (SELECT hour, count(*) AS c FROM h GROUP BY 1) SELECT arg_max(hour, row(c, -hour)) AS peak_hour FROM n")(
    lambda a: A.peak_hour(a.prompts, "UTC")
)
on("night_weekend", f"{HOURS} SELECT count(*) FILTER (hour >= 20 OR hour <= 4) AS night, count(*) FILTER (weekday >= 5) AS weekend, count(*) AS prompts FROM h")(
    lambda a: A.prompt_hours(a.prompts, "UTC").agg(
        F.sum(F.when(F.col("hour").isin(*A.NIGHT_HOURS), F.col("prompts")).otherwise(0)).alias("night"),
        F.sum(F.when(F.col("weekday") >= 5, F.col("prompts")).otherwise(0)).alias("weekend"), F.sum("prompts").alias("prompts"),
    )
)
BUCKETS = """, o AS (SELECT *, lag(ts_start) OVER w AS before, lag(top_model) OVER w AS model_before FROM resp WINDOW w AS (PARTITION BY file_idx ORDER BY ts_start, final_key)),
bk AS (SELECT *, CASE WHEN before IS NULL THEN 'first' WHEN top_model <> model_before THEN 'modelSwitch' WHEN ts_start - before <= 300000 THEN 'le5m'
  WHEN ts_start - before <= 3600000 THEN 'm5to60' ELSE 'gt60m' END AS bucket FROM o)"""
on("idle_buckets", f"""{BUCKETS} SELECT bucket, count(*) AS responses, CAST(sum(nano_cw5m + nano_cw1h) AS BIGINT) AS write_nano,
  count(*) FILTER (t_miss) AS full_misses FROM (SELECT *, cache_read = 0 AND cw5m + cw1h > 20000 AS t_miss FROM bk) GROUP BY 1""")(
    lambda a: A.idle_buckets(a.priced).groupBy("bucket").agg(
        F.count("*").alias("responses"), F.sum("write_nano").alias("write_nano"), F.count_if("full_miss").alias("full_misses")
    )
)
on("tool_pairing", "SELECT id AS tool_use_id, name, status, error_category, session_id FROM calls")(
    lambda a: a.calls.select("tool_use_id", "name", "status", "error_category", "session_id")
)
on("tool_orphans", "SELECT id AS tool_use_id, is_error FROM results WHERE id NOT IN (SELECT id FROM uses)")(
    lambda a: a.orphans.select("tool_use_id", "is_error")
)
FAIL_RUNS = """, r0 AS (SELECT *, status IN ('shell_exit', 'failed') AS bad FROM calls WHERE status <> 'unpaired'),
r1 AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY file_idx, name ORDER BY ms, id ROWS UNBOUNDED PRECEDING) AS island FROM r0),
r2 AS (SELECT file_idx, name, island, count(*) AS c FROM r1 WHERE bad GROUP BY 1, 2, 3), fr AS (SELECT name, max(c) AS longest_fail_run FROM r2 GROUP BY 1)"""
on("fail_runs", f"{FAIL_RUNS} SELECT * FROM fr")(lambda a: tools.fail_runs(a.calls))
on("tool_table", f"""{FAIL_RUNS}, t AS (
  SELECT name, count(*) AS calls, count(*) FILTER (status <> 'unpaired') AS paired, count(*) FILTER (status = 'ok') AS ok,
    count(*) FILTER (status = 'denied') AS denied, count(*) FILTER (status = 'shell_exit') AS shell_exit, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (status = 'unpaired') AS unpaired FROM calls GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY shell_exit + failed DESC, name) AS nth, CASE WHEN paired > 0 THEN (shell_exit + failed) / paired ELSE 0.0 END AS failure_rate FROM t)
SELECT n.* EXCLUDE (nth), coalesce(longest_fail_run, 0) AS longest_fail_run,
  (calls >= 50 AND failure_rate >= 0.05) OR (shell_exit + failed > 0 AND nth <= 3) AS flagged FROM n LEFT JOIN fr USING (name)""")(
    lambda a: tools.tool_table(a.calls).drop("display_name", "name_class")
)
on("files_created", """, c AS (SELECT * FROM calls WHERE status = 'ok' AND name IN ('Edit', 'Write'))
SELECT path_hash, arg_min(name, row(ms, id)) AS first_tool, bool_or(name = 'Edit') AS edited FROM c GROUP BY 1""")(
    lambda a: tools.first_touches(a.calls)
)
on("churn", f""", ct AS (
  SELECT session_id, ms, id FROM calls UNION ALL SELECT session_id, ts_start, NULL FROM resp UNION ALL SELECT session_id, ts_end, NULL FROM resp),
cg AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY session_id ORDER BY ms) > {IDLE} THEN 1 ELSE 0 END AS fresh FROM ct),
cb AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ms) AS block FROM cg),
cd AS (SELECT path_hash, calls.session_id, block, count(*) AS n FROM calls JOIN (SELECT id, block FROM cb WHERE id IS NOT NULL) USING (id)
  WHERE status = 'ok' AND name IN ('Edit', 'Write') GROUP BY 1, 2, 3)
SELECT path_hash, CAST(sum(n) AS BIGINT) AS edits, max(n) AS most_in_block FROM cd GROUP BY 1""")(
    lambda a: tools.churn(tools.session_blocks(a.calls, a.priced, IDLE)).drop("label")
)
on("intent_counts", """, it AS (SELECT status, unnest(CASE WHEN k % 6 = 0 AND event_id % 3 = 0 THEN ['test'] WHEN k % 6 = 0 AND event_id % 3 = 1 THEN ['git_commit', 'build'] ELSE [] END) AS intent FROM calls)
SELECT intent, count(*) AS count, count(*) FILTER (status IN ('shell_exit', 'failed')) AS failures FROM it GROUP BY 1""")(
    lambda a: tools.intent_counts(a.calls)
)
on("episodes", """, e AS (SELECT DISTINCT session_id, ms FROM obs WHERE event_type = 'error' AND k >= 95),
eg AS (SELECT ms, ms - lag(ms) OVER (ORDER BY ms) AS gap FROM e)
SELECT ms AS ts_ms, CAST(hour(make_timestamp(ms * 1000)) AS INT) AS hour FROM eg WHERE gap IS NULL OR gap > 1800000""")(
    lambda a: A.episodes(a.refusals)
)
QUOTA = """, q AS (SELECT CAST(ms - ms % 86400000 AS DOUBLE) AS resets_at, ms, CASE k % 2 WHEN 0 THEN 'five_hour' ELSE 'seven_day' END AS t
  FROM obs WHERE event_type = 'error' AND k >= 90),
qw AS (SELECT resets_at, arg_min(t, row(ms, t)) AS limit_type, min(ms) AS first_reject_ms FROM q GROUP BY 1)"""
on("quota_windows", f"{QUOTA} SELECT * FROM qw")(lambda a: a.quota_windows)
on("lookback_value", f"""{QUOTA} SELECT count(*) AS responses, CAST(coalesce(sum(nano), 0) AS BIGINT) AS nano FROM resp
WHERE EXISTS (SELECT 1 FROM qw WHERE ts_start >= first_reject_ms - 18000000 AND ts_start < first_reject_ms)""")(
    lambda a: A.in_spans(a.priced, A.merged_spans(a.quota_windows), "ts_start").agg(
        F.count("*").alias("responses"), F.coalesce(F.sum("nano"), F.lit(0)).alias("nano")
    )
)
on("launch_folder", "SELECT session_id, home AS launch FROM launch")(lambda a: a.launch)
on("project_rules", """
SELECT CASE WHEN cwd = '/w/p1' OR starts_with(cwd, '/w/p1/') THEN '/w/p1' WHEN cwd = '/w/p2/sub' THEN '/w/p2/sub' WHEN cwd = '/w/p2' THEN '/w/p2' ELSE project_key END AS project_key,
  CASE WHEN cwd = '/w/p1' OR starts_with(cwd, '/w/p1/') THEN 'one' WHEN cwd = '/w/p2/sub' THEN 'sub' WHEN cwd = '/w/p2' THEN 'two'
    ELSE split_part(project_key, '/', -1) END AS project_label, count(*) AS responses FROM resp GROUP BY 1, 2""")(
    lambda a: projects.with_project(a.priced.drop("project_key", "project_label"), a.launch, RULES).groupBy("project_key", "project_label").agg(F.count("*").alias("responses"))
)
on("attribution_topk", """, n AS (
  SELECT 'agent' AS kind, 'a' || (user_id % 31) AS name, nano FROM resp WHERE user_id % 4 >= 2
  UNION ALL SELECT 'skill', 'k' || (event_id % 5), nano FROM resp WHERE event_id % 9 = 0),
s AS (SELECT kind, name, count(*) AS responses, CAST(sum(nano) AS BIGINT) AS nano FROM n GROUP BY 1, 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY nano DESC, name) AS INT) AS nth FROM s) WHERE nth <= 25""")(
    lambda a: G.attribution(a.priced)
)
on("delegation", f""", s AS (SELECT CAST(coalesce(sum(nano) FILTER (side), 0) AS BIGINT) AS side_nano, CAST(sum(nano) AS BIGINT) AS nano FROM resp)
SELECT side_nano, nano, {share('side_nano', 'nano')} AS side_share FROM s""")(lambda a: G.delegation(a.priced))
on("reprice", """, own AS (SELECT * FROM wparts WHERE side AND priced AND (starts_with(model, 'claude-opus-') OR starts_with(model, 'claude-fable-'))),
t AS (SELECT event_id, n_part, CASE WHEN geo_us THEN 11 ELSE 10 END AS m, * EXCLUDE (event_id, n_part) FROM own),
s AS (SELECT count(DISTINCT event_id) AS e, sum(n_part) AS a, sum(t_in * (2000 * m // 10) + t_out * (10000 * m // 10) + w5 * (2500 * m // 10) + w1 * (4000 * m // 10) + t_read * (200 * m // 10)) AS b FROM t)
SELECT e AS eligible_responses, CAST(coalesce(a, 0) AS BIGINT) AS eligible_nano, CAST(coalesce(b, 0) AS BIGINT) AS at_target_nano, CAST(coalesce(a - b, 0) AS BIGINT) AS difference_nano FROM s""")(
    lambda a: G.reprice(a.priced, a.prices)
)
on("net_saving", """, r AS (
  SELECT w5 + w1 + t_read AS n, CASE WHEN fast AND model = 'claude-opus-5' THEN f_input ELSE r_input END * CASE WHEN geo_us AND model <> 'claude-haiku-4-5' THEN 11 ELSE 10 END // 10 AS rate,
    n_5m + n_1h + n_read AS paid FROM wparts WHERE priced)
SELECT CAST(sum(n * rate) - sum(paid) AS BIGINT) AS net_saving_nano FROM r""")(
    lambda a: G.caching_saving(a.priced, a.prices)
)
on("effort_hist", """
SELECT CASE event_id % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'other' WHEN 4 THEN 'unset' ELSE 'max' END AS effort, count(*) AS responses
FROM resp GROUP BY 1""")(lambda a: G.efforts(a.priced))
on("thinking_share", "SELECT CASE WHEN sum(output) > 0 THEN least(sum(thinking) / sum(output), 1.0) END AS thinking_share FROM resp WHERE thinking IS NOT NULL")(
    lambda a: G.thinking_share(a.priced)
)
on("incomplete_band", """, fit AS (SELECT top_model, visible_chars, least(thinking, output) AS th, output FROM resp WHERE complete AND thinking IS NOT NULL AND output > 0),
fm AS (SELECT top_model, sum(visible_chars) AS c, sum(output - th) AS p, sum(th) AS t, sum(output) AS o FROM fit GROUP BY 1),
fp AS (SELECT sum(visible_chars) AS c, sum(output - th) AS p, sum(th) AS t, sum(output) AS o FROM fit),
m AS (SELECT top_model, c / p AS mc, t / o AS mt FROM fm WHERE c > 0 AND p > 0 AND t < o), pp AS (SELECT c / p AS pc, t / o AS pt FROM fp WHERE c > 0 AND p > 0 AND t < o),
op AS (SELECT resp.*, coalesce(mc, pc) AS cc, coalesce(mt, pt) AS tt FROM resp LEFT JOIN m USING (top_model) LEFT JOIN pp ON true WHERE NOT complete AND visible_chars > 0),
b AS (SELECT floor(visible_chars / cc) AS low, floor(visible_chars / cc / (1 - tt)) AS high,
  coalesce(CASE WHEN op.fast AND has_fast THEN f_out ELSE r_out END * CASE WHEN op.geo_us AND geo THEN 11 ELSE 10 END // 10, 0) AS rate
  FROM op LEFT JOIN price ON price.model = op.top_model WHERE cc IS NOT NULL)
SELECT CAST(sum(low) AS BIGINT) AS low_tokens, CAST(sum(high) AS BIGINT) AS high_tokens, CAST(sum(low * rate) AS BIGINT) AS low_nano, CAST(sum(high * rate) AS BIGINT) AS high_nano FROM b""")(
    lambda a: G.incomplete_band(a.priced, a.prices)
)
on("orphan_days", f""", main AS (SELECT DISTINCT {day('ms')} AS day FROM act WHERE file_class = 'main' UNION SELECT {day('ms')} FROM prm)
SELECT DISTINCT {day('ms')} AS day FROM act WHERE file_class <> 'main' EXCEPT SELECT day FROM main""")(lambda a: A.orphan_days(a.activity, a.prompts, "UTC"))
on("fill_days", f""", n AS (SELECT {day('ms')} AS day, count(*) AS c FROM prm GROUP BY 1), e AS (SELECT min(CAST(day AS DATE)) AS a, max(CAST(day AS DATE)) AS b FROM n),
s AS (SELECT strftime(unnest(generate_series(CAST(greatest(a, b - 999) AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM e)
SELECT day, coalesce(c, 0) AS prompts FROM s LEFT JOIN n USING (day)""")(lambda a: A.fill_days(A.prompt_days(a.prompts, "UTC"), "prompts"))
on("workflow_counts", """
SELECT count(*) FILTER (k % 4 = 0) AS launched, count(*) FILTER (k % 4 = 1) AS started, count(*) FILTER (k % 4 = 2) AS result, count(*) FILTER (k % 4 = 3) AS failed
FROM obs WHERE event_type = 'view' AND user_id % 4 = 3""")(lambda a: G.workflow_counts(a.tables["workflow"]))
COST = """, cs AS (SELECT session_id, min(ms) AS start_ms, max(ms) AS last_ms, 1000000 * (1 + any_value(user_id) % 9) AS reported_nano FROM obs GROUP BY session_id, ms - ms % 86400000)"""
on("cost_windows", f"""{COST}, j AS (SELECT cs.session_id, start_ms, last_ms, reported_nano, count(resp.final_key) AS responses, coalesce(sum(nano), 0) AS nano FROM cs
  LEFT JOIN resp ON resp.session_id = cs.session_id AND ts_start BETWEEN start_ms AND last_ms GROUP BY 1, 2, 3, 4)
SELECT session_id, start_ms, last_ms, CAST(reported_nano AS BIGINT) AS reported_nano, responses, CAST(nano AS BIGINT) AS nano, CAST(nano AS DOUBLE) / CAST(reported_nano AS DOUBLE) AS ratio FROM j""")(
    lambda a: G.cost_ratios(a.cost_windows, a.priced).withColumn("reported_nano", F.col("reported_nano").cast("long"))
)
on("secret_findings", """, s AS (SELECT *, CASE k % 3 WHEN 0 THEN 'aws_access_key' WHEN 1 THEN 'github_pat' ELSE 'jwt' END AS secret_type,
  substr(sha256(CAST(user_id % 40 AS VARCHAR)), 1, 12) AS fingerprint12, CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END AS rank,
  CASE k % 5 WHEN 0 THEN true WHEN 1 THEN false END AS expired FROM obs WHERE event_type = 'purchase')
SELECT secret_type, fingerprint12, CASE min(rank) WHEN 0 THEN 'critical' ELSE 'likely_fixture' END AS severity, count(*) AS copies,
  CAST(count(DISTINCT file_idx) AS INT) AS files, max(ms) AS newest_ms,
  CASE WHEN bool_or(NOT coalesce(expired, true)) THEN false WHEN bool_and(coalesce(expired, false)) THEN true END AS expired FROM s GROUP BY 1, 2""")(
    lambda a: a.secrets.select("secret_type", "fingerprint12", "severity", "copies", "files", "newest_ms", "expired")
)
LEDGER = f""", lr AS (
  SELECT {day('ts_start')} AS day, substr(sha256(session_id), 1, 16) AS session16, CASE WHEN model = 'other-model' THEN 'other:' || substr(sha256(model), 1, 16) ELSE model END AS model,
    file_class, fast, geo_us, substr(sha256(project_key), 1, 16) AS project16, complete, t_in, t_out, w5, w1, t_read, n_part + CASE WHEN pos = 0 THEN web * 10000000 ELSE 0 END AS n FROM wparts)"""
on("ledger_rows", f"""{LEDGER} SELECT day, session16, model, file_class, fast, geo_us, project16, count(*) AS responses, count(*) FILTER (NOT complete) AS incomplete,
  CAST(sum(t_in) AS BIGINT) AS input, CAST(sum(t_out) AS BIGINT) AS output, CAST(sum(w5) AS BIGINT) AS cw5m, CAST(sum(w1) AS BIGINT) AS cw1h, CAST(sum(t_read) AS BIGINT) AS cache_read,
  CAST(sum(n) AS BIGINT) AS nano FROM lr GROUP BY ALL""")(lambda a: L.ledger_rows(a.priced, "UTC"))
UNITS = f"""{LEDGER}, u1 AS (SELECT day, session16, count(*) AS responses, sum(n) AS nano FROM lr GROUP BY 1, 2),
u2 AS (SELECT {day('ms')} AS day, substr(sha256(session_id), 1, 16) AS session16, count(*) AS calls, count(*) FILTER (status IN ('failed', 'shell_exit')) AS failed_calls FROM calls GROUP BY 1, 2),
u3 AS (SELECT {day('ms')} AS day, substr(sha256(session_id), 1, 16) AS session16, count(*) AS prompts FROM prm GROUP BY 1, 2),
dm AS (SELECT DISTINCT session_id, ms FROM act), dg AS (SELECT *, ms - lag(ms) OVER (PARTITION BY session_id ORDER BY ms) AS gap FROM dm),
u4 AS (SELECT {day('ms')} AS day, substr(sha256(session_id), 1, 16) AS session16, sum(gap) AS active_ms FROM dg WHERE gap <= {IDLE} GROUP BY 1, 2),
un AS MATERIALIZED (SELECT day, session16, coalesce(responses, 0) AS responses, CAST(coalesce(nano, 0) AS BIGINT) AS nano, coalesce(calls, 0) AS calls, coalesce(failed_calls, 0) AS failed_calls,
  coalesce(prompts, 0) AS prompts, CAST(coalesce(active_ms, 0) AS BIGINT) AS active_ms, substr(day, 1, 7) AS month
  FROM u1 FULL JOIN u2 USING (day, session16) FULL JOIN u3 USING (day, session16) FULL JOIN u4 USING (day, session16))"""


def units(a: Accounting) -> DataFrame:
    return plain(L.ledger_units(a.priced, a.calls, a.prompts, a.activity, IDLE, "UTC"))


on("ledger_units", f"{UNITS} SELECT * FROM un")(units)
# A ledger that holds the odd days with one response more, as if later lines had been deleted since, and no value.
on("ledger_merge", f"""{UNITS}, held AS (SELECT *, responses + CASE WHEN CAST(substr(day, 9, 2) AS INT) % 2 = 1 THEN 1 ELSE -1 END AS r2 FROM un WHERE CAST(substr(day, 9, 2) AS INT) % 3 <> 0)
SELECT un.day, un.session16, CASE WHEN r2 > un.responses THEN r2 ELSE un.responses END AS responses, CASE WHEN r2 > un.responses THEN 0 ELSE un.nano END AS nano
FROM un LEFT JOIN held USING (day, session16)""")(
    lambda a: L.merge_units(
        units(a).where("cast(substr(day, 9, 2) as int) % 3 <> 0")
        .withColumn("responses", F.expr("responses + if(cast(substr(day, 9, 2) as int) % 2 = 1, 1, -1)"))
        .withColumn("nano", F.lit(0).cast("long")),
        units(a),
    ).select("day", "session16", "responses", "nano")
)
on("ledger_totals", f"""{UNITS} SELECT count(DISTINCT day) AS days, count(DISTINCT session16) AS sessions, CAST(sum(responses) AS BIGINT) AS responses, CAST(sum(prompts) AS BIGINT) AS prompts,
  CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(failed_calls) AS BIGINT) AS failed_calls, CAST(sum(active_ms) AS BIGINT) AS active_ms, CAST(sum(nano) AS BIGINT) AS nano FROM un""")(
    lambda a: L.ledger_totals(units(a))
)
on("redact_labels", f""", p AS (SELECT project_key, sum(nano) AS nano FROM resp GROUP BY 1), r AS (SELECT project_key, row_number() OVER (ORDER BY nano DESC, project_key) AS nth FROM p)
SELECT project_key, 'project ' || CASE WHEN nth <= 26 THEN chr(CAST(64 + nth AS INT)) ELSE chr(CAST(64 + (nth - 1) // 26 AS INT)) || chr(CAST(65 + (nth - 1) % 26 AS INT)) END AS label FROM r""")(
    lambda a: G.redacted(a.by_project, "project_key", "project")
)

on("top_tool", """, t AS (SELECT CASE WHEN starts_with(name, 'mcp__') THEN 'MCP tools' ELSE name END AS tool, count(*) AS calls FROM calls GROUP BY 1)
SELECT arg_max(tool, row(calls, -list_position(['Bash', 'PowerShell', 'Read', 'Write', 'Edit', 'MultiEdit', 'NotebookEdit', 'Grep', 'Glob', 'WebFetch', 'MCP tools'], tool))) AS tool, max(calls) AS calls FROM t""")(
    lambda a: O.top_tool(a.calls)
)
on("top_model", "SELECT model, CAST(sum(n_part) AS BIGINT) AS nano FROM wparts GROUP BY 1 HAVING sum(n_part) > 0 ORDER BY 2 DESC, 1 LIMIT 1")(
    lambda a: O.top_model(G.by_model(a.priced))
)
on("agent_versions", "SELECT DISTINCT '1.0' AS agent_version FROM act")(lambda a: O.agent_versions(a.tables["activity"]))
on("cost_ratio_summary", f"""{COST}, j AS (SELECT cs.session_id, start_ms, last_ms, reported_nano, coalesce(sum(nano), 0) AS nano FROM cs
  LEFT JOIN resp ON resp.session_id = cs.session_id AND ts_start BETWEEN start_ms AND last_ms GROUP BY 1, 2, 3, 4),
r AS (SELECT CAST(nano AS DOUBLE) / CAST(reported_nano AS DOUBLE) AS ratio FROM j)
SELECT count(*) AS windows, CAST(median(ratio) AS DOUBLE) AS median_ratio, min(ratio) AS least_ratio, max(ratio) AS largest_ratio FROM r""")(
    lambda a: O.ratio_summary(G.cost_ratios(a.cost_windows, a.priced))
)
USD = "printf('%d.%06d', CAST(n // 1000000000 AS BIGINT), CAST((n % 1000000000 + 500) // 1000 AS BIGINT))"
on("export_by_day", f"""SELECT day, responses, input, output, cw5m, cw1h, cache_read, CASE WHEN (n % 1000000000 + 500) // 1000 = 1000000
  THEN printf('%d.000000', CAST(n // 1000000000 + 1 AS BIGINT)) ELSE {USD} END AS usd FROM (
  SELECT {day('ts_start')} AS day, {MEASURES}, sum(nano) AS n FROM resp GROUP BY 1)""")(lambda a: O.export(a, "day"))
on("secret_locations", """SELECT CASE k % 3 WHEN 0 THEN 'aws_access_key' WHEN 1 THEN 'github_pat' ELSE 'jwt' END AS secret_type,
  substr(sha256(CAST(user_id % 40 AS VARCHAR)), 1, 12) AS fingerprint12, rel_path, len(list(DISTINCT event_id)) AS lines FROM obs WHERE event_type = 'purchase' GROUP BY 1, 2, 3""")(
    lambda a: O.secret_locations(a.tables["secret"], a.files).withColumn("lines", F.size("lines").cast("long"))
)

HABITS = f""", oc AS (SELECT count(*) FILTER (status = 'ok' AND name = 'Edit') AS e, count(*) FILTER (status = 'ok' AND name = 'Write') AS w,
  count(*) FILTER (name IN ('Read', 'WebFetch')) AS r, count(*) FILTER (name = 'Bash') AS b, count(*) AS n, median(k % 15) FILTER (status = 'ok' AND name = 'Edit') AS m FROM calls),
fc AS (SELECT arg_min(name, row(ms, id)) AS t FROM calls WHERE status = 'ok' AND name IN ('Edit', 'Write') GROUP BY path_hash),
sd AS (SELECT coalesce(sum(nano) FILTER (side), 0) AS a, sum(nano) AS b FROM resp),
hb AS MATERIALIZED (SELECT 'conductor' AS field, {share('a', 'b')} AS value FROM sd UNION ALL SELECT 'surgeon', CASE WHEN e + w > 0 THEN e / (e + w) ELSE 0 END FROM oc
  UNION ALL SELECT 'builder', CASE WHEN e + w > 0 THEN w / (e + w) ELSE 0 END FROM oc UNION ALL SELECT 'researcher', CASE WHEN n > 0 THEN r / n ELSE 0 END FROM oc
  UNION ALL SELECT 'operator', CASE WHEN n > 0 THEN b / n ELSE 0 END FROM oc UNION ALL SELECT 'median_edit_lines', CAST(m AS DOUBLE) FROM oc
  UNION ALL SELECT 'files_created', count(*) FILTER (t = 'Write') FROM fc)"""
on("habits", f"{HABITS} SELECT field, CAST(value AS DOUBLE) AS value FROM hb")(lambda a: R.habits(a))
on("archetype", f"""{HABITS}, th AS (SELECT * FROM (VALUES (0, 'conductor', 0.25), (1, 'surgeon', 0.6), (2, 'builder', 0.6), (3, 'researcher', 0.4), (4, 'operator', 0.45)) t(nth, field, least)),
sc AS (SELECT nth, field, value / CAST(least AS DOUBLE) AS score FROM hb JOIN th USING (field) WHERE value / CAST(least AS DOUBLE) >= 1
  AND (field <> 'surgeon' OR (SELECT value FROM hb WHERE field = 'median_edit_lines') <= 10) AND (field <> 'builder' OR (SELECT value FROM hb WHERE field = 'files_created') >= 50))
SELECT coalesce(arg_max(field, row(score, -nth)), 'generalist') AS archetype, max(score) AS score FROM sc""")(lambda a: R.archetype(R.habits(a)))
PATTERNS = f"""{HOURS}, pd AS (SELECT DISTINCT CAST({day('ms')} AS DATE) AS d FROM prm), pi AS (SELECT d - CAST(row_number() OVER (ORDER BY d) AS INT) AS island FROM pd),
pn AS (SELECT count(*) AS c FROM pi GROUP BY island), ca AS (SELECT sum(t_read) AS r, sum(t_in + w5 + w1 + t_read) AS n FROM wparts),
pf AS (SELECT 'night-shift' AS field, count(*) FILTER (hour >= 20 OR hour <= 4) / count(*) AS value FROM h UNION ALL SELECT 'weekend-builder', count(*) FILTER (isodow(d) >= 6) / count(*) FROM pd
  UNION ALL SELECT 'streak', max(c) FROM pn UNION ALL SELECT 'cache-pro', {share('r', 'n')} FROM ca UNION ALL SELECT 'wall-hitter', count(*) FROM qw)"""
on("pattern_figures", f"{QUOTA} {PATTERNS} SELECT field, CAST(value AS DOUBLE) AS value FROM pf")(lambda a: R.pattern_figures(a, rate_limits=True))
on("badges", f"""{QUOTA} {PATTERNS}, th AS (SELECT * FROM (VALUES (0, 'night-shift', 0.35), (1, 'weekend-builder', 0.3), (2, 'streak', 14.0), (3, 'cache-pro', 0.9), (4, 'wall-hitter', 5.0)) t(nth, field, least))
SELECT CAST(nth AS INT) AS nth, field AS badge FROM pf JOIN th USING (field) WHERE value >= CAST(least AS DOUBLE)""")(lambda a: R.badges(R.pattern_figures(a, rate_limits=True)))
on("heat_levels", f"""{HOURS}, e AS (SELECT CAST(range // 24 AS INT) AS weekday, CAST(range % 24 AS INT) AS hour FROM range(168)),
n AS (SELECT weekday, hour, count(*) AS c FROM h GROUP BY 1, 2), f AS (SELECT weekday, hour, coalesce(c, 0) AS c FROM e LEFT JOIN n USING (weekday, hour))
SELECT weekday, hour, CASE WHEN c = 0 THEN 0 ELSE greatest(1, CAST(ceil(4 * sqrt(c / (SELECT max(c) FROM f)) - 1e-9) AS INT)) END AS level FROM f""")(lambda a: R.heat_levels(a))
on("ledger_checked", f"""{UNITS}, bad AS (SELECT day, session16, CASE WHEN responses % 5 = 0 THEN -1 ELSE responses END AS responses, CASE WHEN day LIKE '%7' THEN '0000-00' ELSE month END AS month FROM un)
SELECT day, session16, 'responses' AS rule FROM bad WHERE responses < 0 UNION ALL SELECT day, session16, 'month' FROM bad WHERE month <> substr(day, 1, 7)
UNION ALL SELECT day, session16, 'failed_of_calls' FROM un WHERE failed_calls > calls""")(
    lambda a: checks.ledger_problems(
        units(a).withColumn("responses", F.expr("if(responses % 5 = 0, -1L, responses)")).withColumn("month", F.expr("if(day like '%7', '0000-00', month)"))
    )
)
on("secret_folders", """, s AS (SELECT DISTINCT CASE k % 3 WHEN 0 THEN 'aws_access_key' WHEN 1 THEN 'github_pat' ELSE 'jwt' END AS secret_type,
  substr(sha256(CAST(user_id % 40 AS VARCHAR)), 1, 12) AS fingerprint12, session_id FROM obs WHERE event_type = 'purchase')
SELECT secret_type, fingerprint12, string_agg(DISTINCT home, ',' ORDER BY home) AS folders FROM s LEFT JOIN launch USING (session_id) GROUP BY 1, 2""")(
    lambda a: checks.secret_folders(a.secrets, a.launch).withColumn("folders", F.array_join("folders", ","))
)

#: Over other tables: (tables, Spark SQL or function, DuckDB SQL).
OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def over(name: str, sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        OTHER[name] = (f, sql)
        return f

    return add


@over("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _json_props(spark, d):
    from loomtally.functions import variant as V

    v = F.try_parse_json("props")
    return _table(spark, d, "events").select("event_id", V.count_or_null(v, "k").alias("k"))


@over("line_counts", "SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS lines FROM documents")
def _line_counts(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.count_lines(F.col("text")).alias("lines"))


@over("prompts_text", "SELECT conv_id, count(*) AS prompts, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE role = 'user' AND NOT starts_with(text, '[Request interrupted by user') GROUP BY 1")
def _prompts_text(spark, d):
    rows = _table(spark, d, "conversations").where((F.col("role") == "user") & ~F.col("text").startswith("[Request interrupted by user"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("prompts"), F.sum(F.length("text")).cast("long").alias("chars"))


# The patterns of functions.text once more, as DuckDB writes them.
_E = {
    "edit_string_not_found": r"string to replace not found|old_string (was )?not found|no match(es)? found for old_string",
    "file_not_read_first": r"has not been read yet|read (it|the file) first|must (first )?read .{0,40}before",
    "user_rejected": r"user (doesn''t|does not) want|rejected by (the )?user|user rejected|user denied",
    "permission_or_hook": r"permission|not permitted|not allowed|access (is )?denied|\bdenied\b|\bhook\b|\bblocked\b",
    "timeout": r"timed? ?out|\btimeout\b", "not_found": r"not found|no such file|does not exist|ENOENT|cannot find|could not find|not recognized",
}
_CASES = " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{k}'" for k, p in _E.items())


@over("error_categories", f"SELECT error_category, count(*) AS n FROM (SELECT CASE {_CASES} ELSE 'other' END AS error_category FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def _error_categories(spark, d):
    rows = _table(spark, d, "documents").where("text is not null")
    return rows.groupBy(T.error_category(F.lit(None).cast("string"), F.col("text")).alias("error_category")).agg(F.count("*").alias("n"))


@over("path_hash", r"SELECT doc_id, sha256(lower(replace('C:\Work\' || source || '\' || doc_id, '\', '/'))) AS path_hash, source || '/' || doc_id AS label FROM documents WHERE source IS NOT NULL")
def _path_hash(spark, d):
    rows = _table(spark, d, "documents").where("source is not null")
    p = F.concat(F.lit("C:\\Work\\"), F.col("source"), F.lit("\\"), F.col("doc_id").cast("string"))
    return rows.select("doc_id", F.sha2(T.normalize_path(p), 256).alias("path_hash"), T.path_label(p).alias("label"))


@over("model_norm", r"SELECT DISTINCT regexp_replace(regexp_replace(p_brand || '-20250101[1m]', '\[[^\]]*\]$', ''), '-[0-9]{8}$', '') AS model FROM part")
def _model_norm(spark, d):
    return _table(spark, d, "part").select(T.normalize_model(F.concat("p_brand", F.lit("-20250101[1m]"))).alias("model")).distinct()


@over("rev_by_nation", """
SELECT n_name, count(*) AS lines, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def _rev_by_nation(spark, d):
    t = {n: _table(spark, d, n) for n in ("lineitem", "orders", "customer", "nation")}
    cents = F.round(F.col("l_extendedprice") * 100).cast("long") * (100 - F.round(F.col("l_discount") * 100).cast("long"))
    return (
        t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name").agg(F.count("*").alias("lines"), F.sum(cents).alias("revenue"))
    )


@over("semi_orders", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
def _semi_orders(spark, d):
    back = _table(spark, d, "lineitem").where("l_returnflag = 'R'")
    kept = _table(spark, d, "orders").join(back, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@over("anti_customers", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def _anti_customers(spark, d):
    urgent = _table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return _table(spark, d, "customer").join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@over("topk_lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def _topk_lineitem(spark, d):
    rows = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25)


@over("union_except", "(SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def _union_except(spark, d):
    a = _table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"))
    b = _table(spark, d, "supplier").select("s_nationkey")
    return a.union(b).distinct().subtract(_table(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey"))


_SCANNED = " UNION ALL ".join(
    f"""SELECT doc_id, '{k}' AS secret_type, '^{h}({b})' AS inner_, text, regexp_extract_all(text, '{e}{h}{b}{t}{z}') AS vs, string_split_regex(text, '{e}{h}{b}{t}{z}') AS ps
    FROM planted WHERE regexp_matches(text, '{e}{h}{b}{t}{z}')"""
    for k, h, b, t in S.FORMATS for e, z in [("" if k == "private_key" else r"\b", r"\b" if k in S.EXACT else "")]
)


# The driver's documents hold no value of these formats, so half of them get a made-up one at their end, every other of those called an example.
_PLANTED = """CASE doc_id % 4 WHEN 0 THEN concat(text, ' hf_', md5(CAST(doc_id AS {0}))) WHEN 1 THEN concat(text, ' example npm_', md5(CAST(doc_id AS {0})), 'wxyz') ELSE text END"""


@over("secrets_scan", f"""WITH planted AS (SELECT doc_id, {_PLANTED.format("VARCHAR")} AS text FROM documents), f AS ({_SCANNED}),
e AS (SELECT *, unnest(range(1, len(vs) + 1)) AS i FROM f),
p AS (SELECT doc_id, secret_type, i, vs[i] AS v, inner_, text, sum(length(ps[i]) + length(vs[i])) OVER (PARTITION BY doc_id, secret_type ORDER BY i) - length(vs[i]) AS a FROM e),
n AS (SELECT doc_id, secret_type, i, v, regexp_extract(v, inner_, 1) AS body,
  substr(text, CAST(greatest(a - 150, 0) + 1 AS BIGINT), CAST(least(a, 150) AS BIGINT)) || chr(10) || substr(text, CAST(a + length(v) + 1 AS BIGINT), 150) AS near FROM p),
c AS (SELECT doc_id, secret_type, i, unnest(string_split(body, '')) AS c, length(body) AS n FROM n),
h AS (SELECT doc_id, secret_type, i, -sum(k / n * log2(k / n)) AS entropy FROM (SELECT doc_id, secret_type, i, c, any_value(n) AS n, count(*) AS k FROM c GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
SELECT doc_id, secret_type, substr(sha256(v), 1, 12) AS fingerprint12,
  CASE WHEN entropy >= 3.2 AND NOT regexp_matches(near, '{S.FIXTURE}') THEN 'critical' ELSE 'likely_fixture' END AS severity,
  count(*) AS copies FROM n JOIN h USING (doc_id, secret_type, i) GROUP BY 1, 2, 3, 4""")
def _secrets_scan(spark, d):
    texts = _table(spark, d, "documents").select("doc_id", F.expr(_PLANTED.format("STRING")).alias("text"), F.lit("user_text").alias("place"), F.lit(None).cast("string").alias("tool_name"))
    return S.findings(texts).groupBy("doc_id", "secret_type", "fingerprint12", "severity").agg(F.count("*").alias("copies"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: (lambda spark, d, f=f: plain(f(accounting(spark, d)))) for k, f in FOUND.items()}
    return own | {k: f for k, (f, _) in OTHER.items()}


def oracle_sql() -> dict[str, str]:
    return dict(TWINS) | {k: sql for k, (_, sql) in OTHER.items() if sql}
