"""What a report shows: sections, habits, badges, and the summary that may be published.

Tables here have a row for each field or section, so they join nothing and stay
small however many transcripts there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtally.functions import clock
from loomtally.functions import text as T
from loomtally.functions.money import share
from loomtally.operators import activity as A
from loomtally.operators import aggregate as G
from loomtally.operators import tools
from loomtally.plans import outputs
from loomtally.plans.accounting import Accounting

# Habits in the order that breaks ties, with their thresholds; shares of value from which sections are shown.
ARCHETYPES = (("conductor", 0.25), ("surgeon", 0.60), ("builder", 0.60), ("researcher", 0.40), ("operator", 0.45))
GENERALIST = "generalist"
MEDIAN_EDIT_LINES, FILES_CREATED = 10, 50
BADGES = (("night-shift", 0.35), ("weekend-builder", 0.30), ("streak", 14.0), ("cache-pro", 0.90), ("wall-hitter", 5.0))
SHOW_IDLE, SHOW_SIDE, SHOW_REPRICE, SHOW_STARTED = 5, 5, 20, 10
HEAT_LEVELS = 4
RESEARCH = ("WebFetch", "WebSearch", "Read", "Grep", "Glob")
NANO = 10**9


def _field(df: DataFrame, name: str, value: Column) -> DataFrame:
    """One row: field, value as a double."""
    return df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("field"), "value")


def _rows(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _part(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


def habits(a: Accounting) -> DataFrame:
    """field, value: the figures that habits are told from."""
    name, ok = F.col("name"), F.col("status") == "ok"
    edits, writes = F.count_if(ok & name.isin("Edit", "MultiEdit")), F.count_if(ok & (name == "Write"))
    called = a.calls.agg(
        _part(edits, edits + writes).alias("surgeon"), _part(writes, edits + writes).alias("builder"),
        _part(F.count_if(name.isin(*RESEARCH)), F.count("*")).alias("researcher"),
        _part(F.count_if(name.isin(*T.SHELL_TOOLS)), F.count("*")).alias("operator"),
        F.median(F.when(ok & name.isin(*T.EDIT_TOOLS), F.col("edit_lines"))).cast("double").alias("median_edit_lines"),
    )
    shares = called.unpivot([], called.columns, "field", "value")
    created = _field(tools.first_touches(a.calls), "files_created", F.count_if(F.col("first_tool").isin(*T.WRITE_TOOLS)))
    return _rows([_field(G.delegation(a.priced), "conductor", F.max("side_share")), shares, created])


def archetype(figures: DataFrame) -> DataFrame:
    """The habit with the highest figure over its threshold, the first of equals; one of which none reaches it is a generalist."""
    at = F.map_from_entries(F.collect_list(F.struct("field", F.coalesce("value", F.lit(float("inf"))))))
    scored = []
    for nth, (name, least) in enumerate(ARCHETYPES):
        score = F.col("m")[name] / least
        fits = score >= 1
        if name == "surgeon":
            fits = fits & (F.col("m")["median_edit_lines"] <= MEDIAN_EDIT_LINES)
        if name == "builder":
            fits = fits & (F.col("m")["files_created"] >= FILES_CREATED)
        scored.append(F.when(fits, F.struct(score.alias("score"), F.lit(-nth).alias("o"), F.lit(name).alias("name"))))
    best = F.array_max(F.filter(F.array(*scored), lambda x: x.isNotNull()))
    return figures.agg(at.alias("m")).select(F.coalesce(best["name"], F.lit(GENERALIST)).alias("archetype"), best["score"].alias("score"))


def pattern_figures(a: Accounting, tz: str = "UTC", rate_limits: bool = False) -> DataFrame:
    """field, value: what badges are given for; quota windows only where they are asked for."""
    days = A.prompt_days(a.prompts, tz)
    hours = A.prompt_hours(a.prompts, tz)
    night = F.sum(F.when(F.col("hour").isin(*A.NIGHT_HOURS), F.col("prompts")).otherwise(0))
    hit = G.totals(a.priced)
    reads, all_in = F.max("cache_read"), F.max(F.col("input") + F.col("cw5m") + F.col("cw1h") + F.col("cache_read"))
    frames = [
        _field(hours, "night-shift", F.coalesce(_part(night, F.sum("prompts")), F.lit(0.0))),
        _field(days, "weekend-builder", F.coalesce(_part(F.count_if(F.weekday(F.to_date("day")) >= 5), F.count("*")), F.lit(0.0))),
        _field(A.streak(days), "streak", F.max("longest_streak")),
        _field(hit, "cache-pro", share(reads, all_in)),
    ]
    if rate_limits:
        frames.append(_field(a.quota_windows, "wall-hitter", F.count("*")))
    return _rows(frames)


def badges(figures: DataFrame) -> DataFrame:
    """Badges whose figure reaches the threshold, in their order: nth, badge."""
    spark = figures.sparkSession
    rules = spark.createDataFrame([(n, b, t) for n, (b, t) in enumerate(BADGES)], "nth int, field string, least double")
    return figures.join(F.broadcast(rules), "field").where("value >= least").select("nth", F.col("field").alias("badge")).orderBy("nth")  # five rules


def heat_levels(a: Accounting, tz: str = "UTC") -> DataFrame:
    """Weekday, hour and level: 0 without prompts, else 1 to 4 by the root of the share of the busiest hour; no rows without prompts."""
    cells = A.heatmap(a.prompts, tz).groupBy().agg(F.max("prompts").alias("most"), F.collect_list(F.struct("weekday", "hour", "prompts")).alias("c"))  # 168 cells
    each = cells.where("most > 0").select("most", F.inline("c"))
    level = F.greatest(F.lit(1), F.ceil(HEAT_LEVELS * F.sqrt(F.col("prompts") / F.col("most")) - 1e-9).cast("int"))
    return each.select("weekday", "hour", F.when(F.col("prompts") > 0, level).otherwise(0).alias("level"))


def sections(a: Accounting, tz: str = "UTC") -> DataFrame:
    """section, evidence, shown for each of the report's sections.

    Most are always shown; idle gaps, side work and repricing from a share of the
    value on, rate limits, hot files, workflows and secrets where there are any
    (workflows: ten started).
    """
    a.keep()
    idle = A.idle_buckets(a.priced)
    late = F.sum(F.when(F.col("bucket") == "gt60m", F.col("write_nano")))
    value = G.totals(a.priced).select(F.lit("value").alias("k"), F.col("nano").cast("decimal(38,0)").alias("n"))
    side = G.delegation(a.priced).select(F.lit("side").alias("k"), F.col("side_nano").cast("decimal(38,0)").alias("n"))
    priced_at = G.reprice(a.priced, a.prices)
    eligible = priced_at.select(F.lit("eligible").alias("k"), F.col("eligible_nano").cast("decimal(38,0)").alias("n"))
    gap = idle.agg(late.cast("decimal(38,0)").alias("n")).select(F.lit("idle").alias("k"), "n")
    nano = F.map_from_entries(F.collect_list(F.struct("k", F.coalesce("n", F.lit(0).cast("decimal(38,0)")))))
    counts = _rows([
        _field(a.priced, "i01", F.count("*")), _field(a.priced, "i02", F.count("*")),
        _field(idle, "i03", F.count_if(F.col("bucket") == "gt60m")),
        _field(a.priced, "i04", F.countDistinct(F.when(F.col("is_sidechain"), F.col("file_idx")))),
        _field(priced_at, "i05", F.max("eligible_responses")),
        _field(a.quota_windows.select(F.lit(1).alias("x")).unionByName(A.episodes(a.refusals, tz).select(F.lit(1).alias("x"))), "i06", F.count("*")),
        _field(a.calls, "i07", F.count("*")),
        _field(tools.churn(tools.session_blocks(a.calls, a.priced, a.options.idle_ms)), "i08", F.count_if(F.col("edits") >= tools.HOT_EDITS)),
        _field(a.prompts, "i09", F.count("*")), _field(G.workflow_counts(a.tables["workflow"]), "i10", F.max("started")),
        _field(a.secrets, "i11", F.count("*")),
        _field(a.activity, "i12", F.countDistinct(clock.local_day(F.col("ts_ms"), tz))),
        _field(a.priced, "i13", F.count("*")), _field(a.prompts, "i14", F.count("*")),
    ])
    c = F.map_from_entries(F.collect_list(F.struct("field", F.coalesce("value", F.lit(0.0)))))
    # A handful of sums and counts: each side is one row, brought together by a union.
    both = _rows([value, side, eligible, gap]).agg(nano.alias("m")).select("m", F.lit(None).cast("map<string,double>").alias("c")).unionByName(
        counts.agg(c.alias("c")).select(F.lit(None).cast("map<string,decimal(38,0)>").alias("m"), "c")
    ).agg(F.first("m", True).alias("m"), F.first("c", True).alias("c"))
    m, n = F.col("m"), F.col("c")

    def reaches(k: str, percent: int) -> Column:
        return (m["value"] > 0) & (m[k] * 100 >= m["value"] * percent)

    rule = {
        "i03": reaches("idle", SHOW_IDLE), "i04": reaches("side", SHOW_SIDE), "i05": reaches("eligible", SHOW_REPRICE) & (n["i05"] > 0),
        "i06": n["i06"] > 0, "i08": n["i08"] > 0, "i10": n["i10"] >= SHOW_STARTED, "i11": n["i11"] > 0,
    }
    each = [F.struct(F.lit(k).alias("section"), n[k].cast("long").alias("evidence"), rule.get(k, F.lit(True)).alias("shown")) for k in (f"i{i:02d}" for i in range(1, 15))]
    return both.select(F.inline(F.array(*each)))


def floor_two(nano: Column) -> Column:
    """Whole dollars of two significant figures, never more than there is."""
    dollars = F.floor(nano / NANO).cast("long")
    unit = F.pow(F.lit(10), F.greatest(F.length(dollars.cast("string")) - 2, F.lit(0))).cast("long")
    return dollars - dollars % unit


def public_summary(a: Accounting, tz: str = "UTC", rate_limits: bool = False, hide: tuple[str, ...] = ()) -> DataFrame:
    """field, value (text): all that may be published, no path, name, id or text of the user's among it.

    The value is shown, cut to two figures, where prices are known for 99 % of the
    tokens and it is a dollar at least. Models and tools go by their display names.
    """
    a.keep()
    cover = G.token_coverage(a.priced).select(F.struct("priced_tokens", "all_tokens").alias("t"), F.lit(None).cast("decimal(38,0)").alias("n"))
    total = G.totals(a.priced).select(F.lit(None).cast("struct<priced_tokens:bigint,all_tokens:bigint>").alias("t"), F.col("nano").cast("decimal(38,0)").alias("n"))
    t = F.col("t")
    known = (t["priced_tokens"] * 100 >= t["all_tokens"] * 99) & (t["all_tokens"] > 0) & (F.col("n") >= NANO)
    value = cover.select(F.col("t").cast("struct<priced_tokens:bigint,all_tokens:bigint>").alias("t"), "n").unionByName(total).agg(
        F.first("t", True).alias("t"), F.first("n", True).alias("n")
    ).select(F.lit("value").alias("field"), F.when(known, floor_two(F.col("n")).cast("string")).alias("value"))

    def one(df: DataFrame, field: str, c: Column) -> DataFrame:
        return df.agg(c.cast("string").alias("value")).select(F.lit(field).alias("field"), "value")

    day = clock.local_day(F.col("ts_ms"), tz)
    names = a.prices.select("model", "display_name")
    top_model = outputs.top_model(G.by_model(a.priced)).join(F.broadcast(names), "model", "left")  # a row per price
    figures = pattern_figures(a, tz, rate_limits)
    frames = [
        value,
        one(a.activity, "coverage_from", F.min(day)), one(a.activity, "coverage_to", F.max(day)),
        one(a.prompts, "active_days", F.countDistinct(day)),
        one(G.totals(a.priced), "output_tokens", F.max("output")),
        one(a.sessions, "active_hours", F.round(F.sum("active_ms") / 3_600_000, 1)),
        one(a.calls, "tool_calls", F.count("*")),
        one(outputs.top_tool(a.calls), "top_tool", F.max("tool")),
        one(top_model, "top_model", F.max(F.coalesce("display_name", F.lit("other model")))),
        one(G.delegation(a.priced), "delegation_share", F.round(F.max("side_share"), 4)),
        one(tools.churn(tools.session_blocks(a.calls, a.priced, a.options.idle_ms)), "most_edits_of_a_file", F.max("edits")),
        one(A.peak_hour(a.prompts, tz), "peak_hour", F.max("peak_hour")),
        one(archetype(habits(a)), "archetype", F.max("archetype")),
        one(badges(figures), "badges", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "badge"))), lambda x: x["badge"]), " ")),
        one(figures.where("field = 'cache-pro'"), "cache_hit_rate", F.round(F.max("value"), 4)),
        one(figures.where("field = 'streak'"), "longest_streak_days", F.max("value").cast("long")),
    ]
    out = _rows(frames)
    return out.where(~F.col("field").isin(*hide)) if hide else out


def leaks(published: DataFrame, private: DataFrame) -> DataFrame:
    """Strings of ``private`` (kind, needle) that occur in a published value, of four characters or more; empty when all is well.

    The published rows are a fixed few, so they go to every task of the private ones.
    """
    shown = published.where("value is not null").agg(F.array_join(F.collect_list(F.lower("value")), "\n").alias("all"))
    text = shown.first()["all"]  # a few dozen short values
    return private.where((F.length("needle") >= 4) & F.contains(F.lit(text), F.lower("needle"))).select("kind", "needle").distinct()


def private_strings(a: Accounting) -> DataFrame:
    """kind, needle: what must never be published: sessions, folders, labels, paths, agents and skills."""
    a.keep()
    frames = [
        a.activity.select(F.lit("session").alias("kind"), F.col("session_id").alias("needle")),
        a.launch.select(F.lit("folder").alias("kind"), F.col("launch").alias("needle")),
        a.by_project.select(F.lit("project").alias("kind"), F.col("project_label").alias("needle")),
        a.calls.select(F.lit("path").alias("kind"), F.col("path_label").alias("needle")),
        *(a.priced.select(F.lit(c).alias("kind"), F.col(c).alias("needle")) for c in ("agent", "skill", "mcp_server", "plugin")),
    ]
    return _rows(frames).where("needle is not null").distinct()
