"""The fourteen sections of a report as documents.

A section is registered with its title, what its evidence counts, its advice and a
function that gives parts: one-row DataFrames whose columns are fields of its data. Parts ask
``Facts`` for aggregates, which are worked out together: all groupings of priced
responses come from one pass with grouping sets. The parts of all sections are one
union of rows of JSON, put together by section and parsed into a VARIANT, so a document takes no join.
Money is a string of whole nanodollars; shares are floored to twelve decimals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtally.functions import clock
from loomtally.functions import text as T
from loomtally.functions.money import share, sum_big
from loomtally.operators import activity as A
from loomtally.operators import aggregate as G
from loomtally.operators import tools
from loomtally.operators.pricing import TOKENS
from loomtally.plans.accounting import Accounting
from loomtally.plans.summary import sections

# Names of fields that buckets and classes have in documents.
NAMED = {"input": "input", "output": "output", "cw5m": "cw5m", "cw1h": "cw1h", "cache_read": "cacheRead"}
IDLE_BUCKETS = ("first", "modelSwitch", "le5m", "m5to60", "gt60m")
TOP_FILES, DEFAULT_RETENTION, URGENT_DAYS = 10, 30, 60
STATUSES = ("ok", "denied", "shell_exit", "failed", "unpaired")
SEVERITIES = ("critical", "likely_fixture", "third_party_public")


def money(nano: Column) -> Column:
    return F.coalesce(nano.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).cast("string")


def in_order(order: list[Column], **fields: Column) -> Column:
    """An aggregate: the rows as objects of ``fields``, sorted by ``order``."""
    row = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.struct(*(c.alias(k) for k, c in fields.items())).alias("v"))
    return F.transform(F.sort_array(F.collect_list(row)), lambda x: x["v"])


def lettered(rows: Column, field: str, noun: str, hide: Callable[[Column], Column]) -> Column:
    """``rows`` with a letter in ``field`` of every row to hide, counted in order of the rows that are."""

    def named(x: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(rows, F.lit(1), i + 1), hide))
        return F.when(hide(x), x.withField(field, F.concat(F.lit(f"{noun} "), T.letters(nth)))).otherwise(x)

    return F.transform(rows, named)


class Facts:
    """Aggregates that sections ask for; each is a lazy table that is small beside the transcripts."""

    def __init__(self, a: Accounting, tz: str):
        self.a, self.tz = a, tz
        a.keep()

    @cached_property
    def groups(self) -> DataFrame:
        """Measures of priced responses over all, by class, day, month, project and side work: one pass, kept."""
        p = self.a.priced.withColumns({"day": clock.local_day(F.col("ts_start"), self.tz), "month": clock.local_month(F.col("ts_start"), self.tz)})
        keys = ("file_class", "day", "month", "project_key", "is_sidechain")
        found = p.groupingSets([[], *([F.col(k)] for k in keys)], *(F.col(k) for k in keys)).agg(
            F.grouping_id().alias("g"), *G.measures(), F.min("project_label").alias("project_label"), F.countDistinct("session_id").alias("sessions")
        )
        every = (1 << len(keys)) - 1
        of = {every: "all"} | {every ^ (1 << (len(keys) - 1 - i)): k for i, k in enumerate(keys)}
        told = F.create_map(*(F.lit(x) for pair in of.items() for x in pair))
        return found.withColumn("by", told[F.col("g").cast("int")]).persist()

    def by(self, key: str) -> DataFrame:
        return self.groups.where(F.col("by") == key)

    @cached_property
    def total(self) -> DataFrame:
        return self.by("all")

    @cached_property
    def models(self) -> DataFrame:
        return G.by_model(self.a.priced)

    @cached_property
    def blocks(self) -> DataFrame:
        return A.work_blocks(self.a.activity, "session_id", self.a.options.idle_ms)

    @cached_property
    def touched(self) -> DataFrame:
        return tools.churn(tools.session_blocks(self.a.calls, self.a.priced, self.a.options.idle_ms))

    @cached_property
    def asked(self) -> DataFrame:
        """One row: prompts, active days, interrupts."""
        days = F.countDistinct(clock.local_day(F.col("ts_ms"), self.tz)).alias("active_days")
        return self.a.prompts.agg(F.count("*").alias("prompts"), days).crossJoin(self.a.interrupts.agg(F.count("*").alias("interrupts")))


@dataclass(frozen=True)
class Section:
    title: str
    unit: str
    advice: str
    parts: Callable[[Facts], list[DataFrame]]


SECTIONS: dict[str, Section] = {}


def section(name: str, title: str, unit: str, advice: str):
    def add(f: Callable[[Facts], list[DataFrame]]) -> Callable[[Facts], list[DataFrame]]:
        SECTIONS[name] = Section(title, unit, advice, f)
        return f

    return add


def _models(f: Facts, df: DataFrame, **more: Column) -> DataFrame:
    """byModel, the dearest first; ids without a price get letters in a redacted report."""
    rows = in_order(
        [-F.col("nano"), F.col("model")], model=F.col("model"), displayName=F.col("display_name"), responses=F.col("responses"), valueNano=money(F.col("nano")), **more
    )
    found = df.agg(rows.alias("byModel"))
    if f.a.options.redact:
        found = found.withColumn("byModel", lettered(F.col("byModel"), "model", "Unpriced model", lambda x: x["displayName"].isNull()))
    return found


@section("i01", "Value of the work at list prices", "responses", "Hold the value of a usual month against the price of the plan.")
def _value(f: Facts) -> list[DataFrame]:
    a, total = f.a, f.total
    unpriced = G.unpriced(a.priced).agg(in_order([-F.col("tokens"), F.col("model")], model=F.col("model"), responses=F.col("responses"), tokens=F.col("tokens")).alias("unpriced"))
    projects = f.by("project_key").agg(
        in_order(
            [-F.col("nano"), F.col("project_key")],
            label=F.col("project_label"), valueNano=money(F.col("nano")), responses=F.col("responses"), sessions=F.col("sessions"),
        ).alias("byProject")
    )
    if a.options.redact:
        always = lambda x: F.lit(True)
        unpriced = unpriced.withColumn("unpriced", lettered(F.col("unpriced"), "model", "Unpriced model", always))
        projects = projects.withColumn("byProject", lettered(F.col("byProject"), "label", "Project", always))
    series = [
        f.by(k).where(F.col(k).isNotNull()).agg(
            in_order([F.col(k)], **{name: F.col(k)}, valueNano=money(F.col("nano")), responses=F.col("responses")).alias(field)
        )
        for k, name, field in (("month", "month", "byMonth"), ("day", "date", "byDay"))
    ]
    usd = a.options.plan_usd_per_month
    months = f.by("month").agg(F.count_if(F.col("month").isNotNull()).alias("months"))
    dollars = F.floor(F.col("nano") / 10_000_000).cast("double") / 100
    multiple = F.when(F.col("months") > 0, F.round(dollars / F.col("months") / F.lit(usd), 2)) if usd else F.lit(None).cast("double")
    plan = F.when(F.lit(bool(usd)), F.struct(F.lit(a.options.plan_name).alias("name"), F.lit(usd).cast("double").alias("usdPerMonth")))
    classes = [money(F.max(F.when(F.col("file_class") == c, F.col("nano")))).alias(c) for c in G.CLASSES]
    band = G.incomplete_band(a.priced, a.prices)
    return [
        total.select(
            money(F.col("nano")).alias("totalNano"), "responses", F.col("incomplete").alias("incompleteResponses"),
            share(F.col("incomplete"), F.col("responses")).alias("incompleteShare"),
        ),
        G.token_coverage(a.priced).select(
            F.col("priced_tokens").alias("pricedTokens"), F.col("all_tokens").alias("allTokens"), F.col("priced_share").alias("pricedTokenShare")
        ),
        unpriced,
        G.modifiers(a.priced).select(F.col("fast").alias("fastResponses")),
        total.crossJoin(f.asked).select(
            "prompts", F.when(F.col("prompts") > 0, F.expr("cast(nano div prompts as string)")).alias("valuePerPromptNano")
        ),
        *series,
        _models(f, f.models),
        projects,
        f.by("file_class").agg(F.struct(*classes).alias("byClassNano")),
        total.crossJoin(months).select(plan.alias("plan"), multiple.alias("valueMultiple")),
        band.select(
            F.struct(
                F.col("low_tokens").cast("long").alias("lowTokens"), F.col("high_tokens").cast("long").alias("highTokens"),
                money(F.col("low_nano")).alias("lowNano"), money(F.col("high_nano")).alias("highNano"),
            ).alias("incompleteBand")
        ),
    ]


@section("i02", "Which tokens the value is in", "responses", "Long outputs and writes to the cache weigh most; keep contexts short and sessions warm.")
def _buckets(f: Facts) -> list[DataFrame]:
    of = {b: F.col(f"nano_{b}") for b in TOKENS}
    five = reduce(lambda x, y: x + y, of.values())
    all_in = F.col("input") + F.col("cw5m") + F.col("cw1h") + F.col("cache_read")
    return [
        f.total.select(
            F.struct(*(money(of[b]).alias(n) for b, n in NAMED.items())).alias("bucketsNano"),
            F.struct(*(share(of[b], five).alias(n) for b, n in NAMED.items())).alias("bucketShares"),
            share(F.col("cache_read"), all_in).alias("cacheHitRate"),
            F.struct(
                "output", (F.col("input") + F.col("cw5m") + F.col("cw1h")).alias("freshInput"), F.col("cache_read").alias("cacheRead")
            ).alias("tokens"),
        ),
        G.caching_saving(f.a.priced, f.a.prices).select(money(F.col("net_saving_nano")).alias("netCachingSavingNano")),
    ]


@section("i03", "What pauses cost", "responses", "After an hour's pause the cache is gone: begin anew or sum up before going on.")
def _pauses(f: Facts) -> list[DataFrame]:
    b = F.col("bucket")
    each = [
        F.struct(F.count_if(b == n).alias("responses"), money(sum_big(F.when(b == n, F.col("write_nano")))).alias("cacheWriteNano")).alias(n) for n in IDLE_BUCKETS
    ]
    late = sum_big(F.when(b == "gt60m", F.col("write_nano"))).alias("late")
    missed = [F.count_if("full_miss").alias("fullMisses"), F.count_if(F.col("full_miss") & (b == "gt60m")).alias("fullMissesAfterGap60")]
    found = A.idle_buckets(f.a.priced).agg(F.struct(*each).alias("buckets"), late, *missed).crossJoin(f.total.select("nano"))
    return [found.select("buckets", share(F.col("late"), F.col("nano")).alias("gt60mShareOfTotal"), "fullMisses", "fullMissesAfterGap60")]


@section("i04", "Work done by side agents", "agent runs", "See which agents and skills take most and whether a smaller model would do for them.")
def _delegation(f: Facts) -> list[DataFrame]:
    side = G.delegation(f.a.priced).select(F.col("side_share").alias("delegationShare"), money(F.col("side_nano")).alias("sidechainNano"))
    of = lambda c: F.struct(
        F.coalesce(F.max(F.when(F.col("file_class") == c, F.col("responses"))), F.lit(0)).alias("responses"),
        money(F.max(F.when(F.col("file_class") == c, F.col("nano")))).alias("valueNano"),
    )
    runs = f.a.priced.where("file_class <> 'main'").agg(F.countDistinct("file_idx").alias("agentRuns"))
    kinds = {"agent": "agent", "skill": "skill", "mcp_server": "mcpServer"}
    named = G.attribution(f.a.priced)
    lists = []
    for k, name in kinds.items():
        own = F.when(F.col("kind") == k, F.struct((-F.col("nano")).alias("o"), F.col("name").alias("n"), F.struct("name", "responses", money(F.col("nano")).alias("valueNano")).alias("v")))
        rows = F.transform(F.sort_array(F.collect_list(own)), lambda x: x["v"])
        lists.append((lettered(rows, "name", k.replace("mcp_server", "server").capitalize(), lambda x: F.lit(True)) if f.a.options.redact else rows).alias(name))
    return [
        side, f.by("file_class").agg(of("subagent").alias("subagent"), of("workflow_agent").alias("workflowAgent")), runs,
        named.agg(*(x.alias(f"l{i}") for i, x in enumerate(lists))).select(F.struct(*(F.col(f"l{i}").alias(n) for i, n in enumerate(kinds.values()))).alias("byAttribution")),
    ]


@section("i05", "Side work at a smaller model's price", "responses", "Try the smaller model on a few of these tasks first; the tokens it needs may differ.")
def _repriced(f: Facts) -> list[DataFrame]:
    found = G.reprice(f.a.priced, f.a.prices).crossJoin(f.total.select("nano"))
    return [
        found.select(
            F.col("eligible_responses").alias("eligibleResponses"), money(F.col("eligible_nano")).alias("eligibleNano"),
            money(F.col("at_target_nano")).alias("atTargetNano"), money(F.col("difference_nano")).alias("differenceNano"),
            share(F.col("eligible_nano"), F.col("nano")).alias("eligibleShareOfTotal"),
            F.lit("The same tokens at other list prices; another model would use other tokens.").alias("label"),
        )
    ]


@section("i06", "Rate limits", "windows", "Spread heavy work over the day, or move it from the hours in which limits were hit.")
def _limits(f: Facts) -> list[DataFrame]:
    a = f.a
    kind = F.when(F.col("limit_type").rlike(r"^[a-z0-9_]{1,40}$"), F.col("limit_type")).otherwise("unknown")
    types = a.quota_windows.groupBy(kind.alias("t")).agg(F.count("*").alias("n"))
    hours = A.episodes(a.refusals, f.tz)
    by_hour = F.array(*(F.count_if(F.col("hour") == h) for h in range(24))).alias("episodeStartsByLocalHour")
    inside = A.in_spans(a.priced, A.merged_spans(a.quota_windows), "ts_start")
    before = G.parts_of(inside).where("priced").groupBy("model").agg(sum_big("nano").alias("nano"))
    return [
        a.quota_windows.agg(F.count("*").alias("windows")),
        types.agg(in_order([F.col("t")], rateLimitType=F.col("t"), windows=F.col("n")).alias("byType")),
        a.refusals.agg(F.count("ts_ms").alias("synthetic429Lines")),
        hours.agg(F.count("*").alias("episodes"), by_hour),
        before.agg(in_order([-F.col("nano"), F.col("model")], model=F.col("model"), valueNano=money(F.col("nano"))).alias("valueBeforeWindows")),
    ]


@section("i07", "Tool calls and how they ended", "tool calls", "Look first at the marked tools: each of their failures is a turn that did nothing.")
def _tools(f: Facts) -> list[DataFrame]:
    a = f.a
    table = tools.tool_table(a.calls)
    rows = in_order(
        [-F.col("calls"), F.col("name")],
        name=F.col("name"), displayName=F.col("display_name"), nameClass=F.col("name_class"), calls=F.col("calls"), paired=F.col("paired"),
        ok=F.col("ok"), denied=F.col("denied"), shellExit=F.col("shell_exit"), failed=F.col("failed"), unpaired=F.col("unpaired"),
        failureRate=F.col("failure_rate"), longestFailRun=F.col("longest_fail_run").cast("long"),
    )
    all_ = table.agg(rows.alias("byTool"), in_order([-F.col("calls"), F.col("name")], name=F.col("name"), c=F.col("name_class"), f=F.col("flagged")).alias("m"))
    if a.options.redact:
        for field in ("byTool", "m"):
            kind = "nameClass" if field == "byTool" else "c"
            for cls, noun in (("mcp", "MCP tool"), ("other", "Other tool")):
                all_ = all_.withColumn(field, lettered(F.col(field), "name", noun, lambda x, k=kind, v=cls: x[k] == v))
    marked = F.transform(F.filter("m", lambda x: x["f"]), lambda x: x["name"])
    n = lambda s: F.count_if(F.col("status") == s)
    bad, paired = n("shell_exit") + n("failed"), F.count_if(F.col("status") != "unpaired")
    shown = F.col("display_name")
    per = a.calls.withColumn("display_name", T.tool_display(F.col("name")))

    def counted(ok: Column) -> Column:
        each = F.array(*(F.struct(F.lit(d).alias("key"), F.count_if(ok & (shown == d)).alias("value")) for d in T.DISPLAY_NAMES))
        return F.map_from_entries(F.filter(each, lambda x: x["value"] > 0))

    best = F.array_max(F.array(*(F.struct(F.count_if(shown == d).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(T.DISPLAY_NAMES))))
    top = per.agg(best.alias("b"), F.count("*").alias("calls"))
    categories = F.struct(*(F.count_if(F.col("error_category") == c).alias(c) for c in T.ERROR_CATEGORIES))
    return [
        per.agg(
            F.count("*").alias("toolCalls"), paired.alias("paired"), F.struct(*(n(s).alias(s) for s in STATUSES)).alias("statusCounts"),
            F.when(paired > 0, bad / paired).otherwise(0.0).alias("failureRate"), categories.alias("errorCategories"),
            counted(F.lit(True)).alias("callsByDisplayName"), counted(F.col("status") == "ok").alias("okCallsByDisplayName"),
        ),
        all_.select("byTool", marked.alias("flagged")),
        top.select(
            F.when(F.col("b.n") > 0, F.struct(F.col("b.d").alias("displayName"), F.col("b.n").alias("calls"), (F.col("b.n") / F.col("calls")).alias("share"))).alias("topTool")
        ),
        f.asked.select("interrupts"),
    ]


@section("i08", "Files changed again and again", "files", "A file that is edited ten times over wants a plan, or a test, before the next edit.")
def _churn(f: Facts) -> list[DataFrame]:
    ranked = f.touched
    # Only the ten files of most edits are gathered.
    top = ranked.orderBy(F.desc("edits"), "path_hash").limit(TOP_FILES).agg(
        in_order([-F.col("edits"), F.col("path_hash")], label=F.coalesce("label", F.lit("unnamed file")), edits=F.col("edits")).alias("top")
    )
    if f.a.options.redact:
        top = top.withColumn("top", lettered(F.col("top"), "label", "File", lambda x: F.lit(True)))
    ok = (F.col("status") == "ok") & F.col("name").isin(*T.EDIT_TOOLS)
    zero = F.lit(0)
    return [
        ranked.agg(
            F.count("*").alias("distinctFiles"), F.count_if(F.col("edits") >= tools.HOT_EDITS).alias("filesWithTenPlusEdits"),
            F.coalesce(F.max("edits"), zero).alias("maxEditsOneFile"), F.coalesce(F.max("most_in_block"), zero).alias("maxEditsOneFileOneBlock"),
        ),
        top,
        f.a.calls.agg(F.median(F.when(ok, F.col("edit_lines"))).cast("double").alias("medianEditNewLines")),
    ]


@section("i09", "When the work is done", "prompts", "Long blocks and late hours are seen here; no advice follows from them.")
def _patterns(f: Facts) -> list[DataFrame]:
    a, tz = f.a, f.tz
    seconds = lambda c: F.floor(F.coalesce(c, F.lit(0)) / 1000).cast("long")
    hours = lambda c: F.round(seconds(c) / 3600, 1)
    days, heat = A.prompt_days(a.prompts, tz), A.heatmap(a.prompts, tz)
    night = F.sum(F.when(F.col("hour").isin(*A.NIGHT_HOURS), F.col("prompts")).otherwise(0))
    cells = F.sort_array(F.collect_list(F.struct("weekday", "hour", "prompts")))
    grid = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.transform(F.filter(cells, lambda x: x["weekday"] == d), lambda x: x["prompts"]))
    spent, agents = F.sum("active_ms"), F.sum("agent_ms")
    late = F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY duration_ms)")
    return [
        a.sessions.agg(seconds(spent).alias("activeSeconds"), hours(spent).alias("activeHours")),
        A.agent_time(a.activity, a.options.idle_ms).agg(seconds(agents).alias("agentSeconds"), hours(agents).alias("agentHours")),
        f.blocks.agg(
            F.count("*").alias("workBlocks"), seconds(F.max("duration_ms")).alias("longestBlockSeconds"),
            seconds(F.median("duration_ms")).alias("medianBlockSeconds"), seconds(late).alias("p90BlockSeconds"),
        ),
        f.asked.select("prompts", "interrupts", F.col("active_days").alias("activeDays")),
        A.streak(days).select(F.col("longest_streak").cast("long").alias("longestStreakDays")),
        A.peak_hour(a.prompts, tz).select(F.col("peak_hour").alias("peakHourLocal")),
        heat.agg(grid.alias("heatmap"), F.when(F.sum("prompts") > 0, night / F.sum("prompts")).otherwise(0.0).alias("nightPromptShare")),
        days.agg(
            F.when(F.count("*") > 0, F.count_if(F.weekday(F.to_date("day")) >= 5) / F.count("*")).otherwise(0.0).alias("weekendDayShare"),
            F.min("day").alias("firstActiveLocalDate"), F.max("day").alias("lastActiveLocalDate"),
        ),
    ]


@section("i10", "Workflows", "started", "Where many fail, run one agent alone before starting a group of them.")
def _workflows(f: Facts) -> list[DataFrame]:
    found = G.workflow_counts(f.a.tables["workflow"])
    return [found.select("*", F.when(F.col("started") > 0, F.col("failed") / F.col("started")).otherwise(0.0).alias("failureRate"))]


@section("i11", "Secrets in transcripts", "findings", "Change every secret marked critical; taking it out of the transcript does not.")
def _secrets(f: Facts) -> list[DataFrame]:
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    rows = in_order(
        [rank, F.col("newest_ms").isNull(), -F.col("newest_ms"), F.col("fingerprint12")],
        secretType=F.col("secret_type"), fingerprint12=F.col("fingerprint12"), copies=F.col("copies"), files=F.col("files").cast("long"),
        newestLocalDate=clock.local_day(F.col("newest_ms"), f.tz), severity=F.col("severity"), source=F.col("source"), expired=F.col("expired"),
    )
    by = F.struct(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    return [f.a.secrets.agg(rows.alias("findings"), by.alias("bySeverity"))]


@section("i12", "How far back transcripts reach", "days covered", "Keep the ledger, or longer transcripts, if old days are to be seen later.")
def _history(f: Facts) -> list[DataFrame]:
    o, day = f.a.options, lambda c: clock.local_day(F.col(c), f.tz)
    ends = A.coverage(f.a.activity).select(day("earliest_main").alias("m"), day("earliest_any").alias("e"), day("latest").alias("l"))
    covered = F.coalesce(F.date_diff(F.to_date("l"), F.to_date("e")) + 1, F.lit(0)).cast("long")
    days = F.array_distinct(F.array(*map(F.lit, o.stats_cache_days or ())).cast("array<string>"))
    lost = F.size(F.filter(days, lambda d: F.col("m").isNull() | (d < F.col("m")))).cast("long")
    main = f.a.priced.where("file_class = 'main'").select(clock.local_day(F.col("ts_start"), f.tz).alias("day"))
    main = main.unionByName(f.a.prompts.select(clock.local_day(F.col("ts_ms"), f.tz).alias("day"))).distinct()
    side = f.a.priced.where("file_class <> 'main' and ts_start is not null").select(clock.local_day(F.col("ts_start"), f.tz).alias("day")).distinct()
    own = o.cleanup_period_days
    return [
        ends.select(
            F.col("m").alias("earliestMainLocalDate"), F.col("e").alias("earliestAnyLocalDate"), F.col("l").alias("latestLocalDate"),
            covered.alias("coverageDays"), F.lit(own).cast("long").alias("cleanupPeriodDays"), F.lit(own is None).alias("retentionIsDefault"),
            F.lit(DEFAULT_RETENTION if own is None else own).cast("long").alias("effectiveRetentionDays"),
            (lost if o.stats_cache_days is not None else F.lit(None).cast("long")).alias("deletedHistoryDays"), (covered < URGENT_DAYS).alias("topOfReport"),
        ),
        side.join(main, "day", "left_anti").agg(F.count("*").alias("orphanDays")),
    ]


@section("i13", "Models", "responses", "Keep the dearest model for the work that needs it.")
def _by_model(f: Facts) -> list[DataFrame]:
    of = f.models.crossJoin(f.total.select(F.col("nano").alias("whole")))
    best = F.max_by(F.struct("model", F.col("display_name").alias("displayName")), F.struct("nano", F.lit(0)))
    first = f.models.where("nano > 0").orderBy(F.desc("nano"), "model").limit(1).agg(best.alias("topModel"))
    known = F.create_map(*(x for e in (*G.EFFORTS, "other", "unset") for x in (F.lit(e), F.coalesce(F.max(F.when(F.col("effort") == e, F.col("responses"))), F.lit(0)))))
    return [
        _models(f, of, share=share(F.col("nano"), F.col("whole"))),
        first,
        G.thinking_share(f.a.priced).select(F.col("thinking_share").alias("thinkingShare")),
        G.efforts(f.a.priced).agg(known.alias("effort")),
    ]


@section("i14", "Receipts", "prompts", "Figures to look back on; lines written are not lines that stayed.")
def _receipts(f: Facts) -> list[DataFrame]:
    a = f.a
    ok = F.col("status") == "ok"
    lines = F.when(ok & F.col("name").isin(*T.WRITE_TOOLS), F.coalesce("write_lines", F.lit(0))).when(ok & F.col("name").isin(*T.EDIT_TOOLS), F.coalesce("edit_lines", F.lit(0)))
    per = tools.intent_counts(a.calls)
    zero = F.lit(0).cast("long")
    intents = F.array(*(
        F.struct(
            F.lit(i).alias("intent"), F.coalesce(F.max(F.when(F.col("intent") == i, F.col("count"))), zero).alias("count"),
            F.coalesce(F.max(F.when(F.col("intent") == i, F.col("failures"))), zero).alias("failures"),
        ) for i in T.INTENTS
    ))
    shown = _models(f, f.models).select(F.array_distinct(F.transform("byModel", lambda x: F.coalesce(x["displayName"], x["model"]))).alias("models"))
    return [
        f.asked.select(F.col("active_days").alias("activeDays"), "prompts", "interrupts"),
        f.blocks.agg(F.count("*").alias("workBlocks")),
        tools.first_touches(a.calls).agg(
            F.count_if(F.col("first_tool").isin(*T.WRITE_TOOLS)).alias("filesCreated"), F.count_if("edited").alias("filesEdited")
        ),
        a.calls.agg(F.coalesce(F.sum(lines), zero).cast("long").alias("linesWritten")),
        per.agg(intents.alias("commandIntents")),
        shown,
        f.total.select(money(F.col("nano")).alias("totalNano")),
    ]


def data_of(a: Accounting, tz: str = "UTC", only: tuple[str, ...] = ()) -> DataFrame:
    """section, data (VARIANT): what each section tells."""
    facts, rows = Facts(a, tz), []
    for name, s in SECTIONS.items():
        if only and name not in only:
            continue
        for nth, part in enumerate(s.parts(facts)):
            body = F.to_json(F.struct(*part.columns), {"ignoreNullFields": "false"})
            inner = body.substr(F.lit(2), F.length(body) - 2)
            rows.append(part.select(F.lit(name).alias("section"), F.lit(nth).alias("nth"), inner.alias("body")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("nth", "body"))), lambda x: x["body"])
    whole = F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
    return reduce(DataFrame.unionByName, rows).groupBy("section").agg(whole.alias("json")).select("section", F.parse_json("json").alias("data"))


def documents(a: Accounting, tz: str = "UTC") -> DataFrame:
    """One row per section, in order: section, title, shown, evidence (count, unit), data (VARIANT), action."""
    titles = [(k, s.title, s.unit, s.advice) for k, s in SECTIONS.items()]
    told = a.spark.createDataFrame(titles, "section string, title string, unit string, action string")
    found = data_of(a, tz).join(F.broadcast(told), "section").join(sections(a, tz), "section")  # fourteen rows each
    evidence = F.when(F.col("section") == "i12", F.variant_get("data", "$.coverageDays", "long")).otherwise(F.col("evidence"))
    return found.select(
        "section", "title", "shown", F.struct(evidence.alias("count"), "unit").alias("evidence"), "data", "action"
    ).orderBy("section")  # fourteen rows
