"""The summary of a report as one nested value, what may be published of it, and the checks of both.

A summary is a VARIANT of one row. Rules for it are a table (``walk.problems``); private
strings are looked for with automata over shards of them; the share-safe copy is rebuilt
by lists of what may stay.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtally.functions import text as T
from loomtally.operators import aggregate as G
from loomtally.operators import tools
from loomtally.operators.pricing import TOKENS
from loomtally.plans import documents as D
from loomtally.plans import summary as S
from loomtally.plans import walk as W
from loomtally.plans.accounting import Accounting
from loomtally.session import ship
from loomtally.sources.prices import AS_OF

KIND, VERSION = "loomtally.summary", "0.3.0"
CLASSES = ("main", "subagent", "workflow_agent", "workflow_journal")
LABELS = {False: "at list prices", True: "at the user's own rates"}
OTHER_MODEL = "other model"
# Forms of dates, times, versions and published names.
DATE, ISO = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,3})?Z$"
NAME, DIGITS = r"^[A-Za-z0-9 .]{1,40}$", r"^-?\d+$"
HIDEABLE = ("value", "coverage", "outputTokens", "activeHours", "toolCalls", "topTool", "cacheHitRate", "delegationShare", "longestStreakDays",
            "peakHourLocal", "maxEditsOneFile", "topModel", "archetype", "badges", "heatmap")


def _object(fields: list[Column]) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def summary(a: Accounting, tz: str = "UTC", taken_at: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One row, ``data``: schema, kind, tool, tz, pricing, scan, totals, audit and the fourteen sections."""
    own = bool(a.options.price_overrides)
    facts = D.Facts(a, tz)
    money = D.money
    head = a.spark.range(1).select(
        F.lit(1).alias("schema"), F.lit(KIND).alias("kind"), F.struct(F.lit("loomtally").alias("name"), F.lit(VERSION).alias("version")).alias("tool"),
        F.lit(taken_at).alias("generatedAt"), F.lit(tz).alias("tz"), F.lit(a.options.idle_minutes).alias("idleMinutes"), F.lit(a.options.redact).alias("redacted"),
    )
    table = D.in_order([F.col("model")], id=F.col("model"), displayName=F.col("display_name"))
    pricing = a.prices.where("display_name is not null").agg(table.alias("t")).select(
        F.struct(F.lit(AS_OF).alias("asOf"), F.lit(LABELS[own]).alias("label"), F.lit(own).alias("custom"), F.col("t").alias("tableModels")).alias("pricing")
    )
    if hasattr(a, "found"):
        counts = {"filesRead": "files", "bytes": "bytes", "lines": "lines", "parseErrors": "n_error", "trailingPartial": "n_partial", "oversizeLines": "n_oversize", "unreadable": "n_unreadable"}
        each = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in counts.items()]
        per = [
            F.struct(*(F.coalesce(F.sum(F.when(F.col("file_class") == k, F.col(c))), F.lit(0)).cast("long").alias(n) for n, c in counts.items())).alias(k) for k in CLASSES
        ]
        scan = a.receipts.agg(*each, *(x.alias(k) for x, k in zip(per, CLASSES, strict=True)))
        scan = scan.select(F.struct(F.lit(taken_at).alias("takenAt"), *counts, F.struct(*CLASSES).alias("byClass")).alias("scan"))
    else:
        of = a.files.groupBy().agg(F.count_if(F.col("file_class").isNotNull()).alias("n"))
        zero = [F.lit(0).cast("long").alias(n) for n in ("bytes", "lines", "parseErrors", "trailingPartial", "oversizeLines", "unreadable")]
        scan = of.select(F.struct(F.lit(taken_at).alias("takenAt"), F.col("n").alias("filesRead"), *zero, F.struct(*(F.struct(*zero).alias(k) for k in CLASSES)).alias("byClass")).alias("scan"))
    total = facts.total.crossJoin(G.token_coverage(a.priced)).select(
        F.struct(
            "responses", F.col("incomplete").alias("incompleteResponses"), "sessions", F.col("priced_tokens").alias("pricedTokens"), F.col("all_tokens").alias("allTokens"),
            money(F.col("nano")).alias("valueNano"), F.struct(*(F.col(t).alias(D.NAMED[t]) for t in TOKENS)).alias("tokens"),
        ).alias("totals")
    )
    methods = a.methods.agg(F.sort_array(F.collect_list(F.struct("method", money(F.col("nano")).alias("valueNano"), "ratio"))).alias("methods"))
    more = G.modifiers(a.priced).crossJoin(tools.duplicates(a.tables["tool_use"])).crossJoin(a.orphans.agg(F.count("*").alias("orphanResults")))
    ratios = G.cost_ratios(a.cost_windows, a.priced).agg(
        F.count("ratio").alias("compared"), F.median("ratio").alias("median"), F.min("ratio").alias("least"), F.max("ratio").alias("largest")
    )
    audit = a.stats.crossJoin(methods).crossJoin(more).crossJoin(ratios)  # one row each
    audit = audit.select(F.struct(*(F.col(c) for c in audit.columns)).alias("audit"))
    rows = [x.select(F.lit(n).alias("nth"), _object([F.col(c) for c in x.columns]).alias("j")) for n, x in enumerate((head, pricing, scan, total, audit))]
    docs = D.documents(a, tz)
    front = _object([F.col("section").alias("id"), *(F.col(c) for c in ("title", "shown", "evidence", "action"))])
    one = F.concat(F.lit('"'), F.col("section"), F.lit('":'), front.substr(F.lit(1), F.length(front) - 1), F.lit(',"data":'), F.to_json("data"), F.lit("}"))
    told = docs.agg(F.array_join(F.sort_array(F.collect_list(one)), ",").alias("s"))
    rows.append(told.select(F.lit(len(rows)).alias("nth"), F.concat(F.lit('{"insights":{'), "s", F.lit("}}")).alias("j")))
    bodies = F.transform(F.sort_array(F.collect_list(F.struct("nth", "j"))), lambda x: x["j"].substr(F.lit(2), F.length(x["j"]) - 2))
    whole = F.concat(F.lit("{"), F.array_join(bodies, ","), F.lit("}"))
    return reduce(DataFrame.unionByName, rows).agg(whole.alias("json")).select(F.parse_json("json").alias("data"))


def _counts(at: str, *names: str) -> list[tuple]:
    return [W.rule(f"{at[2:]}.{n}".lstrip("."), f"{at}.{n}", "integer", low=0) for n in names]


SUMMARY_RULES = [
    W.rule("summary", "$", "object"), W.rule("schema", "$.schema", "integer", low=1, high=1), W.rule("kind", "$.kind", "string", r"^loomtally\.summary$"),
    W.rule("tool", "$.tool", "object"), W.rule("tool.name", "$.tool.name", "string", "^loomtally$"), W.rule("tool.version", "$.tool.version", "string"),
    W.rule("generatedAt", "$.generatedAt", "string", ISO), W.rule("tz", "$.tz", "string", r"^[A-Za-z0-9_+\-/:]+$"), W.rule("idleMinutes", "$.idleMinutes", "number", low=1e-9),
    W.rule("redacted", "$.redacted", "boolean"),
    W.rule("pricing", "$.pricing", "object"), W.rule("pricing.asOf", "$.pricing.asOf", "string", DATE), W.rule("pricing.label", "$.pricing.label", "string"),
    W.rule("pricing.custom", "$.pricing.custom", "boolean"), W.rule("pricing.tableModels", "$.pricing.tableModels", "array"),
    W.rule("scan", "$.scan", "object"), W.rule("scan.takenAt", "$.scan.takenAt", "string", ISO),
    *_counts("$.scan", "filesRead", "bytes", "lines", "parseErrors", "trailingPartial", "oversizeLines", "unreadable"),
    W.rule("scan.byClass", "$.scan.byClass", "object"), *(W.rule(f"scan.byClass.{c}", f"$.scan.byClass.{c}", "object") for c in CLASSES),
    W.rule("totals", "$.totals", "object"), *_counts("$.totals", "responses", "incompleteResponses", "sessions", "pricedTokens", "allTokens"),
    W.rule("totals.valueNano", "$.totals.valueNano", "string", DIGITS), W.rule("totals.tokens", "$.totals.tokens", "object"),
    W.rule("totals.tokens.output", "$.totals.tokens.output", "integer", low=0), W.rule("audit", "$.audit", "object"), W.rule("insights", "$.insights", "object"),
    *(
        r
        for k in D.SECTIONS
        for r in (
            W.rule(f"insights.{k}", f"$.insights.{k}", "object"), W.rule(f"insights.{k}.id", f"$.insights.{k}.id", "string", f"^{k}$"),
            W.rule(f"insights.{k}.shown", f"$.insights.{k}.shown", "boolean"), W.rule(f"insights.{k}.data", f"$.insights.{k}.data", "object"),
            W.rule(f"insights.{k}.evidence", f"$.insights.{k}.evidence", "object null"), W.rule(f"insights.{k}.evidence.count", f"$.insights.{k}.evidence.count", "number"),
            W.rule(f"insights.{k}.evidence.unit", f"$.insights.{k}.evidence.unit", "string"), W.rule(f"insights.{k}.action", f"$.insights.{k}.action", "string null", "^(?s).{0,400}$"),
        )
    ),
]
_ONE_OF = lambda words: "^(" + "|".join(map(re.escape, words)) + ")$"
PUBLIC_RULES = [
    W.rule("public", "$", "object", closed=True), W.rule("schema", "$.schema", "integer", low=1, high=1), W.rule("toolVersion", "$.toolVersion", "string", r"^\d+\.\d+\.\d+$"),
    W.rule("pricesAsOf", "$.pricesAsOf", "string", DATE), W.rule("scanTakenAt", "$.scanTakenAt", "string", ISO), W.rule("filesScanned", "$.filesScanned", "integer", low=0),
    W.rule("coverage", "$.coverage", "object null", closed=True), W.rule("coverage.fromLocalDate", "$.coverage.fromLocalDate", "string", DATE),
    W.rule("coverage.toLocalDate", "$.coverage.toLocalDate", "string", DATE), W.rule("coverage.activeDays", "$.coverage.activeDays", "integer", low=0),
    W.rule("value", "$.value", "object", closed=True), W.rule("value.shown", "$.value.shown", "boolean"),
    W.rule("value.atLeastUsd2sf", "$.value.atLeastUsd2sf", "number null", low=0), W.rule("value.label", "$.value.label", "string", _ONE_OF(LABELS.values())),
    *(W.rule(k, f"$.{k}", "integer null", low=0) for k in ("outputTokens", "toolCalls", "longestStreakDays", "maxEditsOneFile", "rateLimitWindows")),
    W.rule("activeHours", "$.activeHours", "number null", low=0),
    *(W.rule(k, f"$.{k}", "number null", low=0, high=1) for k in ("cacheHitRate", "delegationShare")),
    W.rule("peakHourLocal", "$.peakHourLocal", "integer null", low=0, high=23),
    W.rule("topTool", "$.topTool", "object null", closed=True), W.rule("topTool.name", "$.topTool.name", "string", _ONE_OF(T.DISPLAY_NAMES)),
    W.rule("topTool.share", "$.topTool.share", "number", low=0, high=1), W.rule("topModel", "$.topModel", "string null", NAME),
    W.rule("archetype", "$.archetype", "string null", _ONE_OF([*(n for n, _ in S.ARCHETYPES), S.GENERALIST])),
    W.rule("badges", "$.badges", "array"), W.rule("badges[]", "$.badges[]", "string", _ONE_OF([b for b, _ in S.BADGES])),
    W.rule("heatmap", "$.heatmap", "array null", low=7, high=7), W.rule("heatmap[]", "$.heatmap[]", "array", low=24, high=24),
    W.rule("heatmap[][]", "$.heatmap[][]", "integer", low=0, high=S.HEAT_LEVELS),
]


def summary_problems(found: DataFrame) -> DataFrame:
    """rule and path of whatever in a summary is not as it must be."""
    return W.problems(W.values(found, [], "data"), [], SUMMARY_RULES)


def public_problems(found: DataFrame) -> DataFrame:
    """rule and path of whatever in a published summary is not as it must be, what hangs together included."""
    get = lambda p, kind: F.try_variant_get("data", p, kind)
    shown, value = get("$.value.shown", "boolean"), get("$.value.atLeastUsd2sf", "double")
    order = F.transform(get("$.badges", "array<string>"), lambda b: F.array_position(F.array(*(F.lit(x) for x, _ in S.BADGES)), b))
    wrong = {
        "value_hidden": shown != value.isNotNull(),
        "badges_order": order != F.array_sort(F.array_distinct(order)),
    }
    told = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(k).alias("rule"), F.lit("$").alias("path"))) for k, c in wrong.items())))
    return W.problems(W.values(found, [], "data"), [], PUBLIC_RULES).unionByName(found.select(F.inline(told)))


def publish(a: Accounting, found: DataFrame, tz: str = "UTC", rate_limits: bool = False, hide: tuple[str, ...] = ()) -> DataFrame:
    """What may be published of the summary ``found``: one row, ``data``, with fixed fields; hidden ones are null.

    The value is shown, cut to two figures, where prices are known for 99 % of the tokens and it is a dollar at least.
    """
    if wrong := set(hide) - set(HIDEABLE):
        raise ValueError(f"can't be hidden: {sorted(wrong)}")
    habit = S.archetype(S.habits(a)).select("archetype")
    figures = S.pattern_figures(a, tz, rate_limits)
    badges = S.badges(figures).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "badge"))), lambda x: x["badge"]).alias("badges"))
    cells = F.sort_array(F.collect_list(F.struct("weekday", "hour", "level")))
    grid = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.transform(F.filter(cells, lambda x: x["weekday"] == d), lambda x: x["level"]))
    heat = S.heat_levels(a, tz).agg(F.when(F.count("*") > 0, grid).alias("heat"))
    row = found.crossJoin(habit).crossJoin(badges).crossJoin(heat)  # one row each
    get = lambda p, kind: F.try_variant_get("data", p, kind)
    at = lambda k, p, kind: get(f"$.insights.{k}.data.{p}", kind)
    nano = at("i01", "totalNano", "decimal(38,0)")
    priced, every = at("i01", "pricedTokens", "decimal(20,0)"), at("i01", "allTokens", "decimal(20,0)")
    shown = (every > 0) & (priced * 100 >= every * 99) & (nano >= S.NANO) & F.lit("value" not in hide)
    # Names come from the price table and the fixed list of tools alone.
    model = at("i13", "topModel.model", "string")
    known = a.prices.where("display_name is not null").agg(F.map_from_entries(F.collect_list(F.struct("model", "display_name"))).alias("names"))
    row = row.crossJoin(known)
    tool = T.tool_display(at("i07", "topTool.displayName", "string"))
    listed = at("i07", "topTool.displayName", "string").isin(*T.DISPLAY_NAMES)
    span = F.struct(at("i12", "earliestAnyLocalDate", "string").alias("fromLocalDate"), at("i12", "latestLocalDate", "string").alias("toLocalDate"), at("i09", "activeDays", "long").alias("activeDays"))
    fields = {
        "coverage": F.when(at("i12", "earliestAnyLocalDate", "string").isNotNull(), span),
        "outputTokens": get("$.totals.tokens.output", "long"), "activeHours": F.round(at("i09", "activeHours", "double"), 1), "toolCalls": at("i07", "toolCalls", "long"),
        "topTool": F.when(
            at("i07", "topTool.displayName", "string").isNotNull() & F.lit("toolCalls" not in hide),
            F.struct(F.when(listed, at("i07", "topTool.displayName", "string")).otherwise(tool).alias("name"), F.round(at("i07", "topTool.share", "double"), 4).alias("share")),
        ),
        "cacheHitRate": F.round(at("i02", "cacheHitRate", "double"), 4), "delegationShare": F.round(at("i04", "delegationShare", "double"), 4),
        "longestStreakDays": at("i09", "longestStreakDays", "long"), "peakHourLocal": at("i09", "peakHourLocal", "long"), "maxEditsOneFile": at("i08", "maxEditsOneFile", "long"),
        "topModel": F.when(model.isNotNull(), F.coalesce(F.col("names")[model], F.lit(OTHER_MODEL))), "archetype": F.col("archetype"), "badges": F.col("badges"), "heatmap": F.col("heat"),
    }
    none = {"badges": F.array().cast("array<string>")}
    left = [(none.get(k, F.when(F.lit(False), c)) if k in hide else c).alias(k) for k, c in fields.items()]
    value = F.struct(shown.alias("shown"), F.when(shown, S.floor_two(nano).cast("double")).alias("atLeastUsd2sf"), get("$.pricing.label", "string").alias("label"))
    whole = row.select(
        F.lit(1).alias("schema"), get("$.tool.version", "string").alias("toolVersion"), get("$.pricing.asOf", "string").alias("pricesAsOf"),
        get("$.scan.takenAt", "string").alias("scanTakenAt"), get("$.scan.filesRead", "long").alias("filesScanned"), value.alias("value"), *left,
        (at("i06", "windows", "long") if rate_limits else F.lit(None).cast("long")).alias("rateLimitWindows"),
    )
    return whole.select(F.parse_json(_object([F.col(c) for c in whole.columns])).alias("data"))


# --- Private strings ---

#: Labels of the user's own, by the shape of their path: what each is called where it may not be told.
LABELLED = {
    "$.insights.i01.data.byProject[].label": "Project", "$.insights.i01.data.unpriced[].model": "Unpriced model", "$.insights.i01.data.byModel[].model": "Unpriced model",
    "$.insights.i04.data.byAttribution.agent[].name": "Agent", "$.insights.i04.data.byAttribution.skill[].name": "Skill",
    "$.insights.i04.data.byAttribution.mcpServer[].name": "Server", "$.insights.i07.data.byTool[].name": "Tool", "$.insights.i07.data.flagged[]": "Tool",
    "$.insights.i08.data.top[].label": "File", "$.insights.i13.data.byModel[].model": "Unpriced model", "$.insights.i13.data.topModel.model": "Unpriced model",
    "$.insights.i14.data.models[]": "Unpriced model",
}
#: The program's own words; a private string inside one of them is no leak, but in a label.
FIXED_COPY = tuple(dict.fromkeys([
    KIND, "loomtally", *LABELS.values(), OTHER_MODEL, *T.DISPLAY_NAMES, *CLASSES, *T.INTENTS, *T.ERROR_CATEGORIES,
    *(x for s in D.SECTIONS.values() for x in (s.title, s.unit, s.advice)),
]))
LEAST = {"log path": 8, "project key": 6, "session id": 8, "launch folder": 6, "file path hash": 16, "tool call id": 12, "file label": 8, "tool name": 8, "attribution name": 8,
         "project label": 8, "unpriced model id": 8}
HELD = 200_000


def private_needles(a: Accounting, labels: bool = False) -> DataFrame:
    """category, needle: what a summary may not tell; ``labels`` too where it is for others' eyes."""
    a.keep()
    one = lambda df, c, category: df.select(F.lit(category).alias("category"), F.col(c).alias("needle"))
    frames = [
        one(a.files, "rel_path", "log path"), one(a.priced, "project_key", "project key"), one(a.activity, "session_id", "session id"),
        one(a.launch, "launch", "launch folder"), one(a.calls, "path_hash", "file path hash"), one(a.calls, "tool_use_id", "tool call id"),
    ]
    if labels:
        own = a.calls.where(T.tool_class(F.col("name")) != "builtin")
        frames += [one(a.by_project, "project_label", "project label"), one(a.calls, "path_label", "file label"), one(own, "name", "tool name")]
        frames += [one(a.priced, c, "attribution name") for c in ("agent", "skill", "mcp_server", "plugin")]
        frames.append(one(G.unpriced(a.priced), "model", "unpriced model id"))
    return reduce(DataFrame.unionByName, frames).where("needle is not null").distinct()


def _spans(automaton, text: str) -> list[tuple[int, int]]:
    return [(end - len(word) + 1, end + 1) for end, word in automaton.iter(text)] if automaton is not None else []


def _automaton(words):
    import ahocorasick

    made = ahocorasick.Automaton()
    for word, value in words:
        made.add_word(word, value)
    made.make_automaton()
    return made if len(made) else None


def _searched(fixed: tuple[str, ...]):
    """Of rows shard, kind, rank, text, path, label, sorted by shard and kind: (path, rank) of each string's first needle by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _automaton((w.lower(), w.lower()) for w in fixed)
        shard, held, needles = None, [], None
        for batch in batches:
            found = []
            for s, kind, rank, text, path, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    shard, held, needles = s, [], None
                if kind == 0:
                    held.append((text, (rank, text)))
                    continue
                if held:
                    needles, held = _automaton(held), []
                if needles is None:
                    continue
                low, best, spans = text.lower(), None, None
                for end, (r, word) in needles.iter(low):
                    if best is not None and r >= best:
                        continue
                    if not label:
                        spans = _spans(own, low) if spans is None else spans
                        if any(a <= end - len(word) + 1 and end + 1 <= b for a, b in spans):
                            continue
                    best = r
                if best is not None:
                    found.append((path, best))
            columns = list(zip(*found, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32())], ["path", "rank"])

    return run


def leaks(strings: DataFrame, needles: DataFrame, fixed: tuple[str, ...] = FIXED_COPY, held: int = HELD) -> DataFrame:
    """category, path of every string that holds a private one; the private string itself is never told.

    ``strings``: path, text, label (whether it is a label of the user's); ``needles``: category,
    needle. Case does not count, needles shorter than their category allows (six
    where none is set) do not either. Of several categories in a string the first of ``LEAST`` is told. An
    occurrence inside a phrase of ``fixed`` is none, but in a label. Needles are
    dealt to shards of about ``held``, each an automaton of one task; strings go to every shard.
    """
    ship(strings.sparkSession)
    order = {c: i for i, c in enumerate(LEAST)}
    rank = F.coalesce(*(F.when(F.col("category") == c, F.lit(i)) for c, i in order.items()), F.lit(len(order)))
    least = F.coalesce(*(F.when(F.col("category") == c, F.lit(n)) for c, n in LEAST.items()), F.lit(6))
    kept = needles.where(F.length("needle") >= least).groupBy(F.lower("needle").alias("text")).agg(F.min(F.struct(rank.alias("rank"), "category")).alias("c"))
    shards = max(1, -(-kept.count() // held))
    none = F.lit(None).cast("string")
    dealt = kept.select(F.pmod(F.xxhash64("text"), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), "c.rank", "text", none.alias("path"), F.lit(False).alias("label"))
    everywhere = strings.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("kind"), F.lit(0).alias("rank"), "text", "path", "label")
    rows = dealt.unionByName(everywhere).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    best = rows.mapInArrow(_searched(fixed), "path string, rank int").groupBy("path").agg(F.min("rank").alias("rank"))
    names = F.create_map(*(F.lit(x) for c, i in order.items() for x in (i, c)), F.lit(len(order)), F.lit("other"))
    return best.select(names[F.col("rank")].alias("category"), "path")


def strings_of(found: DataFrame) -> DataFrame:
    """path, text, label of all strings of a summary, keys among them (their path ends in ``{key}``)."""
    each = W.values(found, [], "data")
    text = each.where("kind = 'string'").select("path", "text", F.col("shape").isin(*LABELLED).alias("label"))
    keys = each.where("path <> '$'").select(F.concat("path", F.lit("{key}")).alias("path"), F.regexp_extract("path", r"\.([^.]*)$", 1).alias("text"), F.lit(False).alias("label"))
    return text.unionByName(keys.where("text <> ''"))


# --- The copy that may be shared ---

HIDDEN = "[hidden]"
SAFE = re.compile(r"-?\d+(\.\d+)?|\d{4}-\d{2}(-\d{2})?|\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,3})?Z|[0-9a-f]{12}|[a-z][a-z0-9]{0,31}|[a-z][a-z0-9]*([_-][a-z0-9]+)+")
SAFE_KEY = re.compile(r"[A-Za-z][A-Za-z0-9_]*")


def lettered(n: int) -> str:
    """A to Z, AA, AB and on, from 0."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def rebuilt(value, allowed: set[str], names: dict[str, str] = LABELLED):
    """The value anew, of strings and keys that may stay only: labels become letters, in order of their first use."""
    letters: dict[str, dict[str, str]] = {}
    replaced: set[str] = set()

    def relabel(v, shape: str):
        if isinstance(v, dict):
            return {k: relabel(x, f"{shape}.{k}") for k, x in v.items()}
        if isinstance(v, list):
            return [relabel(x, shape + "[]") for x in v]
        noun = names.get(shape)
        if noun is None or not isinstance(v, str) or v in allowed:
            return v
        of = letters.setdefault(noun, {})
        replaced.add(v)
        return Safe(of.setdefault(v, f"{noun} {lettered(len(of))}"))

    def sweep(v):
        if isinstance(v, str):
            stays = isinstance(v, Safe) or v in allowed or (v not in replaced and SAFE.fullmatch(v))
            return str(v) if stays else HIDDEN
        if isinstance(v, list):
            return [sweep(x) for x in v]
        if isinstance(v, dict):
            out, n = {}, 0
            for k, x in v.items():
                if k in allowed or (k not in replaced and SAFE_KEY.fullmatch(k)):
                    out[k] = sweep(x)
                else:
                    out[f"{HIDDEN} {lettered(n)}"] = sweep(x)
                    n += 1
            return out
        return v

    return sweep(relabel(value, "$"))


class Safe(str):
    """A string that this library made."""


def share_safe(found: DataFrame, prices: DataFrame) -> DataFrame:
    """The summary ``found`` as others may see it: labels as letters, and no string or key that isn't on a list.

    What may stay are ids and names of the price table, the program's own words, and
    numbers, dates, times, fingerprints and lower-case words of an enumeration.
    """
    ship(found.sparkSession)
    names = prices.where("display_name is not null").select(F.explode(F.array("model", "display_name")).alias("n")).distinct()
    allowed = {r["n"] for r in names.collect()} | set(FIXED_COPY) | {"UTC", VERSION, KIND}  # a price table has some dozens of rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [json.dumps(rebuilt(json.loads(x), allowed) | {"redacted": True}) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["json"])

    return found.select(F.to_json("data").alias("json")).mapInArrow(run, "json string").select(F.parse_json("json").alias("data"))


# --- Exports in words ---


def _dollars(nano: str, places: int = 2) -> str:
    from decimal import ROUND_HALF_UP, Decimal

    return f"{(Decimal(nano) / 10**9).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP):,}"


def method_note(s: dict) -> str:
    """How the figures of a summary came about, for every export."""
    share = s["totals"]["incompleteResponses"] / s["totals"]["responses"] if s["totals"]["responses"] else 0
    return (
        f"Value {s['pricing']['label']} of {s['pricing']['asOf']}, a lower bound: {share:.1%} of the responses have no final token count, and searches and calls "
        f"outside the transcripts are not in them. It is not what was paid. Read {s['scan']['takenAt']}, {s['scan']['filesRead']} files, time zone {s['tz']}."
    )


def as_dict(found: DataFrame) -> dict:
    """A summary as a Python value: one row, of sections that are as long as lists of days and projects."""
    return json.loads(found.select(F.to_json("data").alias("j")).first()["j"])


BY = {"day": ("byDay", "date"), "month": ("byMonth", "month"), "model": ("byModel", "displayName"), "project": ("byProject", "label")}


def export_rows(s: dict, by: str) -> list[list]:
    """Header and rows of one grouping: key, responses, value_usd, and sessions of projects."""
    field, key = BY[by]
    more = ["sessions"] if by == "project" else []
    rows = [[by, "responses", "value_usd", *more]]
    for r in s["insights"]["i01"]["data"][field]:
        rows.append([r[key] or r["model"] if by == "model" else r[key], r["responses"], _dollars(r["valueNano"], 6).replace(",", ""), *(r[m] for m in more)])
    return rows


def csv_cell(v) -> str:
    """A cell that no spreadsheet takes for a formula."""
    s = "" if v is None else str(v)
    guarded = "'" + s if isinstance(v, str) and re.match(r"[=+\-@\t\r]", s) else s
    return '"' + guarded.replace('"', '""') + '"' if guarded != s or re.search(r'[",\r\n]', s) else s


def csv_text(s: dict, by: str) -> str:
    """The export as CSV, with a last row that tells the method."""
    lines = [",".join(map(csv_cell, r)) for r in export_rows(s, by)]
    return "\r\n".join([*lines, csv_cell("# " + method_note(s))]) + "\r\n"


def json_text(s: dict) -> str:
    """The whole report without the findings of secrets."""
    return json.dumps({**s, "insights": {k: v for k, v in s["insights"].items() if k != "i11"}}, indent=2, ensure_ascii=False, sort_keys=True)


def _md(v) -> str:
    return re.sub(r"[\r\n]+", " ", str(v)).replace("\\", "\\\\").replace("|", "\\|").replace("<", "&lt;")


def _table(rows: list[list]) -> list[str]:
    head, *rest = rows
    return [f"| {' | '.join(map(_md, head))} |", "|" + "|".join([" --- ", *(" ---: " for _ in head[1:])]) + "|", *(f"| {' | '.join(map(_md, r))} |" for r in rest)]


def markdown_text(s: dict, by: str) -> str:
    """Receipts, the value of one grouping and the method."""
    r, when = s["insights"]["i14"]["data"], s["insights"]["i09"]["data"]
    receipts = [
        ["Receipt", "Count"], ["Days with a prompt", r["activeDays"]], [f"Active hours, pauses of up to {s['idleMinutes']} minutes", when["activeHours"]],
        ["Work blocks", r["workBlocks"]], ["Prompts", r["prompts"]], ["Interrupts", r["interrupts"]], ["Files created", r["filesCreated"]], ["Files edited", r["filesEdited"]],
        ["Lines written by tools, not lines that stayed", r["linesWritten"]],
        *([f"Commands: {c['intent'].replace('_', ' ')} (failed)", f"{c['count']} ({c['failures']})"] for c in r["commandIntents"]),
        ["Value", f"at least ${_dollars(r['totalNano'])} {s['pricing']['label']}"],
    ]
    models = ["", "Models: " + ", ".join(map(_md, r["models"])) + "."] if r["models"] else []
    return "\n".join(["# Activity", "", *_table(receipts), *models, "", f"## Value by {by}", "", *_table(export_rows(s, by)), "", "## Method", "", method_note(s), ""])


def audit_text(s: dict) -> list[str]:
    """The figures behind a summary, in lines: files, responses, value, price table, cost snapshots, counting methods."""
    scan, t, u, m = s["scan"], s["totals"], s["audit"], s["insights"]["i01"]["data"]
    out = ["files by class"]
    for c, n in scan["byClass"].items():
        out.append(f"  {c}: {n.get('filesRead', 0):,} files, {n['bytes']:,} bytes, {n['lines']:,} lines, {n['parseErrors']:,} parse errors, {n['trailingPartial']:,} partial")
    lines = u["observations"] / u["keys"] if u["keys"] else 0
    out += [
        "responses", f"  {u['observations']:,} lines are {u['keys']:,} responses, {lines:.2f} lines each; {u['forked_keys']:,} stand in several files and count once",
        f"  lines that disagree: {u['invariant_violations']:,} responses; ids used twice: {u['gateway_conflicts']:,}; lines without a request that were attached: {u['ambiguous_attach']:,}",
        f"  tools: {u['duplicate_tool_use_ids']:,} repeated ids, {u['orphanResults']:,} results without a call",
        f"  {t['responses']:,} responses, {t['incompleteResponses']:,} without a final count",
        "value", f"  at least ${_dollars(t['valueNano'])} {s['pricing']['label']} of {s['pricing']['asOf']}; not what was paid",
        f"  priced tokens: {m['pricedTokenShare']:.2%}; {len(m['unpriced']):,} models without a price, {sum(x['tokens'] for x in m['unpriced']):,} tokens",
        f"  fast: {u['fast']:,}, US: {u['geo_us']:,}, other tiers: {u['non_standard_tier']:,}, split guessed: {u['ttl_estimated']:,}, searches: {u['web_searches']:,}",
        f"  tokens: output {t['tokens']['output']:,}, input {t['tokens']['input']:,}, 5m writes {t['tokens']['cw5m']:,}, 1h writes {t['tokens']['cw1h']:,}, reads {t['tokens']['cacheRead']:,}",
        "price table", f"  list prices of {s['pricing']['asOf']} for {len(s['pricing']['tableModels'])} models, for all dates",
        "cost snapshots, never added to totals",
        f"  {u['compared']:,} compared" + (f": median {u['median']:.3f}, from {u['least']:.3f} to {u['largest']:.3f}" if u["compared"] else ""),
        "value under each counting method",
        *(f"  {x['method']}: ${_dollars(x['valueNano'])}, ratio {x['ratio']:.3f}" if x["ratio"] is not None else f"  {x['method']}: ${_dollars(x['valueNano'])}" for x in u["methods"]),
    ]
    return out


def checked(found: DataFrame, rules: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``found`` itself, or an error that names the first broken rules."""
    wrong = [tuple(r) for r in rules(found).orderBy("path", "rule").limit(5).collect()]
    if wrong:
        raise ValueError(f"not as it must be: {wrong}")
    return found
