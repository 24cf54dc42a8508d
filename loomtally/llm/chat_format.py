"""Chat formatting: record layouts are told by their schema's fingerprint and mapped to turns.

All nested field paths of a record (a VARIANT) are hashed once, and the digest is
looked up in a table of fingerprints, made by a rule from the declarative layouts:
a mapping says where roles and texts are. A schema that isn't in the table goes to
the layout that reads most of its paths. Fields that a mapping doesn't read are
kept beside the turns, so no text is lost. Turns are rendered by a template whose
marks cannot occur inside texts, and can be read back from the formatted text
alone, as can what the loss counts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtally.llm.common import without

TURNS = "array<struct<role:string,text:string>>"
UNREAD = "array<struct<path:string,value:string>>"
MAPPINGS = "array<struct<paths:array<string>,fields:array<string>,turns:array<struct<role:string,field:string>>,role:string,texts:array<string>,each:string>>"
DEPTH = 3


@dataclass(frozen=True)
class Layout:
    """Field paths a record must have (``[]`` marks an array) and the turns they hold.

    ``turns`` lists (role, field): a field that the record lacks gives no turn, so
    those that ``paths`` does not name are optional. ``own`` names the fields of
    role and text of a record that is one turn itself, and others whose text
    follows; ``each`` an array of such records, which comes after ``turns``.
    """

    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    own: tuple[str, ...] = ()
    each: str | None = None

    @property
    def fields(self) -> tuple[str, ...]:
        """The fields that the mapping reads, with all that is below them."""
        return tuple(dict.fromkeys([f for _, f in self.turns] + list(self.own) + [self.each] * bool(self.each)))


def _exchange(asked: str, answered: str, *between: str) -> Layout:
    inner = tuple(("user", x) for x in between)
    return Layout((answered, asked), (("system", "system"), ("user", asked), *inner, ("assistant", answered)))


def _list(field: str) -> Layout:
    return Layout((f"{field}[]",), (("system", "system"),), each=field)


#: Of layouts that fit equally well the first is taken.
LAYOUTS = (
    _list("messages"),
    _list("conversations"),
    _list("conversation"),
    _list("turns"),
    Layout(("content", "role"), own=("role", "content", "tool_calls")),
    Layout(("role", "tool_calls[]"), own=("role", "content", "tool_calls")),
    Layout(("role", "text"), own=("role", "text")),
    Layout(("from", "value"), own=("from", "value")),
    _exchange("instruction", "output", "input"),
    _exchange("instruction", "response", "input", "context"),
    _exchange("prompt", "completion", "input", "context"),
    _exchange("prompt", "response", "input", "context"),
    _exchange("question", "answer", "context"),
    _exchange("input", "output"),
)
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}


def fingerprint_of(paths: tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def schemas(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, int]:
    """The table of fingerprints: each layout with every choice of its optional fields, an array with the records of each layout in it."""
    table: dict[str, int] = {}
    for i, layout in enumerate(layouts):
        inner = [()] + [tuple(f"{layout.each}[].{p}" for p in x.paths) for x in layouts if x.own] if layout.each else [()]
        optional = [f for _, f in layout.turns if f not in layout.paths]
        for n in range(len(optional) + 1):
            for more in combinations(optional, n):
                for below in inner:
                    table.setdefault(fingerprint_of((*layout.paths, *more, *below)), i)
    return table


def _fields(value: Column) -> Column:
    """The fields of an object as (key, value); none of anything else."""
    return F.coalesce(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), 0)


def paths(value: Column, depth: int = DEPTH) -> Column:
    """The nested field paths of a variant, sorted, down to ``depth`` levels; of records in an array all they have between them."""
    none = F.array().cast("array<string>")

    def below(field: Column) -> Column:
        name = F.regexp_replace(field["key"], r"([\\.\[])", r"\\$1")
        items = F.try_variant_get(field["value"], "$", "array<variant>")
        inside = F.flatten(F.transform(items, lambda x: paths(x, depth - 1))) if depth > 1 else none
        own = paths(field["value"], depth - 1) if depth > 1 else none
        many = F.concat(F.array(F.concat(name, F.lit("[]"))), F.transform(inside, lambda p: F.concat(name, F.lit("[]."), p)))
        return F.when(items.isNotNull(), many).otherwise(F.concat(F.array(name), F.transform(own, lambda p: F.concat(name, F.lit("."), p))))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(_fields(value), below))))


def fingerprint(record: Column) -> Column:
    """SHA-256 of all nested field paths of a variant; a field that holds null is there."""
    return F.sha2(F.array_join(paths(record), "\n"), 256)


def _mappings(layouts: tuple[Layout, ...]) -> Column:
    """The layouts as one constant, by place."""
    rows = [{"paths": x.paths, "fields": x.fields, "turns": [{"role": r, "field": f} for r, f in x.turns], "role": x.own[0] if x.own else None, "texts": x.own[1:], "each": x.each} for x in layouts]
    return F.from_json(F.lit(json.dumps(rows)), MAPPINGS)


def _nearest(found: Column, layouts: tuple[Layout, ...]) -> Column:
    """The place of the layout that reads most of the paths, of those whose own paths are all there, a list of parts for a text too; null if there is none."""

    def rank(x: Column, i: Column) -> Column:
        read = F.filter(found, lambda p: F.exists(x["fields"], lambda f: (p == f) | F.startswith(p, F.concat(f, F.lit("."))) | F.startswith(p, F.concat(f, F.lit("[]")))))
        there = F.forall(x["paths"], lambda q: F.array_contains(found, q) | F.array_contains(found, F.concat(q, F.lit("[]"))))
        return F.when(there, F.struct(F.size(read).alias("read"), (-i).alias("minus")))

    return -F.array_max(F.transform(_mappings(layouts), rank))["minus"]


def layout_of(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The place of a record's layout: by its fingerprint, for a schema that isn't in the table by its paths; null if none fits."""
    table = F.from_json(F.lit(json.dumps(schemas(layouts))), "map<string,int>")
    return _let(paths(record), lambda p: F.coalesce(F.try_element_at(table, F.sha2(F.array_join(p, "\n"), 256)), _nearest(p, layouts)))


def _said(value: Column) -> Column:
    """A value as text: parts of a list one after another, of an object that is no more than a text that text, else its JSON; null is empty."""

    def plain(x: Column) -> Column:
        bare = F.forall(_fields(x), lambda f: (f["key"] == "text") | ((f["key"] == "type") & (F.try_variant_get(f["value"], "$", "string") == "text")))
        return F.coalesce(F.when(bare, F.try_variant_get(x, "$.text", "string")), F.try_variant_get(x, "$", "string"))

    parts = F.try_variant_get(value, "$", "array<variant>")
    listed = F.array_join(F.transform(parts, lambda x: F.coalesce(plain(x), F.lit(""))), "\n")
    return F.coalesce(F.when(parts.isNotNull(), listed).otherwise(plain(value)), F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.struct(F.coalesce(F.try_element_at(names, role), role).alias("role"), text.alias("text"))


def _left(record: Column, mapping: Column, before: Column) -> Column:
    """Fields of a record that a mapping doesn't read, as path and JSON; those that hold null have nothing to lose."""
    rest = F.filter(_fields(record), lambda f: ~F.array_contains(mapping["fields"], f["key"]) & F.try_variant_get(f["value"], "$", "string").isNotNull())
    return F.transform(rest, lambda f: F.struct(F.concat(before, f["key"]).alias("path"), F.try_variant_get(f["value"], "$", "string").alias("value")))


def _own(fields: Column, mapping: Column) -> Column:
    """The turn that a record of these fields is."""
    texts = F.filter(F.transform(mapping["texts"], lambda f: _said(F.try_element_at(fields, f))), lambda x: x != "")
    return _turn(F.try_variant_get(F.try_element_at(fields, mapping["role"]), "$", "string"), F.array_join(texts, "\n"))


def _item(item: Column, layouts: tuple[Layout, ...], before: Column) -> Column:
    """An element of an array of turns, as turn and what isn't read; one of no known layout has no role and its JSON as text."""
    fields = F.try_variant_get(item, "$", "map<string,variant>")
    whole = F.struct(_turn(F.lit(""), F.coalesce(F.try_variant_get(item, "$", "string"), F.lit(""))).alias("turn"), F.array().cast(UNREAD).alias("unread"))
    return _let(
        F.get(_mappings(layouts), layout_of(item, layouts)),
        lambda m: F.when(m.isNull(), whole).otherwise(F.struct(_own(fields, m).alias("turn"), _left(item, m, before).alias("unread"))),
    )


def mapped(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """(turns, unread) of a record, by its layout; null if it has none."""
    fields = F.try_variant_get(record, "$", "map<string,variant>")
    alone = tuple(x for x in layouts if x.own)

    def by(m: Column) -> Column:
        named = F.filter(m["turns"], lambda t: F.map_contains_key(fields, t["field"]))
        said = F.transform(named, lambda t: _turn(t["role"], _said(F.try_element_at(fields, t["field"]))))
        own = F.when(m["role"].isNotNull(), F.array(_own(fields, m))).otherwise(F.array().cast(TURNS))
        listed = F.coalesce(F.try_variant_get(F.try_element_at(fields, m["each"]), "$", "array<variant>"), F.array().cast("array<variant>"))
        items = F.transform(listed, lambda x: _item(x, alone, F.concat(m["each"], F.lit("[]."))))
        return _let(items, lambda xs: F.struct(
            F.concat(said, own, F.transform(xs, lambda x: x["turn"])).alias("turns"),
            F.concat(_left(record, m, F.lit("")), F.flatten(F.transform(xs, lambda x: x["unread"]))).alias("unread"),
        ))

    return _let(F.get(_mappings(layouts), layout_of(record, layouts)), lambda m: F.when(m.isNotNull(), by(m)))


def turns(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The turns of a record, by the mapping of its schema; null if no layout fits."""
    return mapped(record, layouts)["turns"]


def escape(text: Column) -> Column:
    r"""No ``<`` is left: ``\`` becomes ``\s``, then ``<`` becomes ``\l``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    r"""Undoes ``escape``: every ``\`` starts a pair, so ``\l`` may go first."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def _role_out(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def formatted(turns_col: Column) -> Column:
    """The turns as text; what the loss counts is what stands in the turns of an assistant."""

    def one(t: Column) -> Column:
        return F.concat(F.lit("<turn "), _role_out(t["role"]), F.lit(">"), escape(t["text"]), F.lit("</turn>\n"))

    return F.array_join(F.transform(turns_col, one), "")


def format_conversations(records: DataFrame, conv_col: str, order_cols: list[str], record: Column) -> DataFrame:
    """One row per conversation: conv_id, formatted, unmapped, rejected, unread.

    ``record`` is a VARIANT of any known layout, holding one turn or many;
    records of a conversation follow each other by ``order_cols`` (nulls first),
    ties by their turns; repeated rows are turns of their own. A null role or
    text is empty. A record whose layout is not known adds no turn: it is counted
    in ``unmapped`` and kept whole, as JSON, in ``rejected``. A null record is
    one too. Fields that a record's mapping does not read are in ``unread``, as
    path and JSON (a string as it is), unless they hold null; the mark ``type``
    of a plain part of text counts as read. Rows with a null conversation id form one conversation. A conversation
    is one training sample, so its turns meet in one row. Other columns are ignored;
    an empty table gives no rows.
    """
    p = without(records)
    own = mapped(record)
    rows = records.select(
        F.col(conv_col).alias("conv_id"),
        *(F.col(c).alias(f"{p}_{i}") for i, c in enumerate(order_cols)),
        own.alias("own"),
        F.coalesce(F.try_variant_get(record, "$", "string"), F.lit("null")).alias("json"),
    )
    lost = F.col("own").isNull()
    rows = rows.withColumns({"turns": F.col("own.turns"), "unread": F.col("own.unread")})
    held = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(*(f"{p}_{i}" for i in range(len(order_cols))), "turns"))).alias("all"),
        F.count_if(lost).alias("unmapped"),
        F.array_sort(F.collect_list(F.when(lost, F.col("json")))).alias("rejected"),
        F.array_sort(F.flatten(F.collect_list("unread"))).alias("unread"),
    )
    flat = F.flatten(F.transform("all", lambda x: F.coalesce(x["turns"], F.array().cast(TURNS))))
    return held.select("conv_id", formatted(flat).alias("formatted"), "unmapped", "rejected", "unread")


TURN_PATTERN = r"<turn ([^>]*+)>([^<]*+)</turn>\n"


def read_back(text: Column) -> Column:
    """The turns that a formatted text holds."""
    roles = F.regexp_extract_all(text, F.lit(TURN_PATTERN), F.lit(1))
    texts = F.regexp_extract_all(text, F.lit(TURN_PATTERN), F.lit(2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(_role_in(r).alias("role"), unescape(t).alias("text")))


def read_loss(text: Column) -> Column:
    """What the loss counts in a formatted text, unescaped, one turn after another."""
    own = F.regexp_extract_all(text, F.lit(r"<turn assistant>([^<]*+)</turn>\n"), F.lit(1))
    return F.array_join(F.transform(own, unescape), "")


def loss_spans(text: Column) -> Column:
    """Where in a formatted text the loss counts: (start, end) in code points of each assistant turn's text."""
    parts = F.transform(
        F.regexp_extract_all(text, F.lit(r"(?s)(<turn [^>]*+>[^<]*+</turn>\n)"), F.lit(1)),
        lambda t: F.struct(
            F.length(t).alias("n"),
            F.when(t.startswith("<turn assistant>"), F.length(t) - F.lit(len("<turn assistant></turn>\n"))).alias("own"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        first = a["at"] + len("<turn assistant>")
        span = F.array(F.struct(first.alias("start"), (first + x["own"]).alias("end")))
        return F.struct((a["at"] + x["n"]).alias("at"), F.when(x["own"].isNull(), a["out"]).otherwise(F.concat(a["out"], span)).alias("out"))

    return F.aggregate(parts, start, step, lambda a: a["out"])
