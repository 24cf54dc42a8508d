"""Nested values as rows, and rules for them as a table.

``values`` takes a VARIANT apart into a row for each value inside it, with its path.
``problems`` joins those with a table of rules, so a rule is data: a path (``[]``
for any element of an array), the kinds it may have, a pattern, a range.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtally.session import ship

RULES = "rule string, at string, kinds array<string>, pattern string, low double, high double, required boolean, closed boolean"
WALKED = "path string, shape string, above string, kind string, text string, number double"


def _kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int) or (isinstance(v, float) and v.is_integer()):
        return "integer"
    return {float: "number", str: "string", list: "array", dict: "object"}[type(v)]


def walk(value) -> Iterator[tuple]:
    """(path, shape, shape of the holder, kind, text, number) of a value and all inside it, as deep as it goes.

    The number of an array or object is how many values it holds.
    """
    stack = [("$", "$", "", value)]
    while stack:
        path, shape, above, v = stack.pop()
        kind = _kind(v)
        text = v if kind == "string" else str(v).lower() if kind == "boolean" else None
        size = v if kind in ("integer", "number") else len(v) if kind in ("array", "object") else None
        yield path, shape, above, kind, text, None if size is None else float(size)
        if kind == "object":
            stack += [(f"{path}.{k}", f"{shape}.{k}", shape, x) for k, x in reversed(v.items())]
        elif kind == "array":
            stack += [(f"{path}[{i}]", f"{shape}[]", shape, x) for i, x in reversed(list(enumerate(v)))]


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys and a JSON text become a row for each value inside."""
    for batch in batches:
        at, found = [], []
        for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            rows = list(walk(json.loads(text)))
            at += [i] * len(rows)
            found += rows
        places = pa.array(at, pa.int64())
        columns = list(zip(*found, strict=True)) if found else [()] * 6
        made = [pa.array(c, pa.float64() if n == 5 else pa.string()) for n, c in enumerate(columns)]
        keys = [batch.column(i).take(places) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*keys, *made], [*batch.schema.names[:-1], *(c.split()[0] for c in WALKED.split(", "))])


def values(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Every value inside the VARIANT ``column``, containers too: keys, path, shape, above, kind, text, number.

    ``path`` begins with ``$``; ``shape`` is the path with ``[]`` for every place in an
    array, ``above`` the shape of the object or array that holds the value. A null column has no rows.
    """
    ship(df.sparkSession)
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.to_json(column).alias("_json"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_walked, fields + WALKED)


def leaves(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The values that hold no others: keys, path, kind, text, number."""
    return values(df, keys, column).where("kind not in ('object', 'array')").select(*keys, "path", "kind", "text", "number")


def rule(name: str, path: str, kinds: str, pattern: str | None = None, low: float | None = None, high: float | None = None, required: bool = True, closed: bool = False):
    """A row of a table of rules; ``kinds`` are parted by blanks; ``closed`` objects have no keys but those with rules."""
    bounds = (None if x is None else float(x) for x in (low, high))
    return (name, path, kinds.split(), pattern, *bounds, required, closed)


def problems(found: DataFrame, keys: list[str], rules: list[tuple]) -> DataFrame:
    """keys, rule, path of every value (of ``values``) against a rule, every one that is required and missing, and every key too many.

    The rules of a schema are some dozens, so they go to every task.
    """
    table = F.broadcast(found.sparkSession.createDataFrame(rules, RULES))
    met = found.join(table, F.col("shape") == F.col("at"))
    whole = ~F.array_contains("kinds", F.col("kind")) & ~((F.col("kind") == "integer") & F.array_contains("kinds", F.lit("number")))
    spelt = F.coalesce((F.col("kind") == "string") & F.col("pattern").isNotNull() & ~F.rlike("text", F.col("pattern")), F.lit(False))
    out = F.coalesce((F.col("number") < F.col("low")) | (F.col("number") > F.col("high")), F.lit(False))
    broken = met.where(whole | spelt | out).select(*keys, "rule", "path")
    # A key is required of every object that its parent's shape has.
    parent = F.regexp_replace("at", r"(\.[^.\[\]]+|\[\])$", "")
    needed = table.where("required and at <> '$'").withColumn("parent", parent)
    holders = found.where("kind = 'object'").select(*keys, F.col("shape").alias("parent"), F.col("path").alias("holder"))
    last = F.regexp_extract("at", r"(\.[^.\[\]]+)$", 1)
    asked = holders.join(needed, "parent").where(last != "").select(*keys, "rule", F.concat("holder", last).alias("path"))
    missing = asked.join(found.select(*keys, "path"), [*keys, "path"], "left_anti").select(*keys, "rule", "path")
    shut = table.where("closed").select(F.col("at").alias("above"), F.col("rule").alias("rule"))
    allowed = table.select(F.col("at").alias("shape"))
    more = found.join(shut, "above").join(allowed, "shape", "left_anti").select(*keys, F.concat("rule", F.lit("_keys")).alias("rule"), "path")
    return broken.unionByName(missing).unionByName(more)
