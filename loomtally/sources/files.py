"""Transcript files: where they are, what class each is, how large it was when listed."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtally.session import shared_folder, ship

DEPTHS = {"main": 0, "subagent": 1, "workflow_agent": 2, "workflow_journal": 3}
SCHEMA = "file_idx int, root_idx int, rel_path string, path string, file_class string, depth int, size long"
LISTED = "root_idx int, rel_path string, path string, what string, size long"
ARROW = pa.schema([("root_idx", pa.int32()), ("rel_path", pa.string()), ("path", pa.string()), ("what", pa.string()), ("size", pa.int64())])
BATCH = 10_000


def default_roots(env: dict[str, str], home: str, app: str) -> list[str]:
    """Project folders of ``app``: a named folder, one under home, one under the config home."""
    named = (env.get(f"{app.upper()}_CONFIG_DIR") or "").strip()
    config = (env.get("XDG_CONFIG_HOME") or "").strip() or (f"{home}/.config" if home else "")
    found = [named and f"{named}/projects", home and f"{home}/.{app}/projects", config and f"{config}/{app}/projects"]
    return list(dict.fromkeys(x for x in found if x))


def resolve_roots(candidates: Iterable[str], only: str | None = None) -> tuple[list[str], list[str]]:
    """Existing folders without repeats, and those that are missing; ``only`` wins outright."""
    found, missing = [], []
    for c in [only] if only else candidates:
        if os.path.isdir(c):
            found.append(os.path.realpath(c))
        else:
            missing.append(c)
    return list(dict.fromkeys(found)), missing


# The shapes of a path below a root, without the file's extension, and the class of each; the first that fits.
SHAPES = (
    ("main", r"^[^/]+/[^/]+$"),
    ("subagent", r"^[^/]+/[^/]+/subagents/[^/]+$"),
    ("workflow_agent", r"^[^/]+/[^/]+/subagents/workflows/[^/]+/agent-[^/]*$"),
    ("workflow_journal", r"^[^/]+/[^/]+/subagents/workflows/([^/]+)/(?:journal|\1)$"),
)
EXTENSIONS = (
    ("compressed", r"\.jsonl(\.superseded-[^/]+)?\.zst$"),
    ("read", r"\.jsonl(\.superseded-[^/]+)?$"),
)


def with_class(df: DataFrame, rel_path: str = "rel_path") -> DataFrame:
    """Adds file_class and depth, or the reason why a path is skipped, from its shape alone."""

    def first_of(c: Column, table: tuple[tuple[str, str], ...]) -> Column:
        return F.coalesce(*(F.when(c.rlike(pattern), name) for name, pattern in table))

    clean = F.regexp_replace(F.translate(F.col(rel_path), "\\", "/"), r"(^|/)(?:\.?/)+", "$1")
    whole = F.regexp_replace(clean, r"(^|/)\.orphaned-([^/]*)$", "$1$2")
    kind = first_of(F.regexp_replace(whole, r"\.jsonl[^/]*$", ""), SHAPES)
    ending = F.coalesce(first_of(whole, EXTENSIONS), F.lit("unknown-extension"))
    reason = F.when(whole == "", "unknown-shape").when(ending != "read", ending).when(kind.isNull(), "unknown-shape")
    depth = F.element_at(F.create_map(*(F.lit(x) for pair in DEPTHS.items() for x in pair)), F.col("file_class"))
    return (
        df.withColumn("skip_reason", reason)
        .withColumn("file_class", F.when(F.col("skip_reason").isNull(), kind))
        .withColumn("depth", depth)
    )


def _inside(folder: str) -> Iterator[tuple[str, str, int | None]]:
    """(name, what, size) of each thing in a folder: a file, a folder, a link, other or unreadable; links are not followed."""
    if "://" not in folder:
        with os.scandir(folder) as entries:
            for e in entries:
                name = e.name.encode("utf-8", "replace").decode()
                try:
                    kinds = (("link", e.is_symlink()), ("folder", e.is_dir(follow_symlinks=False)), ("file", e.is_file(follow_symlinks=False)))
                    what = next((k for k, yes in kinds if yes), "other") if name == e.name else "unreadable"
                    size = e.stat(follow_symlinks=False).st_size if what == "file" else None
                except OSError:
                    what, size = "unreadable", None
                yield name, what, size
        return
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(folder)
    for x in system.get_file_info(fs.FileSelector(inner)):
        what = {fs.FileType.File: "file", fs.FileType.Directory: "folder"}.get(x.type, "other")
        yield x.base_name, what, x.size if what == "file" else None


def _below(root_idx: int, rel_path: str, path: str) -> Iterator[tuple]:
    """Rows of ``LISTED`` for what a folder holds; one of its own where it can't be read (to the end)."""
    named = quote if "://" in path else str
    try:
        for name, what, size in _inside(path):
            yield root_idx, f"{rel_path}/{name}" if rel_path else name, f"{path.rstrip('/')}/{named(name)}", what, size
    except OSError:
        yield root_idx, rel_path, path, "unreadable", None


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            below = _below(r["root_idx"], r["rel_path"], r["path"])
            while rows := list(islice(below, BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


def list_tree(spark: SparkSession, roots: list[str], at_once: int = 256) -> DataFrame:
    """Everything below ``roots`` (folders or URIs): root_idx, rel_path, path, what, size.

    ``what`` is file, folder, link (never followed, so no cycle is entered), other
    or unreadable, which a folder that can't be read or is gone is, too. The driver
    lists no more than ``at_once`` folders a level and 40 times as many things; the
    rest is listed level by level by tasks, each level written once.
    """
    found, level, left = [], [(i, "", root) for i, root in enumerate(roots)], []
    while level and not left:
        deeper = []
        for folder in level:
            rows = list(islice(_below(*folder), at_once + 1)) if len(level) <= at_once and len(found) <= 40 * at_once else None
            if rows is None or len(rows) > at_once:
                left.append(folder)
                continue
            found += rows
            deeper += [r[:3] for r in rows if r[3] == "folder"]
        level = deeper
    own = spark.createDataFrame(found, LISTED)
    if not left:
        return own
    ship(spark)
    kept = shared_folder(spark, "listing")
    ahead, n = spark.createDataFrame(left + level, "root_idx int, rel_path string, path string"), 0
    while folders := ahead.count():
        tasks = min(folders, 4 * spark.sparkContext.defaultParallelism)
        below = ahead.repartition(tasks, "root_idx", "rel_path").mapInArrow(_list_folders, LISTED)
        below.write.parquet(f"{kept}/level={n}")
        ahead, n = spark.read.schema(LISTED).parquet(f"{kept}/level={n}").where("what = 'folder'").select("root_idx", "rel_path", "path"), n + 1
    return own.unionByName(spark.read.schema(LISTED).parquet(*(f"{kept}/level={i}" for i in range(n))))


def _in_order(files: DataFrame) -> DataFrame:
    """Numbers files by root and path as UTF-16 text: a sort by ranges, each range beginning where those before it end."""
    kept = shared_folder(files.sparkSession, "files")
    files.orderBy("root_idx", F.encode("rel_path", "UTF-16BE")).withColumn("_n", F.monotonically_increasing_id()).write.parquet(kept)
    placed = files.sparkSession.read.parquet(kept).withColumn("_part", F.shiftright("_n", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    firsts = placed.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    idx = (F.col("_first") + F.col("_n").bitwiseAND((1 << 33) - 1)).cast("int").alias("file_idx")
    return placed.join(F.broadcast(firsts), "_part").select(idx, "root_idx", "rel_path", "path", "size")


def list_files(spark: SparkSession, roots: list[str], at_once: int = 256) -> DataFrame:
    """One row per file below ``roots``, symbolic links not followed; sizes as they were when listed."""
    return files_of(list_tree(spark, roots, at_once), 40 * at_once)


def files_of(tree: DataFrame, at_once: int = 10_240) -> DataFrame:
    """The files of a listing with their number and class; no more than ``at_once`` are sorted by one task."""
    files = tree.where("what = 'file'").drop("what")
    if files.limit(at_once + 1).count() > at_once:
        return with_class(_in_order(files))
    order = Window.orderBy("root_idx", F.encode("rel_path", "UTF-16BE"))
    return with_class(files.select((F.row_number().over(order) - 1).alias("file_idx"), "root_idx", "rel_path", "path", "size"))


def unlisted(tree: DataFrame) -> DataFrame:
    """Of a listing, how many things were passed over: root_idx, what (link, other, unreadable), entries."""
    return tree.where("what in ('link', 'other', 'unreadable')").groupBy("root_idx", "what").agg(F.count("*").alias("entries"))


def pick_root(candidates: list[str]) -> str:
    """Of several ways to read a dropped folder the one under which more files have a known shape."""
    shape = re.compile(r"^[^/]+/([^/]+\.jsonl|[^/]+/subagents/.+\.jsonl)$")

    def known(root: str) -> int:
        found = (os.path.relpath(os.path.join(d, n), root) for d, _, ns in os.walk(root) for n in ns)
        return sum(bool(shape.match(p)) for p in found)

    return max(candidates, key=lambda c: (known(c), -candidates.index(c)))


def retention(settings: Iterable[str], stats_cache: str | None = None) -> tuple[int | None, list[str] | None]:
    """cleanupPeriodDays of the last settings file that has it, and the days of a stats cache."""
    days = None
    for path in settings:
        try:
            with open(path, encoding="utf-8") as f:
                value = json.load(f).get("cleanupPeriodDays")
        except (OSError, ValueError, AttributeError):
            continue
        if isinstance(value, int | float) and not isinstance(value, bool):
            days = int(value)
    try:
        with open(stats_cache or "", encoding="utf-8") as f:
            listed = json.load(f).get("dailyActivity")
    except (OSError, ValueError, AttributeError):
        return days, None
    found = {d.get("date") for d in listed or [] if isinstance(d, dict)}
    return days, sorted(d for d in found if isinstance(d, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", d))


def parse_rules(text: str) -> tuple[tuple[str, str], ...]:
    """Project rules from JSON: an ordered list of prefix and label."""
    found = json.loads(text)
    if not isinstance(found, list):
        raise ValueError("project rules must be a list")
    return tuple((r["prefix"], str(r.get("label") or "")[:120]) for r in found if isinstance(r, dict) and r.get("prefix"))
