"""Lines of transcript files, numbered, with what became of each.

Files are read in byte ranges, from any file system that Arrow knows. A first
pass counts the line breaks of files of several ranges; a second one reads the
lines that begin in a range, numbered from those counts. Both cut at 0x0A alone
and know whether the last line was ended.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtally.session import ship

MAX_LINE = 64 << 20
RANGE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
BLOCK = 1 << 20
MOST_CHARS = 20_000_000  # of one string, beyond which Spark's parser gives up
SCHEMA = "file_idx int, line_no long, terminated boolean, byte_len long, text string, cut_chars long"
ARROW = pa.schema([("file_idx", pa.int32()), ("line_no", pa.int64()), ("terminated", pa.bool_()), ("byte_len", pa.int64()), ("text", pa.string()), ("cut_chars", pa.int64())])


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), path
    return system.open_input_file(inner)


def _blocks(f, at: int, end: int) -> Iterator[bytes]:
    f.seek(at)
    while at < end and (block := f.read(min(BLOCK, end - at))):
        at += len(block)
        yield block


def _count_breaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line breaks of each range; none where a file can't be read, which the second pass reports."""
    for batch in batches:
        for r in batch.to_pylist():
            try:
                with _open(r["path"]) as f:
                    n = sum(b.count(b"\n") for b in _blocks(f, r["a"], r["b"]))
            except OSError:
                n = 0
            yield pa.RecordBatch.from_pydict({"file_idx": pa.array([r["file_idx"]], pa.int32()), "a": [r["a"]], "breaks": [n]})


def _lines_from(f, a: int, b: int, size: int, longest: int) -> Iterator[tuple[int, bool, int, bytes | None]]:
    """(breaks from a, ended, length, bytes) of the lines that begin in [a, b); no bytes of one longer than ``longest``."""
    begun = a == 0  # a line begins at a if the byte before it is a break
    at, held, length, n = max(a - 1, 0), [], 0, 0
    for block in _blocks(f, at, size):
        i = 0
        while (end := block.find(b"\n", i)) >= 0:
            if begun:
                length += end - i
                if length <= longest:
                    held.append(block[i:end])
                yield n, True, length, b"".join(held) if length <= longest else None
            n += at + end >= a
            begun, held, length, i = True, [], 0, end + 1
            if at + i >= b:
                return
        if begun:
            length += len(block) - i
            held = [*held, block[i:]] if length <= longest else []
        at += len(block)
        if not begun and at >= b:
            return
    if begun and length:
        yield n, False, length, b"".join(held) if length <= longest else None


# Matches to the end of the line where a string isn't closed, so that no quote is tried twice.
_STRING = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\Z)', re.S)


def without_giants(raw: bytes, most: int = MOST_CHARS) -> tuple[bytes, int]:
    """JSON text with strings of more than ``most`` UTF-16 characters emptied, and how many characters those had.

    What isn't valid stays as it is, so that it still counts as an error.
    """
    if len(raw) <= most:
        return raw, 0
    out, at, cut = [], 0, 0
    for m in _STRING.finditer(raw):
        if m.end() - m.start() - 2 <= most:
            continue
        try:
            chars = len(json.loads(m[0].decode("utf-8", "replace")).encode("utf-16-le", "surrogatepass")) // 2
        except ValueError:
            continue
        if chars > most:
            out.append(raw[at : m.start()] + b'""')
            at, cut = m.end(), cut + chars
    return b"".join([*out, raw[at:]]), cut


def _reader(longest: int, most: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows, held = [], 0
                try:
                    with _open(r["path"]) as f:
                        for n, ended, length, raw in _lines_from(f, r["a"], r["b"], r["size"], longest):
                            raw, cut = (None, 0) if raw is None else without_giants(raw.removesuffix(b"\r"), most)
                            text = None if raw is None else raw.decode("utf-8", "replace")
                            rows.append((r["file_idx"], r["first"] + n + 1, ended, length, text, cut))
                            held += length
                            if held >= BATCH_BYTES:
                                yield _batch(rows)
                                rows, held = [], 0
                except OSError:
                    rows.append((r["file_idx"], None, None, None, None, None))
                if rows:
                    yield _batch(rows)

    return read


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


def read_lines(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES, longest: int = MAX_LINE, most: int = MOST_CHARS) -> DataFrame:
    """file_idx, line_no (from 1), terminated, byte_len, text (null if longer than ``longest``, without one CR at its end), cut_chars.

    JSON strings of more than ``most`` characters are emptied, so that the rest of
    their record is read; ``cut_chars`` counts what was left out.

    Reads no more of a file than the size it was listed with. A range that can't
    be read is one row that has a file_idx only.
    """
    wanted = files.where("file_class is not null and size > 0").select("file_idx", "path", F.col("size").cast("long").alias("size"))
    tasks = _tasks(spark, wanted, range_bytes)
    ship(spark)
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))
    ranges = wanted.select("*", F.explode(starts).alias("a")).withColumn("b", F.least("size", F.col("a") + range_bytes))
    # Ranges are dealt by their own hash, so many tasks read a large file.
    many = ranges.where(F.col("size") > range_bytes).repartition(tasks, "file_idx", "a")
    counted = many.mapInArrow(_count_breaks, "file_idx int, a long, breaks long")
    before = Window.partitionBy("file_idx").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select("file_idx", "a", F.coalesce(F.sum("breaks").over(before), F.lit(0)).alias("breaks"))
    placed = ranges.join(firsts, ["file_idx", "a"], "left")
    first = F.coalesce("breaks", F.lit(0)).cast("long").alias("first")
    return placed.select("file_idx", "path", "size", "a", "b", first).repartition(tasks, "file_idx", "a").mapInArrow(_reader(longest, most), SCHEMA)


def _tasks(spark: SparkSession, files: DataFrame, range_bytes: int) -> int:
    """A task for about every range's worth of bytes, and all cores where there are more than a few megabytes."""
    total = files.agg(F.sum("size")).first()[0] or 0
    least = spark.sparkContext.defaultParallelism if total > BATCH_BYTES else 1
    return min(max(total // range_bytes + 1, least), 100_000)


def records(lines: DataFrame) -> DataFrame:
    """Adds ``r``, the record as a VARIANT where the line holds an object, and ``fate`` of every line.

    Fates: object, blank, oversize, unreadable (a range of a file), partial (a last line that isn't ended and doesn't
    parse), error, other (valid JSON, but no object).
    """
    clean = F.regexp_replace("text", "^﻿", "")
    parsed = lines.withColumn("r", F.try_parse_json(clean))
    shape = F.schema_of_variant("r")
    fate = (
        F.when(F.col("line_no").isNull(), "unreadable")
        .when(F.col("text").isNull(), "oversize")
        .when(F.trim(clean) == "", "blank")
        .when(F.col("r").isNull(), F.when(F.col("terminated"), "error").otherwise("partial"))
        .when(shape.startswith("OBJECT"), "object")
        .otherwise("other")
    )
    return parsed.withColumn("fate", fate)


def scan_receipts(found: DataFrame, files: DataFrame) -> DataFrame:
    """What was read, by class of file."""
    dim = F.broadcast(files.select("file_idx", "file_class"))
    fates = [F.count_if(F.col("fate") == f).alias(f"n_{f}") for f in ("object", "blank", "error", "partial", "other", "oversize", "unreadable")]
    return found.join(dim, "file_idx").groupBy("file_class").agg(
        F.countDistinct("file_idx").alias("files"), F.count("line_no").alias("lines"), F.sum("byte_len").alias("bytes"),
        F.max("byte_len").alias("longest_line"), *fates, F.sum("cut_chars").alias("cut_chars"),
    )
