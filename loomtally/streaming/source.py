"""Transcripts that grow, as a stream of their ended lines.

How far every file has been read is a numbered list in the folder ``state``; the
stream's own offset is the number alone, so checkpoints stay small however many files
there are. A line whose end hasn't been written yet waits. Lines are placed by the byte at which
they begin, whose order is that of their numbers in a scan.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loomtally.session import configure, ship
from loomtally.sources.files import EXTENSIONS, with_class
from loomtally.sources.lines import BATCH_BYTES, BLOCK, MAX_LINE, RANGE_BYTES, _blocks, _lines_from, _open, records

SCHEMA = "root_idx int, rel_path string, line_no long, terminated boolean, byte_len long, text string"
ARROW = pa.schema(
    [("root_idx", pa.int32()), ("rel_path", pa.string()), ("line_no", pa.int64()), ("terminated", pa.bool_()), ("byte_len", pa.int64()), ("text", pa.string())]
)
NAME = "loomtally_transcripts"


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(roots: list[str]) -> dict[tuple[int, str], tuple[str, int]]:
    """(root number, relative path) -> (path, size) of the transcripts below ``roots``; links are not followed."""
    from pyarrow import fs

    shape = re.compile(dict(EXTENSIONS)["read"])
    found = {}
    for i, root in enumerate(roots):
        system, inner = _system(root)
        local = isinstance(system, fs.LocalFileSystem)
        for x in system.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=True)):
            rel = x.path[len(inner.rstrip("/")) + 1 :]
            linked = local and any(os.path.islink(os.path.join(inner, *rel.split("/")[:n])) for n in range(1, rel.count("/") + 2))
            if x.is_file and shape.search(rel) and not linked:
                found[i, rel] = (f"{root.rstrip('/')}/{rel}", x.size)
    return found


def ended(path: str, at: int, size: int) -> int:
    """Where the last ended line of [at, size) ends, or ``at``; read from the back."""
    with _open(path) as f:
        end = size
        while end > at:
            begin = max(at, end - BLOCK)
            f.seek(begin)
            if (cut := f.read(end - begin).rfind(b"\n")) >= 0:
                return begin + cut + 1
            end = begin
    return at


def placed_lines(f, a: int, b: int, size: int, longest: int) -> Iterator[tuple[int, int, bytes | None]]:
    """(first byte, length, bytes) of the lines that begin in [a, b)."""
    at = a
    if a:
        at = size
        seen = a - 1
        for block in _blocks(f, a - 1, size):
            if (cut := block.find(b"\n")) >= 0:
                at = seen + cut + 1
                break
            seen += len(block)
    for _, _, length, raw in _lines_from(f, a, b, size, longest):
        yield at, length, raw
        at += length + 1


@dataclass
class Range(InputPartition):
    root_idx: int
    rel_path: str
    path: str
    a: int
    b: int
    size: int


class Progress:
    """Numbered lists of how far each file is read, in the folder ``state``; number 0 is the empty one."""

    def __init__(self, state: str):
        self.system, self.folder = _system(state)
        self.system.create_dir(self.folder, recursive=True)

    def numbers(self) -> list[int]:
        from pyarrow import fs

        names = (x.base_name for x in self.system.get_file_info(fs.FileSelector(self.folder)))
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"read-(\d+)\.json", n)))

    def load(self, number: int) -> dict[tuple[int, str], int]:
        if number == 0:
            return {}
        with self.system.open_input_stream(f"{self.folder}/read-{number}.json") as f:
            return {(i, rel): n for i, rel, n in json.loads(f.read())}

    def save(self, number: int, read: dict[tuple[int, str], int]) -> None:
        """Written beside and moved, so that a list is there whole or not at all."""
        beside = f"{self.folder}/.read-{number}.new"
        with self.system.open_output_stream(beside) as f:
            f.write(json.dumps(sorted((i, rel, n) for (i, rel), n in read.items())).encode())
        self.system.move(beside, f"{self.folder}/read-{number}.json")

    def forget_before(self, number: int) -> None:
        for n in self.numbers():
            if n < number:
                self.system.delete_file(f"{self.folder}/read-{n}.json")


class Reader(DataSourceStreamReader):
    def __init__(self, roots: list[str], state: str, range_bytes: int, longest: int):
        self.roots, self.state, self.range_bytes, self.longest = roots, state, range_bytes, longest

    def initialOffset(self) -> dict:
        return {"list": 0}

    def latestOffset(self) -> dict:
        progress = Progress(self.state)
        number = max(progress.numbers(), default=0)
        read = progress.load(number)
        now = dict(read)
        for key, (path, size) in listed(self.roots).items():
            done = read.get(key, 0)
            if size > done:
                try:
                    now[key] = ended(path, done, size)
                except OSError:  # gone or locked meanwhile: looked at again next time
                    continue
        if all(read.get(k, 0) == n for k, n in now.items()):
            return {"list": number}
        progress.save(number + 1, now)
        return {"list": number + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        progress = Progress(self.state)
        before, after = progress.load(start["list"]), progress.load(end["list"])
        out = []
        for (i, rel), size in sorted(after.items()):
            begin = before.get((i, rel), 0)
            path = f"{self.roots[i].rstrip('/')}/{rel}"
            out += [Range(i, rel, path, a, min(a + self.range_bytes, size), size) for a in range(begin, size, self.range_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        p, rows, held = partition, [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)

        with _open(p.path) as f:
            for at, length, raw in placed_lines(f, p.a, p.b, p.size, self.longest):
                text = None if raw is None else raw.removesuffix(b"\r").decode("utf-8", "replace")
                rows.append((p.root_idx, p.rel_path, at, True, length, text))
                held += length
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    def commit(self, end: dict) -> None:
        """Lists before the one a restart would begin from are not asked for again."""
        Progress(self.state).forget_before(end["list"])


class Transcripts(DataSource):
    """Options: roots (a JSON list), state, rangeBytes, longest."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        o = self.options
        return Reader(json.loads(o["roots"]), o["state"], int(o.get("rangebytes", RANGE_BYTES)), int(o.get("longest", MAX_LINE)))


def read_growing(spark: SparkSession, roots: list[str], state: str, range_bytes: int = RANGE_BYTES, longest: int = MAX_LINE) -> DataFrame:
    """A stream of the lines that are ended below ``roots``: root_idx, rel_path, line_no (the byte at which it begins), terminated, byte_len, text.

    ``state`` is a folder of the stream's own, on a shared file system, kept as long as its
    checkpoint. A file that is cut short has nothing new until it is longer than it was.
    """
    ship(spark)
    spark.dataSource.register(Transcripts)
    options = {"roots": json.dumps(roots), "state": state, "rangeBytes": str(range_bytes), "longest": str(longest)}
    return spark.readStream.format(NAME).options(**options).load()


def growing_records(lines: DataFrame) -> DataFrame:
    """Records of such lines with what the order of files needs; file_idx is a number made of root and path."""
    configure(lines.sparkSession)
    placed = with_class(lines).where("file_class is not null")
    return records(placed.withColumn("file_idx", F.xxhash64("root_idx", "rel_path")))
