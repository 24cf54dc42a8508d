"""Helpers shared by the document operators."""

from __future__ import annotations

import tempfile
import uuid
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: blank and 0x09 to 0x0D.
ASCII_SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="loomtally-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks can import it."""
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_loomtally_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp(prefix="loomtally-"))
    copy = folder / "tree" / package.name
    shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(folder / package.name), "zip", folder / "tree", package.name))
    sc._loomtally_shipped = True


#: Whether Spark removes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, rows: int | None = None, each: int = 1 << 14) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Cuts the lineage, so later steps neither recompute it nor depend on an
    executor that may be lost. The shuffle files of the write go when it ends: what
    follows reads the table, and without this they stay until the driver's heap is collected.
    A table that is known to have ``rows`` rows at most is written in files of about ``each``
    rows, where that makes fewer of them than there are shuffle partitions.
    """
    spark = df.sparkSession
    if rows is not None and (files := -(-rows // each)) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(max(1, files))
    path = f"{shared_dir(spark).rstrip('/')}/loomtally/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    made = spark.read.schema(df.schema).parquet(path)
    made._written = path
    return made


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote; nothing may read them any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def of_driver(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of rows that the driver holds. Sent as Arrow: executors start no Python workers to unpack it."""
    import pyarrow as pa

    kinds = spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("r")).select("r.*").toArrow().schema
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds.types, strict=True)], names=kinds.names))


def small(df: DataFrame, made_from: DataFrame, most: int = 1 << 15) -> DataFrame:
    """``df``, to be sent to all tasks of a join if the written table that it is made from has ``most`` rows or fewer.

    The other side of the join, say all texts, then stays where it is.
    """
    return F.broadcast(df) if made_from.limit(most + 1).count() <= most else df


def without(df: DataFrame, *names: str) -> str:
    """A column prefix that no column of ``df`` starts with."""
    prefix = "_lt"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold(column: str | Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; a null id counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")) % modulus


def numbered(
    df: DataFrame,
    key: str,
    order: list[Column],
    out: str,
    rows_per_bucket: int | None = None,
    along: str | None = None,
) -> DataFrame:
    """Number the rows of every ``key`` from 0, without one task per key.

    Rows are dealt to hash buckets; a small table of bucket sizes gives each
    bucket its first number, and only the rows of a bucket are sorted together.
    Without ``rows_per_bucket`` there are about as many buckets as rows in one,
    so neither a bucket nor the table of sizes grows faster than the root of the rows.
    ``order`` must tell rows apart; rows equal in it are interchangeable. Numbers
    follow ``order`` only within a bucket, unless ``along`` names a column of
    whole numbers that never falls in that order: buckets are then ranges of it.
    """
    from pyspark.sql import Window

    p = without(df)
    rows = df.count()
    buckets = max(1, -(-rows // (rows_per_bucket or max(512, isqrt(rows)))))
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets))
    if along and rows:
        low, high = df.agg(F.min(along), F.max(along)).first()
        bucket = F.expr(f"(`{along}` - {low}L) div {(high - low) // buckets + 1}L")
    dealt = df.withColumn(f"{p}_b", bucket.cast("int"))
    sizes = dealt.groupBy(key, f"{p}_b").agg(F.count("*").alias(f"{p}_n"))
    before = Window.partitionBy(key).orderBy(f"{p}_b").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(
        F.col(key).alias(f"{p}_k"),
        F.col(f"{p}_b").alias(f"{p}_kb"),
        F.coalesce(F.sum(f"{p}_n").over(before), F.lit(0)).alias(f"{p}_first"),
    )
    within = Window.partitionBy(key, f"{p}_b").orderBy(*order)
    return (
        dealt.withColumn(f"{p}_r", F.row_number().over(within) - 1)
        .join(first, F.col(key).eqNullSafe(F.col(f"{p}_k")) & (F.col(f"{p}_b") == F.col(f"{p}_kb")))
        .withColumn(out, F.col(f"{p}_first") + F.col(f"{p}_r"))
        .drop(f"{p}_b", f"{p}_r", f"{p}_k", f"{p}_kb", f"{p}_first")
    )
