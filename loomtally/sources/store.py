"""A scan kept as columns: every line is read and parsed once, however many tables are made of it.

A store is a folder with ``records``, Parquet by kind of record, and ``files``, the
listing with the sizes that were read, written last: a store without it isn't whole.
Only records that tables are made of keep their contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtally.functions import variant as V
from loomtally.functions.clock import parse_ms
from loomtally.operators.secrets import suspect

# Kinds of records.
TEXT_BEARING = ("custom-title", "ai-title", "last-prompt", "agent-name", "queue-operation")
CONTENTS = ("assistant", "user", "cost-state")


def kind(record_type: Column, file_class: Column) -> Column:
    """The part of a store that a record goes to: one of ``CONTENTS``, journal, text or rest; line where there is no record."""
    return (
        F.when(F.col("fate") != "object", "line")
        .when(file_class == "workflow_journal", "journal")
        .when(record_type.isin(*CONTENTS), record_type)
        .when(record_type.isin(*TEXT_BEARING), "text")
        .otherwise("rest")
    )


def with_heads(found: DataFrame, files: DataFrame | None) -> DataFrame:
    """Adds to records what all tables ask of them: type, ts_ms, kind and whether a secret may be in the line.

    Without ``files`` the records have their file_class themselves, as those of a stream do.
    """
    if "kind" in found.columns:
        return found
    r = F.col("r")
    placed = found if files is None else found.join(F.broadcast(files.select("file_idx", "file_class")), "file_idx", "left")
    headed = placed.withColumns(
        {"type": V.any_text(r, "type"), "ts_ms": parse_ms(V.any_text(r, "timestamp")), "suspect": suspect(F.col("text"))}
    )
    headed = headed.withColumn("kind", kind(F.col("type"), F.col("file_class")))
    return headed if files is None else headed.drop("file_class")


def write_store(found: DataFrame, files: DataFrame, path: str) -> None:
    """Writes the records of a scan and its listing to the folder ``path``, which must not be there yet."""
    headed = with_heads(found, files).withColumn("r", F.when(F.col("kind").isin(*CONTENTS), F.col("r")))
    kept = headed.select("file_idx", "line_no", "terminated", "byte_len", "cut_chars", "fate", "type", "ts_ms", "suspect", "r", "kind")
    kept.write.partitionBy("kind").parquet(f"{path}/records")
    files.write.parquet(f"{path}/files")


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records and the files of a store."""
    files = spark.read.parquet(f"{path}/files")
    schema = "file_idx int, line_no long, terminated boolean, byte_len long, cut_chars long, fate string, type string, ts_ms long, suspect boolean, r variant, kind string"
    return spark.read.schema(schema).parquet(f"{path}/records"), files
