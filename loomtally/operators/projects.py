"""Which project a response belongs to: its launch folder, or the first rule that fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtally.functions import text as T
from loomtally.operators.dedup import file_order, with_files

UNKNOWN = "unknown folder"


def launch_folders(activity: DataFrame, files: DataFrame) -> DataFrame:
    """session_id and folder: of its main thread if it has one, the earliest; never limited in time."""
    seen = with_files(activity.where("session_id is not null and cwd is not null"), files)
    side = ~((F.col("file_class") == "main") & ~F.col("is_sidechain"))
    order = F.struct(side.alias("s"), F.col("ts_ms"), *(c.alias(f"o{i}") for i, c in enumerate(file_order(False))))
    return seen.groupBy("session_id").agg(T.normalize_path(F.min_by("cwd", order)).alias("launch"))


def rule_for(path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """(key, label) of the first rule whose prefix holds ``path``; rules are a short ordered list."""
    out = F.lit(None).cast("struct<key:string,label:string>")
    for prefix, label in reversed(rules):
        p = T.normalize_path(F.lit(prefix))
        own = F.struct(p.alias("key"), F.coalesce(F.nullif(F.lit(label), F.lit("")), T.base_name(p)).alias("label"))
        out = F.when(T.is_inside(path, p), own).otherwise(out)
    return out


def with_project(df: DataFrame, launch: DataFrame, rules: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Adds project_key and project_label.

    Without a rule the project is the launch folder, or its first subfolder when
    the work was done below it.
    """
    rows = df.join(launch, "session_id", "left")
    cwd, home = T.normalize_path(F.col("cwd")), F.col("launch")
    base = F.when(home.endswith("/"), home).otherwise(F.concat(home, F.lit("/")))
    sub = F.concat(base, F.substring_index(F.expr("substring(_cwd, length(_base) + 1)"), "/", 1))
    rows = rows.withColumn("_cwd", cwd).withColumn("_base", base)
    key = (
        F.when(home.isNull(), F.coalesce("_cwd", F.lit("")))
        .when((F.col("_cwd") != home) & T.is_inside(F.col("_cwd"), home), sub)
        .otherwise(home)
    )
    label = F.when(F.col("_key") == "", UNKNOWN).otherwise(T.base_name(F.col("_key")))
    rows = rows.withColumn("_rule", rule_for(F.coalesce("_cwd", home), rules)).withColumn("_key", key)
    return (
        rows.withColumn("project_label", F.coalesce("_rule.label", label))
        .withColumn("project_key", F.coalesce("_rule.key", "_key"))
        .drop("_cwd", "_base", "_rule", "_key", "launch")
    )
