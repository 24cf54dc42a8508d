"""Exact deduplication that no group of copies can skew.

Three stages, each of which compares whole normalised texts beside the digest:

1. every map task combines its own copies (partial aggregation on digest,
   salt and text);
2. salted digest groups are merged, so that a group with many copies is spread
   over as many tasks as its size asks for;
3. the winners of the salts of one text are combined into the group's winner.

Only digests with more than ``rows_per_salt`` rows are salted. They are found
by a first pass over digests alone; there are fewer than ``hot_limit`` of them
by construction, so that list may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtally.llm.common import ASCII_SPACE, materialize, text_or_empty, without


def normalised(text: str = "text") -> Column:
    """The text without any ASCII white space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), f"{ASCII_SPACE}+", "")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_salt: int = 1000,
    hot_limit: int = 100_000,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null and empty
    texts form one group. The row with the most code points stays, then the one
    with the smallest id, of whatever type that can be ordered; a null id comes last. Of rows that repeat an id and a
    length within a group exactly one is marked kept. Other columns of ``docs``
    are ignored; an empty table gives no rows.
    """
    body = normalised(text_col)
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), F.length(text_or_empty(text_col)).alias("n"), body.alias("body")
    ).withColumn("digest", F.unhex(F.sha2("body", 256)))
    per_salt = max(rows_per_salt, -(-docs.count() // hot_limit))
    hot = (
        keyed.groupBy("digest")
        .agg(F.count("*").alias("copies"))
        .where(F.col("copies") > per_salt)
        .select(F.col("digest").alias("hot_digest"), F.ceil(F.col("copies") / per_salt).alias("salts"))
    )
    best = F.struct((-F.col("n")).alias("minus"), F.col("doc_id").isNull().alias("unknown"), "doc_id")
    salted = (
        keyed.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
        .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "n") + F.spark_partition_id(), F.col("salts")), F.lit(0)))
        .groupBy("digest", "body", "salt", F.coalesce("salts", F.lit(1)).alias("salts"))
        .agg(F.min(best).alias("best"), F.collect_list(best).alias("members"))
    )
    # From here on only groups that were salted carry their text.
    local = materialize(
        salted.select(
            "digest", "salt", "salts", F.when(F.col("salts") > 1, F.col("body")).alias("body"), "best", "members"
        )
    )
    single = local.where("salts = 1").select(
        "digest", "best", "members", F.col("best").alias("top"), F.size("members").cast("long").alias("rows")
    )
    spread = local.where("salts > 1")
    tops = spread.groupBy("digest", "body").agg(
        F.min("best").alias("top"), F.sum(F.size("members")).alias("rows"), F.max("salts").alias("salts")
    )
    # The winner goes to every salt of its text, so that the lists of members stay apart.
    tops = tops.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    merged = spread.join(tops, ["digest", "salt", "body"]).select("digest", "best", "members", "top", "rows")
    member = F.posexplode("members").alias("at", "m")
    return (
        single.unionByName(merged)
        .select("digest", "top", "rows", (F.array_position("members", F.col("top")) - 1).alias("top_at"), member)
        .select(
            F.col("m.doc_id").alias("doc_id"),
            F.col("top.doc_id").alias("keep_id"),
            F.col("rows").alias("group_size"),
            (F.col("at") == F.col("top_at")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of every group of equal texts; columns as they were."""
    p = without(docs)
    row, digest = f"{p}_row", f"{p}_digest"
    kept = exact_groups(docs, id_col, text_col, **options).where("kept").select("doc_id", F.unhex("text_sha256").alias(digest))
    kept = kept.select(F.xxhash64("doc_id", digest).alias(row), digest)
    marked = docs.withColumn(digest, F.unhex(F.sha2(normalised(text_col), 256))).withColumn(row, F.xxhash64(F.col(id_col), F.col(digest)))
    # Rows that repeat an id and its text: one stays. The window keeps one of each task before the shuffle that the join needs as well.
    again = Window.partitionBy(row, digest).orderBy(F.length(text_or_empty(text_col)).desc(), text_col)
    once = marked.withColumn(f"{p}_again", F.row_number().over(again)).where(F.col(f"{p}_again") == 1)
    return once.join(kept, [row, digest], "left_semi").select(*docs.columns)
