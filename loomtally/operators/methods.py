"""The value under each way of counting: the right one, and five that go wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtally.functions.money import sum_big
from loomtally.operators import dedup as D
from loomtally.operators import pricing as P

METHODS = ("correct", "sumEveryLine", "keepFirstLine", "dedupPerFile", "allWritesAt5m", "mainFilesOnly")


def methods_totals(
    responses: DataFrame, files: DataFrame, prices: DataFrame, multiplier: int | None = None
) -> DataFrame:
    """method, nano and ratio to the right value (floored to six decimals); never limited in time."""
    lines = D.with_files(P.observation_nano(responses, prices, multiplier), files)
    keyed = D.response_keys(lines)
    kept = D.dedup_responses(responses, files)
    keys = ["pk", "final_key"]
    right = P.price_responses(kept, keys, prices, multiplier).select("nano")
    short = P.price_responses(kept, keys, prices, multiplier, all_5m=True).select("nano")
    order = [F.coalesce("ts_ms", F.lit(0)), *D.file_order(False)]
    first = D.pick(keyed, keys, order, ["obs_nano"]).select(F.col("obs_nano").alias("nano"))
    each = keyed.groupBy("file_idx", "pk").agg(F.max_by("obs_nano", F.struct("output", "line_no")).alias("nano")).select("nano")
    main = D.pick(keyed.where("file_class = 'main'"), ["pk"], [-F.col("output"), *D.file_order()], ["obs_nano"])
    every = (right, lines.select(F.col("obs_nano").alias("nano")), first, each, short, main.select(F.col("obs_nano").alias("nano")))
    out = None
    for name, rows in zip(METHODS, every, strict=True):
        one = rows.agg(sum_big("nano").alias("nano")).select(F.lit(name).alias("method"), "nano")
        out = one if out is None else out.unionByName(one)
    base = out.where("method = 'correct'").select(F.col("nano").alias("base"))
    ratio = F.when(F.col("base") > 0, F.floor(F.col("nano").cast("decimal(28,0)") * 1000000 / F.col("base").cast("decimal(28,0)")).cast("double") / 1e6)
    return out.join(F.broadcast(base)).select("method", "nano", ratio.alias("ratio"))  # one row beside six
