"""Interleaving sources at target weights by Pfair scheduling.

The rows of a source are dealt to blocks of equal size, and a slot holds one
block. A phase lasts until a source runs out; in it a source of share w has its
k-th block (from 0) released at floor(k / w) and due at ceil((k+1) / w), counted
from the start of the phase. Earliest deadline first among released blocks meets
all deadlines, so in each slot every source is within less than one block of its
share. When a source runs out, the weights of the others are scaled up and a new
phase begins in the next slot, so every row is placed exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from heapq import heapify, heappop, heappush
from math import isqrt, lcm

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtally.llm.common import materialize, numbered, of_driver, text_or_empty, without

SLOTS_PER_CYCLE = 1024


def whole(weights: list[float]) -> list[int]:
    """The weights as whole numbers in the very same proportion."""
    exact = [Fraction(w) for w in weights]
    unit = lcm(*(x.denominator for x in exact))
    return [int(x * unit) for x in exact]


def schedule(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int, int, int]]:
    """(source, block, release, deadline) of slot 0, 1, ... until all blocks are placed.

    Sources of weight zero come when no other has blocks left, in equal shares.
    Memory is a few numbers a source, work is in proportion to slots and, at the
    start of each phase, to the sources that are left.
    """
    exact, left, used, at = whole(weights), list(blocks), [0] * len(blocks), 0
    while any(left):
        w = {i: exact[i] for i, n in enumerate(left) if n and exact[i] > 0} or {i: 1 for i, n in enumerate(left) if n}
        total, first, done = sum(w.values()), at, dict.fromkeys(w, 0)
        ready = [(-(-total // n), i) for i, n in w.items()]
        heapify(ready)
        waiting: list[tuple[int, int]] = []
        over = False
        while not over:
            while waiting and waiting[0][0] <= at - first:
                i = heappop(waiting)[1]
                heappush(ready, (-(-(done[i] + 1) * total // w[i]), i))
            due, i = heappop(ready)
            k = done[i]
            yield i, used[i], first + k * total // w[i], first + due
            done[i], used[i], left[i], at = k + 1, used[i] + 1, left[i] - 1, at + 1
            over = not left[i]
            heappush(waiting, ((k + 1) * total // w[i], i))


def plan_cycles(blocks: list[int], weights: list[float], slots: int = SLOTS_PER_CYCLE) -> Iterator[tuple]:
    """(first slot, sources, blocks, releases, deadlines) for stretches of up to ``slots`` slots."""
    at, held = 0, ([], [], [], [])
    for row in schedule(blocks, weights):
        for column, x in zip(held, row, strict=True):
            column.append(x)
        if len(held[0]) == slots:
            yield at, *held
            at, held = at + slots, ([], [], [], [])
    if held[0]:
        yield at, *held


def block_slots(spark: SparkSession, cycles: Iterator[tuple]) -> DataFrame:
    """s, block, slot, release, deadline for every block; a few numbers a block pass through the driver."""
    names = ("s", "block", "release", "deadline")
    rows = list(cycles)
    schema = "first long, " + ", ".join(f"{n} array<long>" for n in names)
    made = of_driver(spark, rows, schema).repartition(max(1, min(64, len(rows))), "first")
    return made.select("first", F.posexplode(F.arrays_zip(*names)).alias("t", "b")).select(
        F.col("b.s").cast("int").alias("s"),
        "b.block",
        (F.col("first") + F.col("t")).alias("slot"),
        "b.release",
        "b.deadline",
    )


def mix_order(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    block_rows: int | None = None,
    temperature: float = 0.5,
    seed: int = 7,
) -> DataFrame:
    """One row per document: doc_id, source, text_hash, again, block, slot, release, deadline, place.

    ``place`` is the row's place within its block; reading by (slot, place) gives
    the mixture. A block holds ``block_rows`` rows, by default 32 or an eighth of the
    root of all rows if that is more, so that the schedule, which is worked out block
    by block, grows with the root of the table. ``weights`` maps sources to target weights; without it a source
    of n rows weighs n ** ``temperature``. Sources that ``weights`` does not name
    weigh as little as the least named one. A null source is a source of its own.
    Rows within a source come in an order given by a hash. Rows that repeat id,
    source and text are told apart by ``again``. Nothing is dropped; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.xxhash64(text_or_empty(text_col)).alias("text_hash"),
    )
    repeats = Window.partitionBy("doc_id", "source", "text_hash").orderBy("doc_id")
    rows = materialize(rows.withColumn("again", F.row_number().over(repeats)))
    sources = (
        rows.groupBy("source")
        .agg(F.count("*").alias("rows"))
        .withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_first())) - 1)
    )
    known = sources.orderBy("s").collect()  # a row per source
    if not known:
        known_weights, blocks = [], []
        return rows.select(
            "doc_id", "source", "text_hash", "again",
            *(F.lit(None).cast("long").alias(c) for c in ("block", "slot", "release", "deadline", "place")),
        )
    least = min(weights.values()) if weights else 0.0
    known_weights = [weights.get(r["source"], least) if weights else r["rows"] ** temperature for r in known]
    block_rows = block_rows or max(32, isqrt(sum(r["rows"] for r in known)) // 8)
    blocks = [-(-r["rows"] // block_rows) for r in known]
    slots = block_slots(spark, plan_cycles(blocks, known_weights))
    order = [F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.col("doc_id"), F.col("text_hash"), F.col("again")]
    return (
        numbered(rows, "source", order, "nth")
        .join(F.broadcast(sources.select(F.col("source").alias("of"), "s")) if len(known) <= 100_000 else sources.select(F.col("source").alias("of"), "s"), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("block", F.expr(f"nth div {block_rows}"))
        .withColumn("place", F.col("nth") % block_rows)
        .join(slots, ["s", "block"])
        .select("doc_id", "source", "text_hash", "again", "block", "slot", "release", "deadline", "place")
    )


def placed(
    docs: DataFrame,
    slot: str,
    place: str,
    weights: dict[str | None, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """``docs``, all rows, with two columns more: the slot and the place within it that the mixture gives a row."""
    p = without(docs)
    found = mix_order(docs, weights, id_col, source_col, text_col, **options)
    # One column, a struct, is the key of window, groups and join: nulls in it meet, and texts are shuffled once.
    # Read hashes may be null by their schema, others not; as different types they would be shuffled again.
    key = lambda i, s, t: F.struct(i.alias("i"), s.alias("s"), F.coalesce(t, F.lit(0)).alias("t")).alias(f"{p}_k")
    at = found.groupBy(key(F.col("doc_id"), F.col("source"), F.col("text_hash"))).agg(
        F.sort_array(F.collect_list(F.struct("again", "slot", "place"))).alias(f"{p}_at")
    )
    marked = docs.select("*", key(F.col(id_col), F.col(source_col), F.xxhash64(text_or_empty(text_col))))
    repeats = Window.partitionBy(f"{p}_k").orderBy(f"{p}_k")
    marked = marked.withColumn(f"{p}_a", F.row_number().over(repeats))
    own = F.element_at(f"{p}_at", F.col(f"{p}_a"))
    return marked.join(at, f"{p}_k").select(*docs.columns, own["slot"].alias(slot), own["place"].alias(place))


def interleave(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """The rows of ``docs``, all of them, partitioned and sorted in the order of the mixture."""
    p = without(docs)
    found = placed(docs, f"{p}_slot", f"{p}_place", weights, id_col, source_col, text_col, **options)
    return (
        found.repartitionByRange(f"{p}_slot", f"{p}_place")
        .sortWithinPartitions(f"{p}_slot", f"{p}_place")
        .select(*docs.columns)
    )
