"""Hard negatives by a dual-tree search over whole inner products.

Vectors become whole numbers, so that scores are exact. Candidates are dealt to
blocks of one label, cut by random hyperplanes so that near vectors share a block, and anchors
to slices in the same way. Every block has a box (the least and largest of each
component), and so have the nodes of a tree over the candidates of a batch and of a
tree over the anchors of a slice. The inner products of two boxes lie in an interval:
a pair of nodes whose interval misses what its anchors can still use is dropped with
all its pairs of rows, and pairs of leaves that stay are scored exactly. A first
search finds the positives of each anchor within its label, a second one the
negatives of other labels inside the window that each positive's score opens.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtally.llm.common import materialize, ship

LEAF = 64
#: Candidates that one tree is built over.
TOGETHER = 4096
NEVER = np.iinfo(np.int64).min
EXACT_FLOAT, EXACT_LONG = 1 << 53, 1 << 63


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers; too large ones for a long are an error."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < EXACT_FLOAT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < EXACT_LONG:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if max(map(abs, exact.ravel())) >= EXACT_LONG:
        raise OverflowError("an inner product does not fit a long")
    return exact.astype(np.int64)


class Tree:
    """Boxes over the rows of a matrix, halved along the widest component down to ``LEAF`` rows."""

    def __init__(self, rows: np.ndarray):
        self.order = np.arange(len(rows))
        self.begin, self.end, self.child = [0], [len(rows)], [-1]
        node = 0
        while node < len(self.begin):
            b, e = self.begin[node], self.end[node]
            if e - b > LEAF:
                own = rows[self.order[b:e]]
                axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                self.order[b:e] = self.order[b:e][np.argpartition(own[:, axis], (e - b) // 2)]
                self.child[node] = len(self.begin)
                self.begin += [b, b + (e - b) // 2]
                self.end += [b + (e - b) // 2, e]
                self.child += [-1, -1]
            node += 1
        self.child = np.array(self.child)
        parts = [rows[self.order[b:e]] for b, e in zip(self.begin, self.end, strict=True)]
        # Interval sums are kept as floats: widened below by more than they can be off.
        self.low = np.array([p.min(axis=0) for p in parts]).astype(np.float64)
        self.high = np.array([p.max(axis=0) for p in parts]).astype(np.float64)

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.begin[node] : self.end[node]]

    def over(self, value: np.ndarray, best) -> np.ndarray:
        """For every node ``best`` (np.min or np.max) of its rows' values."""
        return np.array([best(value[self.rows(i)]) for i in range(len(self.begin))])


def intervals(low_a, high_a, low_b, high_b) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest inner products of points of two boxes, row by row."""
    ends = np.stack([low_a * low_b, low_a * high_b, high_a * low_b, high_a * high_b])
    least, most = ends.min(axis=0).sum(axis=-1), ends.max(axis=0).sum(axis=-1)
    slack = 1e-9 * np.abs(ends).max(axis=0).sum(axis=-1)
    return least - slack, most + slack


def leaf_pairs(a: Tree, b: Tree, floor: np.ndarray, ceiling: np.ndarray) -> dict[int, list[int]]:
    """For leaves of ``a`` the leaves of ``b`` that may hold a product between the nodes' floors and ceilings."""
    found: dict[int, list[int]] = {}
    x, y = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while len(x):
        least, most = intervals(a.low[x], a.high[x], b.low[y], b.high[y])
        keep = (most >= floor[x]) & (least <= ceiling[x])
        x, y = x[keep], y[keep]
        down_a, down_b = a.child[x], b.child[y]
        for i, j in zip(x[(down_a < 0) & (down_b < 0)].tolist(), y[(down_a < 0) & (down_b < 0)].tolist(), strict=True):
            found.setdefault(i, []).append(j)
        # Both nodes go down a level where both can.
        both, one, other = (down_a >= 0) & (down_b >= 0), (down_a >= 0) & (down_b < 0), (down_a < 0) & (down_b >= 0)
        x, y = (
            np.concatenate([*(down_a[both] + i for i in (0, 0, 1, 1)), *(down_a[one] + i for i in (0, 1)), x[other], x[other]]),
            np.concatenate([*(down_b[both] + i for i in (0, 1, 0, 1)), y[one], y[one], *(down_b[other] + i for i in (0, 1))]),
        )
    return found


def _best(score: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, ties by ``order``."""
    if len(score) > 4 * most:
        bound = np.partition(score, len(score) - most)[len(score) - most]
        at = np.flatnonzero(score >= bound)
        return at[np.lexsort((order[at], -score[at]))][:most]
    return np.lexsort((order, -score))[:most]


class Anchors:
    """The anchors of a slice, their windows of scores and the best rows found for each window."""

    def __init__(self, ids, vectors: np.ndarray, lows: list[np.ndarray], highs: list[np.ndarray], most: int, others: bool):
        self.ids, self.vectors, self.most, self.others = ids, vectors, most, others
        self.lows, self.highs = lows, highs
        self.held = [[(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in w] for w in lows]
        self.tree = Tree(vectors)

    def floors(self) -> np.ndarray:
        """The least score that each anchor can still use."""
        out = []
        for lows, held in zip(self.lows, self.held, strict=True):
            still = [max(lo, int(h[0][-1])) if len(h[0]) == self.most else lo for lo, h in zip(lows.tolist(), held, strict=True)]
            out.append(min(still, default=2**62))
        return np.array(out, dtype=np.float64)

    def search(self, ids: np.ndarray, unknown: np.ndarray, vectors: np.ndarray) -> None:
        """Hold the anchors against candidates; ``unknown`` marks those without an id, which come last among ties."""
        tree = Tree(vectors)
        ceiling = np.array([h.max() if len(h) else -(2**62) for h in self.highs], dtype=np.float64)
        pairs = leaf_pairs(self.tree, tree, self.tree.over(self.floors(), np.min), self.tree.over(ceiling, np.max))
        place = np.lexsort((ids, unknown))
        rank = np.empty(len(ids), dtype=np.int64)
        rank[place] = np.arange(len(ids))
        for leaf, leaves in pairs.items():
            rows = np.concatenate([tree.rows(j) for j in leaves])
            scores = products(self.vectors[self.tree.rows(leaf)], vectors[rows])
            for own, score in zip(self.tree.rows(leaf).tolist(), scores, strict=True):
                self._take(own, score, rows, rank, ids, unknown, vectors)

    def _take(self, own: int, score, rows, rank, ids, unknown, vectors) -> None:
        if not self.others:  # the anchor itself is no positive
            same = np.flatnonzero((ids[rows] == self.ids[own]) & ~unknown[rows])
            same = same[(vectors[rows[same]] == self.vectors[own]).all(axis=1)]
            score, rows = np.delete(score, same), np.delete(rows, same)
        for w, (lo, hi) in enumerate(zip(self.lows[own].tolist(), self.highs[own].tolist(), strict=True)):
            best, best_ids, best_unknown = self.held[own][w]
            least = max(lo, int(best[-1])) if len(best) == self.most else lo
            at = np.flatnonzero((score >= least) & (score <= hi))
            if len(at):
                at = at[_best(score[at], rank[rows[at]], self.most)]
                s, i, u = np.append(best, score[at]), np.append(best_ids, ids[rows[at]]), np.append(best_unknown, unknown[rows[at]])
                top = np.lexsort((i, u, -s))[: self.most]
                self.held[own][w] = s[top], i[top], u[top]


def _searching(most: int, others: bool):
    """Rows block, slice, kind, id, vector, lows, highs come sorted by the first three, anchors (kind 0) before candidates."""
    schema = pa.schema([("anchor", pa.int64()), ("vector", pa.binary()), ("window", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def matrix(column) -> np.ndarray:
        rows = [np.frombuffer(v.as_buffer(), np.int64) for v in column]
        return np.stack(rows) if rows else np.empty((0, 0), np.int64)

    def longs(column) -> tuple[np.ndarray, np.ndarray]:
        unknown = column.is_null().to_numpy(zero_copy_only=False)
        return column.fill_null(0).to_numpy(zero_copy_only=False), unknown

    def told(anchors: Anchors) -> pa.RecordBatch:
        out = [
            (int(i), v.tobytes(), w, None if u else int(n), int(s))
            for i, v, held in zip(anchors.ids, anchors.vectors, anchors.held, strict=True)
            for w, (scores, ids, unknown) in enumerate(held)
            for s, n, u in zip(scores, ids, unknown, strict=True)
        ]
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, anchors, last = None, [], None, None
        for batch in batches:
            block, slot, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            change = (np.diff(block) != 0) | (np.diff(slot) != 0) | (np.diff(kind) != 0)
            edges = np.concatenate([[0], np.flatnonzero(change) + 1, [len(block)]]) if len(block) else [0]
            for b, e in zip(edges[:-1], edges[1:], strict=True):
                if (block[b], slot[b]) != key:
                    if anchors:
                        yield told(anchors)
                    key, asked, anchors, last = (block[b], slot[b]), [], None, None
                part = batch.slice(b, e - b)
                if kind[b] == 0:
                    asked.append(part)
                    continue
                if not asked:
                    continue
                if anchors is None:
                    held = pa.Table.from_batches(asked).combine_chunks()
                    lows, highs = ([np.array(x, dtype=np.int64) for x in held.column(c).to_pylist()] for c in ("lows", "highs"))
                    anchors = Anchors(longs(held.column("id"))[0], matrix(held.column("vector")), lows, highs, most, others)
                ids, unknown = longs(part.column("id"))
                vectors = matrix(part.column("vector"))
                # Rows that repeat id and vector follow each other and count once.
                again = np.zeros(len(ids), dtype=bool)
                again[1:] = (ids[1:] == ids[:-1]) & (unknown[1:] == unknown[:-1]) & (vectors[1:] == vectors[:-1]).all(axis=1)
                again[0] = last is not None and last[:2] == (ids[0], unknown[0]) and np.array_equal(last[2], vectors[0])
                last = ids[-1], unknown[-1], vectors[-1]
                ids, unknown, vectors = ids[~again], unknown[~again], vectors[~again]
                for at in range(0, len(ids), TOGETHER):
                    anchors.search(ids[at : at + TOGETHER], unknown[at : at + TOGETHER], vectors[at : at + TOGETHER])
        if anchors:
            yield told(anchors)

    return run


def _whole(scale: int, cuts: np.ndarray):
    """Vectors as whole numbers of one length, the side of each cut they lie on, without rows that have nothing to compare."""
    dim = cuts.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, vectors, sides = [], [], []
            for i, v in enumerate(batch.column("vector")):
                x = np.array(v.values.to_numpy(zero_copy_only=False), dtype=np.float64) if v.is_valid else None
                if x is None or v.values.null_count or not np.isfinite(x).all():
                    continue
                whole = np.floor(scale * x)
                if len(whole) and np.abs(whole).max() >= EXACT_LONG:
                    raise OverflowError("a scaled component does not fit a long")
                whole = np.pad(whole.astype(np.int64), (0, dim - len(whole)))
                keep.append(i)
                vectors.append(whole.tobytes())
                sides.append(int(((cuts @ whole) > 0) @ (1 << np.arange(len(cuts)))))
            at = pa.array(keep, pa.int64())
            columns = [batch.column(c).take(at) for c in ("id", "label", "is_anchor")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(vectors, pa.binary()), pa.array(sides, pa.int32())], ["id", "label", "is_anchor", "vector", "side"]
            )

    return run


def _box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The boxes of keys within a task: key, low, high."""
    boxes: dict[tuple, list[np.ndarray]] = {}
    for batch in batches:
        for key, v in zip(batch.column("key").to_pylist(), batch.column("vector"), strict=True):
            x = np.frombuffer(v.as_buffer(), np.int64)
            box = boxes.setdefault(key, [x.copy(), x.copy()])
            np.minimum(box[0], x, out=box[0])
            np.maximum(box[1], x, out=box[1])
    columns = [list(boxes), [b[0].tolist() for b in boxes.values()], [b[1].tolist() for b in boxes.values()]]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "low", "high"])


def _boxes(rows: DataFrame, key: str) -> DataFrame:
    """(key, low, high) of the vectors of every key; tasks send one box a key."""
    part = rows.select(F.col(key).alias("key"), "vector").mapInArrow(_box, "key long, low array<long>, high array<long>")
    ends = part.select("key", F.posexplode(F.arrays_zip("low", "high")))
    each = ends.groupBy("key", "pos").agg(F.min("col.low").alias("low"), F.max("col.high").alias("high"))
    whole = each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "low", "high"))).alias("b"))
    return whole.select("key", F.col("b.low").alias("low"), F.col("b.high").alias("high"))


def _meets(slots: DataFrame):
    """Of blocks key, low, high, label the pairs (block, slice) whose interval reaches a slice's windows; ``slots`` are few and held."""
    held = [
        (s["key"], s["labels"], np.array(s["low"], float), np.array(s["high"], float), float(s["floor"]), float(s["ceiling"]))
        for s in slots
    ]
    keys, low, high = [h[0] for h in held], np.array([h[2] for h in held]), np.array([h[3] for h in held])
    floor, ceiling = np.array([h[4] for h in held]), np.array([h[5] for h in held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high")), strict=True):
                least, most = intervals(low, high, np.array(lo, float), np.array(hi, float))
                found += [(block, keys[i]) for i in np.flatnonzero((most >= floor) & (least <= ceiling))]
            yield pa.RecordBatch.from_pylist(
                [{"block": a, "slot": b} for a, b in found], schema=pa.schema([("block", pa.int64()), ("slot", pa.int64())])
            )

    return run


def _search(candidates: DataFrame, blocks: DataFrame, anchors: DataFrame, most: int, others: bool) -> DataFrame:
    """(anchor, vector, window, id, score) of the best rows of each block for each anchor and window.

    ``candidates``: block, label, id, vector; ``anchors``: slot, label, id, vector, lows, highs. Anchors
    meet candidates of other labels or of their own. No more than 256 slots come to the driver.
    """
    spark = candidates.sparkSession
    windows = anchors.groupBy("slot").agg(
        F.min(F.array_min("lows")).alias("floor"), F.max(F.array_max("highs")).alias("ceiling"), F.lit(None).alias("labels")
    )
    slots = _boxes(anchors, "slot").join(windows, F.col("key") == F.col("slot")).collect()
    if not slots:
        return spark.createDataFrame([], "anchor long, vector binary, window int, id long, score long")
    pairs = materialize(blocks.select("key", "low", "high").mapInArrow(_meets(slots), "block long, slot long"))
    of_label = blocks.select(F.col("key").alias("block"), F.col("label").alias("other"))
    differ = F.col("label") != F.col("other") if others else F.col("label") == F.col("other")
    asked = anchors.join(pairs, "slot").join(of_label, "block").where(differ)
    asked = asked.select("block", "slot", F.lit(0).alias("kind"), "id", "vector", "lows", "highs")
    none = F.array().cast("array<long>")
    rows = candidates.join(pairs, "block").select("block", "slot", F.lit(1).alias("kind"), "id", "vector", none.alias("lows"), none.alias("highs"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = asked.unionByName(rows).repartition(parts, "block", "slot").sortWithinPartitions("block", "slot", "kind", "id", "vector")
    return dealt.mapInArrow(_searching(most, others), "anchor long, vector binary, window int, id long, score long")


def _ranked(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = [F.desc("score"), F.col("id").isNull(), "id"]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= most)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    n_positives: int = 5,
    n_negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    scale: int = 256,
    seed: int = 42,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x), a score is the inner product of these
    whole numbers; higher scores come first, ties by smaller id, null ids last. An
    anchor's positives are its best ``n_positives`` other rows of its label; for each, its
    best ``n_negatives`` rows of other labels whose score lies within ``window``
    percent of the positive's are returned, ranks from 1. A positive of a negative
    score opens no window, as 50 % of it are more than 95 %.

    Rows with a null label, a null vector or a null or non-finite component take no
    part. Shorter vectors count as filled up with zeros, an empty one as all zeros. Rows that
    repeat id, label and vector count once; rows that repeat an id alone are rows of
    their own. Anchors without an id are left out, as nothing could name them. A
    score that leaves the range of a long is an error. Other columns are ignored; an
    empty table gives no rows. Ids are whole numbers, labels of any simple type.

    A block holds about 16 times the root of all rows, so blocks grow as the root in number
    and size; no more than 256 slices of anchors and their boxes are held at once.
    """
    spark = rows.sparkSession
    ship(spark)
    taken = rows.where(F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.coalesce(is_anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("is_anchor"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    size = taken.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    n, dim = size["n"], max(0, size["dim"] or 0)
    per_block = max(512, 16 * isqrt(n))
    cuts = np.random.default_rng(seed).standard_normal((max(0, (n // per_block).bit_length() - 1), dim))
    whole = taken.mapInArrow(_whole(scale, cuts), "id long, label string, is_anchor boolean, vector binary, side int")
    whole = materialize(whole)
    # A block is a label and a side of the cuts, dealt out by id where it has too many rows.
    sizes = whole.groupBy("label", "side").agg(F.ceil(F.count("*") / per_block).alias("many"))
    sizes = materialize(sizes.withColumn("first", F.monotonically_increasing_id() * 65536))
    spread = F.pmod(F.xxhash64("id", "vector"), F.col("many"))
    dealt = whole.join(sizes, ["label", "side"]).withColumn("block", F.col("first") + spread)
    candidates = materialize(dealt.select("block", "label", "id", "vector", "side", "is_anchor"))
    labels = candidates.select(F.col("block").alias("key"), "label").distinct()
    blocks = materialize(_boxes(candidates, "block").join(labels, "key"))
    anchors = candidates.where("is_anchor").select("id", "label", "vector", "side").distinct()
    anchors = materialize(anchors)
    slices = min(256, -(-anchors.count() // 1024))
    few = max(1, slices)
    by_side = F.pmod(F.when(F.lit(few) > (1 << len(cuts)), F.xxhash64("id")).otherwise(F.col("side").cast("long")), F.lit(few))
    anchors = anchors.withColumn("slot", by_side)
    everything = anchors.withColumns({"lows": F.array(F.lit(-(2**62))), "highs": F.array(F.lit(2**62))})
    positives = _search(candidates, blocks, everything, n_positives, False)
    positives = materialize(_ranked(positives, ["anchor", "vector"], n_positives).withColumnRenamed("rank", "nth"))
    low, high = window
    # Whole scores within the percentages: low * p <= 100 * s <= high * p.
    opened = positives.select(
        F.col("anchor").alias("id"),
        "vector",
        F.col("nth").alias("place"),
        F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
        F.ceil(F.col("score").cast("decimal(38,0)") * low / 100).cast("long").alias("lo"),
        F.floor(F.col("score").cast("decimal(38,0)") * high / 100).cast("long").alias("hi"),
    )
    at = F.sort_array(F.collect_list(F.struct("place", "lo", "hi"))).alias("w")
    windows = opened.groupBy("id", "vector").agg(at).select("id", "vector", F.col("w.lo").alias("lows"), F.col("w.hi").alias("highs"))
    negatives = _search(candidates, blocks, anchors.join(windows, ["id", "vector"]), n_negatives, True)
    negatives = _ranked(negatives, ["anchor", "vector", "window"], n_negatives)
    named = opened.select(F.col("id").alias("anchor_id"), "vector", (F.col("place") - 1).alias("window"), "positive_id", "positive_score")
    return negatives.withColumnRenamed("anchor", "anchor_id").join(named, ["anchor_id", "vector", "window"]).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
