"""Packing documents into sequences of fixed length: dominance reduction, then best fit.

Only lengths matter to a packing, and there are at most ``size`` of them. So the
table is reduced to a histogram of piece lengths, the packing is solved on the
driver over counts (its work depends on the number of distinct lengths, not of
documents), and pieces are then dealt to the places of the solution by their
number within their length.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtally.llm.common import materialize, numbered, of_driver, ship

END_OF_TEXT = "<|endoftext|>"
# White space as the byte-level vocabulary's splitting rule knows it (Unicode White_Space).
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SEGMENT = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


class Segments(dict):
    """Token ids (little-endian bytes) of stretches between white space, kept for reuse.

    The vocabulary never merges across these stretches, so encoding them one by
    one gives the ids of the whole text. The store starts anew when it is full.
    """

    def __init__(self, encode, ranks: dict[bytes, int], most: int = 400_000) -> None:
        super().__init__()
        self.encode, self.ranks, self.most = encode, ranks, most

    def begins_with_blank(self) -> np.ndarray:
        """For each id whether its bytes begin with a blank."""
        out = np.zeros(max(self.ranks.values(), default=0) + 2, dtype=bool)
        out[[i for token, i in self.ranks.items() if token.startswith(b" ")]] = True
        return out

    def __missing__(self, segment: str) -> bytes:
        ids = array("I", self.encode(segment)).tobytes()
        if len(segment) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[segment] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _SEGMENT.findall(text)))


@cache
def segments(path: str, pattern: str) -> Segments:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Segments(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, ranks)


def token_ids(text: str, vocabulary: str | None = None) -> bytes:
    """Ids of a text, little-endian unsigned 32-bit; equal to those of byte_bpe_50k.json.

    ``vocabulary`` is the path of the same vocabulary as ranks, which encodes
    several times faster than the JSON form. The end-of-text string in a text
    is its special token, as it is there.
    """
    import public_tokenizers

    s = segments(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    if END_OF_TEXT in text:
        return array("I", [50256]).tobytes().join(s.ids(x) for x in text.split(END_OF_TEXT))
    return s.ids(text)


def _pieces(size: int, end_id: int, vocabulary: str | None):
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(b.num_columns - 1)):
                ids = memoryview(token_ids(text.as_py() or "", vocabulary) + end)
                n = len(ids) // 4
                at, cut, k = 0, (n % size or size), 0
                while at < n:
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(cut)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + cut)]))
                    at, cut, k = at + cut, size, k + 1
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.take(take) for c in b.columns[:-1]),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                [*b.schema.names[:-1], "piece", "start", "length", "ids_crc32"],
            )

    return run


def reduce_by_dominance(counts: dict[int, int], size: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets of lengths that some best packing holds, how often, and the counts that are left.

    For an item of length w let r be the room beside it. The set is fixed if
    nothing fits (w alone); if a partner of exactly r is there; if at most one
    further item fits (its largest); or if at most two fit and the largest single
    partner is no shorter than any pair that fits: every other set with w is then
    dominated, as its items can be exchanged for the partner.
    """
    left = {w: n for w, n in counts.items() if n > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []
    sizes = sorted(left)

    def take(items: tuple[int, ...]) -> None:
        need = Counter(items)
        times = min(left[w] // k for w, k in need.items())
        fixed.append((items, times))
        for w, k in need.items():
            left[w] -= k * times
            if not left[w]:
                del left[w]
                sizes.pop(bisect_left(sizes, w))

    def smallest(without: int, many: int) -> list[int]:
        out: list[int] = []
        for w in sizes:
            out += [w] * min(many - len(out), left[w] - (w == without))
            if len(out) == many:
                break
        return out

    def largest(room: int, without: int) -> int:
        for i in range(bisect_right(sizes, room) - 1, -1, -1):
            if left[sizes[i]] - (sizes[i] == without) > 0:
                return sizes[i]
        return 0

    def best_pair(room: int, without: int) -> int:
        """The longest two items together that fit into ``room``."""
        own = [w for w in sizes if w <= room and left[w] - (w == without) > 0]
        best, i, j = 0, 0, len(own) - 1
        while i <= j:
            t = own[i] + own[j]
            if t > room or (i == j and left[own[i]] - (own[i] == without) < 2):
                j -= 1
            else:
                best, i = max(best, t), i + 1
        return best

    again = True
    while again:
        again = False
        for w in sorted(left, reverse=True):
            while left.get(w):
                room = size - w
                k = largest(room, w)
                low = smallest(w, 3)
                if not k:
                    take((w,))
                elif k == room or sum(low[:2]) > room or len(low) < 2:
                    take((w, k))
                elif (sum(low) > room or len(low) < 3) and k >= best_pair(room, w):
                    take((w, k))
                else:
                    break
                again = True
    return fixed, left


def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: each item goes where it leaves the least room."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room left
    rooms: list[int] = []

    def put(room: int, items: tuple[int, ...], times: int) -> None:
        if not bins[room]:
            insort(rooms, room)
        bins[room].append((items, times))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect_left(rooms, w)
            if at < len(rooms):
                room = rooms[at]
                items, times = bins[room].pop()
                if not bins[room]:
                    rooms.pop(at)
                use = min(n, times)
                if use < times:
                    put(room, items, times - use)
                put(room - w, (*items, w), use)
                n -= use
            else:
                # New sequences, each filled with as many of this length as fit.
                each = size // w
                if n >= each:
                    put(size - each * w, (w,) * each, n // each)
                    n %= each
                else:
                    put(size - n * w, (w,) * n, 1)
                    n = 0
    return [x for same in bins.values() for x in same]


def solve(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences) for the whole histogram."""
    fixed, left = reduce_by_dominance(counts, size)
    return fixed + best_fit(left, size)


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, numbers, first sequence, items a sequence, first offset)."""
    used: Counter = Counter()
    out, sequence = [], 0
    for items, times in patterns:
        offset = 0
        for w, k in sorted(Counter(items).items(), reverse=True):
            out.append((w, used[w], k * times, sequence, k, offset))
            used[w] += k * times
            offset += k * w
        sequence += times
    return out


def _seats(spark: SparkSession, patterns: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """A row per place of the solution: w, sequence, at, share, step.

    ``share`` is how far along the sequences of its pattern a place's is, from 0 to 1.
    """
    most = max(1024, isqrt(sum(n for _, n in patterns)))
    rows, sequence = [], 0
    for items, times in patterns:
        offset, held = 0, []
        for w, k in sorted(Counter(items).items(), reverse=True):
            held.append((w, k, offset))
            offset += k * w
        rows += [(sequence, i, min(most, times - i), times, held) for i in range(0, times, most)]
        sequence += times
    schema = "first long, i long, n long, times long, held array<struct<w:long,k:long,at:long>>"
    made = of_driver(spark, rows, schema).repartition(max(1, min(64, len(rows))), "first", "i")
    each = made.select("first", "times", "held", F.explode(F.expr("sequence(i, i + n - 1)")).alias("j"))
    lengths = each.select("first", "times", "j", F.explode("held").alias("h"))
    return lengths.select("*", F.explode(F.expr("sequence(0L, h.k - 1)")).alias("c")).selectExpr(
        "h.w AS w",
        "first + j AS sequence",
        "h.at + c * h.w AS at",
        "(j + 0.5D) / times AS share",
        "cast((j + 0.5D) / times * 1073741824 AS long) AS step",
    )


def _pack_in_order(pieces: DataFrame, patterns: list[tuple[tuple[int, ...], int]], names: list[str]) -> DataFrame:
    """Deals pieces in the order of ``names`` and numbers sequences by where their tokens stand in it, on average."""
    order = [F.col(c) for c in (*names, "doc_id", "piece", "ids_crc32", "start")]
    dealt = numbered(pieces, "length", order, "number", along=names[0])
    # Every pattern takes its share of each stretch of the order, so that the pieces of a sequence stand near each other.
    seats = numbered(_seats(pieces.sparkSession, patterns), "w", [F.col(c) for c in ("share", "sequence", "at")], "seat", along="step")
    held = materialize(dealt.join(seats, (F.col("length") == F.col("w")) & (F.col("number") == F.col("seat"))))
    turn = held.groupBy("sequence").agg((F.sum(F.col(names[0]) * F.col("length")) / F.sum("length")).alias("turn"))
    turn = turn.select(F.lit(0).alias("all"), "sequence", "turn", F.floor("turn").alias("step"))
    turn = numbered(turn, "all", [F.col("turn"), F.col("sequence")], "sequence_id", along="step")
    return held.join(turn.select("sequence", "sequence_id"), "sequence").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("at").alias("offset")
    )


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 1024,
    end_id: int = 2,
    vocabulary: str | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then ``end_id``; a null or empty text is
    ``end_id`` alone. Only documents longer than ``size`` are cut, the first
    piece taking what does not fill a sequence. Rows that repeat an id are
    packed each for itself. An empty table gives no rows. ``order`` names columns
    of ``docs``, the first of whole numbers: pieces of one length are dealt, and
    sequences numbered, in that order. Without it their order means nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f"order_{i}" for i in range(len(order or []))]
    kinds = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(names, order or [], strict=True))
    by = [F.col(c).alias(n) for n, c in zip(names, order or [], strict=True)]
    rows = docs.select(F.col(id_col).alias("doc_id"), *by, F.col(text_col).alias("text"))
    pieces = materialize(
        rows.mapInArrow(
            _pieces(size, end_id, vocabulary),
            f"doc_id {kind}, {kinds}piece int, start long, length long, ids_crc32 long",
        )
    )
    counts = dict(pieces.groupBy("length").count().collect())  # at most ``size`` rows
    patterns = solve(counts, size)
    if names:
        return _pack_in_order(pieces, patterns, names)
    places = _places(patterns)
    schema = "w long, first long, numbers long, sequence long, each long, at long"
    # At most a few places for each of ``size`` lengths, whatever the number of documents.
    place = F.broadcast(of_driver(spark, places, schema))
    by = [F.col(c) for c in ("doc_id", "piece", "ids_crc32", "start")]
    held = (F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("numbers"))
    nth = F.col("number") - F.col("first")
    return (
        numbered(pieces, "length", by, "number")
        .join(place, (F.col("length") == F.col("w")) & held)
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("sequence") + F.expr("(number - first) div each")).alias("sequence_id"),
            (F.col("at") + nth % F.col("each") * F.col("length")).alias("offset"),
        )
    )
