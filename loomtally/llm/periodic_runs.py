"""Runs of repeated words, by a harmonic grid and hashes of prefixes.

A run is a stretch of words with smallest period q, at least ``fewest`` words and
``times`` periods long, that neither neighbour extends. The places where a word
equals the word p places on form stretches that a run of period p fills for
``max(fewest, times * p) - p`` words at least, so a grid of that step meets every
run; the steps of all periods add up to a harmonic series. For all pairs of period
and grid point at once the longest equal extensions to both sides are found by
halving over hashes of prefixes. What is found is held against the words
themselves, and found again under another base if a hash has lied, so results are
exact. Words become numbers by a dictionary of the words of a slice of texts; no
word is a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtally.llm.common import ship, text_or_empty, without
from loomtally.llm.words import slices, split_words

_PRIME = np.uint64((1 << 31) - 1)
#: Pairs of period and grid point that are looked at together.
PAIRS = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1), modulo the prime, by doubling."""
    out = np.ones(max(1, n), dtype=np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step) % _PRIME
        done, step = done + more, step * step % int(_PRIME)
    return out


class _Prefixes:
    """Hashes of all prefixes of a sequence of numbers; equal stretches have equal hashes."""

    def __init__(self, words: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.power = _powers(int(rng.integers(1 << 16, int(_PRIME) - 1)), len(words) + 1)
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        # Numbers of words and terms lie below 2**31, so that the sums of 2**32 words fit.
        np.cumsum((words.astype(np.uint64) + np.uint64(1)) * self.power[: len(words)] % _PRIME, out=self.sums[1:])

    def same(self, at: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether the words at ``at`` and ``period`` places on agree over ``length`` words."""
        left = (self.sums[at + length] - self.sums[at]) % _PRIME
        right = (self.sums[at + period + length] - self.sums[at + period]) % _PRIME
        return left * self.power[period] % _PRIME == right


def _longest(most: np.ndarray, agrees) -> np.ndarray:
    """For each pair the largest length up to ``most`` for which ``agrees``; by halving, all pairs at once."""
    low, high = np.zeros_like(most), most.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_] + 1) >> 1
        good = agrees(open_, mid)
        low[open_] = np.where(good, mid, low[open_])
        high[open_] = np.where(good, high[open_], mid - 1)


def _grid(first: np.ndarray, n: np.ndarray, fewest: int, times: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, period, place) of every grid point of texts at ``first`` of ``n`` words, some ``PAIRS`` at a time."""
    periods = np.where(n >= fewest, n // times, 0)
    doc = np.repeat(np.arange(len(n)), periods)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(fewest, times * period) - period
    points = (n[doc] - period - 1) // step + 1
    before = np.cumsum(points) - points
    total = int(points.sum())
    for lo in range(0, total, PAIRS):
        pair = np.arange(lo, min(total, lo + PAIRS))
        row = np.searchsorted(before, pair, side="right") - 1
        yield doc[row], period[row], first[doc[row]] + (pair - before[row]) * step[row]


def find_runs_in(words: np.ndarray, n: np.ndarray, fewest: int = 6, times: int = 4) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, by text, start and period.

    ``words`` holds the numbers of the words of one text after another, ``n`` how
    many each text has; starts count from the beginning of their text.
    """
    first = np.cumsum(n) - n
    seed = 1
    while (found := _runs(words, first, n, fewest, times, seed)) is None:
        seed += 1  # a hash lied: again under another base
    doc, start, length, period = found
    return doc, start - first[doc], length, period


def _runs(words: np.ndarray, first: np.ndarray, n: np.ndarray, fewest: int, times: int, seed: int):
    prefixes = _Prefixes(words, seed)
    kept = [np.empty((0, 4), dtype=np.int64)]
    for doc, period, at in _grid(first, n, fewest, times):
        hit = words[at] == words[at + period]
        doc, period, at = doc[hit], period[hit], at[hit]
        begins, ends = first[doc], first[doc] + n[doc]
        after = _longest(ends - at - period, lambda i, k: prefixes.same(at[i], k, period[i]))
        ahead = _longest(at - begins, lambda i, k: prefixes.same(at[i] - k, k, period[i]))
        start, end = at - ahead, at + period + after
        keep = end - start >= np.maximum(fewest, times * period)
        kept.append(np.unique(np.stack([doc, start, end, period], axis=1)[keep], axis=0))
    rows = np.unique(np.concatenate(kept), axis=0)
    if not len(rows):
        return (rows[:, 0],) * 4
    # One stretch found with several periods has the smallest of them; the others must be its multiples.
    lead = np.flatnonzero(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))
    smallest = np.repeat(rows[lead, 3], np.diff(np.append(lead, len(rows))))
    if (rows[:, 3] % smallest).any():
        return None
    doc, start, end, period = rows[lead].T
    for d, s, e, q in rows[lead].tolist():
        if not np.array_equal(words[s : e - q], words[s + q : e]):
            return None
        if (s > first[d] and words[s - 1] == words[s - 1 + q]) or (e < first[d] + n[d] and words[e] == words[e - q]):
            return None
    return doc, start, end - start, period


def _drop_repeats(n: np.ndarray, length: np.ndarray, packed: np.ndarray, runs: tuple[np.ndarray, ...]) -> pa.Array:
    """The texts with one blank between words, without the words that a run holds after its first period."""
    doc, start, size, period = runs
    first = np.cumsum(n) - n
    change = np.zeros(len(length) + 1, dtype=np.int64)
    np.add.at(change, first[doc] + start + period, 1)
    np.add.at(change, first[doc] + start + size, -1)
    keep = np.cumsum(change[:-1]) == 0
    spaced = np.full(len(packed) + len(length), 32, dtype=np.uint8)
    spaced[np.arange(len(packed)) + np.repeat(np.arange(len(length)), length)] = packed
    spaced = spaced[np.repeat(keep, length + 1)]
    sizes = np.concatenate([[0], np.cumsum(np.where(keep, length + 1, 0))])
    last = sizes[np.append(first, len(length))]
    held = pa.Array.from_buffers(
        pa.large_binary(), len(n), [None, pa.py_buffer(last.astype(np.int64)), pa.py_buffer(spaced)]
    )
    return pc.binary_slice(held, 0, -1)  # without the last blank


def _detect(fewest: int, times: int, slice_bytes: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, n, length, packed = split_words(batch.column("text"))
        runs = find_runs_in(words, n, fewest, times)
        doc, start, size, period = runs
        of = np.append(0, np.cumsum(np.bincount(doc, minlength=len(n)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(
            pa.array(of),
            pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, size, period)], fields=list(kind.value_type)),
        )
        rest = _drop_repeats(n, length, packed, runs).cast(pa.binary()).cast(pa.string())
        columns = [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(n), lists, rest]
        return pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(part, slices(batch, "text", slice_bytes))

    return run


def find_runs(
    docs: DataFrame,
    keep: list[str],
    text_col: str = "text",
    fewest: int = 6,
    times: int = 4,
    slice_bytes: int = 1 << 22,
) -> DataFrame:
    """One row per document: the columns ``keep``, n_words, runs, collapsed.

    Words are what ASCII white space parts. ``runs`` is an array of structs start
    (number of the first word, from 0), length, period, by start and period: every
    stretch with smallest period ``period``, ``max(fewest, times * period)`` words
    at least, that neither neighbour extends (``times`` of 2 or more). ``collapsed``
    is the text with one blank between words and without the words that any run
    holds after its first period. Texts that are null, empty or only white space
    have no words, no runs and an empty text. Repeated rows are rows of their own,
    an empty table gives none, and other columns are ignored whatever their names.
    A text is worked on whole by one task, about ``slice_bytes`` of short ones together;
    memory is some thirty times a long text, work its words times their logarithm.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    ship(docs.sparkSession)
    rows = docs.select(*keep, text_or_empty(text_col).alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    made = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(_detect(fewest, times, slice_bytes), f"{fields}, {made}")


def repeat_tail(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` repeating a stretch of words to its end in a tenth of the rows, told by ``key``.

    With h the crc32 of the key as decimal text and g = h // 10, rows with h % 10 = 0 and
    n > 0 words have the words from a = g % n on replaced by the 1 + (n - a) // (3 + g % 8)
    words from a, again and again; their words are then parted by one blank. Null
    keys count as the empty text, null texts stay null. It is a way to plant known runs.
    """
    p = without(docs)
    h = F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8"))
    planted = docs.withColumns({f"{p}_g": F.floor(h / 10), f"{p}_hit": h % 10 == 0})
    words = F.when(F.col(f"{p}_hit"), F.regexp_extract_all(text_col, F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    planted = planted.withColumn(f"{p}_w", words).withColumn(f"{p}_n", F.size(f"{p}_w"))
    w, n, g = f"{p}_w", f"{p}_n", f"{p}_g"
    a, many = f"cast({g} % {n} as int)", f"cast(3 + {g} % 8 as int)"
    tile = f"slice({w}, {a} + 1, cast(1 + ({n} - {a}) div {many} as int))"
    whole = f"slice(concat(slice({w}, 1, {a}), flatten(array_repeat({tile}, {many} + 1))), 1, {n})"
    hit = F.col(f"{p}_hit") & (F.col(n) > 0)
    edited = F.when(hit, F.expr(f"array_join({whole}, ' ')")).otherwise(F.col(text_col))
    return planted.withColumn(text_col, edited).select(*docs.columns)
