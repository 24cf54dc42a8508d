"""Words of whole batches of texts as numbers, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows whose texts have ``most`` bytes together, or one row of more."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most)))
        yield batch.slice(at, end - at)
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cut(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, where each word begins (one more at the end) in the bytes of all words, and those."""
    held = texts.cast(pa.large_binary())
    offsets = np.frombuffer(held.buffers()[1], dtype=np.int64)[held.offset : held.offset + len(held) + 1]
    data = np.frombuffer(held.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    edges = offsets - offsets[0]
    inside = (data != 32) & ((data < 9) | (data > 13))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = edges[:-1][(edges[:-1] < len(data)) & (np.diff(edges) > 0)]
    begins[cut] = inside[cut]  # a word ends with its text
    starts = np.flatnonzero(begins)
    n = np.diff(np.searchsorted(starts, edges))
    packed = data[inside]
    if lower:
        packed[(packed >= 65) & (packed <= 90)] += 32
    inside[:-1] &= begins[1:] | ~inside[1:]  # now where words end
    bounds = np.append(0, np.cumsum(np.flatnonzero(inside) + 1 - starts))
    return n.astype(np.int64), bounds, packed


def word_counts(texts: pa.Array) -> np.ndarray:
    """How many words each text has."""
    return _cut(texts, False)[0]


def numbered_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of all words, words of each text, and the distinct words in UTF-8 by number; words as in ``split_words``."""
    n, bounds, packed = _cut(texts, lower)
    words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
    coded = pc.dictionary_encode(words)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), n, coded.dictionary


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all words, words of each text, lengths of the words in bytes, and the bytes of all words.

    Words are what ASCII white space parts; with ``lower`` A-Z count as a-z. Equal
    words have equal numbers, below the number of words.
    """
    n, bounds, packed = _cut(texts, lower)
    words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
    numbers = pc.dictionary_encode(words).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return numbers, n, np.diff(bounds), packed


_TABLE_PLACES = 64
#: A random number for each byte at each of the first places of a word.
_TABLE = mix(np.arange(1, _TABLE_PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the words of each text; words as in ``split_words``.

    A hash is the sum of random numbers, one for each byte and place, mixed with the length.
    """
    n, bounds, packed = _cut(texts, lower)
    return hashes(bounds, packed), n


def hashes(bounds: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """64-bit hashes of words that lie one after another in ``packed``, each from one of the ``bounds`` to the next."""
    length = np.diff(bounds)
    if not len(length):
        return np.empty(0, np.uint64)
    place = np.arange(len(packed)) - np.repeat(bounds[:-1], length)
    key = place * 256 + packed
    value = _TABLE[key % len(_TABLE)]
    far = np.flatnonzero(place >= _TABLE_PLACES)
    value[far] = mix((key[far] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(value, bounds[:-1]) + length.astype(np.uint64))
