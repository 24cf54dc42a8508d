"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are summed from XXH64 hashes of word shingles. Documents with
equal fingerprints form one class, so copies are never paired. Two fingerprints
within ``budget`` bits agree on at least two of ``budget + 2`` blocks of bits:
each class goes to the groups of every two blocks, and the trie of a group is
joined with itself. A pair of trie nodes carries the bits in which their
prefixes differ and is dropped once they exceed the budget. A group reports
links that span it, never all pairs; components of the whole table are then
found by alternating large-star and small-star steps.

``drop_near_copies`` asks for a share of equal five-word shingles. At a
similarity of 0.8 the fingerprints of such shingles differ in ten of 64 bits or
so, too many for a join of tries, and fingerprints of shorter ones lose links, so
it takes the exact join of ``jaccard_join``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtally.llm.common import materialize, ship, text_or_empty, without

BITS = 64


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """SimHash of UTF-8 bytes; 0 for a text without words."""
    return _simhash(text.lower().split(), words, seed)  # bytes: ASCII letters and ASCII white space only


def _shingles(w: list[bytes], words: int) -> Iterator[bytes]:
    """Stretches of ``words`` words; the whole sequence where there are fewer."""
    return map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else iter([b" ".join(w)])


def _simhash(w: list[bytes], words: int, seed: int) -> int:
    import xxhash

    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in _shingles(w, words)), dtype=">u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            fps = np.fromiter(
                (fingerprint(t.as_py(), words, seed) for t in texts), dtype=np.uint64, count=b.num_rows
            )
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(b.num_columns - 1)), pa.array(fps.view(np.int64))],
                [*b.schema.names[:-1], "fp"],
            )

    return run


def block_masks(budget: int) -> list[int]:
    """Masks of every two of ``budget + 2`` blocks of bits."""
    n = budget + 2
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [a | b for a, b in combinations(blocks, 2)]


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (all roots) after linking a[i] with b[i]; the smallest index leads."""
    while len(a):
        ra, rb = parent[a], parent[b]
        keep = ra != rb
        a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = _roots(parent)
    return parent


def _split_bit(x: np.ndarray) -> np.ndarray:
    """A number whose highest one bit is that of ``x``, with all bits below set as well."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(s))
    return x


def _middle(f: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First place in [lo, hi) whose value has ``bit`` set; by halving, all nodes at once."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = (f[np.minimum(mid, len(f) - 1)] & bit) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def _new_links(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links a[i] - b[i] one for each two components that they join."""
    ra, rb = parent[a], parent[b]
    keep = ra != rb
    a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
    _, first = np.unique(np.minimum(ra, rb) * len(parent) + np.maximum(ra, rb), return_index=True)
    return a[first], b[first]


def trie_links(
    f: np.ndarray, starts: np.ndarray, budget: int, few: int = 0, chunk: int = 1 << 17
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in ``f`` whose values differ in at most ``budget`` bits, and which span each group's components.

    Within components of up to ``few`` values all such pairs are given. ``f`` holds the groups one after another, each sorted and without repeats;
    ``starts`` holds where each begins. Nodes of the (path-compressed) trie are
    intervals of ``f``. Work waits on a stack in chunks, so memory is bounded,
    and node pairs whose values are already in one component are dropped.
    """
    n = len(f)
    parent = np.arange(n, dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def link(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a[a != b], b[a != b]
        if few and len(a):
            size = np.bincount(parent, minlength=n)
            small = size[parent[a]] + np.where(parent[a] == parent[b], 0, size[parent[b]]) <= few
            found.append((a[small], b[small]))
            parent, a, b = _unite(parent, a[small], b[small]), a[~small], b[~small]
        a, b = _new_links(parent, a, b)
        found.append((a, b))
        return _unite(parent, a, b)

    ends = np.append(starts[1:], n)
    big = ends - starts > 1
    lo, hi = starts[big].astype(np.int64), ends[big].astype(np.int64)
    for a, b in zip(lo[hi - lo >= 512], hi[hi - lo >= 512], strict=False):
        # Dense groups: join values one bit apart by look-up first.
        g = f[a:b]
        for bit in range(BITS):
            other = g ^ np.uint64(1 << bit)
            at = np.minimum(np.searchsorted(g, other), len(g) - 1)
            hit = np.flatnonzero(g[at] == other)
            parent = link(parent, a + hit, a + at[hit])
    stack = [(lo, hi, lo, hi)]
    while stack:
        alo, ahi, blo, bhi = stack.pop()
        if len(alo) > chunk:
            cut = len(alo) // 2
            stack += [(alo[:cut], ahi[:cut], blo[:cut], bhi[:cut]), (alo[cut:], ahi[cut:], blo[cut:], bhi[cut:])]
            continue
        changes = np.concatenate([[0], np.cumsum(parent[1:] != parent[:-1])])
        one = (
            (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (parent[alo] == parent[blo])
        )
        if few:
            one &= np.bincount(parent, minlength=n)[parent[alo]] > few
        sa = _split_bit(f[alo] ^ f[ahi - 1])
        sb = _split_bit(f[blo] ^ f[bhi - 1])
        differ = np.bitwise_count((f[alo] ^ f[blo]) & ~np.maximum(sa, sb))
        go = ~one & (differ <= budget)
        alo, ahi, blo, bhi, sa, sb = (x[go] for x in (alo, ahi, blo, bhi, sa, sb))
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        parent = link(parent, alo[leaf], blo[leaf])
        rest = ~leaf
        alo, ahi, blo, bhi, sa, sb = (x[rest] for x in (alo, ahi, blo, bhi, sa, sb))
        if not len(alo):
            continue
        same = alo == blo
        # Split the node whose values part at the higher bit; a node paired with itself gives three pairs.
        swap = ~same & (sb > sa)
        xlo, xhi, s = np.where(swap, blo, alo), np.where(swap, bhi, ahi), np.where(swap, sb, sa)
        ylo, yhi = np.where(swap, alo, blo), np.where(swap, ahi, bhi)
        mid = _middle(f, xlo, xhi, s ^ (s >> np.uint64(1)))
        d = ~same
        stack.append(
            tuple(
                np.concatenate(x)
                for x in (
                    (xlo[same], mid[same], xlo[same], xlo[d], mid[d]),
                    (mid[same], xhi[same], mid[same], mid[d], xhi[d]),
                    (xlo[same], mid[same], mid[same], ylo[d], ylo[d]),
                    (mid[same], xhi[same], xhi[same], yhi[d], yhi[d]),
                )
            )
        )
    return np.concatenate([x[0] for x in found] or [parent[:0]]), np.concatenate([x[1] for x in found] or [parent[:0]])


def _group_links(budget: int, few: int = 0):
    """Links within groups of rows key, fp, node; rows come sorted by key. Nodes of one fp and group are linked in a row."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(key: np.ndarray, f: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.append(False, key[1:] != key[:-1]))
        order = np.lexsort((node, f, group))
        group, f, node = group[order], f[order], node[order]
        fresh = np.append(True, (f[1:] != f[:-1]) | (group[1:] != group[:-1]))
        again = np.flatnonzero(~fresh)
        at = np.flatnonzero(fresh)
        starts = np.flatnonzero(np.append(True, group[at][1:] != group[at][:-1]))
        a, b = trie_links(f[at], starts, budget, few)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.append(node[again], node[at[a]])), pa.array(np.append(node[again - 1], node[at[b]]))], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def joined() -> pa.RecordBatch:
            return links(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for batch in batches:
            key, f, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "node"))
            if not len(key):
                continue
            f = f.view(np.uint64)
            last = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
            if held and held[0][0][0] == key[0] and last == 0:
                held.append((key, f, node))
                continue
            held.append((key[:last], f[:last], node[:last]))
            if sum(len(x[0]) for x in held):
                yield joined()
            held[:] = [(key[last:], f[last:], node[last:])]
        if held:
            yield joined()

    return run


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for every node that is not its component's smallest; edges: a, b, ``rows`` of them at most.

    Rounds of large-star and small-star steps go on until nothing changes, which
    takes a number of them that grows as the logarithm of the nodes. No step makes more edges than there were.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), rows)
    state, rows = None, e.count()
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = materialize(small.unionByName(small_m.select("u", F.col("m").alias("v"))).distinct(), rows)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def _linked(classes: DataFrame, key_print: str, budget: int, node: str, own: str, within: int, few: int = 0) -> DataFrame:
    """Links (a, b) of nodes: groups by every two blocks of ``key_print``, joined by tries of ``own`` within ``within`` bits."""
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(budget)]
    keys = F.array(*(F.xxhash64(F.lit(i), F.col(key_print).bitwiseAND(F.lit(m))) for i, m in enumerate(masks)))
    grouped = classes.select(F.col(own).alias("fp"), F.col(node).alias("node"), F.explode(keys).alias("key"))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grouped.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_group_links(within, few), "a long, b long")


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    seed: int = 42,
    budget: int = 4,
) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, text_hash.

    ASCII letters are lower-cased; texts without words (null, empty, only white
    space) have fingerprint zero and link like any other; texts shorter than a
    shingle count as one shingle. A component is named by its smallest doc_id;
    null ids are kept and never lead. ``text_hash`` tells rows apart that
    repeat an id. Other columns of ``docs`` are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_or_empty(text_col)).alias("text_hash"),
        text_or_empty(text_col).alias("text"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    prints = materialize(rows.mapInArrow(_fingerprints(words, seed), f"doc_id {kind}, text_hash long, fp long"))
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = _linked(classes, "fp", budget, "fp", "fp", budget)
    roots = connected_components(links)
    labelled = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    names = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = labelled.join(names, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "text_hash",
    )


def shingle_set(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; none for a text without words."""
    import xxhash

    w = text.lower().split()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in _shingles(w, words)), dtype=np.uint64)) if w else np.empty(0, np.uint64)


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, digest) of every row, and (digest, component, lead) of every class, a struct unknown, doc_id, text_hash.

    Texts of the same shingles of ``words`` words (ASCII letters lower-cased) are one class. Classes are
    linked where they share ``least`` of their distinct shingles (Jaccard; over a half, in whole hundredths);
    the join of ``jaccard_join`` loses no link between what does not hang together otherwise. ``component``
    numbers what is linked, directly or through others; ``lead`` is its row with the
    smallest id, null ids last, ties by the text's hash. Texts without words (null,
    empty) are one class. Other columns are ignored; an empty table gives no rows.
    """
    from loomtally.llm.jaccard_join import set_classes  # which takes components from here

    sets, named = set_classes(docs, id_col, text_col, words, round(100 * least))
    return sets.select("doc_id", "text_hash", "digest"), named


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, component_id, the smallest id of its group of near copies; options as in ``near_classes``."""
    prints, classes = near_classes(docs, id_col, text_col, **options)
    return prints.join(classes, "digest").select("doc_id", F.col("lead.doc_id").alias("component_id"))


def _row_key(id_col: str, hash_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(hash_col))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of every group of near copies (its smallest id); columns as they were.

    Of rows that repeat both id and text one stays. Options are those of ``near_classes``.
    """
    p = without(docs)
    _, classes = near_classes(docs, id_col, text_col, **options)
    kept = classes.select("lead").distinct().select(
        _row_key("lead.doc_id", "lead.text_hash").alias(f"{p}_k"), F.col("lead.text_hash").alias(f"{p}_h")
    )
    h = F.xxhash64(text_or_empty(text_col))
    marked = docs.withColumn(f"{p}_h", h).withColumn(f"{p}_k", F.xxhash64(F.col(id_col), h))
    nth = F.row_number().over(Window.partitionBy(f"{p}_k", f"{p}_h").orderBy(f"{p}_h"))
    once = marked.withColumn(f"{p}_n", nth).where(F.col(f"{p}_n") == 1)
    return once.join(kept, [f"{p}_k", f"{p}_h"], "left_semi").select(*docs.columns)
