"""Similarity join of shingle sets in the metric space of the Jaccard distance.

One minus the Jaccard similarity is a metric: with a radius r, two linked sets x and
y have distances to any pivot that differ by r at most. Nearly all texts are at
distance one from any pivot, where no window tells them apart, so regions begin from
rare shingles: sets within r share one of their ``n - ceil((1 - r) n) + 1`` rarest, and
each of those makes a region of the sets that have it (any one order of shingles is
right; the commonest come last). Sets are held against each other where sizes and the
place of the region's shingle allow a link; of a linked pair the region of the first
shingle in order that both have always does. Nearly all regions are of a few sets, which
are all held against each other at once. Then, in all larger regions at the same time:

* some sets of the region become its pivots, and every other set is held against them,
* sets within r of a pivot are linked to it and leave the region for the pivot's cell,
* sets beyond r but within 2r of a pivot that has a cell lie on its boundary: they stay, and a copy goes to the cell,
* what stays is divided again by new pivots, twice as many each time, until few sets or none are left.

Two linked sets stay in a region together until one of them becomes a pivot, which
finds the other, or joins a cell, whose boundary then holds the other. So boundary
copies that are in another component than their cell are at last held against the
members of it that the triangle inequality leaves, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtally.llm.common import materialize, release, ship, small, text_or_empty
from loomtally.llm.simhash import connected_components
from loomtally.llm.words import mix, slices, word_hashes

SLICE = 1 << 22
#: Sets of a region that are held against each other without pivots.
FEW = 32
#: Most pivots of a region in one round.
PIVOTS = 1 << 12


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text in a row, and where each text begins (one more at the end)."""
    h, n = word_hashes(texts, lower=True)
    first = np.cumsum(n) - n
    count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    ends = np.cumsum(count)
    at = np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
    many = np.uint64(0x9E3779B97F4A7C15)
    made = np.full(len(at), words, dtype=np.uint64)
    last = max(0, len(h) - 1)
    for i in range(words):
        made = mix(made * many + h[np.minimum(at + i, last)])
    for d in np.flatnonzero((n > 0) & (n < words)):  # the whole sequence
        one = np.array([n[d]], dtype=np.uint64)
        for x in h[first[d] : first[d] + n[d]]:
            one = mix(one * many + x)
        made[ends[d] - 1] = one[0]
    fresh = np.ones(len(made), dtype=bool)
    for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True):
        made[a:b].sort()
    fresh[1:] = made[1:] != made[:-1]
    fresh[(ends - count)[count > 0]] = True
    return made[fresh], np.append(0, np.cumsum(fresh))[np.append(0, ends)]


def _often(words: int, least: int, together: int = 1 << 22):
    """Shingles that ``least`` texts or more of a stretch of texts have, with how many have them."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held), return_counts=True)
        keep = n >= least
        return pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(n[keep])], ["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                held.append(shingle_sets(part.column("text"), words)[0])
                if sum(map(len, held)) >= together:
                    yield counted(held)
                    held.clear()
        if held:
            yield counted(held)

    return run


def _prints(words: int, percent: int, often: np.ndarray, rank: np.ndarray):
    """For each text the size and digest of its set, and its rarest shingles, of which linked sets share one."""

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        made, edges = shingle_sets(batch.column("text"), words)
        n = np.diff(edges)
        doc = np.repeat(np.arange(len(n)), n)
        place = np.minimum(np.searchsorted(often, made), max(0, len(often) - 1))
        known = often[place] == made if len(often) else np.zeros(len(made), bool)
        common = np.where(known, rank[place] if len(rank) else 0, 0)
        order = np.arange(len(made))
        for d in np.unique(doc[common > 0]):
            a, b = edges[d], edges[d + 1]
            order[a:b] = a + np.argsort(common[a:b], kind="stable")
        few = np.where(n > 0, n + (-percent * n) // 100 + 1, 0)
        taken = np.arange(len(made)) - edges[doc] < few[doc]
        rare = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(few)).astype(np.int32)), pa.array(made[order][taken].view(np.int64))
        )
        digests = [xxhash.xxh3_128_digest(made[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        sketches = pa.array([sketch(made[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
        columns = [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(n), pa.array(digests, pa.binary()), rare, sketches]
        return pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n", "digest", "rare", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(part, slices(batch, "text", SLICE))

    return run


def sketch(tokens: np.ndarray) -> bytes:
    """How many hashes of a set fall into each of its buckets, a power of two of them, by their last bits.

    Nothing for a set whose counts don't fit a byte; such sets pass every test.
    """
    buckets = 1 << max(0, len(tokens).bit_length() - 1)
    counts = np.bincount((tokens & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def most_shared(x: np.ndarray, y: np.ndarray) -> int:
    """An upper bound of the numbers that two sets of these sketches have in common."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    while len(x) != len(y):  # the finer one is folded
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] + x[len(x) // 2 :]
    return int(np.minimum(x, y).sum())


def _possible(least: int):
    """Of pairs a, b of sets of n_a and n_b those that their sketches allow to be alike in ``least`` percent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            rows = zip(*(batch.column(c) for c in ("sketch_a", "sketch_b")), *(batch.column(c).to_pylist() for c in ("n_a", "n_b")), strict=True)
            for i, (x, y, n, m) in enumerate(rows):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                both = most_shared(x, y) if len(x) and len(y) else min(n, m)
                if 100 * both >= least * (n + m - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    return run


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Numbers that two sorted arrays without repeats have in common."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def _measured(words: int, least: int):
    """Of pairs a, b of texts those whose sets are alike in ``least`` percent or more, with the sizes of intersection and union."""

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, starts = shingle_sets(batch.column("text_a"), words)
        # Rows of one text follow each other: its set is made once.
        text_b = batch.column("text_b").dictionary_encode()
        other, begins = shingle_sets(text_b.dictionary, words)
        keep, both, all_ = [], [], []
        for i, k in enumerate(text_b.indices.to_pylist()):
            x, y = one[starts[i] : starts[i + 1]], other[begins[k] : begins[k + 1]]
            if 100 * min(len(x), len(y)) < least * max(len(x), len(y)):
                continue
            n = _shared(x, y)
            if 100 * n >= least * (len(x) + len(y) - n):
                keep.append(i)
                both.append(n)
                all_.append(len(x) + len(y) - n)
        at = pa.array(keep, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("a").take(at), batch.column("b").take(at), pa.array(both, pa.int64()), pa.array(all_, pa.int64())],
            ["a", "b", "n_both", "n_all"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(part, slices(batch, "text_a", SLICE))

    return run


def _cells(words: int, percent: int):
    """Links between the boundary copies (kind 0) of a cell and its members (kind 1), one for each copy at most.

    Rows cell, slot, kind, id, alike, text come sorted by the first three. The
    copies of a cell and slot are held, its members pass one by one.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, copies, index = None, [], None
        for part in (p for b in batches for p in slices(b, "text", SLICE)):
            found: list[tuple[int, int]] = []
            made, edges = shingle_sets(part.column("text"), words)
            rows = zip(*(part.column(i).to_pylist() for i in range(5)), edges[:-1], edges[1:], strict=True)
            for cell, slot, kind, own, alike, start, end in rows:
                if (cell, slot) != key:
                    key, copies, index = (cell, slot), [], None
                tokens = made[start:end]
                if kind == 0:
                    copies.append((own, alike, tokens.copy()))
                    continue
                if not copies:
                    continue
                if index is None:
                    held = np.concatenate([c[2] for c in copies])
                    sizes = np.array([len(c[2]) for c in copies])
                    order = np.argsort(held, kind="stable")
                    index = held[order], np.repeat(np.arange(len(copies)), sizes)[order]
                    near = np.array([c[1] for c in copies])
                    open_ = np.ones(len(copies), dtype=bool)
                # The triangle inequality: distances to the pivot differ by the radius at most.
                look = open_ & (near + (100 - percent) / 100 + 1e-9 >= alike)
                if not look.any():
                    continue
                lo, hi = np.searchsorted(index[0], tokens), np.searchsorted(index[0], tokens, side="right")
                many = hi - lo
                at = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                both = np.bincount(index[1][at], minlength=len(copies))
                hit = look & (100 * both >= percent * (sizes + len(tokens) - both))
                open_ &= ~hit
                found += [(own, copies[i][0]) for i in np.flatnonzero(hit)]
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in found], schema=schema)

    return run


def _pairs_measured(pairs: DataFrame, most: int, classes: DataFrame, texts_of, words: int, least: int) -> DataFrame:
    """A table of the ``pairs`` (a, b), at most ``most``, of sets that are alike enough, with the sizes of intersection and union.

    Sizes, then sketches, drop pairs that can't be; only the texts of the others are looked up.
    """

    def of(side: str, held: DataFrame, *columns: str) -> DataFrame:
        return held.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))

    sized = pairs.join(of("a", classes, "n"), "a").join(of("b", classes, "n"), "b")
    sized = materialize(sized.where(F.expr(f"100 * least(n_a, n_b) >= {least} * greatest(n_a, n_b)")), most)
    ids = lambda of_pairs: of_pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    drawn = classes.join(small(ids(sized), sized), "id").select("id", "sketch")
    rows = sized.join(of("a", drawn, "sketch"), "a").join(of("b", drawn, "sketch"), "b")
    left = materialize(rows.mapInArrow(_possible(least), "a long, b long"), sized.count())
    texts = texts_of(ids(left), left)
    # Texts are never sent to all tasks; those of one ``b`` come sorted together.
    rows = left.join(of("a", texts, "text").hint("merge"), "a").join(of("b", texts, "text").hint("merge"), "b")
    found = rows.select("a", "b", "text_a", "text_b").mapInArrow(_measured(words, least), "a long, b long, n_both long, n_all long")
    found = materialize(found, left.count())
    release(sized, left, texts)
    return found


def _fits(x, p, percent: int):
    """Whether the sizes and places of a region's token let set ``x`` and pivot ``p`` be alike in ``percent``.

    In the region of the first token in order that two sets share, no more than that
    token and what follows it in both can be shared.
    """
    most = F.least(x["n"] - x["pos"], p["n"] - p["pos"])
    return 100 * most >= percent * (x["n"] + p["n"] - most)


def _able(region: DataFrame, percent: int) -> DataFrame:
    """The sets of each region that can have a link there at all, by the best place any set of the region has, and how ``many`` these are.

    Sets are shuffled once, by the region; one that is left alone goes.
    """
    whole = Window.partitionBy("token")
    best = region.withColumn("best", F.min(F.col("pos") / F.col("n")).over(whole))
    # A link to a set with the share f before the token needs 1 / (1 - own share) + 1 / (1 - f) to be at most 1 + 100 / percent.
    able = best.where(F.expr(f"n / (n - pos) + 1 / (1 - best) <= 1 + 100 / {percent} + 1e-9")).drop("best")
    return able.withColumn("many", F.count("*").over(whole)).where("many > 1")


def _near_sizes(x, p, percent: int):
    return 100 * F.least(x["n"], p["n"]) >= percent * F.greatest(x["n"], p["n"])


def _pairs_of_few(region: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """All pairs (a, b) of sets of one region that can be linked, of regions of ``FEW`` sets at most, and a bound of their number."""
    few = region.where(f"many <= {FEW}")
    most = (few.agg(F.sum(F.col("many") - 1)).first()[0] or 0) // 2
    sets = few.groupBy("token").agg(F.collect_list(F.struct("id", "n", "pos")).alias("sets"))
    each, x = sets.select("sets", F.explode("sets").alias("x")), F.col("x")
    fit = F.filter("sets", lambda p: (p["id"] > x["id"]) & _fits(x, p, percent) & _near_sizes(x, p, percent))
    return each.select(F.col("x.id").alias("a"), F.explode(fit).alias("p")).select("a", F.col("p.id").alias("b")).distinct(), most


def _pivots(region: DataFrame, round_: int) -> DataFrame:
    """(token, pivots) of the regions of more than ``FEW`` sets: structs id, n, pos of some of its sets."""
    # The first pivot has the least that is rarer than the token, so it lies amid its near copies.
    first = F.row_number().over(Window.partitionBy("token").orderBy("pos", "id"))
    other = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("id", F.lit(round_)), "id"))
    ranked = region.where(f"many > {FEW}").withColumn("first", first).withColumn("other", other)
    some = ranked.where(f"first = 1 or other <= {min(PIVOTS, 2 << round_) - 2}")
    return some.groupBy("token").agg(F.collect_list(F.struct("id", "n", "pos")).alias("pivots"))


def _links(classes: DataFrame, texts_of, words: int, percent: int) -> tuple[DataFrame, int]:
    """Links (a, b), and how many at most, that join the components of the sets ``classes`` (id, n, rare, sketch); ``texts_of`` writes a text (id, text) of each id of a column made from a written table."""
    tokens = classes.select("id", F.col("n").cast("int").alias("n"), F.posexplode("rare").alias("pos", "token"))
    region = materialize(_able(tokens, percent))
    found = _pairs_measured(*_pairs_of_few(region, percent), classes, texts_of, words, percent)
    regions, region = region, region.where(f"many > {FEW}")
    if rows := region.count():
        region = materialize(region, rows)
        release(regions)
        # Their sets are a small part of all, so what follows reads no others.
        ids = materialize(region.select("id").distinct(), rows)
        own = materialize(classes.join(small(ids, ids), "id").select("id", "n", "sketch"), rows, 1 << 11)
        texts = texts_of(ids, ids)
        linked, boundary = _links_by_pivots(
            region, own, lambda ids, made_from: materialize(texts.join(small(ids, made_from), "id"), rows, 1 << 12), words, percent
        )
        more = _across(found, linked, boundary, texts, words, percent)
        release(own, texts)
        found = found.select("a", "b").unionByName(linked.select("a", "b")).unionByName(more).distinct()
    else:
        release(regions)
    return found.select("a", "b"), found.count()


def _links_by_pivots(region: DataFrame, classes: DataFrame, texts_of, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links of sets of the regions, and those within two radii between pivots with cells and what does not leave for these."""
    near_percent = max(0, 2 * percent - 100)  # two radii
    x = {"n": F.col("n"), "pos": F.col("pos")}
    pair = [F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")]
    links, boundary, round_ = [], [], 0
    while rows := region.count():
        pivots = materialize(_pivots(region, round_), rows)
        held = region.join(pivots, "token")
        # Pairs that don't fit are never made.
        fit = F.filter("pivots", lambda p: (p["id"] != F.col("id")) & _fits(x, p, percent) & _near_sizes(x, p, percent))
        tried = held.select("id", F.explode(fit).alias("p")).select("id", F.col("p.id").alias("pivot")).select(*pair)
        few, n_few = _pairs_of_few(region, percent)
        pairs = rows * min(PIVOTS, (2 << round_) - 1) + n_few
        linked = _pairs_measured(tried.unionByName(few).distinct(), pairs, classes, texts_of, words, percent)
        links.append(linked)
        # Only pivots with a link have a cell, and so a boundary.
        ends_of = linked.select(F.explode(F.array("a", "b")).alias("pivot")).distinct()
        flat = held.select("token", "id", "n", F.explode("pivots").alias("p")).where("id <> p.id")
        flat = flat.select("token", "id", "n", F.col("p.id").alias("pivot"), F.col("p.n").alias("m"))
        celled = flat.join(ends_of, "pivot", "left_semi").where(f"100 * least(n, m) >= {near_percent} * greatest(n, m)")
        near = celled.select("token", "id", *pair)
        wide = near.select("a", "b").distinct().join(linked, ["a", "b"], "left_anti")
        boundary.append(_pairs_measured(wide, pairs, classes, texts_of, words, near_percent))
        # A set leaves a region as one of its pivots or into the cell of one.
        gone = near.join(linked.select("a", "b"), ["a", "b"], "left_semi").select("token", "id")
        gone = gone.unionByName(pivots.select("token", F.explode("pivots.id").alias("id"))).distinct()
        rest = region.where(f"many > {FEW}").drop("many").join(gone, ["token", "id"], "left_anti")
        before, region = region, materialize(_able(rest, percent), rows)
        release(before, pivots)
        round_ += 1
    found, edge = links[0], boundary[0]
    for more, wider in zip(links[1:], boundary[1:], strict=True):
        found, edge = found.unionByName(more), edge.unionByName(wider)
    return found, edge


def _across(every: DataFrame, found: DataFrame, boundary: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between cells and those of their boundary copies that are in other components yet, by the links ``every`` and ``found``, of which the cells are."""
    alike = (F.col("n_both") / F.col("n_all")).alias("alike")
    both = lambda d: d.select(F.col("a").alias("cell"), F.col("b").alias("id"), alike).unionByName(
        d.select(F.col("b").alias("cell"), F.col("a").alias("id"), alike)
    )
    roots = connected_components(every.select("a", "b").unionByName(found.select("a", "b")), every.count() + found.count())
    root = lambda d, on: d.join(roots.select(F.col("node").alias(on), F.col("root").alias(f"{on}_root")), on, "left").withColumn(
        f"{on}_root", F.coalesce(f"{on}_root", on)
    )
    copies = root(root(both(boundary), "id"), "cell").where("id_root <> cell_root").select("cell", "id", "alike")
    most = 2 * boundary.count()
    copies = materialize(copies.distinct(), most)
    slots = copies.groupBy("cell").agg(F.ceil(F.count("*") / 512).cast("int").alias("slots"))
    put = copies.join(slots, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("slots")).alias("slot"), F.lit(0).alias("kind"), "id", "alike")
    members = both(found).distinct().join(slots, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - F.lit(1).cast("long"))).alias("slot"), F.lit(1).alias("kind"), "id", "alike"
    )
    rows = put.unionByName(members)
    rows = rows.join(texts, "id").select("cell", "slot", "kind", "id", "alike", "text")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "cell", "slot").sortWithinPartitions("cell", "slot", "kind")
    links = materialize(dealt.mapInArrow(_cells(words, percent), "a long, b long"), most)
    release(copies)
    return links


def near_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    percent: int = 85,
    heavy: int = 1 << 17,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    ASCII letters are lower-cased; a text's set has its distinct shingles of ``words``
    words, or its whole sequence of words where there are fewer. Texts link where
    100 times the intersection is at least ``percent`` (over 50) times the union.
    Texts without words (null, empty, only white space) have no shingles and link with
    nothing, so they are components of their own. ``component_id`` is the smallest
    id reachable; null ids never lead, unless there are no others. Repeated rows are
    one set and rows of their own; other columns are ignored; an empty table gives
    none. Shingles are told apart by 64-bit hashes. The ``heavy`` commonest shingles
    are put last in the order in which regions are made; it bears on speed alone.
    """
    prints, classes = set_classes(docs, id_col, text_col, words, percent, heavy)
    own = classes.select("digest", F.col("lead.doc_id").alias("component_id"))
    with_words = prints.where("n > 0").join(own, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return with_words.unionByName(
        prints.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    )


def set_classes(
    docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, heavy: int = 1 << 17
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n, digest, ...) of every row, and (digest, component, lead) of every set of shingles.

    ``component`` numbers what is linked as in ``near_components``, ``lead`` is its row with the smallest id, a struct
    unknown, doc_id, text_hash; null ids come last, then ties by the text's hash. Texts without words are one set.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent lies between 50 and 100")
    ship(docs.sparkSession)
    text = text_or_empty(text_col).alias("text")
    kind = docs.schema[id_col].dataType.simpleString()
    seen = docs.select(text).mapInArrow(_often(words, 2), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = seen.orderBy(F.desc("n"), "token").limit(heavy).toPandas()
    top = top.assign(token=top["token"].to_numpy().astype("int64").view("uint64")).sort_values("token")
    often, rank = top["token"].to_numpy(), top["n"].to_numpy()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text)
    prints = materialize(
        rows.mapInArrow(
            _prints(words, percent, often, rank), f"doc_id {kind}, text_hash long, n long, digest binary, rare array<long>, sketch binary"
        )
    )
    most = prints.count()
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")).alias("lead")
    classes = prints.groupBy("digest").agg(lead, *(F.first(c).alias(c) for c in ("n", "rare", "sketch")))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), most, 1 << 11)

    # What the rows keep is small; the shingles and sketches of copies go.
    wide, prints = prints, materialize(prints.select("doc_id", "text_hash", "n", "digest"))
    release(wide)

    def texts_of(ids: DataFrame, made_from: DataFrame) -> DataFrame:
        # One number is the key of rows and of leads, which keeps a table of few of them small; the text's hash is compared as well.
        key = lambda doc, text_hash: F.xxhash64(doc, text_hash).alias("key")
        asked = ids.join(classes.select("id", "lead"), "id").select("id", key("lead.doc_id", "lead.text_hash"), F.col("lead.text_hash").alias("h"))
        # Of rows that repeat id and text one is read; null ids meet by the text alone.
        held = rows.select(key("doc_id", "text_hash"), "text_hash", "text").join(small(asked, made_from), "key")
        held = held.where(F.col("text_hash").between(F.col("h"), F.col("h")))
        texts = held.groupBy("key", "id").agg(F.first("text").alias("text")).select("id", "text")
        few = made_from.limit((1 << 15) + 1).count()  # as in small(): more texts are not shuffled once more
        return materialize(texts, 2 * few if few <= 1 << 15 else None, 1 << 12)

    links, n_links = _links(classes, texts_of, words, percent)
    roots = connected_components(links, n_links)
    own = classes.join(roots, F.col("id") == F.col("node"), "left").select("digest", "lead", F.coalesce("root", "id").alias("component"))
    firsts = own.groupBy("component").agg(F.min("lead").alias("first"))
    named = materialize(own.join(firsts, "component").select("digest", "component", F.col("first").alias("lead")), most)
    release(classes)
    return prints, named
