"""I-Match fingerprints over randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band. A
document's distinct terms in the lexicon are sorted and hashed, once over the
whole lexicon and once over each of several random subsets of it. Subsets of
falling size suit short and long documents alike: two documents that share most
of their terms agree on many of the small ones.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtally.llm.common import materialize, text_or_empty

#: Random subsets of each size, and sizes: a subset of size l holds a term with probability 4**-l.
REPLICAS, LEVELS = 12, 5
#: Values of one hash are 1 to 2**24 - 1; 0 says that the document has no term in the subset.
_VALUES = (1 << 24) - 1


def terms(text: Column) -> Column:
    """Hashes of the distinct terms: lower-cased, parted by white space and ASCII punctuation."""
    words = F.split(F.lower(text), r"[\s\p{Punct}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str, rows: int, rarest: int = 2000, commonest: int = 20) -> DataFrame:
    """Terms (as hashes) found in at least 1 of ``rarest`` and at most 1 of ``commonest`` documents.

    So ln(commonest) <= idf <= ln(rarest). There are at most ``rarest`` times as
    many as a document has distinct terms on average, however many documents.
    """
    found = docs.select(F.explode(terms(text_or_empty(text_col))).alias("term"))
    return (
        found.groupBy("term")
        .agg(F.count("*").alias("df"))
        .where((F.col("df") * rarest >= rows) & ((F.col("df") * commonest <= rows) | (F.col("df") == 1)))
        .select("term")
    )


def hashes(found: Column, whole: Column) -> Column:
    """The hashes of sorted distinct terms: whole lexicon first, then the random subsets.

    A document without a term in the lexicon has the hash ``whole`` of all its terms.
    """

    def one(a: Column) -> Column:
        return F.when(F.size(a) == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64(a), F.lit(_VALUES - 1)).cast("int") + 1)

    def subsets(own: Column) -> Column:
        def replica(j: Column) -> Column:
            def level(state: Column, size: Column) -> Column:
                keep = F.filter(state["own"], lambda t: _slice(t, j).bitwiseAND(_mask(size)) == 0)
                return F.element_at(
                    F.transform(
                        F.array(keep),
                        lambda a: F.struct(a.alias("own"), F.concat(state["out"], F.array(one(a))).alias("out")),
                    ),
                    1,
                )

            start = F.struct(own.alias("own"), F.array().cast("array<int>").alias("out"))
            return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), start, level, lambda s: s["out"])

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(REPLICAS // 2 - 1)), replica))

    again = F.transform(found, lambda t: F.xxhash64(t))
    first = F.when(F.size(found) == 0, whole).otherwise(one(found))
    return F.concat(F.array(first), subsets(found), subsets(again))


def _slice(t: Column, j: Column) -> Column:
    return F.call_function("shiftrightunsigned", t, j * 10)


def _mask(size: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), size * 2) - 1


def as_text(h: Column) -> Column:
    """Six hexadecimal digits for each hash; dashes where the document has no term."""
    return F.array_join(F.transform(h, lambda x: F.when(x == 0, "------").otherwise(F.lower(F.lpad(F.hex(x), 6, "0")))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among those that either document has; 1 for equal fingerprints."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    either = F.size(F.filter(pairs, lambda p: (p["a"] != 0) | (p["b"] != 0)))
    same = F.size(F.filter(pairs, lambda p: (p["a"] != 0) & (p["a"] == p["b"])))
    return F.when(a == b, F.lit(1.0)).otherwise(same / either)


def _bucket(docs: DataFrame, id_col: str, rows: int, per_bucket: int) -> Column:
    """A number for each range of ids, in descending order; ranges hold about as many rows each.

    Looks the id up in two steps among approximate quantiles, so rows next to each
    other meet without one global sort. A range holds ``per_bucket`` rows or the root
    of all rows if that is more: neither ranges nor bounds grow faster than the root.
    """
    n = max(1, rows // max(per_bucket, isqrt(rows) if per_bucket >= 500 else 1))
    if n == 1:
        return F.lit(0)
    at = [i / n for i in range(1, n)]
    bounds = docs.agg(F.percentile_approx(id_col, at, 10 * n + 1000)).first()[0] or []
    bounds = sorted(set(bounds), reverse=True)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    top = F.array(*(F.lit(g[0]) for g in groups))
    rest = F.array(*(F.array(*(F.lit(x) for x in g)) for g in groups))
    above = F.size(F.filter(top, lambda x: x > F.col(id_col)))  # groups whose largest bound is above the id
    within = F.size(F.filter(F.element_at(rest, F.greatest(above, F.lit(1))), lambda x: x > F.col(id_col)))
    found = F.when(above == 0, F.lit(0)).otherwise((above - 1) * step + within)
    return F.when(F.col(id_col).isNull(), F.lit(len(bounds) + 1)).otherwise(found).cast("int")


def fingerprint_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 500, broadcast_terms: int = 2_000_000
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    One row per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The edited text is the text with
    its last floor(n_chars / 2) code points replaced by the first as many of the
    next document's, in descending order of doc_id (null ids last, rows that
    repeat an id by a hash of their text); the last document is followed by the
    first. A null text counts as empty. Equal texts have equal fingerprints; a
    text without terms has dashes only. Other columns are ignored; an empty table
    gives no rows. A lexicon of more than ``broadcast_terms`` terms is joined by a shuffle.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = base.count()
    lex = materialize(lexicon(docs, text_col, max(1, rows)))
    small = lex.count() <= broadcast_terms
    lex = lex.select("term", F.lit(True).alias("in_lexicon"))

    # Rows in descending order of ids, by ranges. Each range also gets the first row of the next.
    cut = base.withColumn("range", _bucket(base, "doc_id", rows, rows_per_bucket))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.xxhash64("text").alias("h"))
    heads = cut.groupBy("range").agg(F.max(order).alias("head"))
    turn = Window.orderBy("range")
    before = materialize(
        heads.select(
            F.coalesce(F.lag("range").over(turn), F.max("range").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"),
            F.col("range").alias("head_range"),
            "head",
        )
    )
    heads_texts = (
        cut.join(F.broadcast(before), (F.col("range") == F.col("head_range")) & order.eqNullSafe(F.col("head")))
        .select("doc_id", "text", F.col("to").alias("range"), F.lit(True).alias("guest"))
        .dropDuplicates(["range"])
    )
    ranged = cut.withColumn("guest", F.lit(False)).unionByName(heads_texts)
    line = Window.partitionBy("range").orderBy("guest", order.desc())
    n, half = F.length("text"), F.expr("length(text) div 2")
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.left(F.col("next_text"), half))
    texts = (
        ranged.withColumn("next_text", F.coalesce(F.lead("text").over(line), F.lit("")))
        .withColumn("at", F.row_number().over(line))
        .select("range", "at", "doc_id", "guest", n.alias("n_chars"), "text", edited.alias("edited"))
        .select(
            "range", "at", terms(F.col("text")).alias("t0"), terms(F.col("edited")).alias("t1"),
            F.struct("doc_id", "guest", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha")).alias("about"),
        )
    )

    def whole(t: str) -> Column:
        return F.when(F.size(t) == 0, F.lit(0)).otherwise(
            F.pmod(F.xxhash64(F.array_sort(t)), F.lit(_VALUES - 1)).cast("int") + 1
        )

    about = F.col("about").withField("w0", whole("t0")).withField("w1", whole("t1"))
    kind = texts.select(about.alias("about")).schema["about"].dataType.simpleString()

    def tagged(t: str, which: int) -> Column:
        return F.transform(t, lambda x: F.struct(x.alias("term"), F.lit(which).alias("of"), F.lit(None).cast(kind).alias("about")))

    # A row's own entry has no term; a number of its own in that place spreads these entries over the tasks of a join.
    lead = F.array(F.struct(F.xxhash64("range", "at").alias("term"), F.lit(-1).alias("of"), about.alias("about")))
    parts = texts.select("range", "at", F.explode(F.concat(lead, tagged("t0", 0), tagged("t1", 1))).alias("x")).select(
        "range", "at", "x.term", "x.of", "x.about"
    )
    known = parts.join(F.broadcast(lex) if small else lex, "term", "left").where("in_lexicon or of < 0")
    gathered = known.groupBy("range", "at").agg(
        F.max("about").alias("about"),
        F.array_sort(F.collect_list(F.when(F.col("of") == 0, F.col("term")))).alias("f0"),
        F.array_sort(F.collect_list(F.when(F.col("of") == 1, F.col("term")))).alias("f1"),
    )
    made = gathered.select(
        "range", "at", "about",
        hashes(F.col("f0"), F.col("about.w0")).alias("h0"),
        hashes(F.col("f1"), F.col("about.w1")).alias("h1"),
    )
    follow = Window.partitionBy("range").orderBy("at")
    return (
        made.withColumn("hn", F.lead("h0").over(follow))
        .where(~F.col("about.guest"))
        .select(
            F.col("about.doc_id").alias("doc_id"),
            F.col("about.n_chars").cast("long").alias("n_chars"),
            F.lower(F.hex("about.sha")).alias("edited_sha256"),
            as_text(F.col("h0")).alias("fingerprint"),
            as_text(F.col("h1")).alias("edited_fingerprint"),
            likeness(F.col("h0"), F.col("h1")).alias("near_edited"),
            likeness(F.col("h0"), F.col("hn")).alias("near_next"),
        )
    )
