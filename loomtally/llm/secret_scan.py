"""Secret scans: fixed patterns, and credential values by what guessing them would cost.

The base patterns give spans of three kinds. Values in a credential context are
segmented by dynamic programming into words, dates, repeats, keyboard walks and
brute-force spans so that the guesses needed are fewest; values that remain dear
to guess are reported as spans of kind ``value``. Words are ranked by how often
they occur in the whole corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtally.llm.common import materialize, ship, text_or_empty

KINDS = ("assign", "access", "hex", "value")
_ASSIGN = re.compile(
    r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?((?-i:[A-Za-z0-9+/_.=-]+))"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are taken whole, so this keeps those of 24 or more
_CUES = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential")
# A cue is a word of its own or the end of a name such as DB_PASSWORD or clientSecret; what parts it from its value
# is a colon, an equals sign or an arrow. A blank alone does so only behind "bearer", as in request headers.
_CONTEXT = re.compile(
    r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?:"
    r"(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret|client)[_-]?key"
    r"|auth(?:orization)?|bearer|credentials?)[\"']?\x20{0,3}(?:=>|:=|[:=])\x20{0,3}[\"']?(?ai:bearer\x20)?"
    r"|(?ai:bearer)\x20{1,3})"
    r"([^\s\"'<>,;]{6,})"
)
_REACH = 24  # no cue with what parts it from its value is longer

# Usual words of chosen passwords, most usual first; those of the corpus follow.
WORDS = """
password the admin secret login user test welcome token root example master hello letmein dragon monkey
sunshine princess football baseball shadow superman batman trustno qwerty access love god money
freedom whatever ninja mustang jordan harley ranger hunter buster soccer hockey killer george
charlie andrew michelle jessica pepper daniel ginger summer winter spring autumn changeme default
guest demo sample dummy temp pass key api data server database prod production dev staging service
system public private client company team work home office internet computer windows linux
""".split()  # fmt: skip
#: Letters that a word of the dictionary has.
SHORTEST, LONGEST = 3, 24
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_NEXT = {(a, b) for row in _ROWS for x, y in zip(row, row[1:], strict=False) for a, b in ((x, y), (y, x))}
_LEET = str.maketrans("4301$57@", "aeolsstA".lower())
_DATE = re.compile(
    r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d"
)


def _spare(c: str) -> float:
    """log10 of the symbols a brute-force guess tries for this character."""
    if c.isdigit():
        return 1.0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return math.log10(26)
    return math.log10(33) if c.isascii() else 2.0


def ranks(corpus_words: list[str] = ()) -> dict[str, int]:
    """The rank of each word, 1 for the most usual: the fixed ones, then those of the corpus in their order."""
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *corpus_words]))}


_RANKS = ranks()


def _dates(value: str) -> Iterator[tuple[int, int, float]]:
    for i in range(len(value)):
        if value[i].isdigit() and (m := _DATE.match(value, i)):
            yield i, m.end(), math.log10(120 if m.end() - i == 4 else 120 * 365)


def _repeats(value: str, spare: np.ndarray, longest: int = 32) -> Iterator[tuple[int, int, float]]:
    """Stretches of one to ``longest`` characters that follow each other several times; work is ``longest`` times the length."""
    c = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    before = np.append(0.0, np.cumsum(spare))
    for k in range(1, min(longest, len(c) // 2) + 1):
        differ = np.append(np.flatnonzero(c[k:] != c[:-k]), len(c) - k)
        places = np.arange(len(c) - k)
        run = differ[np.searchsorted(differ, places)] - places  # how far the text goes on as it did k before
        for i in np.flatnonzero(run >= max(k, 2)).tolist():
            times = int(run[i]) // k + 1
            yield i, i + k * times, float(before[i + k] - before[i]) + math.log10(times)


def _walks(low: str) -> Iterator[tuple[int, int, float]]:
    """Walks over neighbouring keys, and runs of the alphabet."""
    size = 1
    for i in range(len(low) - 1, -1, -1):
        near = i + 1 < len(low) and ((low[i], low[i + 1]) in _NEXT or abs(ord(low[i]) - ord(low[i + 1])) == 1)
        size = size + 1 if near else 1
        if size >= 4:
            yield i, i + size, math.log10(47 * size)


def guess_cost(value: str, rank: dict[str, int] = _RANKS, enough: float = math.inf) -> float:
    """log10 of the guesses for ``value`` under its cheapest segmentation.

    Every segment costs its own guesses and a factor of two for being there, so
    that splitting is never free. Work is in proportion to the length. Once no
    segmentation can cost less than ``enough`` a lower bound of the cost is given.
    """
    n, step = len(value), math.log10(2)
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(_LEET)
    spare = np.fromiter(map(_spare, value), dtype=float, count=n)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for found in (_dates(value), _repeats(value, spare), _walks(low)):
        for i, j, cost in found:
            ends[i].append((j, cost))
    best = [0.0] + [math.inf] * n
    free, reach = math.inf, 0  # ``reach``: how far a segmentation under ``enough`` has come
    for i in range(n):
        here = best[i]
        # A brute-force span goes on, or starts here.
        free = min(free, here + step) + float(spare[i])
        best[i + 1] = min(best[i + 1], free)
        for j in range(i + SHORTEST, min(n, i + LONGEST) + 1):
            word, as_letters = low[i:j], plain[i:j]
            nth = rank.get(word) or (3 * rank[as_letters] if as_letters in rank else 0)
            if nth:
                case = 0.0 if value[i:j].islower() else step
                best[j] = min(best[j], here + math.log10(nth + 1) + case + step)
                reach = j if best[j] < enough and j > reach else reach
        for j, cost in ends[i]:
            best[j] = min(best[j], here + cost + step)
            reach = j if best[j] < enough and j > reach else reach
        if reach <= i and free >= enough and best[i + 1] >= enough:
            return enough
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return out


def value_spans(text: str, least: float, rank: dict[str, int] = _RANKS) -> list[tuple[int, int, str]]:
    """Credential values whose guess cost is 10**least or more.

    A value may itself be a cue, as in ``auth = token: ...``. So the search goes on
    at the start of a cheap value, and within reach of a cue before the end of a
    dear one; what lies inside a span that was found adds none.
    """
    out: list[tuple[int, int, str]] = []
    m = _CONTEXT.search(text)
    while m:
        start, end = m.span(1)
        at = start
        if not out or end > out[-1][1]:
            if guess_cost(text[start:end], rank, least) >= least:
                out.append((start, end, "value"))
                at = max(start, end - _REACH)
        m = _CONTEXT.search(text, at)
    return out


def corpus_words(docs: DataFrame, text_col: str = "text", one_in: int = 1 << 16) -> list[str]:
    """Words of letters that make up one in ``one_in`` words of all documents or more, most usual first.

    There are at most ``one_in`` of them, however many documents; a word met less
    than five times is none. Ties go by the word.
    """
    words = docs.select(F.explode(F.split(F.lower(text_or_empty(text_col)), r"[^\p{L}\p{M}\p{N}_]+")).alias("word"))
    counts = words.where((F.length("word") >= SHORTEST) & (F.length("word") <= LONGEST)).groupBy("word").agg(F.count("*").alias("n"))
    letters = counts.where(F.col("word").rlike(r"^[\p{L}\p{M}]+$"))
    kept = materialize(letters)
    total = kept.agg(F.sum("n")).first()[0] or 0
    usual = kept.where((F.col("n") >= 5) & (F.col("n") * one_in >= total))
    return [r["word"] for r in usual.orderBy(F.desc("n"), "word").collect()]  # at most ``one_in`` words


def _scan(least: float, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for b in batches:
            rows = []
            for cell in b.column(b.num_columns - 1):
                text = cell.as_py() or ""
                low = text.lower()
                found = [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
                if any(c in low for c in _CUES) or "AKIA" in text:
                    found = base_spans(text) + value_spans(text, least, rank)
                rows.append(found)
            spans = pa.array(
                [[{"kind": k, "start": a, "end": e} for a, e, k in r] for r in rows],
                pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])),
            )
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], spans], [*b.schema.names[:-1], "found"])

    return run


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 9.0, words: list[str] | None = None
) -> DataFrame:
    """One row per document: doc_id and ``found``, an array of (kind, start, end).

    Starts and ends count code points, ends exclusive; ``assign`` spans take in
    the whole assignment. A null text counts as empty and gives an empty array.
    Values in a credential context that take 10**``least`` guesses or more add
    spans of kind ``value``; they never replace others. ``words`` ranks words for
    the guesses; without it those of the texts themselves count, by ``corpus_words``.
    Each row is scanned for itself, so rows that repeat an id have a row each; spans
    of one start are told apart by kind. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(ranks(corpus_words(docs, text_col) if words is None else words))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scan(least, shared), f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint>>")


def report(found: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the base spans, and all spans as text; by start, then kind."""
    ranked = F.array_sort(F.transform("found", lambda s: F.struct(
        s["start"].alias("a"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"),
        s["end"].alias("e"), s["kind"].alias("n"))))

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["n"], s["a"], s["e"])), ",")

    def count(name: str):
        return F.size(F.filter("found", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    return found.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(line(F.filter(ranked, lambda s: s["n"] != "value")), 256).alias("base_sha256"),
        line(ranked).alias("spans"),
    )
