"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are taken on a bounded sample of labelled documents; every document is
scored whole, with the table of log-probabilities broadcast and the documents
of a batch scored as one sparse product in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtally.llm.common import ship, without

NONE = "und"
BUCKET_BITS = 15
ORDERS = 3
#: Characters that are scored at a time; bounds what a task holds besides its batch.
CHUNK = 1 << 19


@cache
def _folded() -> np.ndarray:
    """For each code point its lower-cased letter, or a blank for anything else."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for cp in range(0x110000):
        if (c := chr(cp)).isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def letters(text: str, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, int]]:
    """The letters with one blank between words and at both ends, in stretches, each with how much of it was there before.

    A stretch repeats the last characters of the one before it, so that an n-gram
    over the border is in one stretch. A text without letters has no stretch.
    """
    blank = np.array([32], dtype=np.uint32)
    tail, known = blank, 0
    for i in range(0, len(text), chunk):
        c = _folded()[np.frombuffer(text[i : i + chunk].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        c = c[(c != 32) | (np.append(tail[-1:], c[:-1]) != 32)]
        if len(c):
            whole = np.concatenate([tail, c])
            yield whole, known
            tail = whole[-(ORDERS - 1) :]
            known = len(tail)
    if known and tail[-1] != 32:
        yield np.concatenate([tail, blank]), known


def grams(text: str, chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """Buckets of the 1- to 3-grams of the letters, whatever ``chunk`` the text is worked through in."""
    for c, before in letters(text, chunk):
        h = c * np.uint32(0x9E3779B1)
        new = h[before:]
        out = [new[c[before:] != 32]]
        for order in range(2, ORDERS + 1):
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[order - 1 :] * np.uint32(0xC2B2AE3D) + np.uint32(order)
            out.append(h[max(0, before - order + 1) :])
        found = np.concatenate(out)
        if len(found):
            yield (found >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column("lang"), b.column("text"), strict=True):
            total = sums.setdefault(lang.as_py(), np.zeros(1 << BUCKET_BITS, dtype=np.int64))
            for found in grams(text.as_py() or ""):
                total += np.bincount(found, minlength=1 << BUCKET_BITS)
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])],
            ["lang", "bucket", "n"],
        )


def fit(
    docs: DataFrame, text: str, lang: str, order: Column, sample_docs: int = 20_000, alpha: float = 0.5, most_languages: int = 512
):
    """(languages, float32 log-probabilities by bucket and language, log-priors).

    More than ``most_languages`` are an error, as the table of them all goes to every task.

    ``order`` is a hash by which about ``sample_docs`` labelled rows are taken; all are
    if there are no more. Null languages are not learned from. Class counts are of all
    labelled rows.
    """
    ship(docs.sparkSession)
    labelled = docs.where(F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(order, F.lit(1 << 30)).alias("at")
    )
    priors = dict(labelled.groupBy("lang").count().limit(most_languages + 1).collect())
    if len(priors) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    rows = sum(priors.values())
    if not rows:
        return [], np.zeros((1 << BUCKET_BITS, 0), dtype=np.float32), np.zeros(0)
    share = min(1.0, sample_docs / rows)
    sums = (
        labelled.where(F.col("at") < int(share * (1 << 30)))
        .select("lang", "text")
        .mapInArrow(_counts, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    langs = sorted(priors)
    at = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((1 << BUCKET_BITS, len(langs)))
    for x, bucket, n in sums.collect():  # languages x buckets at most
        counts[bucket, at[x]] = n
    counts += alpha
    logp = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    return langs, logp, np.log(np.array([priors[x] for x in langs]) / rows)


def _score(langs: list[str], shared):
    def posterior(texts: list[str | None], logp: np.ndarray, prior: np.ndarray):
        total = np.tile(prior, (len(texts), 1))
        known = np.zeros(len(texts), dtype=bool)
        held: list[np.ndarray] = []
        rows: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                # The batch as a sparse matrix in CSR form: one row a text, ones at its buckets.
                indptr = np.concatenate([[0], np.cumsum([len(x) for x in held])[:-1]])
                picked = logp[np.concatenate(held)]
                np.add.at(total, rows, np.add.reduceat(picked, indptr, axis=0, dtype=np.float64))
                held.clear()
                rows.clear()
                size = 0

        for i, text in enumerate(texts):
            for found in grams(text or ""):
                known[i] = True
                held.append(found)
                rows.append(i)
                size += len(found)
                if size > CHUNK:
                    flush()
        flush()
        return total, known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp, prior = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1)
            lang_out: list[str] = []
            score_out: list[float] = []
            for lo in range(0, b.num_rows, 256):
                total, known = posterior(texts.slice(lo, 256).to_pylist(), logp, prior)
                if not langs:
                    known[:] = False
                best = total.argmax(axis=1) if langs else np.zeros(len(total), dtype=int)
                with np.errstate(over="ignore"):
                    p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1) if langs else np.zeros(len(total))
                lang_out += [langs[k] if ok else NONE for k, ok in zip(best, known, strict=True)]
                score_out += np.where(known, p, 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(lang_out, pa.string()), pa.array(score_out, pa.float64())],
                [*b.schema.names[:-1], "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of every row with lang_pred and score (the posterior, 0 to 1).

    A text that is null or has no letter is ``und`` with score 0, as is every
    text if nothing was learned. Of languages that are equally likely the first by
    name is taken. No other column is an input; each row is told for itself, so rows
    that repeat an id have a row each, and an empty table gives none.
    """
    langs, logp, prior = model
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((logp, prior))
    rows = docs.select(*keep, text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_score(langs, shared), f"{schema}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without rows whose language can't be told: ``und``, or a posterior under ``least``."""
    # Under other names, as the columns of ``docs`` may be called like those that predict() adds.
    p = without(docs)
    names = [f"{p}_{i}" for i in range(len(docs.columns))]
    renamed = docs.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)), F.col(text_col).alias(f"{p}_t"))
    found = predict(renamed, model, names, f"{p}_t")
    kept = found.where((F.col("lang_pred") != NONE) & (F.col("score") >= least))
    return kept.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
