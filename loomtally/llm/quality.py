"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage is
encoded by a learned projection of its hashed character trigrams and a few shares
of kinds of characters; a gated attention learned from the labels weighs the
passages, and the weighted representation is scored. The model is small and is
fitted on a bounded sample of labelled rows, each with all its passages; every
document is scored whole, in numpy, inside the tasks that read it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtally.llm.common import ship

#: Bytes of a passage; the last one of a text may be shorter.
PASSAGE = 512
# Classes of bytes: what a passage is made of, whatever its language.
_CLASSES = [b"\n\r\t\v\f", b" ", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789",
            b".", b",", b"!?", b"*", b"%", b"&", b"$", b"#", b"|", b"<>{}[]()/\\=+_~^`@", b"-:;'\""]
_CLASS = np.full(256, len(_CLASSES), dtype=np.int64)
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i
_CLASS[128:] = len(_CLASSES) + 1
_N = len(_CLASSES) + 2
#: Buckets of hashed trigrams of bytes.
BUCKET_BITS = 8
TRIGRAMS = 1 << BUCKET_BITS
FEATURES = _N + 5 + TRIGRAMS


def _buckets(b: np.ndarray) -> np.ndarray:
    """A bucket for the trigram that starts at each byte but the last two."""
    x = b.astype(np.uint32)
    h = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def passages(text: bytes) -> np.ndarray:
    """A row of features for each passage; an empty text has one row of zeros.

    A trigram belongs to the passage in which it begins.
    """
    n = len(text)
    if not n:
        return np.zeros((1, FEATURES), dtype=np.float32)
    m = -(-n // PASSAGE)
    at = np.arange(n) // PASSAGE
    raw = np.frombuffer(text, dtype=np.uint8)
    share = np.bincount(at * _N + _CLASS[raw], minlength=m * _N).reshape(m, _N)
    size = share.sum(axis=1, keepdims=True)
    grams = np.bincount(at[:-2] * TRIGRAMS + _buckets(raw), minlength=m * TRIGRAMS).reshape(m, TRIGRAMS) if n > 2 else np.zeros((m, TRIGRAMS))
    words = np.empty((m, 3))
    for i in range(m):
        w = text[i * PASSAGE : (i + 1) * PASSAGE].split()
        k = max(1, len(w))
        words[i] = (1 - len(set(w)) / k if w else 0, sum(map(bytes.__eq__, w, w[1:])) / k, k / (size[i, 0] + 1))
    tail = np.column_stack([words, np.log1p(size) / 6, np.full(m, np.log1p(m) / 6)])
    return np.concatenate([4 * np.sqrt(share / size), tail, 4 * np.sqrt(grams / size)], axis=1).astype(np.float32)


class GatedAttention:
    """score = sigmoid(u . sum_k a_k h_k), h = tanh(x W), a = softmax(w . (tanh(h V) * sigmoid(h U)))."""

    def __init__(self, params: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray) -> None:
        self.p, self.mean, self.scale = params, mean, scale

    @staticmethod
    def start(rng: np.random.Generator, hidden: int = 24, gate: int = 12) -> dict[str, np.ndarray]:
        def near(*shape: int) -> np.ndarray:
            return rng.normal(0, shape[0] ** -0.5, shape)

        return {
            "W": near(FEATURES, hidden), "b": np.zeros(hidden), "V": near(hidden, gate), "U": near(hidden, gate),
            "w": near(gate), "u": near(hidden), "c": np.zeros(1),
        }

    def forward(self, x: np.ndarray, starts: np.ndarray):
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        tv, sg = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (tv * sg) @ p["w"]
        lens = np.diff(np.append(starts, len(x)))
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), lens))
        a = e / np.repeat(np.add.reduceat(e, starts), lens)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["u"] + p["c"][0], -30, 30)))
        return y, (x, h, tv, sg, a, z, lens)

    def gradients(self, x: np.ndarray, starts: np.ndarray, label: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        p = self.p
        y, (x, h, tv, sg, a, z, lens) = self.forward(x, starts)
        d = (y - label) / len(label)
        dz = d[:, None] * p["u"]
        each = np.repeat(dz, lens, axis=0)
        da = (each * h).sum(axis=1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), lens))
        dg = ds[:, None] * p["w"]
        dtv, dsg = dg * sg * (1 - tv**2), dg * tv * sg * (1 - sg)
        dh = (a[:, None] * each + dtv @ p["V"].T + dsg @ p["U"].T) * (1 - h**2)
        g = {
            "u": z.T @ d, "c": np.array([d.sum()]), "w": (tv * sg).T @ ds, "V": h.T @ dtv, "U": h.T @ dsg,
            "W": x.T @ dh, "b": dh.sum(axis=0),
        }
        return {k: v + decay * p[k] for k, v in g.items()}


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 40, batch: int = 64, seed: int = 11) -> GatedAttention:
    """Adam on the log loss of the bags; without both labels every score is the share of label 1."""
    rng = np.random.default_rng(seed)
    flat = np.concatenate(bags) if bags else np.zeros((1, FEATURES))
    mean, scale = flat.mean(axis=0), flat.std(axis=0) + 0.05
    scale[-TRIGRAMS:] += 0.5  # many features, each of which says little
    model = GatedAttention(GatedAttention.start(rng), mean, scale)
    if len(set(labels.tolist())) < 2:
        model.p = {k: np.zeros_like(v) for k, v in model.p.items()}
        share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
        model.p["c"][0] = np.log(share / (1 - share))
        return model
    m1 = {k: np.zeros_like(v) for k, v in model.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            take = order[i : i + batch]
            x = np.concatenate([bags[j] for j in take])
            starts = np.concatenate([[0], np.cumsum([len(bags[j]) for j in take])[:-1]])
            t += 1
            for k, g in model.gradients(x, starts, labels[take], 1e-4).items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                model.p[k] -= 0.005 * m1[k] / (1 - 0.9**t) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    return model


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 16):
            part = b.slice(i, 16)
            bags = [passages(t.as_py() or b"").astype(np.float16).tobytes() for t in part.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(bags, pa.binary())], ["label", "bag"])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 4096) -> GatedAttention:
    """Learns from about ``sample_docs`` rows of ``labels`` (doc_id, label), all if there are no more.

    The sample goes by a hash of doc_id; of its documents all passages are learned
    from. A doc_id labelled more than once counts as 1 if half of its labels do;
    null labels are left out.
    """
    ship(docs.sparkSession)
    own = (
        labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    )
    rows = own.count()
    share = min(1.0, sample_docs / max(1, rows))
    picked = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # About sample_docs ids and labels, whatever the input.
    bags = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    held = bags.select("label", "text").mapInArrow(_encoded, "label double, bag binary").collect()
    held.sort(key=lambda r: (bytes(r["bag"]), r["label"]))
    xs = [np.frombuffer(bytes(r["bag"]), dtype=np.float16).reshape(-1, FEATURES).astype(np.float32) for r in held]
    return train(xs, np.array([r["label"] for r in held]))


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.binary())
            out = []
            for lo in range(0, b.num_rows, 128):
                bags = [passages(t.as_py() or b"") for t in texts.slice(lo, 128)]
                starts = np.concatenate([[0], np.cumsum([len(x) for x in bags])[:-1]])
                out.append(model.forward(np.concatenate(bags), starts)[0])
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], [*b.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: GatedAttention, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and ``score`` (0 to 1) of every row; null and empty texts are scored as an empty passage.

    Each row is scored for itself from its text alone: equal texts have equal scores, rows that repeat
    an id have a row each, and an empty table gives none.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text_col))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_scores(shared), f"{schema}, score double")
