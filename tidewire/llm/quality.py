"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words (the last one may be shorter; null and empty texts are one passage of no words). Each
passage is described by shares of byte classes, word lengths, repetition and size, encoded by a small network, and given an attention weight
by a gated unit, tanh times sigmoid, soft-maxed over the document. The weighted sum of the encodings is scored. All weights are learned
together from document labels alone, by Adam on batches of whole documents. Every passage of every text is read, whatever its length.
Label rows with null labels, or without a document, are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import crc_mod, session
from .toxicity import MAX_ROWS, sample

PASSAGE = 64
#: Bound on the passages that the fitting task holds; documents beyond it, in the order of their hash, are left out of the fit.
MAX_PASSAGES = 500_000
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 16, 8, 40, 64, 0.01, 1e-4

#: Byte classes: lower and upper letters, digits, spaces, line ends, each of these marks, other marks, bytes beyond ASCII.
MARKS = ".,;:!?|#$%&*@/-_\"'()<>="
_CLASS = np.full(256, 5 + len(MARKS), np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 11, 12, 32]], _CLASS[[10, 13]] = 0, 1, 2, 3, 4
for _i, _c in enumerate(MARKS):
    _CLASS[ord(_c)] = 5 + _i
_CLASS[128:] = 6 + len(MARKS)
CLASSES = 7 + len(MARKS)
SIZE = CLASSES + 7


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Passages' features (rows), and where each text's passages begin (and the end)."""
    w = _text.Words(col)
    n = np.diff(w.off)
    many = np.maximum(1, -(-n // PASSAGE))
    cut = np.append(0, np.cumsum(many))
    place = np.arange(cut[-1]) - np.repeat(cut[:-1], many)  # of a passage in its text
    first = np.repeat(w.off[:-1], many) + place * PASSAGE
    words = np.minimum(np.repeat(w.off[1:], many) - first, PASSAGE)
    start = np.repeat(w.doc_off[:-1], many).astype(np.int64)
    later = place > 0
    start[later] = w.start[first[later]]
    size = np.diff(np.append(start, len(w.buf)))
    of = np.repeat(np.arange(len(start)), size)
    counts = np.bincount(of * CLASSES + _CLASS[w.buf], minlength=len(start) * CLASSES).reshape(-1, CLASSES)
    x = np.zeros((len(start), SIZE), np.float32)
    x[:, :CLASSES] = np.sqrt(counts / np.maximum(size, 1)[:, None])
    p = np.repeat(np.arange(len(start)), np.maximum(words, 0))
    length = (w.end - w.start).astype(np.float64)
    has = np.maximum(words, 1)
    mean = np.bincount(p, length, len(start)) / has
    x[:, CLASSES] = mean / 10
    x[:, CLASSES + 1] = np.sqrt(np.maximum(np.bincount(p, length**2, len(start)) / has - mean**2, 0)) / 10
    h, q, c = _text.distinct(w.h, p)
    x[:, CLASSES + 2] = np.bincount(q, minlength=len(start)) / has
    x[:, CLASSES + 3] = np.sqrt(np.bincount(q, c.astype(float) ** 2, len(start))) / has
    doc = np.repeat(np.arange(len(n)), many)
    _, d, _ = _text.distinct(h, doc[q])
    x[:, CLASSES + 4] = (np.bincount(d, minlength=len(n)) / np.maximum(np.bincount(doc[q], minlength=len(n)), 1))[doc]
    x[:, CLASSES + 5] = np.log1p(words) / 4
    x[:, CLASSES + 6] = np.log1p(n)[doc] / 8
    return x, cut


class Mil:
    """Parameters by name; ``forward`` scores bags, ``step`` learns from them."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {"W": g(SIZE, HIDDEN), "b": np.zeros(HIDDEN), "V": g(HIDDEN, GATE), "U": g(HIDDEN, GATE), "a": r.normal(0, 0.3, GATE), "c": r.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
        self.mean, self.std = np.zeros(SIZE), np.ones(SIZE)
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def forward(self, x: np.ndarray, cut: np.ndarray):
        p = self.p
        x = np.clip((x - self.mean) / self.std, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        tv, su = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (tv * su) @ p["a"]
        n = np.diff(cut)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, cut[:-1]), n))
        alpha = e / np.repeat(np.add.reduceat(e, cut[:-1]), n)
        z = np.add.reduceat(alpha[:, None] * h, cut[:-1])
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -35, 35)))
        return s, (x, h, tv, su, alpha, z, n)

    def step(self, x: np.ndarray, cut: np.ndarray, y: np.ndarray) -> None:
        p = self.p
        s, (x, h, tv, su, alpha, z, n) = self.forward(x, cut)
        ds = (s - y) / len(y)
        dz = np.repeat(ds[:, None] * p["c"], n, axis=0)
        da = (dz * h).sum(1)
        de = alpha * (da - np.repeat(np.add.reduceat(alpha * da, cut[:-1]), n))
        dtv, dsu = de[:, None] * p["a"] * su, de[:, None] * p["a"] * tv
        dv, du = dtv * (1 - tv**2), dsu * su * (1 - su)
        dh = (alpha[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        grad = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "a": (tv * su).T @ de, "c": z.T @ ds, "d": ds.sum(keepdims=True)}
        self.t += 1
        for k, g in grad.items():
            g = g + DECAY * p[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            p[k] = p[k] - RATE * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def fit_bags(bags: list[tuple[np.ndarray, float]], epochs: int = EPOCHS, seed: int = 7) -> Mil:
    model = Mil(seed)
    if not bags:
        model.p["c"][:] = 0
        return model
    every = np.concatenate([x for x, _ in bags])
    model.mean, model.std = every.mean(0), every.std(0) + 1e-2
    r = np.random.default_rng(seed)
    for _ in range(epochs):
        order = r.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            mine = [bags[k] for k in order[i : i + BATCH]]
            model.step(np.concatenate([x for x, _ in mine]), np.append(0, np.cumsum([len(x) for x, _ in mine])), np.array([y for _, y in mine]))
    return model


def fit(labelled: DataFrame, passages: int = MAX_PASSAGES) -> Mil:
    """``labelled`` (at, text, y), a bounded number of rows: passages are described where the texts lie, one task learns."""

    @_text.tidy
    def turn(batches):
        for b in batches:
            for s in _text.slices(b):
                x, cut = features(s.column("text"))
                yield pa.record_batch({"at": s.column("at"), "y": s.column("y"), "x": pa.array([x[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())})

    @_text.tidy
    def train(batches):
        import pickle

        bags, size = [], 0
        for b in batches:
            for y, x in zip(b.column(1).to_pylist(), b.column(2)):
                size += len(x.as_py()) // (4 * SIZE) if size < passages else 0
                if size < passages:
                    bags.append((np.frombuffer(x.as_py(), np.float32).reshape(-1, SIZE), y))
        model = fit_bags(bags)
        model.m = model.v = None
        yield pa.record_batch({"model": pa.array([pickle.dumps(model.__dict__)], pa.binary())})

    import pickle

    model = Mil()
    found = labelled.mapInArrow(turn, "at bigint, y double, x binary").repartition(1).sortWithinPartitions("at", "y", "x").mapInArrow(train, "model binary").first()
    if found is None:  # nothing to learn from: every score is 0.5
        model.p["c"][:] = 0
    else:
        model.__dict__.update(pickle.loads(bytes(found[0])))
    return model


def score(docs: DataFrame, model: Mil, text_col: str = "text", out: str = "_score") -> DataFrame:
    """``docs`` with a column of scores, 0 to 1. No row moves."""
    sent = session(docs).sparkContext.broadcast(model)
    kept = docs.withColumn(out, F.lit(0.0))
    names, schema = kept.columns, kept.schema
    to = names.index(out)

    @_text.tidy
    def run(batches):
        for batch in batches:
            for s in _text.slices(batch, text_col):
                cols = [*s.columns]
                cols[to] = pa.array(sent.value.forward(*features(s.column(text_col)))[0])
                yield pa.RecordBatch.from_arrays(cols, names)

    return kept.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = MAX_ROWS, threshold: float = 0.3) -> DataFrame:
    """(id_col, held_out, score, predicted). Ids with crc32 modulo 5 equal to 0 are held out of the training."""
    model = fit(sample(docs, labels, "quality", crc_mod(id_col, 5) != 0, rows, id_col, text_col))
    scored = score(docs.select(id_col, text_col), model, text_col)
    predicted = F.when(F.col("_score") >= threshold, 1).otherwise(0).cast("int")
    return scored.select(id_col, (crc_mod(id_col, 5) == 0).alias("held_out"), F.col("_score").alias("score"), predicted.alias("predicted"))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
