"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, word pairs and one-word skip pairs (ASCII case folded), hashed to ``2**BITS``
places. Training uses per-coordinate rates and L1, so few weights are not zero; those alone are sent to the executors.
Null, empty and very long texts are scored like any other (an empty text has the intercept alone). Label rows with null labels
or without a document are left out of the training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import crc_mod, fresh, same_columns, session

BITS = 20
#: Bound on the rows fitted on: those with the lowest hash of their id.
MAX_ROWS = 8000
#: Bound on the features that the fitting task holds: a row that would pass it, in the order of the rows' hash, and all after it are left out of the fit.
MAX_FEATURES = 40_000_000
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 6.0, 0.0, 6


def _features(words: _text.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and the text of each; not yet distinct."""
    one = (words.h, words.doc)
    found = [one, words.grams(2), words.grams(2, skip=1)]
    return np.concatenate([(h >> np.uint64(64 - BITS)).astype(np.int64) for h, _ in found]), np.concatenate([d for _, d in found])


class Ftrl:
    """The model in training: z and n of each coordinate; the last coordinate is the intercept."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, y: float) -> None:
        i = np.append(i, 2**BITS)
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        s = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - s * w
        self.n[i] += g * g


def fit(labelled: DataFrame, epochs: int = EPOCHS, features: int = MAX_FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """``labelled`` (id, text, y), at most MAX_ROWS rows: places and weights that aren't zero, and the intercept.

    Rows are turned to features where they lie; one task goes over them in the order of their id's hash.
    """

    @_text.tidy
    def turn(batches):
        for b in batches:
            for s in _text.slices(b):
                w = _text.Words(s.column("text"), lower=True)
                h, d = _features(w)
                h, d, _ = _text.distinct(h, d)
                cut = np.searchsorted(d, np.arange(s.num_rows + 1))
                yield pa.record_batch({"at": s.column("at"), "y": s.column("y"), "f": pa.array([h[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])], pa.binary())})

    @_text.tidy
    def train(batches):
        model, rows, size = Ftrl(), [], 0
        for b in batches:
            for y, f in zip(b.column(1).to_pylist(), b.column(2)):
                size += len(f.as_py()) // 4 if size < features else 0
                if size < features:
                    rows.append((np.frombuffer(f.as_py(), np.int32), y))
        for _ in range(epochs):
            for f, y in rows:
                model.learn(f, y)
        w = model.weights()
        i = np.flatnonzero(w[:-1])
        yield pa.record_batch({"i": pa.array([i.astype(np.int32).tobytes()], pa.binary()), "w": pa.array([w[i].tobytes()], pa.binary()), "b": pa.array([float(w[-1])])})

    r = labelled.select("at", "text", "y").mapInArrow(turn, "at bigint, y double, f binary").repartition(1).sortWithinPartitions("at", "y", "f").mapInArrow(train, "i binary, w binary, b double").first()
    if r is None:  # nothing to learn from: every score is 0.5
        return np.zeros(0, np.int32), np.zeros(0), 0.0
    return np.frombuffer(bytes(r.i), np.int32), np.frombuffer(bytes(r.w)), r.b


def sample(docs: DataFrame, labels: DataFrame, label: str, use, rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``rows`` labelled documents (at, text, y), of those whose id ``use`` (a Column) admits: the lowest by hash of the id.

    The bound is proven, so their ids are sent to where the texts are; no other text moves. Rows that repeat an id count once, with the least text.
    """
    ids = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("y"))
        .where(F.col("y").isNotNull() & F.col("_id").isNotNull())
        .groupBy("_id").agg(F.max("y").alias("y"))
        .withColumnRenamed("_id", id_col).where(use).withColumnRenamed(id_col, "_id")
        .withColumn("at", F.xxhash64(F.col("_id").cast("string"), F.lit("sample")))
        .orderBy("at", "_id").limit(rows)
    )
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "_id").groupBy("at", "y").agg(F.min("text").alias("text")).select("at", "text", "y")


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", out: str = "_score") -> DataFrame:
    """``docs`` with a column ``out`` of scores, 0 to 1 (one of that name is replaced). No row moves."""
    sent = session(docs).sparkContext.broadcast(model)
    kept = docs.withColumn(out, F.lit(0.0))
    names, schema = kept.columns, kept.schema
    to = names.index(out)

    @_text.tidy
    def run(batches):
        i, w, b = sent.value
        table = np.zeros(2**BITS)
        table[i] = w
        for batch in batches:
            for s in _text.slices(batch, text_col):
                h, d = _features(_text.Words(s.column(text_col), lower=True))
                hit = table[h] != 0
                h, d, _ = _text.distinct(h[hit], d[hit])
                z = np.bincount(d, table[h], s.num_rows) + b
                cols = [*s.columns]
                cols[to] = pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))
                yield pa.RecordBatch.from_arrays(cols, names)

    return kept.mapInArrow(run, schema)


def model_of(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = MAX_ROWS):
    """Fit on labelled rows; ids with crc32 modulo 3 equal to 1 are held out."""
    return fit(sample(docs, labels, "toxic", crc_mod(id_col, 3) != 1, rows, id_col, text_col))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score under the threshold, all columns as they are."""
    (out,) = fresh(docs, "_score")
    return score(docs, model_of(docs, labels), out=out).where(F.col(out) < threshold).select(*same_columns(docs))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = MAX_ROWS, threshold: float = 0.7) -> DataFrame:
    """(id_col, held_out, score, predicted) for each row of docs."""
    scored = score(docs.select(id_col, text_col), model_of(docs, labels, id_col, text_col, rows), text_col)
    predicted = F.when(F.col("_score") >= threshold, 1).otherwise(0).cast("int")
    return scored.select(id_col, (crc_mod(id_col, 3) == 1).alias("held_out"), F.col("_score").alias("score"), predicted.alias("predicted"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
