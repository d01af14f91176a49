"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

Null and empty texts have only the bias, so they get the score of a text
without evidence. Repeated rows are scored one by one; extra columns are
ignored. Without training rows every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.llm.features import fitted, in_order, margins, remainder, shape_grams, training_rows, word_grams
from mnemo.llm.words import arrow, releasing

BITS = 18          # 2**18 buckets: a model of 1 MB whatever the input
SAMPLE = 8000      # at most about so many labelled rows are learnt from
EPOCHS = 3
THRESHOLD = 0.3    # fixed by the contract
FAMILIES = [word_grams, shape_grams]
HELD_OUT = 5       # rows whose crc32(doc_id) mod 5 is 0 are never learnt from


class Ftrl:
    """Per-coordinate follow-the-regularised-leader (proximal) for log loss."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, idx=slice(None)) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        pull = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, pull / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, idx: np.ndarray, val: np.ndarray, y: int) -> None:
        w = self.weights(idx)
        g = (sigmoid(float(w @ val)) - y) * val
        n = self.n[idx]
        step = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[idx] += g - step * w
        self.n[idx] = n + g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, eligible: Column | None = None) -> np.ndarray:
    """Weights (the bias last) learnt from a bounded sample of labelled rows."""
    def train(pdf) -> bytes:
        model, data = Ftrl((1 << BITS) + 1), in_order(pdf)
        for _ in range(EPOCHS):
            for idx, val, y in data:
                model.update(idx, val, y)
        return model.weights().astype(np.float32).tobytes()

    arrow(docs.sparkSession)
    model = fitted(training_rows(docs, labels, "quality", sample, BITS, FAMILIES, eligible), train)
    return np.frombuffer(model, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(row, score): every document as a struct of its columns, and its score."""
    arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("_text"))

    def run(batches):
        for b in batches:
            s = sigmoid(margins(b.column("_text"), shared.value, BITS, FAMILIES))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(s)], ["row", "score"])

    return rows.mapInArrow(releasing(run), rows.select("row").schema.add("score", "double"))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    weights = fit(docs, labels, eligible=remainder(HELD_OUT) != 0)
    scored = score(docs.select("doc_id", "text"), weights).select(F.col("row.doc_id").alias("doc_id"), "score")
    return scored.select("doc_id", (remainder(HELD_OUT) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts to be good."""
    return score(docs, weights).where(F.col("score") >= THRESHOLD).select("row.*")
