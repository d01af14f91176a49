"""Quality rules: plain text counts, and a calibrated logistic regression on
hashed word and character n-grams, scored in Arrow batches.

A null or empty text has no words, so it fails the base rules. Equal lines
are compared byte for byte. Repeated rows are judged one by one and extra
columns are ignored. Without usable labels the model passes every text, so
the base rules alone decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.features import char_grams, fitted, in_order, margins, shape_grams, training_rows, word_grams
from mnemo.llm.quality_classifier import sigmoid
from mnemo.llm.words import SPACE, Words, arrow, in_doc, raw, releasing, repeats, runs, sums, windows

BITS = 18          # 2**18 buckets: a model of 1 MB whatever the input
SAMPLE = 4000      # at most about so many labelled rows are learnt from
KEEP = 0.3         # fixed threshold of the calibrated probability
MIN_WORDS = 10     # fixed by the contract
MAX_REPEAT = 20    # per cent, fixed by the contract
WINDOW = 5
FAMILIES = [word_grams, shape_grams, char_grams]
ROWS = 64          # whose features are put together at once while training
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def counts(texts: pa.Array) -> np.ndarray:
    """The five base counts of every text, one column each (see COUNTS)."""
    buf, off = raw(texts)
    out = np.zeros((len(off) - 1, 5), dtype=np.int64)
    for i, j in runs(off):
        w = Words(buf, off[i: j + 1])
        part = out[i:j]
        part[:, 0] = w.counts
        part[:, 1] = sums(((w.data & 0xC0) != 0x80) & ~SPACE[w.data], w.off)
        part[:, 2] = sums(_SYMBOL[w.data], w.off)
        part[:, 3] = _dup_lines(w)
        part[:, 4] = _repeat_words(w)
    return out


def _dup_lines(w: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line, per document."""
    if not len(w):
        return np.zeros(len(w.counts), dtype=np.int64)
    cuts = np.unique(np.concatenate([np.flatnonzero(w.data == 10), w.off - 1, w.off[1:-1] - 1]))
    start, end = cuts[:-1] + 1, cuts[1:]
    last = np.zeros(len(w.data) + 1, dtype=bool)
    last[w.off[1:]] = True
    end = np.where(last[end + 1] & (w.data[end] != 10), end + 1, end)
    words = np.searchsorted(w.start, end) - np.searchsorted(w.start, start)
    start, end = start[words > 0], end[words > 0]
    doc = np.searchsorted(w.off, start, side="right") - 1
    _, later = repeats(in_doc(w.span_hashes(start, end), doc))
    return np.bincount(doc[later], minlength=len(w.counts))


def _repeat_words(w: Words) -> np.ndarray:
    """Words inside a five-word window found twice or more in its document."""
    h, at = windows(w.hashes(), w.doc, WINDOW)
    again, _ = repeats(in_doc(h, w.doc[at]))
    edge = np.zeros(len(w) + 1, dtype=np.int64)
    edge[at[again]] += 1
    edge[at[again] + WINDOW] -= 1
    return sums(np.cumsum(edge[:-1]) > 0, w.first)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights (the bias last) whose sigmoid is a calibrated probability.

    Full-batch AdaGrad on four fifths of a bounded sample of labelled rows;
    the remaining fifth sets the calibration ``sigmoid(a * margin + b)``,
    which is folded into the returned weights.
    """
    def train(pdf) -> bytes:
        data = in_order(pdf)
        w = np.zeros((1 << BITS) + 1)
        if len({y for _, _, y in data}) < 2:
            w[-1] = 40.0
            return w.astype(np.float32).tobytes()
        learn, check = [r for k, r in enumerate(data) if k % 5], data[::5]
        seen = np.full(len(w), 1e-8)
        for _ in range(40):
            g = 1e-5 * w
            for at in range(0, len(learn), ROWS):      # a few rows at a time: the features stay as they came
                part = learn[at: at + ROWS]
                idx, val = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
                row = np.repeat(np.arange(len(part)), [len(r[0]) for r in part])
                off = sigmoid(np.bincount(row, weights=w[idx] * val, minlength=len(part))) - np.array([r[2] for r in part])
                np.add.at(g, idx, (off / len(learn))[row] * val)
            seen += g * g
            w -= 0.3 * g / np.sqrt(seen)
        a, b = _platt(np.array([float(w[i] @ v) for i, v, _ in check]), np.array([r[2] for r in check], dtype=np.float64))
        w *= a
        w[-1] += b
        return w.astype(np.float32).tobytes()

    arrow(docs.sparkSession)
    features = training_rows(docs, labels, "quality", sample, BITS, FAMILIES)
    return np.frombuffer(fitted(features, train), np.float32)


def _platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for the slope and offset of a logistic calibration; the
    slope stays positive, so that the order of scores is kept."""
    good = y.sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    scale = float(np.abs(m).mean()) or 1.0
    m = m / scale

    def loss(a: float, b: float) -> float:
        x = a * m + b
        return float((np.logaddexp(0, x) - t * x).sum())

    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * m + b)
        s = p * (1 - p) + 1e-6
        g = np.array([(p - t) @ m, (p - t).sum()])
        h = np.array([[s @ (m * m), s @ m], [s @ m, s.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-4 and not loss(max(a - size * step[0], 1e-3), b - size * step[1]) <= loss(a, b):
            size /= 2
        a, b = max(a - size * step[0], 1e-3), b - size * step[1]
    return float(a / scale), float(b)


def judge(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(row, COUNTS, base_failed, probability): every document as a struct
    of its columns, its counts and the verdicts."""
    arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("_text"))
    schema = rows.select("row").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("probability", "double")

    def run(batches):
        for b in batches:
            texts = b.column("_text")
            n = counts(texts)
            p = sigmoid(margins(texts, shared.value, BITS, FAMILIES))
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(n[:, k]) for k in range(5)), pa.array(p)], schema.names)

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return rows.mapInArrow(releasing(run), schema).select("row", *COUNTS, failed.alias("base_failed"), "probability")


def _kept():
    return ~F.col("base_failed") & (F.col("probability") >= KEEP)


def rule_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the model's probability."""
    judged = judge(docs.select("doc_id", "text"), fit(docs, labels))
    return judged.select(F.col("row.doc_id").alias("doc_id"), *COUNTS, "base_failed", _kept().alias("kept"), "probability")


def keep_good(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the model."""
    return judge(docs, weights).where(_kept()).select("row.*")
