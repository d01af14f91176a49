"""Hashed n-gram features of texts, shared by the two quality models.

Feature i of a family with n occurrences in a text has the value
``count / sqrt(n)``, so long and short texts weigh alike. ``doc_id``,
``lang`` and ``source`` are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.llm.words import Words, in_doc, mix, raw, releasing, runs, windows

_U = np.uint64


def remainder(mod: int) -> Column:
    """crc32 of doc_id as text, modulo ``mod`` (a null doc_id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % mod


def word_grams(w: Words, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, document) of the word unigrams and bigrams of a run."""
    h = w.hashes()
    two, at = windows(h, w.doc, 2)
    shift = _U(64 - bits)
    return [((h >> shift).astype(np.int64), w.doc), ((two >> shift).astype(np.int64), w.doc[at])]


_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a"): ord("z") + 1] = ord("a")
_CLASS[ord("A"): ord("Z") + 1] = ord("A")
_CLASS[ord("0"): ord("9") + 1] = ord("0")
_CLASS[0x80:] = ord("a")


def shape_grams(w: Words, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, document) of the word shapes of a run, and of whether each
    word repeats the one before it: n-grams that carry over to words which
    the training rows lack. A shape has one letter for each run of lower
    case, upper case, digits or one punctuation mark ("Ab12##" -> "Aa0#").
    """
    n = len(w.data)
    kind = _CLASS[w.data]
    kept = np.zeros(n, dtype=bool)
    kept[1:] = kind[1:] != kind[:-1]
    kept[w.start] = True
    place = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(kept, out=place[1:])
    short = Words.__new__(Words)
    short.data, short._eights = kind[kept], None
    h = short.span_hashes(place[w.start], place[w.end])
    exact = w.hashes()
    at = np.flatnonzero(w.doc[:-1] == w.doc[1:])
    same = mix((exact[at] == exact[at + 1]).astype(_U) + _U(7))
    shift = _U(64 - bits)
    return [((h >> shift).astype(np.int64), w.doc), ((same >> shift).astype(np.int64), w.doc[at])]


def char_grams(w: Words, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, document) of the byte 3- and 4-grams of a run, white space included."""
    data, shift = w.data.astype(_U), _U(64 - bits)
    doc = np.repeat(np.arange(len(w.off) - 1), np.diff(w.off))
    out = []
    for n in (3, 4):
        m = len(data) - n + 1
        if m <= 0:
            continue
        key = np.zeros(m, dtype=_U)
        for k in range(n):
            key |= data[k: m + k] << _U(8 * k)
        key *= _U((0x9E3779B97F4A7C15 * n) & ((1 << 64) - 1))
        at = np.flatnonzero(doc[:m] == doc[n - 1:])
        out.append(((key[at] >> shift).astype(np.int64), doc[at]))
    return out


def margins(texts: pa.Array, weights: np.ndarray, bits: int, families) -> np.ndarray:
    """Sparse dot product of every text's features with ``weights``; the
    bias is the last weight."""
    buf, off = raw(texts)
    out = np.empty(len(off) - 1)
    for i, j in runs(off):
        w = Words(buf, off[i: j + 1])
        total = np.full(j - i, float(weights[-1]))
        for family in families:
            for bucket, doc in family(w, bits):
                n = np.bincount(doc, minlength=j - i)
                s = np.bincount(doc, weights=weights[bucket], minlength=j - i)
                total += s / np.sqrt(np.maximum(n, 1))
        out[i:j] = total
    return out


def rows(texts: pa.Array, bits: int, families) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of every text, each bucket once; the bias comes last."""
    buf, off = raw(texts)
    for k in range(len(off) - 1):
        w = Words(buf, off[k: k + 2])
        idx, val = [], []
        for family in families:
            for bucket, _ in family(w, bits):
                u, c = np.unique(bucket, return_counts=True)
                idx.append(u)
                val.append(c / np.sqrt(max(len(bucket), 1)))
        idx, val = np.concatenate([*idx, [1 << bits]]), np.concatenate([*val, [1.0]])
        u, back = np.unique(idx, return_inverse=True)
        yield u.astype(np.int32), np.bincount(back, weights=val).astype(np.float32)


def labelled_texts(docs: DataFrame, labels: DataFrame, target: str, sample: int, eligible: Column | None = None) -> DataFrame:
    """(key, y, text) of about ``sample`` labelled documents.

    The bound is the caller's documented parameter. Rows are taken by a
    hash of doc_id, so that the choice is the same in every run; all
    labelled rows are used while there are no more than ``sample``. A
    doc_id labelled twice counts once, with its larger label; one that has
    several texts counts once, with the least of them. The sampled labels
    (at most about ``sample`` rows) are broadcast to the documents.
    """
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
    if eligible is not None:
        known = known.where(eligible)
    known = known.groupBy("doc_id").agg(F.max(target).cast("int").alias("_y"))
    total = known.count()
    key = F.xxhash64(F.col("doc_id").cast("string"))
    if total > sample:
        known = known.where(F.pmod(key, F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    return (docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id")
            .agg(F.max("_y").alias("y"), F.min("text").alias("text")).select(key.alias("key"), "y", "text"))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, sample: int, bits: int, families,
                  eligible: Column | None = None) -> DataFrame:
    """Features of about ``sample`` labelled documents (see
    :func:`labelled_texts`): (key, y, idx, val)."""
    def featurise(batches):
        for b in batches:
            idx, val = [], []
            for u, v in rows(b.column("text"), bits, families):
                idx.append(u.tobytes())
                val.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("y").cast(pa.int32()), pa.array(idx, pa.binary()),
                                              pa.array(val, pa.binary())], ["key", "y", "idx", "val"])

    picked = labelled_texts(docs, labels, target, sample, eligible)
    return picked.mapInArrow(releasing(featurise), "key long, y int, idx binary, val binary")


def in_order(pdf) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The training rows of a pandas frame in a fixed, hash-mixed order."""
    pdf = pdf.sort_values(["key", "y", "idx"], kind="stable")
    return [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), int(y)) for i, v, y in zip(pdf.idx, pdf.val, pdf.y)]


def fitted(features: DataFrame, fit) -> bytes:
    """The model that one task makes of the bounded training rows."""
    import pandas as pd

    none = pd.DataFrame({"key": [], "y": [], "idx": [], "val": []})

    def train(batches):
        yield pd.DataFrame({"model": [fit(pd.concat([none, *batches]))]})

    got = features.repartition(1).mapInPandas(releasing(train), "model binary").collect()
    return bytes(got[0][0]) if got else fit(none)


__all__ = ["char_grams", "fitted", "in_doc", "in_order", "labelled_texts", "margins", "mix", "remainder", "rows", "shape_grams", "training_rows", "word_grams"]
