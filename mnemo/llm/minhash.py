"""Document fingerprints: one-permutation MinHash with optimal densification.

Shingles are five consecutive words (a text of fewer words is one shingle).
Every shingle is hashed once; the top bits choose one of ``BINS`` bins and
the bin keeps the least of the rest. An empty bin takes the value of the
first filled bin in a fixed random order of its own, so that two texts choose
alike (optimal densification). Of each bin the ``BITS`` lowest bits are
stored, packed; the likeness of two fingerprints is the share of equal bins,
corrected for the chance that unequal values agree in their low bits.

Repeated rows have a fingerprint each; rows of one doc_id follow one another by
a hash of their text. Extra columns are kept by :func:`fingerprints` and ignored
by :func:`compare_edits`; an empty table gives no rows.

A text without words (null, empty, white space) has the fingerprint "" and is
like another of the kind (1.0) and unlike every other text (0.0).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mnemo.llm.words import Words, arrow, mix, raw, runs, windows

SHINGLE = 5
BINS = 256         # a power of two
BITS = 4
_U = np.uint64
_EMPTY = np.iinfo(np.uint64).max


def _orders(bins: int) -> np.ndarray:
    """orders[i]: the fixed random order in which bin i looks for a value."""
    cell = mix((np.arange(bins, dtype=_U)[:, None] << _U(32)) + np.arange(bins, dtype=_U)[None, :] + _U(1))
    return np.argsort(cell, axis=1, kind="stable")


_ORDERS = _orders(BINS)
_RANKS = np.argsort(_ORDERS, axis=1, kind="stable")


def shingles(w: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of all shingles of a run, repeats included."""
    h = w.hashes()
    parts = [windows(h, w.doc, width)]
    for n in range(1, width):
        if (w.counts == n).any():
            g, at = windows(h, w.doc, n)
            short = w.counts[w.doc[at]] == n
            parts.append((g[short], at[short]))
    return mix(np.concatenate([g for g, _ in parts])), w.doc[np.concatenate([at for _, at in parts])]


def densify(least: np.ndarray) -> None:
    """Fill the empty bins of every row that has a filled one, in place."""
    empty = least == _EMPTY
    rows = np.flatnonzero(empty.any(axis=1) & ~empty.all(axis=1))
    origin = least.copy()
    for step in range(16):
        if not len(rows):
            return
        donor = _ORDERS[:, step]
        fill = empty[rows] & (origin[rows][:, donor] != _EMPTY)
        part = least[rows]
        part[fill] = origin[rows][:, donor][fill]
        least[rows] = part
        empty[rows] &= ~fill
        rows = rows[empty[rows].any(axis=1)]
    for r in rows:     # few filled bins: look for the first of them directly
        filled = np.flatnonzero(origin[r] != _EMPTY)
        bare = np.flatnonzero(empty[r])
        least[r, bare] = origin[r, filled[np.argmin(_RANKS[bare][:, filled], axis=1)]]


def sketches(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, filled): the low bits of each bin, a row per text, and
    whether the text has words."""
    buf, off = raw(texts)
    out, filled = np.zeros((len(off) - 1, BINS), dtype=np.uint8), np.zeros(len(off) - 1, dtype=bool)
    shift = _U(64 - (BINS.bit_length() - 1))
    for i, j in runs(off):
        w = Words(buf, off[i: j + 1])
        if not len(w):
            continue
        h, doc = shingles(w)
        least = np.full((j - i, BINS), _EMPTY)
        np.minimum.at(least.reshape(-1), doc * BINS + (h >> shift).astype(np.int64), h & _U((1 << 56) - 1))
        densify(least)
        out[i:j] = least.astype(np.uint8) & ((1 << BITS) - 1)
        filled[i:j] = w.counts > 0
    out[~filled] = 0
    return out, filled


def packed(values: np.ndarray, filled: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal digits of the packed low bits."""
    bits = (values[:, :, None] >> np.arange(BITS - 1, -1, -1, dtype=np.uint8)) & 1
    rows = np.packbits(bits.reshape(len(values), -1), axis=1)
    return [r.tobytes().hex() if f else "" for r, f in zip(rows, filled)]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Estimated Jaccard similarity of the shingle sets, row by row."""
    chance = 2.0 ** -BITS
    same = (a[0] == b[0]).mean(axis=1)
    near = np.clip((same - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a[1] & b[1], near, (a[1] == b[1]).astype(np.float64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``fingerprint`` (one of that name is replaced)."""
    arrow(docs.sparkSession)
    docs = docs.drop("fingerprint")
    keep = docs.columns
    schema = StructType([*docs.schema.fields, StructField("fingerprint", StringType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(packed(*sketches(b.column("text"))), pa.string())], [*keep, "fingerprint"])

    return docs.mapInArrow(run, schema)


def in_sequence(docs: DataFrame) -> DataFrame:
    """(bucket, doc_id, guest, text), each partition one bucket in descending
    order of doc_id (nulls last, equal ids by a hash of the text), followed by
    its guest: the first row of the next bucket, or of the first after the
    last. So the next row is always at hand.

    Only the bounds of the buckets (quantiles) and each bucket's first row's
    id, one row per bucket, come to the driver.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("place"),
                        F.xxhash64("text").alias("tie"), "text")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    at = [k / n for k in range(1, n)]
    found = keyed.agg(F.percentile_approx("place", at, 10 * n + 1000).alias("q")).first()["q"] if at else None
    bounds = np.unique(np.array(found or [], dtype=np.int64))

    def bucket(place) -> np.ndarray:
        return len(bounds) - np.searchsorted(bounds, place.to_numpy(zero_copy_only=False), side="left")

    def number(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket(b.column("place")).astype(np.int32)), *b.columns], ["bucket", "place", "tie"])

    firsts = (keyed.select("place", "tie").mapInArrow(number, "bucket int, place long, tie long")
              .groupBy("bucket").agg(F.max(F.struct("place", "tie")).alias("top")).orderBy("bucket").collect())
    host = {(r.top.place, r.top.tie): firsts[k - 1].bucket for k, r in enumerate(firsts)}
    columns = ["bucket", "guest", "doc_id", "place", "tie", "text"]

    def deal(batches):
        for b in batches:
            home = bucket(b.column("place")).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(np.zeros(len(home), dtype=np.int32)), *b.columns], columns)
            away = [(i, host[key]) for i, key in enumerate(zip(b.column("place").to_pylist(), b.column("tie").to_pylist())) if key in host]
            if away:
                rows = b.take(pa.array([i for i, _ in away]))
                yield pa.RecordBatch.from_arrays([pa.array([k for _, k in away], pa.int32()), pa.array([1] * len(away), pa.int32()), *rows.columns], columns)

    dealt = keyed.mapInArrow(deal, "bucket int, guest int, doc_id long, place long, tie long, text string")
    return (dealt.repartitionById(len(bounds) + 1, F.col("bucket"))
            .sortWithinPartitions("bucket", "guest", F.desc("place"), F.desc("tie")).select("bucket", "guest", "doc_id", "text"))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and likenesses.

    The edited text has the last half of the document replaced by as many
    code points from the start of the next document (descending doc_id; the
    first follows the last).
    """
    arrow(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        last = None      # (bucket, guest, doc_id, text, values, filled) of the row before
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column("text")
            values, filled = sketches(texts)
            rows = list(zip(b.column("bucket").to_pylist(), b.column("guest").to_pylist(), b.column("doc_id").to_pylist(),
                            (t or "" for t in texts.to_pylist()), range(b.num_rows)))
            if last is not None:
                values, filled = np.vstack([last[1], values]), np.concatenate([last[2], filled])
                rows = [(*last[0], 0), *((*r[:4], r[4] + 1) for r in rows)]
            pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[1] and x[0] == y[0]]
            last = rows[-1][:4], values[-1:], filled[-1:]
            if not pairs:
                continue
            here, there = [x[4] for x, _ in pairs], [y[4] for _, y in pairs]
            new = [edited(x[3], y[3]) for x, y in pairs]
            own = values[here], filled[here]
            changed = sketches(pa.array(new, pa.large_string()))
            yield pa.RecordBatch.from_arrays([
                pa.array([x[2] for x, _ in pairs], pa.int64()), pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()), pa.array(packed(*own), pa.string()),
                pa.array(packed(*changed), pa.string()), pa.array(likeness(own, changed)),
                pa.array(likeness(own, (values[there], filled[there])))], names)

    return in_sequence(docs).mapInArrow(run, schema)
