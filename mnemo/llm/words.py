"""Word tables of Arrow text batches, made with numpy.

A word is a match of ``[^\\x20\\x09-\\x0D]+``. Texts come as Arrow string
arrays; a null text counts as empty. Whole texts are read; a batch is cut
into runs of documents of about ``RUN_BYTES`` so that the scratch arrays
stay small (a single longer text makes a run of its own).
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

RUN_BYTES = 250_000
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_U = np.uint64
_LANE = 8            # bytes that are hashed at once
_LONG = 4096         # longer spans are hashed one by one


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _lanes(data: np.ndarray) -> np.ndarray:
    """lanes[i]: the eight bytes from position i on, zeros after the end."""
    padded = np.zeros(len(data) + _LANE, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0, lanes: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the bytes of each span start[i]:end[i].

    Eight bytes at a time go through :func:`mix`, all spans side by side, so
    every byte passes the mixer before the next; the length is part of the
    hash. Spans of over ``_LONG`` bytes are hashed by XXH3.
    """
    size = (end - start).astype(np.int64)
    out = mix(size.astype(_U) + _U(0x9E3779B97F4A7C15 ^ seed))
    lanes = _lanes(data) if lanes is None else lanes
    at = np.flatnonzero((size > 0) & (size <= _LONG))
    h, place, left = out[at], start[at].astype(np.int64), size[at]
    while len(at):
        v = lanes[place]
        short = np.flatnonzero(left < _LANE)
        v[short] &= (_U(1) << (left[short] * 8).astype(_U)) - _U(1)
        h = mix(h ^ v)
        more = left > _LANE
        if more.all():
            place, left = place + _LANE, left - _LANE
            continue
        out[at[~more]] = h[~more]
        at, h, place, left = at[more], h[more], place[more] + _LANE, left[more] - _LANE
    for k in np.flatnonzero(size > _LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k]: end[k]].tobytes(), seed=seed)
    return out


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return buf, off


def runs(off: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (first, last + 1) documents of about ``most`` bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of one run of documents.

    ``start``/``end`` are byte positions in ``data``; the words of document
    i are ``first[i]:first[i + 1]``; ``doc`` is each word's document.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False):
        self._eights = None
        self.off = off - off[0]
        data = buf[off[0]: off[-1]]
        if lower:
            data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
        self.data = data
        n = len(data)
        ink = ~SPACE[data]
        begin = ink.copy()
        begin[1:] &= ~ink[:-1]
        inner = self.off[(self.off < n)]
        begin[inner] = ink[inner]
        final = ink.copy()
        final[:-1] &= ~ink[1:]
        tails = self.off[1:] - 1
        tails = tails[tails >= 0]
        final[tails] = ink[tails]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(final) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def __len__(self) -> int:
        return len(self.start)

    def span_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span start[i]:end[i]."""
        if self._eights is None:
            self._eights = _lanes(self.data)
        return hash_spans(self.data, start, end, lanes=self._eights)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return self.span_hashes(self.start, self.end)


def windows(h: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every ``width`` consecutive words inside one document."""
    m = len(h) - width + 1
    if m <= 0:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(doc[:m] == doc[width - 1:])
    w = h[at]
    for k in range(1, width):
        w = mix(w * _U(0x9E3779B97F4A7C15) + h[at + k])
    return w, at


def in_doc(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that are equal where both the hash and the document are."""
    return mix(h + mix(doc.astype(_U) + _U(1)))


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal key elsewhere, has an equal key before it), per key."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    later, any_ = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, later


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for every i."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:], dtype=total.dtype)
    return total[first[1:]] - total[first[:-1]]


def arrow(spark, rows: int = 200) -> None:
    """Arrow batches of at most ``rows`` rows: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def release() -> None:
    """Give memory that is no longer used back to the system: a Python worker
    waits for its next task with what it once held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):      # not the GNU library
        pass


def releasing(run):
    """``run``, a function of a task's batches, with :func:`release` after the last."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
