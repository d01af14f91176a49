"""Elias-Fano sequences and an n-gram trie made of them.

All lookups are vectorised: a call takes arrays of questions. A trie is a
list of named arrays; it can be written to one file and mapped into memory.
"""

from __future__ import annotations

import json
import os

import numpy as np

_U = np.uint64
_COUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
_SELECT = np.zeros((256, 8), dtype=np.uint8)
for _b in range(256):
    _ones = [i for i in range(8) if _b >> i & 1]
    _SELECT[_b, : len(_ones)] = _ones


class Monotone:
    """A non-decreasing sequence of unsigned numbers below ``universe``.

    The low ``width`` bits of each number are packed; the rest is a bit
    vector with a one per number and a zero per step of the high part.
    ``ones``/``zeros`` count them before each 64-bit word.
    """

    FIELDS = ("meta", "low", "high", "ones", "zeros")

    def __init__(self, fields: dict):
        self.fields = fields
        self.n, self.width, self.top = (int(x) for x in fields["meta"])
        self.low, self.high, self.ones, self.zeros = (fields[f] for f in self.FIELDS[1:])
        self._bytes = self.high.view(np.uint8).reshape(-1, 8)
        self._windows = np.ndarray((max(len(self.low) - 7, 1),), dtype="<u8", buffer=self.low, strides=(1,)) if self.n else None

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> "Monotone":
        values = values.astype(_U)
        n = len(values)
        width = min(max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1), 56)
        top = ((universe - 1) >> width) + 1 if universe else 1
        high = np.zeros((n + top + 64) // 64 + 1, dtype="<u8")
        at = (values >> _U(width)).astype(np.int64) + np.arange(n)
        np.bitwise_or.at(high, at >> 6, _U(1) << (at & 63).astype(_U))
        bits = _COUNT[high.view(np.uint8)].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        ones = np.concatenate([[0], np.cumsum(bits)])
        zeros = np.arange(len(high) + 1) * 64 - ones
        low = np.zeros((n * width + 7) // 8 + 8, dtype=np.uint8)
        step = 1 << 18      # a multiple of 8 numbers fills whole bytes
        for k in range(0, n if width else 0, step):
            part = np.ascontiguousarray(values[k: k + step]).view(np.uint8).reshape(-1, 8)
            packed = np.packbits(np.unpackbits(part, axis=1, count=width, bitorder="little").reshape(-1), bitorder="little")
            low[k * width // 8: k * width // 8 + len(packed)] = packed
        return cls({"meta": np.array([n, width, top], dtype="<i8"), "low": low, "high": high,
                    "ones": ones.astype("<u4" if n < 1 << 32 else "<u8"), "zeros": zeros.astype("<u4" if n + top < 1 << 31 else "<u8")})

    def _select(self, k: np.ndarray, before: np.ndarray, flip: int) -> np.ndarray:
        """Position of the k-th (from 0) set bit, or unset bit with ``flip`` 255."""
        word = np.searchsorted(before, k, side="right") - 1
        rest = (k - before[word]).astype(np.int64)
        octets = self._bytes[word] ^ np.uint8(flip)
        upto = np.cumsum(_COUNT[octets], axis=1, dtype=np.int16)
        byte = (upto <= rest[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        rest -= np.where(byte > 0, upto[rows, byte - 1], 0)
        return word * 64 + byte * 8 + _SELECT[octets[rows, byte], rest]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), dtype=_U)
        bit = i * self.width
        return (self._windows[bit >> 3] >> (bit & 7).astype(_U)) & _U((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        i = np.asarray(i, dtype=np.int64)
        if not len(i):
            return np.zeros(0, dtype=_U)
        return (self._select(i, self.ones, 0) - i).astype(_U) << _U(self.width) | self._low(i)

    def successor(self, value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first position in begin..end whose number is at least value
        (end if there is none): a search inside each context's range."""
        return self._search(value, begin, end)[0]

    def position(self, value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The position in begin..end of the number value itself, or -1: its
        successor, if that has the same high part and the same low bits."""
        at, last = self._search(value, begin, end)
        hit = at < last
        hit[hit] = self._low(at[hit]) == value[hit].astype(_U) & _U((1 << self.width) - 1)
        return np.where(hit, at, -1)

    def _search(self, value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(successors, ends of the numbers with the value's high part)."""
        value = value.astype(_U)
        h = np.minimum((value >> _U(self.width)).astype(np.int64), self.top)
        # numbers with a smaller high part come before the h-th zero's place
        first = np.where(h > 0, self._select(np.maximum(h - 1, 0), self.zeros, 255) - np.maximum(h - 1, 0), 0)
        last = self._select(np.minimum(h, self.top), self.zeros, 255) - np.minimum(h, self.top)
        lo, hi = np.clip(first, begin, end), np.clip(last, begin, end)
        want = value & _U((1 << self.width) - 1)
        live = np.flatnonzero(lo < hi)
        while len(live):        # halve the numbers of equal high part
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo, np.clip(last, begin, end)


class Trie:
    """Levels of an n-gram trie.

    Level k holds its nodes as one monotone sequence of
    ``parent << bits[k] | word key`` (level 0: word hashes), monotone
    pointers to the ranges of their successors in level k + 1, and byte
    codes per node. A node is found from its parent by a successor search
    inside the parent's range.
    """

    def __init__(self, levels: list[dict], bits: list[int]):
        self.levels, self.bits = levels, bits

    @classmethod
    def build(cls, keys: list[np.ndarray], parents: list[np.ndarray], codes: list[dict], bits: list[int]) -> "Trie":
        """keys[k] and parents[k] in trie order; codes[k]: name -> array."""
        levels = []
        for k, key in enumerate(keys):
            if k == 0:
                level = {"node": Monotone.build(key, 1 << 64)}
            else:
                n = len(keys[k - 1])
                level = {"node": Monotone.build(parents[k].astype(_U) << _U(bits[k]) | key, max(n, 1) << bits[k])}
                ends = np.concatenate([[0], np.cumsum(np.bincount(parents[k], minlength=n))])
                levels[-1]["next"] = Monotone.build(ends, len(key) + 1)
            level |= codes[k]
            levels.append(level)
        return cls(levels, bits)

    def find(self, k: int, key: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
        """Positions of nodes in level k, -1 where there is none (also where
        the parent is -1)."""
        nodes = self.levels[k]["node"]
        out = np.full(len(key), -1, dtype=np.int64)
        if not nodes.n or not len(key):
            return out
        if k == 0:
            ask = np.arange(len(key))
            begin, end, want = np.zeros(len(key), np.int64), np.full(len(key), nodes.n), key
        else:
            ask = np.flatnonzero(parent >= 0)
            up = parent[ask]
            ptr = self.levels[k - 1]["next"]
            if 2 * len(up) > ptr.n:     # many questions: read each pointer once
                every = ptr.get(np.arange(ptr.n)).astype(np.int64)
                begin, end = every[up], every[up + 1]
            else:
                begin, end = ptr.get(up).astype(np.int64), ptr.get(up + 1).astype(np.int64)
            want = up.astype(_U) << _U(self.bits[k]) | key[ask]
        out[ask] = nodes.position(want, begin, end)
        return out

    def save(self, path: str) -> None:
        """All arrays in one file, each at a multiple of 64 bytes."""
        index, body, at = [], [], 0
        for k, level in enumerate(self.levels):
            for name, x in level.items():
                for field, a in (x.fields.items() if isinstance(x, Monotone) else [("", np.ascontiguousarray(x))]):
                    index.append([k, name, field, a.dtype.str, len(a), at])
                    body.append(a)
                    at += -(-a.nbytes // 64) * 64
        head = json.dumps({"bits": self.bits, "arrays": index}).encode()
        with open(path, "wb") as f:
            f.write(len(head).to_bytes(8, "little") + head)
            f.write(bytes(-f.tell() % 64))
            for a in body:
                f.write(a.tobytes())
                f.write(bytes(-a.nbytes % 64))

    @classmethod
    def load(cls, path: str) -> "Trie":
        """The trie of a file, mapped into memory (pages are read when used)."""
        with open(path, "rb") as f:
            size = int.from_bytes(f.read(8), "little")
            head = json.loads(f.read(size))
        start = -(-(8 + size) // 64) * 64
        data = np.memmap(path, dtype=np.uint8, mode="r") if os.path.getsize(path) > start else np.zeros(0, np.uint8)
        levels: list[dict] = []
        for k, name, field, kind, n, at in head["arrays"]:
            while len(levels) <= k:
                levels.append({})
            a = np.asarray(data[start + at: start + at + n * np.dtype(kind).itemsize]).view(kind)
            if field:
                levels[k].setdefault(name, {})[field] = a
            else:
                levels[k][name] = a
        for level in levels:
            for name, x in level.items():
                if isinstance(x, dict):
                    level[name] = Monotone(x)
        return cls(levels, head["bits"])
