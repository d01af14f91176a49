"""Byte-level BPE as a lazily determinised finite-state transducer.

Encoding. A token sequence is what BPE yields exactly if every pair of
neighbours (u, t) is stable, that is if BPE turns the bytes of u and t back
into u, t: the first merge across a boundary would depend on the two tokens
beside it alone. So the merges compile into a nondeterministic transducer
that reads bytes along vocabulary words and may end a word t after u where
(u, t) is stable. Exactly one stable chain ends at every position. The
transducer is determinised while it reads: a deterministic state is the last
emitted token with the bytes not yet emitted, and it knows the chain to every
position of those bytes and which positions may still grow into a longer
token. A token is emitted as soon as all these agree on it, so the lookahead
is bounded by the longest vocabulary word. States and transitions are made
when first met and kept in tables of bounded size.

Decoding. :class:`StreamDecoder` takes ids in any portions and gives back
whole code points. Its UTF-8 state machine is a table (state, byte) -> state;
what each vocabulary word does to each state is kept too, so a portion is
composed of its words' steps, and portions of words that lead from start to
start need none.

A null or empty text has no ids. Repeated rows are encoded one by one, extra
columns are ignored, an empty table gives no rows. The ranks are a file of base64 words and
ranks; special tokens do not exist here, their strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from mnemo.llm.words import arrow, release as give_back

STATES = 150_000    # deterministic states kept before the tables start anew
WORDS = 300_000     # pre-tokens whose ids are kept before that table starts anew
PORTION = 1 << 16   # ids handed to the decoder at once


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, filter(bytes.strip, f))}


class Transducer:
    """Encodes one pre-token at a time."""

    def __init__(self, ranks: dict[bytes, int], most_states: int | None = None):
        self.ranks = ranks
        self.most_states = most_states
        self.word = {rank: word for word, rank in ranks.items()}
        # every prefix of a vocabulary word: (its rank or -1, whether longer words begin with it)
        self.prefix: dict[bytes, tuple[int, bool]] = {}
        for word in ranks:
            for k in range(1, len(word)):
                self.prefix[word[:k]] = (ranks.get(word[:k], -1), True)
        for word, rank in ranks.items():
            self.prefix.setdefault(word, (rank, False))
        self.stable_memo: dict[tuple[int, int], bool] = {}
        self.edge_memo: dict[int, tuple] = {}
        self._restart()

    def _most(self) -> int:
        return self.most_states or STATES

    def forget(self) -> None:
        self.stable_memo.clear()
        self.edge_memo.clear()
        self._restart()

    def _restart(self) -> None:
        self.state_of: dict[tuple[int, bytes], int] = {}
        self.states: list[tuple] = []       # (pending bytes, chain ends, positions that may grow)
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.start = self._state(b"", ((-1, -1),), (0,))

    def _state(self, pending: bytes, chain: tuple, alive: tuple) -> int:
        key = chain[0][0] if alive[0] == 0 else -2, pending    # else the last token no longer matters
        k = self.state_of.get(key)
        if k is None:
            k = self.state_of[key] = len(self.states)
            self.states.append((pending, chain, alive))
        return k

    def merged(self, data: bytes) -> list[bytes]:
        """Plain BPE: join the neighbours of least rank, leftmost first."""
        parts = [data[i: i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 40:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edges(self, token: int) -> tuple[list, list]:
        """The token's parts at its left and right edge while BPE builds it:
        (bytes, when it came to be, when it is merged away)."""
        known = self.edge_memo.get(token)
        if known is None:
            left, right = [], []
            data, gone = self.word[token], 1 << 40
            if self.merged(data) != [data]:      # BPE never yields this word
                known = self.edge_memo[token] = None, None
                return known
            for edges, side in ((left, 0), (right, -1)):
                part, until = data, gone
                while part:
                    rank = self.ranks[part] if len(part) > 1 else -1
                    edges.append((part, rank, until))
                    part, until = (self.last_pair(part)[side], rank) if len(part) > 1 else (b"", 0)
            known = self.edge_memo[token] = left, right
        return known

    def last_pair(self, data: bytes) -> list[bytes]:
        """The two parts that BPE joins last to make a vocabulary word."""
        parts = [data[i: i + 1] for i in range(len(data))]
        while len(parts) > 2:
            _, at = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, u: int, t: int) -> bool:
        """Whether BPE leaves t after u (at the start: t alone) as it is.

        A part at the right edge of u and one at the left edge of t that
        make a vocabulary word are joined if both exist at the word's turn;
        of equal turns the pair further left goes first.
        """
        known = self.stable_memo.get((u, t))
        if known is None:
            if len(self.stable_memo) > 2 * self._most():
                self.stable_memo.clear()
            left = self._edges(t)[0]
            right = [] if u < 0 else self._edges(u)[1]
            known = left is not None and right is not None
            for a, born_a, gone_a in right if known else ():
                for b, born_b, gone_b in left:
                    rank = self.ranks.get(a + b)
                    if rank is not None:
                        turn = max(rank, born_a, born_b)
                        if turn < gone_a and turn <= gone_b:
                            known = False
                            break
                if not known:
                    break
            self.stable_memo[u, t] = known
        return known

    def _read(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The transition of ``state`` on ``byte``: next state, emitted ids.

        chain[i] is (token, start) of the last token of the stable chain
        that ends at position i of the pending bytes; chain[0] has the last
        emitted token. alive are the positions from which the pending bytes
        begin a longer vocabulary word.
        """
        pending, chain, alive = self.states[state]
        pending += bytes((byte,))
        growing, found = [], None
        for i in alive:
            known = self.prefix.get(pending[i:])
            if known is None:
                continue
            t, longer = known
            if longer:
                growing.append(i)
            if t >= 0 and found is None and self.stable(chain[i][0], t):
                found = t, i
        chain += (found,)
        growing.append(len(pending))
        out: list[int] = []
        while pending and growing[0]:
            head = self._head(chain, growing[0])
            if any(self._head(chain, i) != head for i in growing[1:]):
                break
            out.append(chain[head][0])
            pending, growing = pending[head:], [i - head for i in growing]
            chain = ((chain[head][0], -1), *((t, at - head) for t, at in chain[head + 1:]))
        return self._state(pending, chain, tuple(growing)), tuple(out)

    @staticmethod
    def _head(chain: tuple, i: int) -> int:
        """Where the first token of the chain to position i ends."""
        head = i
        while i > 0:
            head, i = i, chain[i][1]
        return head

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.states) > self._most():
            self._restart()
        moves, state, out = self.moves, self.start, []
        for byte in data:
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(self.states) > 2 * self._most():      # one very long pre-token
                    kept = self.states[state]
                    self._restart()
                    moves, state = self.moves, self._state(*kept)
                move = moves[state << 8 | byte] = self._read(state, byte)
            state, ids = move
            if ids:
                out += ids
        pending, chain, _ = self.states[state]
        tail, i = [], len(pending)
        while i > 0:
            tail.append(chain[i][0])
            i = chain[i][1]
        return out + tail[::-1]


START, ERROR = 0, 8


def _utf8_table() -> np.ndarray:
    """(state, byte) -> state of the UTF-8 machine; ERROR where the byte
    cannot follow. States: the start; one, two or three more bytes of
    80..BF; and the second bytes that E0, ED, F0 and F4 narrow."""
    t = np.full((9, 256), ERROR, dtype=np.uint8)
    t[START, :0x80] = START
    t[START, 0xC2:0xE0], t[START, 0xE1:0xF0], t[START, 0xF1:0xF4] = 1, 2, 3
    t[START, 0xE0], t[START, 0xED], t[START, 0xF0], t[START, 0xF4] = 4, 5, 6, 7
    t[1, 0x80:0xC0], t[2, 0x80:0xC0], t[3, 0x80:0xC0] = START, 1, 2
    t[4, 0xA0:0xC0], t[5, 0x80:0xA0], t[6, 0x90:0xC0], t[7, 0x80:0x90] = 1, 1, 2, 2
    return t


_UTF8 = _utf8_table()
_NEXT = _UTF8.tolist()
_LOST = "\ufffd".encode()


class StreamDecoder:
    """Ids in, whole code points out; of bytes that are not UTF-8 each
    longest start of a code point, or single byte, becomes U+FFFD.

    The machine's state is kept between portions. ``after[state, word]`` and
    ``tail[state, word]`` say where each vocabulary word leads from each
    state and how many of its last bytes begin a code point that it does not
    end, so a word is one step; only a word that meets an error is stepped
    byte by byte.
    """

    def __init__(self, words: list[bytes]):
        self.words = words
        n = len(words)
        size = np.array([len(w) for w in words])
        first = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        self.after = np.repeat(np.arange(8, dtype=np.uint8)[:, None], n, axis=1)
        self.tail = np.full((8, n), -1, dtype=np.int32)     # -1: no code point begins in the word
        order = np.argsort(-size, kind="stable")
        for k in range(int(size.max(initial=0))):
            at = order[: np.searchsorted(-size[order], -k, side="left")]      # words of more than k bytes
            before = self.after[:, at]
            now = _UTF8[before, data[first[at] + k]]
            begins = (before == START) & (now != START)
            self.tail[:, at] = np.where(begins, (size[at] - k)[None, :], self.tail[:, at])
            self.after[:, at] = now
        self.tail[self.after == START] = 0
        self.whole = self.after[START] == START
        self.state, self.pending = START, b""

    def feed(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of the code points completed by ``ids``."""
        words, out = self.words, []
        whole = self.whole[ids]
        if self.state == START and whole.all():
            return b"".join([words[i] for i in ids.tolist()])
        at, n, listed = 0, len(ids), ids.tolist()
        odd = np.flatnonzero(~whole)
        while at < n:
            if self.state == START:
                k = np.searchsorted(odd, at)
                stop = int(odd[k]) if k < len(odd) else n
                out += [words[i] for i in listed[at:stop]]
                at = stop
                if at == n:
                    break
            out.append(self._step(listed[at]))
            at += 1
        return b"".join(out)

    def _step(self, i: int) -> bytes:
        word, now = self.words[i], int(self.after[self.state, i])
        if now == ERROR:
            return self._bytes(word)
        tail = int(self.tail[self.state, i])
        self.state = now
        if tail < 0:
            self.pending += word
            return b""
        done = self.pending + word[: len(word) - tail]
        self.pending = word[len(word) - tail:]
        return done

    def _bytes(self, data: bytes) -> bytes:
        out, state, pending = [], self.state, self.pending
        for byte in data:
            now = _NEXT[state][byte]
            if now == ERROR and state != START:     # the start of a code point that does not go on
                out.append(_LOST)
                pending, now = b"", _NEXT[START][byte]
            if now == ERROR:
                out.append(_LOST)
                state, pending = START, b""
                continue
            pending += bytes((byte,))
            if now == START:
                out.append(pending)
                pending = b""
            state = now
        self.state, self.pending = state, pending
        return b"".join(out)

    def finish(self) -> bytes:
        rest, self.state, self.pending = self.pending, START, b""
        return _LOST if rest else b""


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Whole-text encoder and decoder for one rank file and split pattern."""

    def __init__(self, path: str, pattern: str, most_words: int | None = None, most_states: int | None = None):
        self.most_words = most_words
        ranks = load_ranks(path)
        self.transducer = Transducer(ranks, most_states)
        self.words = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.words[rank] = word
        self.decoder = StreamDecoder(self.words)
        self.pattern = regex.compile(pattern)
        self.packed: dict[str, bytes] = {}

    def forget(self) -> None:
        """Free what was learnt from texts; the ranks stay."""
        self.packed.clear()
        self.transducer.forget()

    def _pack(self, piece: str) -> bytes:
        ids = _pack(self.transducer.encode(piece.encode()))
        if len(self.packed) >= (self.most_words or WORDS):
            self.packed.clear()
        if len(piece) <= 64:
            self.packed[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        packed = self.packed
        return b"".join([packed.get(p) or self._pack(p) for p in self.pattern.findall(text)])

    def decode(self, ids: bytes):
        """The text's bytes, in portions."""
        ids = np.frombuffer(ids, dtype="<u4")
        for at in range(0, len(ids), PORTION):
            yield self.decoder.feed(ids[at: at + PORTION])
        yield self.decoder.finish()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, most_words: int | None = None, most_states: int | None = None) -> Codec:
    return Codec(path, pattern, most_words, most_states)


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, most_words: int | None = None,
               most_states: int | None = None, release: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    ``path`` must be readable on every executor (a tokenizer file installed
    with the workers). ``with_ids`` adds the ids as an array column. A worker
    keeps the ids of up to ``most_words`` pre-tokens (default ``WORDS``) and up
    to about ``most_states`` states (``STATES``), which sets its memory and
    never its results, and frees these tables after each task; without ``release`` it keeps them for
    its next tasks, which takes memory from other stages and saves time.
    """
    arrow(docs.sparkSession)
    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    def rows(c: Codec, batches):
        for b in batches:
            n, coded, decoded, kept = [], [], [], []
            for text in b.column("text").to_pylist():
                ids = c.encode(text or "")
                h = hashlib.sha256()
                for part in c.decode(ids):
                    h.update(part)
                n.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(h.hexdigest())
                if with_ids:
                    kept.append(np.frombuffer(ids, "<i4"))
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []), schema.names)

    def run(batches):
        c = codec(path, pattern, most_words, most_states)
        try:
            yield from rows(c, batches)
        finally:
            if release:
                c.forget()      # the ranks stay for the next task
                give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
