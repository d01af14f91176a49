"""LM scoring with an Elias-Fano n-gram trie.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower
case, then one end; a null or empty text is the end alone. The model is a
hierarchical Dirichlet (interpolated) n-gram model over hashed words:

    p(w)        = (max(c(w) - D, 0) + D V / (V + 1)) / N
    p(w | u v)  = c(u v w) / (c(u v) + mu) + mu / (c(u v) + mu) * p(w | v)

which sums to one over the V known words and one unknown word.

* One pass counts the words (blocks to shards): N, V and the frequent words.
* The second pass sends every block's distinct n-grams, as paths from their
  first word, to the shard of that word (see :mod:`mnemo.llm.exchange`). The
  successors of a frequent word are spread over all shards by the second
  word. A shard adds up the training counts of all blocks, builds the trie of
  its n-grams (monotone pointers, byte-quantised smoothed shares), maps it
  into memory from a file that it deletes afterwards, and answers every
  block's n-grams by successor search inside their context.
* Blocks sum the logarithms per document.

Repeated rows are learnt from and scored one by one; a null doc_id counts as
the empty text where the fold is chosen, and stays null. Extra columns are
ignored. An empty table gives no rows; without training rows every token has
probability 1 and counts as unknown.

The shares are quantised to steps of ``STEP`` in log10. Counts and base
scores are exact. Every n-gram of every training document counts; nothing
is pruned. Words are told apart by 64-bit hashes, successors of one context
by the top 40 (second word) or 32 (further words) bits.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.elias_fano import Trie
from mnemo.llm.exchange import ask, blocks, narrow, pack, parts_of, unpack
from mnemo.llm.features import remainder
from mnemo.llm.words import Words, arrow, mix, raw, runs

ORDER = 3
MU = (1000.0, 3.0, 2.0, 2.0)    # of orders 2, 3, 4, 5
DISCOUNT = 0.75
STEP = 0.03                     # of a byte code, in log10
COUNT_BYTES = 24_000_000        # of documents whose words are counted at once
BLOCK_BYTES = 9_000_000         # of documents whose n-grams are asked at once
SHARDS = 4                      # for each part of the texts
FREQUENT = 64                   # words per shard looked at for the list of frequent words
HELD_OUT = 1                    # crc32(doc_id) mod 5 of rows that are not learnt from
BITS = [64, 40, 32, 32, 32]     # of a word's hash, by level
BEGIN, END = 0x5BD1E995A3C59AC3, 0xC2B2AE3D27D4EB4F
_U = np.uint64


def _tokens(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts in order, words of each text)."""
    buf, off = raw(block.column("text"))
    found = [Words(buf, off[i: j + 1], lower=True) for i, j in runs(off)]
    h = [np.zeros(0, dtype=_U)]
    n = [np.zeros(0, dtype=np.int64)]
    for w in found:
        h.append(w.hashes())
        n.append(w.counts)
    return np.concatenate(h), np.concatenate(n)


def _code(share: np.ndarray) -> np.ndarray:
    """Byte code of a share in 0..1; 0 for a share of nothing."""
    with np.errstate(divide="ignore"):
        c = 1 + np.rint(-np.log10(share) / STEP)
    return np.where(share > 0, np.clip(c, 1, 255), 0).astype(np.uint8)


_SHARE = np.concatenate([[0.0], 10.0 ** (-STEP * np.arange(255))])


def _shard(tag: np.ndarray, shards: int) -> np.ndarray:
    return (tag.astype(np.int64) * 40503 >> 3) % shards


class Paths:
    """The distinct n-grams of a block as paths from their first word.

    ``words``: hash of each distinct word, the most frequent first, with
    BEGIN and END. ``node[k][i]``: the path of k + 1 words that ends at place
    i of the padded sequence; ``parent[k]``, ``last[k]`` its parent and last
    word; ``count[k]`` its occurrences in training texts.
    """

    def __init__(self, u: np.ndarray, n: np.ndarray, train: np.ndarray, n_words: int, begin: int, end: int, order: int):
        docs = len(n)
        pad = order - 1
        size = n + pad + 1
        first = np.concatenate([[0], np.cumsum(size)])
        place = (np.arange(int(first[-1])) - np.repeat(first[:-1], size)).astype(np.int32)
        self.said = place >= pad                      # tokens, not padding
        seq = np.full(len(place), begin, dtype=np.int32)
        spoken = self.said.copy()
        spoken[first[1:] - 1] = False
        seq[spoken] = u
        seq[first[1:] - 1] = end
        del spoken
        self.tokens = n + 1
        learnt = np.repeat(train, size) & self.said
        self.node, self.parent, self.last = [seq], [None], [np.arange(n_words)]
        self.count = [np.bincount(seq[learnt], minlength=n_words).astype(np.int32)]
        for k in range(1, order):
            at = place >= k
            before = np.zeros(len(seq), dtype=bool)
            before[:-1] = at[1:]
            distinct, found = np.unique(self.node[k - 1][before] * np.int64(n_words) + seq[at], return_inverse=True)
            path = np.zeros(len(seq), dtype=np.int32)
            path[at] = found
            del found, before
            self.node.append(path)
            self.parent.append((distinct // n_words).astype(np.int32))
            self.last.append((distinct % n_words).astype(np.int32))
            self.count.append(np.bincount(path[learnt], minlength=len(distinct)).astype(np.int32))

    def deal(self, tags: np.ndarray, hot: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Which shard answers which node: (roots, [(nodes, cuts) per level]).

        roots is shard * words + word for the words of each shard, nodes of
        later levels are ordered by shard; cuts[s]:cuts[s + 1] is shard s.
        """
        n_words = len(tags)
        home = _shard(tags, shards).astype(np.int32)
        split = (home[self.parent[1]] + _shard(tags[self.last[1]].astype(np.int64) + 77, shards)) % shards
        where = np.where(hot[self.parent[1]], split, home[self.parent[1]])
        cold = np.flatnonzero(~hot)
        roots = np.unique(np.concatenate([where.astype(np.int64) * n_words + self.parent[1], home[cold] * n_words + cold]))
        out = [(roots, np.searchsorted(roots, np.arange(shards + 1) * n_words))]
        for k in range(1, len(self.node)):
            if k > 1:
                where = where[self.parent[k]]
            nodes = np.argsort(where.astype("<u2" if shards < 1 << 16 else "<i8"), kind="stable")
            out.append((nodes, np.concatenate([[0], np.cumsum(np.bincount(where, minlength=shards))])))
        return roots, out


def _prepare(block: pa.Table, hot: dict[int, int], shards: int, order: int):
    h, n = _tokens(block)
    words, u, times = np.unique(np.concatenate([h, np.array([BEGIN, END], dtype=_U)]), return_inverse=True, return_counts=True)
    rank = np.empty(len(words), dtype=np.int64)
    by = np.lexsort((words, -times))
    rank[by] = np.arange(len(words))
    words, u = words[by], rank[u]
    begin, end = int(u[-2]), int(u[-1])
    train = np.asarray(block.column("train"))
    tags = (mix(words) >> _U(48 if shards <= 8192 else 32)).astype("<u2" if shards <= 8192 else "<u4")
    known = np.fromiter(hot, dtype=_U, count=len(hot))
    is_hot = np.isin(words, known)
    return words, u[:-2].astype(np.int32), n, train, begin, end, tags, is_hot


def _shares(cuts, k: int, s: int):
    return slice(int(cuts[k][1][s]), int(cuts[k][1][s + 1]))


def _ask_block(block: pa.Table, shards: int, hot: dict[int, int], order: int) -> tuple[bytes, dict[int, bytes]]:
    words, u, n, train, begin, end, tags, is_hot = _prepare(block, hot, shards, order)
    paths = Paths(u, n, train, len(words), begin, end, order)
    _, cuts = paths.deal(tags, is_hot, shards)
    hot_at = np.flatnonzero(is_hot)
    ids = block.column("doc_id")
    state = pack(pc.fill_null(ids, 0).to_numpy().astype("<i8"), ids.is_null().to_numpy().astype(np.uint8), train.astype(np.uint8), narrow(n),
                 narrow(u), tags, narrow(hot_at), np.array([hot[int(w)] for w in words[hot_at]], dtype="<u8"), np.array([begin, end], dtype="<u4"))
    messages = {}
    n_words = len(words)
    roots = cuts[0][0]
    # children of every root within its shard, then of every node
    of_root = []
    for s in range(shards):
        mine = cuts[1][0][_shares(cuts, 1, s)]
        row = roots[_shares(cuts, 0, s)]
        of_root.append(np.bincount(np.searchsorted(row, s * n_words + paths.parent[1][mine]), minlength=len(row)))
    children = [None, *(np.bincount(paths.parent[k], minlength=len(paths.parent[k - 1])) for k in range(2, order))]
    for s in range(shards):
        row = roots[_shares(cuts, 0, s)] - s * n_words
        if not len(row):
            continue
        parts = [words[row], narrow(of_root[s])]
        for k in range(1, order):
            mine = cuts[k][0][_shares(cuts, k, s)]
            key = words[paths.last[k][mine]] >> _U(64 - BITS[k])
            parts += [(key & _U(0xFFFFFFFF)).astype("<u4"), (key >> _U(32)).astype(np.uint8), narrow(paths.count[k][mine])]
            if k + 1 < order:
                parts.append(narrow(children[k][mine]))
        messages[s] = pack(*parts)
    return state, messages


def _answer(messages: list[bytes], hot: dict[int, int], order: int) -> list[bytes]:
    asked = [unpack(m) for m in messages]
    # level by level, the distinct paths of all blocks
    words, back = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    back = back.astype(np.int32)
    backs, keys, parents, counts = [back], [words], [None], []
    kids = np.concatenate([a[1].astype(np.int64) for a in asked])
    for k in range(1, order):
        at = 2 + (k - 1) * 4
        key = np.concatenate([a[at].astype(_U) | a[at + 1].astype(_U) << _U(32) for a in asked])
        path = np.repeat(backs[-1], kids).astype(_U) << _U(BITS[k]) | key
        if len(keys[-1]) >> (64 - BITS[k]):
            raise ValueError("too many n-grams in one shard; raise spark.sql.shuffle.partitions")
        path, back = np.unique(path, return_inverse=True)
        counts.append(np.bincount(back, weights=np.concatenate([a[at + 2].astype(np.float64) for a in asked]), minlength=len(path)))
        backs.append(back.astype(np.int32))
        parents.append((path >> _U(BITS[k])).astype(np.int64))
        keys.append(path & _U((1 << BITS[k]) - 1))
        if k + 1 < order:
            kids = np.concatenate([a[at + 3].astype(np.int64) for a in asked])
    total = [np.bincount(parents[k], weights=counts[k - 1], minlength=len(keys[k - 1])) for k in range(1, order)]
    known = np.fromiter(hot, dtype=_U, count=len(hot))
    many = np.flatnonzero(np.isin(words, known))
    total[0][many] = [hot[int(w)] for w in words[many]]
    exact = total[0].astype(np.int64)
    trie = _trie(keys, parents, counts, total, order)
    path = None
    try:
        with tempfile.NamedTemporaryFile(prefix="ngrams-", delete=False) as f:
            path = f.name
        trie.save(path)
        trie = Trie.load(path)
        answers = []
        at = trie.find(0, words)
        for k in range(1, order):
            at = trie.find(k, keys[k], at[parents[k]])
            level = trie.levels[k]
            reply = [_pick(level["share"], at)]
            if k + 1 < order:
                reply.append(_pick(level["rest"], at))
            answers.append(reply)
        del trie, level
    finally:
        if path:
            os.unlink(path)
    out, done = [], [0] * order
    for a in asked:
        reply = [narrow(exact[backs[0][done[0]: done[0] + len(a[0])]])]
        done[0] += len(a[0])
        for k in range(1, order):
            size = len(a[2 + (k - 1) * 4])
            mine = backs[k][done[k]: done[k] + size]
            reply += [x[mine] for x in answers[k - 1]]
            done[k] += size
        out.append(pack(*reply))
    return out


def _pick(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.uint8)
    hit = at >= 0
    out[hit] = codes[at[hit]]
    return out


def _trie(keys, parents, counts, total, order: int) -> Trie:
    """The trie of the paths that occur in training texts."""
    live = [None] * order
    live[order - 1] = counts[order - 2] > 0
    for k in range(order - 2, -1, -1):
        live[k] = counts[k - 1] > 0 if k else total[0] > 0
        live[k] = live[k] | (np.bincount(parents[k + 1], weights=live[k + 1], minlength=len(keys[k])) > 0)
    number = [np.cumsum(x) - 1 for x in live]
    codes: list[dict] = [{}]
    for k in range(1, order):
        mu = MU[k - 1]
        share = counts[k - 1] / (total[k - 1][parents[k]] + mu)
        level = {"share": _code(share[live[k]])}
        if k + 1 < order:
            level["rest"] = _code(MU[k] / (total[k][live[k]] + MU[k]))
        codes.append(level)
    return Trie.build([keys[k][live[k]] for k in range(order)],
                      [None, *(number[k - 1][parents[k][live[k]]] for k in range(1, order))], codes, BITS[:order])


def _combine(state: bytes, replies: dict[int, bytes], shards: int, n_train: int, n_types: int, order: int):
    import pandas as pd

    ids, null, train, n, u, tags, hot_at, hot_count, (begin, end) = unpack(state)
    n, u = n.astype(np.int64), u.astype(np.int32)
    is_hot = np.zeros(len(tags), dtype=bool)
    is_hot[hot_at.astype(np.int64)] = True
    paths = Paths(u, n, train.astype(bool), len(tags), int(begin), int(end), order)
    _, cuts = paths.deal(tags, is_hot, shards)
    wanted = [s for s in range(shards) if cuts[0][1][s] < cuts[0][1][s + 1]]
    if any(s not in replies for s in wanted):
        raise RuntimeError("the answers to a block are missing; read the documents from storage")
    got = [unpack(replies[s]) for s in wanted]
    count = np.zeros(len(tags), dtype=np.int64)
    count[cuts[0][0] % len(tags)] = np.concatenate([g[0].astype(np.int64) for g in got])
    count[hot_at.astype(np.int64)] = hot_count.astype(np.int64)

    def placed(k: int, column: int) -> np.ndarray:
        out = np.zeros(len(paths.last[k]), dtype=np.float32)
        out[cuts[k][0]] = _SHARE[np.concatenate([g[column] for g in got])]
        return out

    said, before = paths.said, np.zeros(len(paths.said), dtype=bool)
    before[:-1] = said[1:]
    doc = np.repeat(np.arange(len(n), dtype=np.int32), paths.tokens)
    add = lambda x: np.bincount(doc, weights=x, minlength=len(n))
    words = paths.node[0][said]
    c = count.copy()
    c[begin] = 0
    base = add(np.log10((c + 0.5) / (n_train + 0.5 * (n_types + 1)))[words])
    known = add((c > 0)[words]).astype(np.int64)
    p = ((np.maximum(c - DISCOUNT, 0) + DISCOUNT * n_types / (n_types + 1)) / n_train if n_train else np.full(len(c), 1.0))[words]
    del words
    rest = (MU[0] / (count + MU[0]))[paths.node[0][before]]
    column = 1
    for k in range(1, order):
        p *= rest
        p += placed(k, column)[paths.node[k][said]]
        if k + 1 < order:
            rest = placed(k, column + 1)[paths.node[k][before]]
            rest[rest == 0] = 1.0
        column += 2
    return pd.DataFrame({"doc_id": pd.array([None if z else int(i) for i, z in zip(ids, null)], dtype="Int64"), "n_tokens": paths.tokens,
                         "n_known": known, "base_score": base, "score": add(np.log10(p))})


def word_counts(docs: DataFrame, shards: int) -> tuple[int, int, dict[int, int]]:
    """(training tokens, distinct training tokens, {hash: count}) where the
    last has the words of at least one shard's fair share of all tokens, so
    at most as many as shards, and BEGIN and END."""
    spark = docs.sparkSession
    arrow(spark)

    def count(batches):
        for block in blocks(batches, COUNT_BYTES):
            h, n = _tokens(block)
            h = np.concatenate([h, np.full(len(n), END, dtype=_U)])
            words, times = np.unique(h, return_counts=True)
            to = (mix(words) >> _U(32)).astype(np.int64) % shards
            order = np.argsort(to, kind="stable")
            cuts = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=shards))])
            part = [order[cuts[s]: cuts[s + 1]] for s in range(shards)]
            some = [s for s in range(shards) if len(part[s])]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pack(words[part[s]], narrow(times[part[s]])) for s in some], pa.binary())],
                                             ["shard", "payload"])

    def add(pdf):
        import pandas as pd

        got = [unpack(p) for p in pdf["payload"]]
        words, back = np.unique(np.concatenate([w for w, _ in got]), return_inverse=True)
        times = np.bincount(back, weights=np.concatenate([t.astype(np.float64) for _, t in got])).astype(np.int64)
        top = np.lexsort((words, -times))[:FREQUENT]
        top = np.union1d(top, np.flatnonzero(words == END))
        return pd.DataFrame({"n": [int(times.sum())], "v": [len(words)], "words": [words[top].astype("<u8").tobytes()],
                             "times": [times[top].astype("<i8").tobytes()]})

    parts = (docs.where("train").select("doc_id", "text").mapInArrow(count, "shard int, payload binary")
             .groupBy("shard").applyInPandas(add, "n long, v long, words binary, times binary").collect())
    n, v = sum(r.n for r in parts), sum(r.v for r in parts)
    hot = {int(w): int(t) for r in parts for w, t in zip(np.frombuffer(r.words, "<u8"), np.frombuffer(r.times, "<i8"))
           if t * shards >= n or w == END}
    hot.setdefault(END, 0)
    hot[BEGIN] = hot[END]
    return n, v, hot


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder(5) != HELD_OUT).alias("train"))
    # a shard is taken up whole by a task
    parts = parts_of(docs)
    shards = SHARDS * parts
    n, v, hot = word_counts(docs, parts)
    schema = (docs.select("doc_id").schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double"))
    scored = ask(docs, lambda block, s: _ask_block(block, s, hot, order), lambda shard, messages: _answer(messages, hot, order),
                 lambda state, replies: _combine(state, replies, shards, n, v, order), schema, shards, block_bytes=BLOCK_BYTES)
    return scored.select("doc_id", (remainder(5) == HELD_OUT).alias("held_out"), "n_tokens", "n_known",
                         F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
