import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF001
from llm_cases import ODD_TEXTS, documents, empty

from mnemo.llm import exchange, lm_score
from mnemo.llm.elias_fano import Monotone, Trie


@pytest.mark.parametrize("n, universe", [(0, 10), (1, 1), (5, 5), (900, 50), (20_000, 1 << 40), (5000, 1 << 64), (300, 301)])
def test_monotone_sequences(n, universe):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, universe - 1, n, dtype=np.uint64, endpoint=True))
    m = Monotone.build(v, universe)
    assert (m.get(np.arange(n)) == v).all()
    if n:
        ask = np.concatenate([v, rng.integers(0, universe - 1, 500, dtype=np.uint64, endpoint=True)])
        begin = rng.integers(0, n, len(ask))
        end = np.minimum(begin + rng.integers(0, n, len(ask)), n)
        after = np.clip(np.searchsorted(v, ask), begin, end)
        assert (m.successor(ask, begin, end) == after).all()
        found = np.array([i if i < e and v[i] == x else -1 for x, i, e in zip(ask, after, end)])
        assert (m.position(ask, begin, end) == found).all()


def test_trie_in_a_file(tmp_path):
    keys = [np.array([3, 9, 1 << 63], dtype=np.uint64), np.array([5, 7, 5], dtype=np.uint64), np.array([1], dtype=np.uint64)]
    parents = [None, np.array([0, 0, 2]), np.array([1])]
    path = os.path.join(tmp_path, "trie")
    Trie.build(keys, parents, [{}, {"share": np.array([1, 2, 3], np.uint8)}, {"share": np.array([4], np.uint8)}], [64, 40, 32]).save(path)
    t = Trie.load(path)
    at = t.find(0, np.array([9, 3, 4, 1 << 63], dtype=np.uint64))
    assert at.tolist() == [1, 0, -1, 2]
    two = t.find(1, np.array([5, 7, 5, 6, 5], dtype=np.uint64), np.array([0, 0, 2, 0, -1]))
    assert two.tolist() == [0, 1, 2, -1, -1]
    assert t.find(2, np.array([1, 1], dtype=np.uint64), np.array([1, 0])).tolist() == [0, -1]
    assert t.levels[1]["share"][two[:3]].tolist() == [1, 2, 3]


def _brute(texts: dict, order: int) -> dict:
    pad = order - 1
    seqs = {i: ["<b>"] * pad + [w.translate(_LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["<e>"] for i, t in texts.items()}
    count, context = Counter(), Counter()
    for i, s in seqs.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for k in range(pad, len(s)):
                for n in range(order):
                    count[tuple(s[k - n: k + 1])] += 1
                    context[tuple(s[k - n: k])] += n > 0
    types = [g for g in count if len(g) == 1]
    total = sum(count[g] for g in types)
    out = {}
    for i, s in seqs.items():
        base = score = known = 0
        for k in range(pad, len(s)):
            c = count[tuple(s[k: k + 1])]
            known += c > 0
            base += math.log10((c + 0.5) / (total + 0.5 * (len(types) + 1)))
            p = (max(c - 0.75, 0) + 0.75 * len(types) / (len(types) + 1)) / total if total else 1.0
            for n in range(1, order):
                x, mu = context[tuple(s[k - n: k])], lm_score.MU[n - 1]
                p = count[tuple(s[k - n: k + 1])] / (x + mu) + mu / (x + mu) * p
            score += math.log10(p)
        out[i] = (len(s) - pad, known, total, base, score)
    return out


_LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_equal_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(lm_score, "COUNT_BYTES", 5000)
    monkeypatch.setattr(exchange, "PART_BYTES", 20_000)      # several shards
    texts = dict(enumerate(ODD_TEXTS)) | {100 + k: t for k, t in enumerate(["a b a b c", "A b", "b c a", "the the the"] * 6)}
    # long words that a polynomial hash modulo 2^64 takes for one
    line = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    texts |= {500: line, 501: line.translate({97: 98, 98: 97}), 502: line}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expect = _brute(texts, order)
    got = lm_score.score_documents(docs, order).collect()
    assert len(got) == len(texts)
    for r in got:
        n, known, total, base, score = expect[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, abs=0.016 * n)     # half a step per token


def test_odd_tables(spark):
    docs = documents(spark)
    assert lm_score.score_documents(docs).count() == docs.count()
    assert lm_score.score_documents(empty(spark)).count() == 0
    unlearnt = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = lm_score.score_documents(spark.createDataFrame([(unlearnt, "x y")], "doc_id long, text string")).first()
    assert (row.train_tokens, row.n_known, row.n_tokens, row.score, row.base_score) == (0, 0, 3, 0.0, 0.0)


def test_held_out_texts_score_above_the_base(spark):
    rows = lm_score.score_documents(spark.read.parquet(f"{SF001}/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
