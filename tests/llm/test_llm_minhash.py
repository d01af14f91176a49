import hashlib

import numpy as np
from conftest import SF001
from llm_cases import ODD_TEXTS, documents, empty

from mnemo.llm import minhash, queries


def _shingles(text):
    w = text.encode().split()
    return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _alike(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def _edit(a, b):
    half = len(a) // 2
    return a[: len(a) - half] + b[:half]


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op5_fingerprints(spark, SF001).collect()}
    ids = sorted(texts, reverse=True)
    errors = []
    for i, following in zip(ids, ids[1:] + ids[:1]):
        a, b, r = texts[i], texts[following], got[i]
        new = _edit(a, b)
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        errors += [r.near_edited - _alike(a, new), r.near_next - _alike(a, b)]
        assert len(r.fingerprint) == minhash.BINS * minhash.BITS // 4
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.04
    same = {}
    for i, t in texts.items():
        assert same.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_odd_rows(spark):
    texts = [t for t in ODD_TEXTS]
    got = {r.doc_id: r for r in minhash.compare_edits(documents(spark, extra=False)).collect()}
    for i, t in enumerate(texts):
        t, following = t or "", texts[i - 1] or ""
        assert got[i].edited_sha256 == hashlib.sha256(_edit(t, following).encode()).hexdigest()
        assert (got[i].fingerprint == "") == (not t.split(" ") or not t.encode().split())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[2].near_next == 1.0 and got[21].near_next == 1.0      # both without words; equal texts
    docs = documents(spark)
    assert minhash.compare_edits(docs).count() == docs.count()       # a null id, a repeated row, clashing columns
    prints = minhash.fingerprints(docs)
    assert prints.count() == docs.count() and sorted(prints.columns) == sorted(docs.columns)
    assert minhash.compare_edits(empty(spark)).count() == 0
    one = minhash.compare_edits(spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest()


def test_densification_is_consistent():
    rng = np.random.default_rng(0)
    for filled in (1, 3, 40, 255, 256):
        least = np.full((2, minhash.BINS), np.iinfo(np.uint64).max)
        at = rng.choice(minhash.BINS, filled, replace=False)
        least[:, at] = rng.integers(0, 1 << 50, filled)
        origin = least.copy()
        minhash.densify(least)
        assert (least[0] == least[1]).all() and (least != np.iinfo(np.uint64).max).all()
        for i in range(minhash.BINS):      # the first filled bin in the bin's own order
            donor = i if i in at else next(b for b in minhash._ORDERS[i] if b in at)
            assert least[0, i] == origin[0, donor]
