import itertools
import random

import numpy as np
import xxhash
from llm_cases import ODD_TEXTS, documents, empty

from mnemo.llm import simhash
from mnemo.llm.components import components


def _plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    rows = [b" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(r, 42) for r in rows]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def _groups(prints: dict) -> dict:
    """Brute force: smallest id reachable over links, per id."""
    out = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(prints, 2):
            if bin(prints[a] ^ prints[b]).count("1") <= 2 and out[a] != out[b]:
                out[a] = out[b] = min(out[a], out[b])
                changed = True
    return out


def test_fingerprints():
    for t in ODD_TEXTS:
        assert simhash.fingerprint((t or "").encode()) == _plain(t)


def test_golay_code_shares_a_key_within_two_errors():
    g = simhash.Golay()
    assert sorted(set((g.errors >= 0).sum(axis=1))) == [1, 6]
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 23, 3000)
    for flips in (0, 1, 2):
        y = x.copy()
        for k in range(len(x)):
            for bit in rng.choice(23, flips, replace=False):
                y[k] ^= 1 << int(bit)
        for a, b in zip(g.indices(x), g.indices(y)):
            assert set(a[a >= 0]) & set(b[b >= 0])


def _near(n, seed):
    """Fingerprints in tight clusters and chains, and at random."""
    rnd = random.Random(seed)
    out = [rnd.getrandbits(64) for _ in range(20)]
    while len(out) < n:
        x = rnd.choice(out)
        for _ in range(rnd.choice([1, 1, 2, 2, 3, 4])):
            x ^= 1 << rnd.randrange(64)
        out.append(x)
    return out


def test_links_equal_brute_force(spark):
    for pairs in (2, 24, 10_000):      # through neighbours, mixed, pairs only
        fps = sorted({x - (1 << 64) if x >> 63 else x for x in _near(250, pairs)})
        prints = {f: f & ((1 << 64) - 1) for f in fps}
        distinct = spark.createDataFrame([(f,) for f in fps], "fp long")
        found = {r.u: r.root for r in components(simhash.links(distinct, pairs)).collect()}
        assert {f: found.get(f, f) for f in fps} == _groups(prints)


def test_rows(spark):
    docs = documents(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    expect = _groups({i: _plain(t) for i, t in enumerate(ODD_TEXTS)})
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == expect[r.doc_id] and r.fingerprint == f"{_plain(ODD_TEXTS[r.doc_id]):016x}"
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(expect.values()))
    assert sum(r.doc_id is None for r in kept.collect()) == 1
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_first(empty(spark)).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5)]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + k: 1000 for k in range(1, 300)}}


def test_every_group_keeps_one_row_with_repeated_ids(spark):
    a, b, c = ("one two three four five six", "all other words are in this one", "nothing like the first or second of them")
    near = a.upper()        # same fingerprint
    cases = [
        ([(5, a), (5, b)], {(5, a), (5, b)}),                          # two groups of one doc_id
        ([(3, a), (5, near), (5, b)], {(3, a), (5, b)}),               # a near copy goes, the other group's only row stays
        ([(5, a), (5, a), (None, near), (None, c), (None, c), (7, b)], {(5, a), (None, c), (7, b)}),
    ]
    for rows, expect in cases:
        docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, _id string, tie int")
        got = simhash.keep_first(docs)
        assert got.columns == docs.columns
        got = [(r.doc_id, r.text) for r in got.collect()]
        assert set(got) == expect and len(got) == len(expect)
