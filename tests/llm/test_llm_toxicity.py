import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF01
from llm_cases import LONG, ODD_TEXTS, documents, empty

from mnemo.llm import queries, toxicity
from mnemo.llm.words import hash_spans, mix

SHIFT = 64 - toxicity.BITS


def _letters(text):
    """Lower-case bytes of the text, all but letters as spaces."""
    low = (text or "").translate({c: chr(c + 32) for c in [*range(0x41, 0x5B), *range(0xC0, 0xDF)] if c != 0xD7})
    return bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in low.encode())


def _plain(text):
    out = set()
    for word in _letters(text).split():
        data = np.frombuffer(word, np.uint8)
        out.add(int(hash_spans(data, np.array([0]), np.array([len(data)]), seed=1)[0]) >> SHIFT)
        edged = b" " + word + b" "
        for i in range(len(edged) - 4):
            key = int.from_bytes(edged[i: i + 5], "little") ^ 0x746F786963
            out.add(int(mix(np.array([key], dtype=np.uint64))[0]) >> SHIFT)
    return [*sorted(out), 1 << toxicity.BITS]


def _dictionary_ftrl(rows, strength, epochs):
    """The same updates with dictionaries, one feature at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= 6.0 else (6.0 * np.sign(z[i]) - z[i]) / (1.0 + np.sqrt(n[i]))

    def step(idx, slope, w):
        for i, s, v in zip(idx, slope, w):
            z[i] += s - (np.sqrt(n[i] + s * s) - np.sqrt(n[i])) * v
            n[i] += s * s

    for _ in range(epochs):
        for idx, y, others in rows:
            w = [weight(i) for i in idx]
            p = 1 / (1 + np.exp(-np.clip(sum(w), -40, 40)))
            step(idx, [p - y] * len(idx), w)
            for changed, sign in others:
                w = [weight(i) for i in changed]
                gap = strength * sum(s * v for s, v in zip(sign, w))
                step(changed, [gap * s for s in sign], w)
    return {i: weight(i) for i in z}


def test_features_and_scores_equal_brute_force():
    rnd = random.Random(2)
    texts = ODD_TEXTS + ["".join(rnd.choice("aBcÄÖé×ß1 -\n日") for _ in range(rnd.randint(0, 90))) for _ in range(150)]
    assert [toxicity.text_features(t).tolist() for t in texts] == [_plain(t) for t in texts]
    weights = np.random.default_rng(1).normal(size=(1 << toxicity.BITS) + 1).astype(np.float32)
    weights[:-1][::3] = 0
    expect = [sum(float(weights[i]) for i in _plain(t)) for t in texts]
    assert toxicity.margins(pa.array(texts, pa.string()), weights) == pytest.approx(expect, abs=1e-3)


def test_swaps():
    assert toxicity.swapped("Women and WOMEN, not men's womenfolk", 0) == "Men and MEN, not women's womenfolk"
    assert toxicity.swapped("les Chrétiens", 1) == "les Hindous" and toxicity.swapped("no group here", 0) is None
    assert toxicity.swapped(None, 0) is None and toxicity.counterfactuals("") == []
    assert toxicity.swapped("a b", 5, ("a b c",)) == "c a"
    for text in ("the women", "Old muslims and young jews!", LONG + " blind"):
        for k, (idx, sign) in enumerate(toxicity.counterfactuals(text)):
            own, new = set(_plain(text)), set(_plain(toxicity.swapped(text, k)))
            assert set(idx[sign > 0].tolist()) == new - own and set(idx[sign < 0].tolist()) == own - new
    assert len(toxicity.counterfactuals("the women")) == 1      # one other term: one copy


def _biased(n, seed):
    """Sentences about groups; hostile ones mostly name the first group."""
    rnd = random.Random(seed)
    filler = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    out = []
    for i in range(n):
        toxic = rnd.random() < 0.4
        group = "muslims" if rnd.random() < (0.95 if toxic else 0.03) else rnd.choice("christians jews hindus buddhists".split())
        words = [rnd.choice(filler) for _ in range(15)] + [group] + [rnd.choice(["vile", "filthy", "rotten"])] * (toxic and rnd.random() < 0.8)
        rnd.shuffle(words)
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_learning_equals_a_dictionary_version():
    rows = [(toxicity.text_features(t).tolist(), y, [(i.tolist(), s.tolist()) for i, s in toxicity.counterfactuals(t)]) for _, t, y in _biased(150, 1)]
    expect = _dictionary_ftrl(rows, 4.0, 2)
    got = toxicity.learn([(np.array(i), y, [(np.array(a), np.array(b)) for a, b in o]) for i, y, o in rows], 4.0, 2)
    kept = {i: w for i, w in expect.items() if w}
    assert set(np.flatnonzero(got).tolist()) == set(kept) and len(kept) > 3
    assert [float(got[i]) for i in kept] == pytest.approx(list(kept.values()), rel=1e-4, abs=1e-5)


def test_neutral_mentions_are_not_toxic(spark):
    made = _biased(1500, 3)
    docs = spark.createDataFrame([r[:2] for r in made], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in made], "doc_id long, toxic int")
    fair, plain = toxicity.fit(docs, labels), toxicity.fit(docs, labels, strength=0.0)
    rnd = random.Random(9)
    neutral = [" ".join(rnd.choice("wak wbl wcm wdn weo wfp".split()) for _ in range(12)) + " muslims wak" for _ in range(200)]
    hostile = [t + " vile filthy" for t in neutral]
    other = [t.replace("muslims", "jews") for t in neutral]

    def scored(weights, texts):
        return toxicity.sigmoid(toxicity.margins(pa.array(texts), weights))

    assert (scored(plain, neutral) >= 0.7).mean() > 0.9           # without the penalty the name alone is toxic
    assert (scored(fair, neutral) >= 0.7).mean() < 0.05
    assert (scored(fair, hostile) >= 0.7).mean() > 0.95
    change = {k: np.abs(scored(w, neutral) - scored(w, other)).mean() for k, w in (("fair", fair), ("plain", plain))}
    assert change["fair"] < 0.1 * change["plain"]


def test_query_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op13_toxicity(spark, SF01).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    assert set(got) == set(text)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [i for i in labels if got[i].held_out]
    assert sum(got[i].predicted for i in held if not labels[i]) <= 2
    hostile = re.compile(r"\b(idiot|moron|scum|trash|loser|pathetic|worthless|disgusting|stupid|clown)\b", re.I)
    sure = [i for i in held if labels[i] and hostile.search(text[i])]
    assert sum(got[i].predicted for i in sure) >= 0.6 * len(sure) > 0     # of 260 labelled rows to learn from


@pytest.mark.parametrize("rows", [[], [(1, None)], [(3, 1), (3, 0), (4, 0), (9, 0), (None, 1), (999, 1)]])
def test_odd_rows_and_labels(spark, rows):
    docs = documents(spark)
    labels = spark.createDataFrame(rows, "doc_id long, toxic int").selectExpr("*", "'x' AS text", "1 AS _y")
    scored = toxicity.score_toxicity(docs, labels).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    if len(rows) < 2:
        assert {r.score for r in scored} == {0.5}
    assert toxicity.score_toxicity(empty(spark), labels).count() == 0
