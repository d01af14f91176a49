import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF01, SF001
from llm_cases import ODD_TEXTS, documents, empty

from mnemo.llm import quality_classifier, quality_rules, queries
from mnemo.llm.features import margins, rows
from mnemo.llm.words import Words, hash_spans, mix, raw, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i: i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)]


def _texts():
    rnd = random.Random(7)
    made = ["".join(rnd.choice("ab c\n#é\t") for _ in range(rnd.randint(0, 200))) for _ in range(200)]
    return ODD_TEXTS + made + [" ".join(rnd.choice("abc") for _ in range(60)) for _ in range(40)]


def test_base_counts_equal_brute_force():
    texts = _texts()
    got = quality_rules.counts(pa.array(texts, pa.string()))
    assert got.tolist() == [_counts(t) for t in texts]


def _thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") & 1 else a for i in range(n))


def test_lines_of_alternating_patterns_are_told_apart():
    """Such pairs are equal under a polynomial hash modulo 2^64."""
    for n in (1024, 2048, 4096, 8192):
        line, other = _thue_morse(n), _thue_morse(n, "b", "a")
        text = f"{line}\n{other}\n{line}"
        words = " ".join([line, other, "x", "y", "z", other, line, "x", "y", "z"])
        got = quality_rules.counts(pa.array([text, words], pa.string()))
        assert got.tolist() == [_counts(text), _counts(words)] and got[0, 3] == 1 and got[1, 4] == 0


def test_span_hash_of_all_lengths_and_places():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 9000).astype(np.uint8)
    start = np.concatenate([rng.integers(0, 8990, 20_000), [0, 0, 5, 9000]])
    end = np.minimum(start + np.concatenate([rng.integers(0, 40, 20_000), [9000, 4096, 4102, 0]]), 9000)
    h = hash_spans(data, start, end)
    spans = [data[s:e].tobytes() for s, e in zip(start, end)]
    assert len(set(h.tolist())) == len(set(spans)) == len(set(zip(spans, h.tolist())))
    alone = [hash_spans(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0] for x in spans[:50] + spans[-4:]]
    assert alone == h[[*range(50), *range(-4, 0)]].tolist()


def test_words_of_a_slice_and_hashes():
    texts = pa.array(["skip", *_texts()], pa.string()).slice(1)
    buf, off = raw(texts)
    words, hashes = [], []
    for i, j in runs(off, 500):
        w = Words(buf, off[i: j + 1], lower=True)
        words += [bytes(w.data[s:e]) for s, e in zip(w.start, w.end)]
        hashes += w.hashes().tolist()
    expect = [x.encode().lower() for t in texts.to_pylist() for x in WORD.findall(t or "")]
    assert words == expect
    assert len(set(hashes)) == len(set(words)) == len(set(zip(words, hashes)))


def test_classifier_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in queries.op2_quality_classifier(spark, SF001).collect()}
    labels = spark.read.parquet(f"{SF001}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{SF001}/documents.parquet").count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    right = [rows[x.doc_id].predicted == x.quality for x in labels if rows[x.doc_id].held_out]
    assert np.mean(right) > 0.85


def test_rules_verdicts(spark):
    got = queries.op9_quality_rules(spark, SF001).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    for r in got:
        n, chars, symbols, dup, again = _counts(text[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [n, chars, symbols, dup, again]
        assert r.base_failed == (n < 10 or 100 * again > 20 * n)
        assert r.kept == (not r.base_failed and r.probability >= quality_rules.KEEP)
    model = [(r.probability >= quality_rules.KEEP) == (label[r.doc_id] == 1) for r in got if r.doc_id in label]
    assert np.mean(model) > 0.9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(3, 1), (3, 0), (4, 1), (999, 0)]])
def test_odd_rows_and_labels(spark, rows):
    docs = documents(spark)
    labels = spark.createDataFrame(rows, "doc_id long, quality int").selectExpr("*", "'x' AS text", "1 AS _y")
    scored = quality_classifier.score_quality(docs, labels).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    if len(rows) < 2:
        assert {r.score for r in scored} == {0.5}
    judged = quality_rules.rule_verdicts(docs, labels).collect()
    assert len(judged) == docs.count() and not any(r.kept for r in judged if r.n_words < 10)
    for op in (quality_classifier, quality_rules):
        kept = op.keep_good(docs, op.fit(docs, labels))
        assert kept.columns == docs.columns and kept.count() <= docs.count()
        assert op.keep_good(empty(spark), op.fit(empty(spark), labels)).count() == 0


def test_calibration_is_monotone_and_close():
    rng = np.random.default_rng(1)
    m = rng.normal(size=4000) * 5
    y = (rng.random(4000) < quality_classifier.sigmoid(0.5 * m - 1)).astype(float)
    a, b = quality_rules._platt(m, y)
    assert a == pytest.approx(0.5, abs=0.08) and b == pytest.approx(-1, abs=0.2)
    a, b = quality_rules._platt(np.array([-9.0, -8, 7, 9]), np.array([0.0, 0, 1, 1]))
    assert a > 0 and np.isfinite([a, b]).all()


# ------------------------------------------------- the models against dictionaries

def _h(data):
    return int(hash_spans(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0]) if data else 0


def _mix(x):
    return int(mix(np.array([x & (1 << 64) - 1], dtype=np.uint64))[0])


def _shape(word):
    kinds = ["a" if chr(b).islower() and b < 128 or b >= 128 else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else chr(b) for b in word]
    return "".join(k for k, before in zip(kinds, [None, *kinds]) if k != before).encode()


def _plain_features(text, chars=False):
    """{bucket: value}, the bias last, by plain loops."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    h = [_h(w) for w in words]
    families = [h, [_mix(a * 0x9E3779B97F4A7C15 + b) for a, b in zip(h, h[1:])], [_h(_shape(w)) for w in words], [_mix((a == b) + 7) for a, b in zip(h, h[1:])]]
    if chars:
        for n in (3, 4):
            families.append([int.from_bytes(data[i: i + n], "little") * (0x9E3779B97F4A7C15 * n & (1 << 64) - 1) & (1 << 64) - 1 for i in range(len(data) - n + 1)])
    out = Counter()
    for family in families:
        for x in family:
            out[x >> 46] += 1 / len(family) ** 0.5
    out[1 << 18] += 1
    return out


def test_features_scores_and_ftrl_equal_a_dictionary_version():
    texts = _texts()
    for families, chars in ((quality_classifier.FAMILIES, False), (quality_rules.FAMILIES, True)):
        for (idx, val), t in zip(rows(pa.array(texts, pa.string()), 18, families), texts):
            expect = _plain_features(t, chars)
            assert idx.tolist() == sorted(expect) and val == pytest.approx([expect[i] for i in sorted(expect)], rel=1e-5)
        weights = np.random.default_rng(3).normal(size=(1 << 18) + 1).astype(np.float32)
        got = margins(pa.array(texts, pa.string()), weights, 18, families)
        assert got == pytest.approx([sum(v * float(weights[i]) for i, v in _plain_features(t, chars).items()) for t in texts], rel=1e-4, abs=1e-4)
    rnd = random.Random(4)
    data = [(_plain_features(t), rnd.randint(0, 1)) for t in texts[:120]]
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.05 else (np.sign(z[i]) * 0.05 - z[i]) / ((1 + n[i] ** 0.5) / 0.5 + 0.1)

    model = quality_classifier.Ftrl((1 << 18) + 1)
    for x, y in data:
        p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - y) * v
            w = weight(i)
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5 * w
            n[i] += g * g
        model.update(np.array(sorted(x)), np.array([x[i] for i in sorted(x)]), y)
    got = model.weights()
    assert [got[i] for i in z] == pytest.approx([weight(i) for i in z], rel=1e-9, abs=1e-12)
    assert set(np.flatnonzero(got).tolist()) <= set(z)


def test_rules_model_on_rows_that_it_did_not_learn_from(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    learnt = labels.where("crc32(cast(doc_id AS string)) % 3 <> 0")
    weights = quality_rules.fit(docs, learnt)
    unseen = labels.where("crc32(cast(doc_id AS string)) % 3 = 0").join(docs, "doc_id").collect()
    p = quality_classifier.sigmoid(margins(pa.array([r.text for r in unseen], pa.string()), weights, quality_rules.BITS, quality_rules.FAMILIES))
    right = [(x >= quality_rules.KEEP) == (r.quality == 1) for x, r in zip(p, unseen)]
    assert len(right) > 80 and np.mean(right) > 0.85
