import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF001
from llm_cases import ODD_TEXTS, documents, empty
from oracle_compare import compare, duck
from pyspark.sql import functions as F

from mnemo.llm import importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def _grams(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i: i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)]


def _plain(rows, target, percent=10, least=20, buckets=10_000, width=1, seed="2024"):
    """Brute force: doc_id, n_features, weight, score, rank of every row."""
    def code(g):
        return zlib.crc32(g.encode()) % buckets

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(code, _grams(text, width)[1]))
    for text in target:
        t.update(map(code, _grams(text, width)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        words, grams = _grams(text, width)
        gain = [math.floor(1000 * math.log((t[code(g)] + 1) * (s_all + buckets) / ((s[code(g)] + 1) * (t_all + buckets)))) for g in grams]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((r[:5] for r in out), key=repr)


def _rows(df):
    assert [t for _, t in df.dtypes] == ["bigint"] * 5
    return sorted((list(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_crc_of_spans_equals_zlib():
    rnd = random.Random(3)
    data = bytes(rnd.randrange(256) for _ in range(5000))
    spans = [(s, min(5000, s + rnd.choice([0, 1, 5, 9, 63, 64, 65, 900]))) for s in (rnd.randrange(5000) for _ in range(3000))]
    got = importance.crc32(np.frombuffer(data, np.uint8), *(np.array(x) for x in zip(*spans)))
    assert got.tolist() == [zlib.crc32(data[s:e]) for s, e in spans]
    assert importance.crc32(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


@pytest.mark.parametrize("width,buckets", [(1, 10_000), (3, 50)])
def test_rows_equal_brute_force_on_odd_texts(spark, width, buckets):
    rnd = random.Random(width)
    texts = ODD_TEXTS + [" ".join(rnd.choice("ab é9 Zz x-y q,r".split()) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    docs = documents(spark, texts)      # repeated and null doc_ids, clashing columns
    target = ["a é z", None, "", "q r the quick brown"]
    bench = spark.createDataFrame([(x, 1) for x in target], "text string, doc_id int")
    got = importance.resample(docs, bench, percent=30, min_words=5, buckets=buckets, width=width)
    assert _rows(got) == _plain([(r.doc_id, r.text) for r in docs.collect()], target, 30, 5, buckets, width)


def test_ties_and_repeated_rows(spark):
    text = "one two three four five"
    docs = spark.createDataFrame([(7, text)] * 40 + [(7, text + " six")] * 3 + [(i, text) for i in range(20)] + [(None, text)] * 2, "doc_id long, text string")
    for percent in (1, 30):
        got = importance.resample(docs, docs.select("text"), percent, 5)
        assert _rows(got) == _plain([tuple(r) for r in docs.collect()], [r.text for r in docs.collect()], percent, 5)


def test_empty_tables(spark):
    none = empty(spark)
    assert importance.resample(none, none).count() == 0
    docs = documents(spark)
    got = importance.resample(docs, none)
    assert _rows(got) == _plain([(r.doc_id, r.text) for r in docs.collect()], [])
    assert importance.resample(none, docs).columns == got.columns


def test_quickselect_is_exact(spark):
    rnd = random.Random(1)
    values = [rnd.randint(-50, 50) for _ in range(3000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(5)
    ranks = sorted((v, i) for i, v in enumerate(values))
    for k in (1, 777, 3000):
        for pivots in (1, 4) if k == 777 else (15,):
            assert tuple(importance.kth_key(df, F.struct("v", "i"), k, pivots)) == ranks[k - 1]
    assert importance.kth_key(df, F.struct("v", "i"), 3001) is None
    assert importance.kth_key(df.where("false"), F.struct("v", "i"), 1) is None


def test_query_equals_its_sql(spark):
    got = compare(queries.op11_importance(spark, SF001), duck(SF001), queries.ORACLES["op11_importance"])
    assert got["ok"], got
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    target = [r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    assert _rows(queries.op11_importance(spark, SF001)) == _plain([(r.doc_id, r.text) for r in docs], target)
