import hashlib
import random
import re

import pytest
from conftest import SF01
from llm_cases import ODD_TEXTS, documents, empty

from mnemo.llm import mixing, queries


def test_targets_share_the_excess():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == {"a": 187.5, "b": 75.0, "c": 37.5}
    got = mixing.targets({"a": 10, "b": 200, "c": 200, None: 0})
    assert got["a"] == 30.0 and got[None] == 0 and sum(got.values()) == pytest.approx(410)
    assert got["b"] == pytest.approx(2 * got["c"], rel=1e-6)
    assert mixing.targets({}) == {}


def _best(sizes, quotas):
    """Largest flow, and least cost, by trying whole words."""
    patterns = list(sizes)
    best = (0, 0)

    def rec(k, left, total, cost):
        nonlocal best
        if k == len(patterns):
            best = max(best, (total, -cost))
            return
        p = patterns[k]

        def split(j, words, left):
            if j == len(p):
                full, rest = divmod(words, sizes[p])
                yield words, sum(sizes[p] * (c + 1) for c in range(full)) + rest * (full + 1), left
                return
            for x in range(min(left[p[j]], 3 * sizes[p] - words) + 1):
                yield from split(j + 1, words + x, {**left, p[j]: left[p[j]] - x})

        for words, c, rest in split(0, 0, left):
            rec(k + 1, rest, total + words, cost + c)

    rec(0, quotas, 0, 0)
    return best


@pytest.mark.parametrize("sizes, quotas", [
    ({("a",): 2, ("a", "b"): 2, ("b",): 1}, {"a": 5, "b": 3}),
    ({("a",): 1, ("b",): 3}, {"a": 5, "b": 2}),
    ({("a", "b"): 2, ("b", "c"): 1, ("c",): 2}, {"a": 3, "b": 2, "c": 4}),
])
def test_flow_is_largest_and_cheapest(sizes, quotas):
    got = mixing.flow(sizes, quotas)
    total = sum(map(sum, got.values()))
    cost = sum((k + 1) * w for passes in got.values() for k, w in enumerate(passes))
    assert (total, -cost) == pytest.approx(_best(sizes, quotas))


def test_equals_sql(spark):
    import duckdb

    got = queries.op6_mixing(spark, SF01).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF01}/documents.parquet'")
    expect = con.execute(mixing.ORACLE).df().sort_values("doc_id").reset_index(drop=True)[got.columns]
    assert (got.values == expect.values).all()
    assert (got["taken"] <= 3 * got["size"]).all()
    source = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "source").toPandas()
    per = got.merge(source, on="doc_id").groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((per["taken"] - per["target"]).abs() < 0.03 * per["target"]).all()


def _greedy(rows, rest):
    """Plain greedy choice in seeded order; rows of one place go together."""
    taken = set()
    places = {}
    for i, size in rows:
        if size:
            places.setdefault(hashlib.md5(f"mix-1:{i}".encode()).hexdigest(), []).append((i, size))
    for _, same in sorted(places.items()):
        fit = [(i, size) for i, size in same if size <= rest]
        if fit and sum(size for _, size in fit) <= rest:
            rest -= sum(size for _, size in fit)
            taken |= {i for i, _ in fit}
    return taken


@pytest.mark.parametrize("seed", range(3))
def test_every_document_that_fits_is_taken(spark, seed):
    """Many more than five documents must be passed over before the last fits."""
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([1, 2, 3, 50, 400, 900, 5000])) for i in range(400)] + [(7, 30), (7, 31)]
    docs = spark.createDataFrame([(i, "w " * n, "s") for i, n in rows], "doc_id long, text string, source string")
    wanted = rnd.randint(2000, sum(n for _, n in rows) - 1)
    got = mixing.mix(docs, wanted=lambda sizes: {"s": float(wanted)}).groupBy("doc_id", "text").count().collect()
    expect = _greedy(rows, wanted)
    assert {r.doc_id for r in got} == expect and all(r["count"] == 1 for r in got)
    words = sum(len(r.text.split()) for r in got)
    left = [n for i, n in rows if i not in expect]
    assert words <= wanted and (not left or min(left) > wanted - words)


def test_odd_rows_and_overlaps(spark):
    docs = documents(spark)
    first, again = (sorted(map(tuple, mixing.mixture(docs).collect()), key=str) for _ in range(2))
    assert first == again and len(first) == docs.count()
    for doc_id, size, *_ in first:
        if doc_id is not None:
            assert size == len(re.findall(r"[^\x20\x09-\x0D]+", ODD_TEXTS[doc_id] or ""))
    taken = {r.doc_id: r.taken for r in mixing.mixture(docs).collect() if r.size}
    rows = mixing.mix(docs)
    assert rows.columns == docs.columns
    assert mixing.mixture(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0
    got = {}
    for r in rows.where("text is not null").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v}
    many = spark.range(300).selectExpr("id AS doc_id", "repeat('w ', 1 + int(id % 7)) AS text",
                                       "CASE id % 3 WHEN 0 THEN array('a') WHEN 1 THEN array('b', 'a') ELSE array('b') END AS sources")
    size = 1 + 0 * 7
    picked = mixing.mix(many, many["sources"], lambda sizes: {"a": 600.0, "b": 300.0})
    words = sum(len(r.text.split()) for r in picked.collect())
    assert abs(words - 900) <= 3 * 7 * size
