"""Property tests against naive Python versions of the reference's loops:
word search, trail expansion (depth-first walk), tokenizer, number text."""

import random

import pytest
from pyspark.sql import functions as F

from mnemo.functions.text import tokenize, tokenize_col
from mnemo.operators.expand import adjacency, expand
from mnemo.operators.filters import search_candidates
from mnemo.sources.requests import graph_from_records

WORDS = ["ben", "weeks", "Data", "eng", "x", "Ünï", "42", "4.5", "true", "a b"]


def js_text(v):
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return str(int(v)) if float(v).is_integer() and abs(v) < 1e20 else repr(float(v))
    if isinstance(v, list):
        return " ".join("" if x is None else js_text(x) for x in v)
    return v


def naive_search(nodes, query):
    if query is None or query.strip() == "":
        return sorted(nodes)
    words = query.lower().strip().split()
    hits = []
    for i, props in nodes.items():
        for v in props.values():
            if v is None:
                continue
            text = js_text(v).lower()
            if any(w in text for w in words):
                hits.append(i)
                break
    return sorted(hits)


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_naive_loop(spark, seed):
    rng = random.Random(seed)
    nodes = {}
    for i in range(1, 30):
        props = {}
        for k in rng.sample(["name", "role", "n", "tags", "flag"], rng.randint(0, 4)):
            props[k] = {"name": lambda: " ".join(rng.sample(WORDS, 2)), "role": lambda: rng.choice(WORDS),
                        "n": lambda: rng.choice([25, 4.5, 1e7, -3, 0]),
                        "tags": lambda: rng.sample(["eng", "Data", "x"], 2),
                        "flag": lambda: rng.choice([True, False])}[k]()
        nodes[i] = props
    g = graph_from_records(spark, [(i, ["n"], p) for i, p in nodes.items()])
    for q in ["ben", "DATA eng", "42 true", "4.5", "10000000", "  ", "ünï", "zz", "-3 a"]:
        got = sorted(r.memory_id for r in search_candidates(g.nodes, q).select("memory_id").collect())
        assert got == naive_search(nodes, q), q


def naive_trails(edges, seed, depth):
    """All trails (no repeated edge) of length 1..depth from seed, walking
    edges both ways; distinct (end, first edge, length)."""
    out = set()

    def walk(node, used, first, length):
        if length == depth:
            return
        for eid, s, d in edges:
            if eid in used:
                continue
            steps = [(s, d)] if s == d else [(s, d), (d, s)]
            for a, b in steps:
                if a == node:
                    f = first if first is not None else eid
                    out.add((b, f, length + 1))
                    walk(b, used | {eid}, f, length + 1)

    walk(seed, frozenset(), None, 0)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_expansion_equals_naive_dfs(spark, seed):
    rng = random.Random(seed)
    n = 6
    edges = [(100 + i, rng.randint(1, n), rng.randint(1, n)) for i in range(9)]
    g = graph_from_records(spark, [(i, ["n"], {}) for i in range(1, n + 1)],
                           [(e, s, d, "E", {}) for e, s, d in edges])
    adj = adjacency(g.edges)
    for depth in (1, 2, 3):
        s = rng.randint(1, n)
        seeds = spark.createDataFrame([(s,)], "memory_id bigint")
        got = sorted((r.related_id, r.first_edge, r.distance)
                     for r in expand(seeds, adj, depth, seeds_small=True).collect())
        assert got == naive_trails(edges, s, depth), (edges, s, depth)


def test_tokenizer_column_equals_python(spark):
    qs = ["  Ben  Weeks ", "a b", "﻿x　y", "", "   ", "One\ttwo\nthree", "MIXED case Words",
          " lead", "tail "]
    df = spark.createDataFrame([(q,) for q in qs], "q string").select("q", tokenize_col(F.col("q")).alias("w"))
    for r in df.collect():
        assert list(r.w) == tokenize(r.q), r.q


def test_js_number_text(spark):
    from mnemo.functions.values import js_number_text
    vals = [5.0, 1e7, 0.0001, 24.99, 100.0, 0.0, -12.5, 123456789.125, 2.5e-5, 999999999999.0]
    exp = ["5", "10000000", "0.0001", "24.99", "100", "0", "-12.5", "123456789.125", "0.000025", "999999999999"]
    df = spark.createDataFrame([(v,) for v in vals], "d double").select(js_number_text(F.col("d")).alias("t"))
    assert [r.t for r in df.collect()] == exp


def test_query_lowercase_matches_text_lowercase(spark):
    g = graph_from_records(spark, [(1, ["n"], {"name": "ΟΔΟΣ"}), (2, ["n"], {"name": "İstanbul"})])
    assert [r.memory_id for r in search_candidates(g.nodes, "ΟΔΟΣ").collect()] == [1]
    assert [r.memory_id for r in search_candidates(g.nodes, "İSTANBUL").collect()] == [2]


def test_trails_are_carried_as_edge_sets(spark):
    """Between two nodes with parallel edges every order of walking them is
    the same state: fewer frontier rows, the same result as a walk."""
    from itertools import permutations

    from mnemo.operators.expand import adjacency, expand, release

    n, depth = 6, 5
    g = graph_from_records(spark, [(1, ["n"], {}), (2, ["n"], {})], [(100 + k, 1, 2, "E", {}) for k in range(n)])
    seeds, levels = spark.createDataFrame([(1,)], "memory_id bigint"), []
    got = {tuple(r) for r in expand(seeds, adjacency(g.edges), depth, persisted=levels).select("memory_id", "related_id", "first_edge", "distance").collect()}
    assert got == {(1, 2 if k % 2 else 1, 100 + e, k) for k in range(1, depth + 1) for e in range(n)}
    walks = [sum(1 for _ in permutations(range(n), k)) for k in range(1, depth)]
    kept = [df.count() for df in levels]
    assert kept[0] == n and "others" not in levels[0].columns
    # levels 1, 2 and 4 (3 is checkpointed): first edge, and the set of three others
    assert kept[1] == walks[1] and kept[2] == walks[3] // 6
    release(levels)
