"""Every registered query against its SQL oracle (DuckDB) on the smallest
test tables, and checks on the physical plans."""

import pytest

from conftest import SF001
from oracle_compare import compare, duck

from mnemo.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module", autouse=True)
def stored_graph(spark, tmp_path_factory):
    """One stored graph for all queries, instead of deriving it for each."""
    from mnemo.plans import change_queries, registry
    from mnemo.sources.snapshot import read_graph, write_graph
    from mnemo.sources.testgraph import build_graph

    path = write_graph(build_graph(spark, SF001), str(tmp_path_factory.mktemp("graph") / "g"))
    old = registry.g, registry.stored
    registry.g = change_queries.g = registry.stored = change_queries.stored = lambda spark, sf: read_graph(spark, path) if sf == SF001 else old[0](spark, sf)
    yield
    registry.g = change_queries.g = old[0]
    registry.stored = change_queries.stored = old[1]


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    r = compare(QUERIES[name](spark, SF001), con, ORACLES[name])
    assert r["ok"], r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF001).count() > 0


def plan_text(df) -> str:
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ["search_memories", "expand_depth2", "bulk_search", "label_summary",
                                  "update_memories", "delete_memories", "connection_patterns"])
def test_no_python_in_plans(spark, name):
    text = plan_text(QUERIES[name](spark, SF001))
    for op in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas"):
        assert op not in text


def test_search_pushes_filters_and_prunes(spark, tmp_path):
    from mnemo.operators.filters import search_candidates
    from mnemo.operators.order import DEFAULT_ORDER, top_k
    from mnemo.sources.snapshot import read_graph, write_graph
    from mnemo.sources.testgraph import build_graph

    g = read_graph(spark, write_graph(build_graph(spark, SF001), str(tmp_path / "g")))
    df = top_k(search_candidates(g.nodes, "urgent high", "order", "1998-01-01"), DEFAULT_ORDER, 10)
    text = plan_text(df.select("memory_id"))
    assert "TakeOrderedAndProject" in text
    assert "StringContains(search_text,urgent)" in text
    assert "GreaterThanOrEqual(created_at,1998-01-01)" in text
    assert "props" not in text.split("ReadSchema:")[1].split("\n")[0]
    assert "PartitionFilters: [isnotnull(label_bucket" in text


def test_expansion_pushes_seed_ids_and_never_shuffles_connections(spark, tmp_path):
    from mnemo.plans.search import search_memories
    from mnemo.sources.snapshot import read_graph, write_graph
    from mnemo.sources.testgraph import build_graph

    g = read_graph(spark, write_graph(build_graph(spark, SF001), str(tmp_path / "g")))
    flat = search_memories(g, query="urgent high", label="order", since_date="1998-01-01", limit=10, depth=1)
    text = plan_text(flat)
    assert "PushedFilters: [In(a," in text          # seed ids reach the adjacency scan
    assert "SortMergeJoin" not in text              # connections are never shuffled to meet the seeds
    assert flat.count() > 0


def test_reply_pushes_seed_ids_and_plans_the_expansion_once(spark, tmp_path):
    from mnemo.plans.search import _reply_tables, search_memories
    from mnemo.sources.snapshot import read_graph, write_graph
    from mnemo.sources.testgraph import build_graph

    g = read_graph(spark, write_graph(build_graph(spark, SF001), str(tmp_path / "g")))
    flat = search_memories(g, query="urgent high", label="order", since_date="1998-01-01", limit=10, depth=1)
    # the search reads the adjacency twice (connections, seeds without any);
    # a reply writes it and reads only what was written. Each scan is named
    # twice in the text.
    assert plan_text(flat).count("Scan parquet") <= 4
    seeds = [r[0] for r in flat.select("memory_id").distinct().collect()]
    text = plan_text(g.nodes.where(g.nodes.memory_id.isin(seeds)).select("memory_id", "props"))
    assert "PushedFilters: [In(memory_id," in text
    _, memories, edges = _reply_tables(flat, g)
    assert set(seeds) <= {r[0] for r in memories.select("memory_id").collect()} and edges.count() > 0
