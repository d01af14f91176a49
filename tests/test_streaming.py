"""Structured Streaming replay on a tiny graph: log files arriving over
several runs, per-batch deltas, compaction, and a restart that has nothing
new to do."""

import json

from mnemo.sources.requests import graph_from_records
from mnemo.sources.snapshot import write_graph
from mnemo.streaming.replay import stream_replay, stream_state

NOW = "2026-01-01T00:00:00.000Z"


def write_lines(folder, calls):
    folder.mkdir(parents=True)
    (folder / "part-0.json").write_text("\n".join(json.dumps(c) for c in calls) + "\n")


def test_stream_replay_incremental(spark, tmp_path):
    g = graph_from_records(spark, [(1, ["person"], {"name": "a"}), (2, ["place"], {"name": "b"})],
                           [(10, 1, 2, "AT", {})])
    snap = write_graph(g, str(tmp_path / "snap0"))
    log, out, ckpt = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "ckpt")
    write_lines(log / "f1", [
        {"seq": 1, "name": "create_memory", "arguments": {"label": "note", "memoryId": 3,
                                                          "properties": {"text": "hi"}}},
        {"seq": 2, "name": "create_connection", "arguments": {"fromMemoryId": 3, "toMemoryId": 1,
                                                              "type": "ABOUT", "connectionId": 11}},
        {"seq": 3, "name": "bogus_tool", "arguments": {}},
    ])
    last = stream_replay(spark, str(log), snap, out, NOW, ckpt, compact_every=2)
    assert last == 0
    g1 = stream_state(spark, snap, out, last + 1, 2)
    assert sorted(r.memory_id for r in g1.nodes.collect()) == [1, 2, 3]
    assert sorted(r.edge_id for r in g1.edges.collect()) == [10, 11]

    # a restart with no new files does nothing
    assert stream_replay(spark, str(log), snap, out, NOW, ckpt, compact_every=2) is None

    # a new file: only it is processed, on top of the previous state
    write_lines(log / "f2", [
        {"seq": 4, "name": "delete_memory", "arguments": {"nodeId": 1}},
        {"seq": 5, "name": "update_memory", "arguments": {"nodeId": 3, "properties": {"text": None, "k": 1}}},
    ])
    last = stream_replay(spark, str(log), snap, out, NOW, ckpt, compact_every=2)
    assert last == 1
    g2 = stream_state(spark, snap, out, last + 1, 2)   # batch 1 was compacted (every 2 batches)
    assert sorted(r.memory_id for r in g2.nodes.collect()) == [2, 3]
    assert g2.edges.count() == 0
    props = {r.memory_id: {k: v.text for k, v in r.props.items()} for r in g2.nodes.collect()}
    assert props[3] == {"k": "1", "created_at": NOW}
    quarantine = spark.read.parquet(f"{out}/deltas/batch=0/quarantine").collect()
    assert [(r.seq, r.reason) for r in quarantine] == [(3, "Unknown tool: bogus_tool")]


def line(seq, name, **arguments):
    return {"seq": seq, "name": name, "arguments": arguments}


def rows_of(graph):
    from mnemo.operators.expand import ADJ_COLUMNS
    nodes = sorted((r.memory_id, tuple(r.labels), r.created_at, r.search_text, tuple(sorted((k, v.text) for k, v in r.props.items()))) for r in graph.nodes.collect())
    edges = sorted((r.edge_id, r.src, r.dst, r.type, tuple(sorted((k, v.text) for k, v in r.props.items()))) for r in graph.edges.collect())
    return nodes, edges, sorted(map(tuple, graph.adj.select(*ADJ_COLUMNS).collect()))


def test_compaction_copies_the_rows_that_stay(spark, tmp_path):
    """Two compactions: the state is that of one replay of the whole log; the
    rows that stay are met by the ids gone without being shuffled, whatever
    the planner would choose, until too many rows lie beside them."""
    from mnemo.operators.expand import ADJ_COLUMNS, adjacency
    from mnemo.sources.requests import parse_log_lines
    from mnemo.sources.snapshot import read_graph
    from mnemo.streaming.replay import replay_log

    nodes = [(i, ["person"] if i % 2 else ["place"], {"name": f"n{i}", "created_at": f"20{i}"}) for i in range(10, 40)]
    g = graph_from_records(spark, nodes, [(100 + i, i, i + 1 if i % 7 else i, "KNOWS", {"w": i}) for i in range(10, 39)])
    snap = write_graph(g, str(tmp_path / "snap0"))
    stored = read_graph(spark, snap)
    assert sorted(map(tuple, stored.adj.collect())) == sorted(map(tuple, adjacency(g.edges).select(*ADJ_COLUMNS).collect()))
    files = [
        [line(1, "create_memory", label="note", memoryId=70, properties={"name": "x", "created_at": "1"}),
         line(2, "create_connection", fromMemoryId=70, toMemoryId=12, type="ABOUT", connectionId=200),
         line(3, "update_memory", nodeId=13, properties={"name": "new"}), line(4, "delete_memory", nodeId=14)],
        [line(5, "delete_memory", nodeId=70), line(6, "create_memory", label="thing", memoryId=14, properties={"name": "again", "created_at": "2"}),
         line(7, "update_connection", fromMemoryId=20, toMemoryId=21, type="KNOWS", properties={"w": 5}),
         line(8, "create_connection", fromMemoryId=14, toMemoryId=14, type="SELF", connectionId=201)],
        [line(9, "delete_connection", fromMemoryId=15, toMemoryId=16, type="KNOWS"), line(9, "delete_memory", nodeId=30)],
        [line(10 + i, "create_connection", fromMemoryId=20, toMemoryId=20 + i, type="MANY", connectionId=300 + i) for i in range(8)],
    ]
    log, out, ckpt = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "ckpt")
    for i, calls in enumerate(files):
        write_lines(log / f"f{i}", calls)
        last = stream_replay(spark, str(log), snap, out, NOW, ckpt, compact_every=2)
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            state = stream_state(spark, snap, out, last + 1, 2)
            for table in (state.nodes, state.edges, state.adj):
                plan = table._jdf.queryExecution().toString()
                # of a table of rows made and removed by the deltas alone
                stored_joins = [x for x in plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].split("\n") if "rightHint=(strategy=broadcast)" in x]
                assert stored_joins or (last + 1) % 2 == 0
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        lines = spark.createDataFrame([(json.dumps(c),) for f in files[:i + 1] for c in f], "value string")
        change, _ = replay_log(read_graph(spark, snap), parse_log_lines(lines), NOW)
        if i >= 1:      # one batch for all would not make memory 14 anew
            assert (14, ("thing",)) in [x[:2] for x in rows_of(state)[0]]
        else:
            assert rows_of(state) == rows_of(change.graph)
        assert rows_of(state)[2] == sorted(map(tuple, adjacency(state.edges).select(*ADJ_COLUMNS).collect()))
    loose = [tuple(spark.read.parquet(f"{out}/snapshots/batch={b}/meta").select("loose_nodes", "loose_edges").first()) for b in (1, 3)]
    # 13 and 14 again; 201 and the one updated; then too many connections
    assert loose == [(2, 2), (2, 0)]
    final = rows_of(stream_state(spark, snap, out, 4, 2))
    assert [x[0] for x in final[0]] == list(range(10, 40)) and dict((x[0], x[3]) for x in final[0])[13].split("\n").count("new") == 1
    gone = {100 + i for i in (13, 14, 15)}
    assert [x[0] for x in final[1]] == sorted(({100 + i for i in range(10, 39)} - gone) | {201} | set(range(300, 308)))
    assert dict((x[0], x[4]) for x in final[1])[120] == (("w", "5"),)


def test_compaction_of_an_unchanged_table_copies_it(spark, tmp_path):
    from mnemo.operators.delta import GraphDelta, net_delta
    from mnemo.sources.snapshot import read_graph, write_compacted

    g = graph_from_records(spark, [(i, ["n"], {"t": f"g{i}"}) for i in range(9)], [(i, i, i + 1, "E", {}) for i in range(8)])
    snap = write_graph(g, str(tmp_path / "a"))
    none = GraphDelta(node_deletes=spark.createDataFrame([(3,)], "memory_id bigint"), edge_deletes=spark.createDataFrame([(2,), (3,)], "edge_id bigint"))
    seen = []
    import mnemo.sources.snapshot as snapshot
    old, snapshot._clustered = snapshot._clustered, lambda df, *order: seen.append(df.count()) or old(df, *order)
    try:
        for _ in range(2):      # again over what an earlier try left
            write_compacted(spark, snap, net_delta(spark, [none]), str(tmp_path / "b"))
    finally:
        snapshot._clustered = old
    nodes, edges, adj = rows_of(read_graph(spark, str(tmp_path / "b")))
    assert [x[0] for x in nodes] == [0, 1, 2, 4, 5, 6, 7, 8] and [x[0] for x in edges] == [0, 1, 4, 5, 6, 7] and len(adj) == 12
    assert set(seen) == {0}     # nothing that stays is clustered anew


def test_net_delta_equals_its_deltas_in_turn(spark):
    import random

    from mnemo.model import Graph
    from mnemo.operators.delta import GraphDelta, apply_delta, net_delta
    from mnemo.operators.expand import adjacency

    rng = random.Random(5)
    make = lambda ids, tag: graph_from_records(spark, [(i, ["n"], {"t": f"{tag}{i}"}) for i in ids], [(i, i, i + 1, "E", {"t": f"{tag}{i}"}) for i in ids])
    g = make(range(12), "g")
    base = Graph(g.nodes, g.edges, adjacency(g.edges), 50, 50)
    live, chain, deltas = set(range(12)), base, []
    for k in range(4):
        new = set(rng.sample(sorted(set(range(24)) - live), 4))
        up, dead = (lambda some: (set(some[:2]), set(some[2:])))(rng.sample(sorted(live), 5))
        ins, ups = make(sorted(new), f"i{k}-"), make(sorted(up), f"u{k}-")
        ids = spark.createDataFrame([(i,) for i in sorted(dead)], "memory_id bigint")
        d = GraphDelta(ins.nodes, ups.nodes, ids, ins.edges, ups.edges, ids.withColumnRenamed("memory_id", "edge_id"), 50 + k, 50 + k)
        deltas.append(d)
        chain, live = apply_delta(chain, d), (live - dead) | new
    net = net_delta(spark, deltas)
    got = apply_delta(base, net.delta)
    assert net.nodes_bounded and net.edges_bounded and (got.node_high, got.edge_high) == (53, 53)
    assert rows_of(got) == rows_of(chain) and {x[0] for x in rows_of(got)[0]} == live


def test_edges_in_order_are_written_without_another_shuffle(spark, tmp_path):
    from dataclasses import replace

    from conftest import SF001
    from mnemo.model import EDGE_COLUMNS
    from mnemo.sources.snapshot import read_graph, write_graph
    from mnemo.sources.testgraph import build_graph, edges_by_order

    graph = build_graph(spark, SF001)
    lines, others = edges_by_order(spark, SF001)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
    assert lines.count() > 0 and others.where("type = 'CONTAINS'").isEmpty()
    rows = lambda df: sorted(map(str, df.select(*EDGE_COLUMNS).collect()))
    one = read_graph(spark, write_graph(graph, f"{tmp_path}/one"))
    two = read_graph(spark, write_graph(replace(graph, edge_parts=None), f"{tmp_path}/two"))
    assert rows(one.edges) == rows(two.edges) == rows(graph.edges)
    assert sorted(map(tuple, one.adj.collect())) == sorted(map(tuple, two.adj.collect()))
    lines.select("edge_id", "src").write.parquet(f"{tmp_path}/lines")
    for path in (tmp_path / "lines").glob("*.parquet"):
        ids = [(r.src, r.edge_id) for r in spark.read.parquet(str(path)).collect()]
        assert ids == sorted(ids)
