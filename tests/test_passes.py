"""How often the change jobs read their inputs, counted by a function in the
input's plan."""

from pyspark.sql import functions as F

from mnemo.functions.values import empty_props, props_map, pv_number, pv_string
from mnemo.model import Graph
from mnemo.operators import mutate
from mnemo.sources.requests import graph_from_records, local_props

NOW = "2026-01-01T00:00:00.000Z"


def counted(df, column):
    """``df`` and the number of its rows that were computed so far."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def same(x):
        seen.add(1)
        return x

    return df.withColumn(column, F.udf(same, "bigint").asNondeterministic()(column)), seen


def people(spark):
    return graph_from_records(spark, [(1, ["person"], {"name": "Alice"}), (2, ["person"], {"name": "Bob"}), (3, ["place"], {"name": "Paris"})],
                              [(10, 1, 3, "LIVES_IN", {"since": 2020}), (11, 1, 3, "LIVES_IN", {}), (12, 2, 3, "LIVES_IN", {})])


def test_update_connections_computes_its_requests_once(spark):
    reqs = [(1, 1, 3, "LIVES_IN", {"since": None, "seen": "yes"}), (2, 2, 3, "LIVES_IN", {"a": 1}), (3, 2, 3, "LIVES_IN", {"a": 2}),
            (4, 9, 3, "LIVES_IN", {"a": 1}), (None, 1, 2, "KNOWS", {"a": 1}), (6, None, 3, "LIVES_IN", {"a": 1}), (7, None, 3, "LIVES_IN", {"a": 1})]
    requests, seen = counted(local_props(spark, reqs, "req_id bigint, from_id bigint, to_id bigint, type string"), "to_id")
    change = mutate.update_connections(people(spark), requests)
    got = {r.req_id: (r.n_matched, r.edge_id, r.status) for r in change.result.collect()}
    assert seen.value == len(reqs)
    assert got == {1: (2, 10, "applied"), 2: (0, None, "rejected_duplicate"), 3: (0, None, "rejected_duplicate"), 4: (0, None, "no_match"),
                   None: (0, None, "no_match"), 6: (0, None, "no_match"), 7: (0, None, "no_match")}
    edges = {r.edge_id: sorted(r.props) for r in change.graph.edges.collect()}
    assert edges == {10: ["seen"], 11: ["seen"], 12: []}


def test_connect_by_name_reads_nodes_and_edges_in_few_passes(spark):
    plain = people(spark)
    nodes, node_rows = counted(plain.nodes, "memory_id")
    edges, edge_rows = counted(plain.edges, "edge_id")
    requests = spark.createDataFrame([(1, "Alice", "Paris", "likes"), (2, "Bob", "Atlantis", "likes"), (3, "2", "Alice", "knows"), (4, None, "Bob", "knows")],
                                     "req_id bigint, from_ref string, to_ref string, relationship string")
    change = mutate.connect_by_name(Graph(nodes, edges), requests, NOW)
    got = {r.req_id: (r.edge_id is not None, r.error, r.status) for r in change.result.collect()}
    # by name, by id and the ends of the connections; the highest id
    assert node_rows.value <= 3 * 3 and edge_rows.value == 3
    assert got[1] == (True, None, "created") and got[3] == (True, None, "created")
    assert got[2] == (False, "Target memory 'Atlantis' not found", "error") and not got[4][0]
    new = change.delta.edge_inserts.select("src", "dst", "type").collect()
    assert sorted(map(tuple, new)) == [(1, 3, "likes"), (2, 1, "knows")]


def test_supplied_connection_ids_are_checked_beside_assigned_ones(spark):
    reqs = [(1, 10, 1, 2, "KNOWS", {}), (2, None, 1, 2, "KNOWS", {}), (3, 20, 2, 1, "KNOWS", {}), (4, 20, 1, 3, "KNOWS", {}), (5, None, 1, 9, "KNOWS", {})]
    requests = local_props(spark, reqs, "req_id bigint, edge_id bigint, from_id bigint, to_id bigint, type string")
    got = {r.req_id: (r.edge_id, r.status) for r in mutate.create_connections(people(spark), requests, NOW).result.collect()}
    assert got == {1: (None, "id_exists"), 2: (21, "created"), 3: (20, "created"), 4: (None, "id_exists"), 5: (None, "no_match")}


def test_property_maps_with_named_inputs_leave_out_nulls(spark):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, 1e21), (3, "c", None), (4, None, None)], "id int, s string, x double")
    pairs = [("s", pv_string("s")), ("x", pv_number("x"))]
    rows = df.select("id", props_map(*pairs).alias("old"), props_map(*pairs, inputs=[F.col("s"), F.col("x")]).alias("new"), empty_props().alias("none")).collect()
    assert all(r.old == r.new for r in rows)
    assert [sorted(r.new) for r in sorted(rows)] == [["s", "x"], ["x"], ["s"], []]


def test_search_reply_does_not_store_the_graph(spark, tmp_path, monkeypatch):
    from conftest import SF001
    from mnemo.plans import change_queries

    def no(*_):
        raise AssertionError("one search needs no stored graph")

    monkeypatch.setattr(change_queries, "stored", no)
    assert change_queries.q_search_result_json(spark, SF001).count() > 0


def test_replay_reads_the_ids_of_connections_once(spark):
    from mnemo.sources.requests import change_ops, local_log, validate_requests
    from mnemo.streaming.replay import lifetimes, replay

    plain = people(spark)
    edges, edge_rows = counted(plain.edges, "edge_id")
    calls = [("delete_memory", {"nodeId": 2}), ("create_connection", {"fromMemoryId": 1, "toMemoryId": 3, "type": "LIKES", "connectionId": 11}),
             ("create_connection", {"fromMemoryId": 1, "toMemoryId": 3, "type": "LIKES", "connectionId": 20}),
             ("update_connection", {"fromMemoryId": 1, "toMemoryId": 3, "type": "LIVES_IN", "properties": {"seen": True}}),
             ("update_memory", {"nodeId": 1, "properties": {"age": 4}}), ("delete_memory", {"nodeId": 77})]
    ops = change_ops(validate_requests(local_log(spark, [{"seq": i, "name": n, "arguments": a} for i, (n, a) in enumerate(calls)])))
    lives = lifetimes(Graph(plain.nodes, edges), ops, NOW)
    assert edge_rows.value == 3
    assert sorted((r.edge_id, r.y < 1 << 62) for r in lives.edges.collect()) == [(10, False), (11, False), (12, True), (20, False)]
    change = replay(plain, ops, NOW)
    # what the merge takes from the stored tables, written beforehand
    assert sorted(r[0] for r in change.delta.node_gone.collect()) == [1, 2]
    assert sorted(r[0] for r in change.delta.edge_gone.collect()) == [10, 11, 12]
    assert sorted(r.memory_id for r in change.graph.nodes.collect()) == [1, 3]
    assert {r.edge_id: sorted(r.props) for r in change.graph.edges.collect()} == {10: ["seen", "since"], 11: ["seen"], 20: ["created_at"]}
    assert "Broadcast" in change.graph.nodes._jdf.queryExecution().sparkPlan().toString()


def _mixed_log(spark):
    from mnemo.sources.requests import local_log, validate_requests

    calls = [("delete_memory", {"nodeId": 2}), ("update_connection", {"fromMemoryId": 1, "toMemoryId": 3, "type": "LIVES_IN", "properties": {"seen": True}}),
             ("create_memory", {"memoryId": 50, "label": "note", "properties": {"name": "n"}}), ("delete_memory", {"nodeId": 50})]
    return validate_requests(local_log(spark, [{"seq": i, "name": n, "arguments": a} for i, (n, a) in enumerate(calls)]))


def test_replay_reads_changed_connections_once(spark):
    from mnemo.sources.requests import change_ops
    from mnemo.streaming.replay import replay

    plain = people(spark)
    edges, edge_rows = counted(plain.edges, "edge_id")
    change = replay(Graph(plain.nodes, edges), change_ops(_mixed_log(spark)), NOW)
    assert {r.edge_id: sorted(r.props) for r in change.delta.edge_upserts.collect()} == {10: ["seen", "since"], 11: ["seen"]}
    assert edge_rows.value == 3 + 3      # the ids and ends of all, the rows that change


def test_stored_memories_are_not_shuffled_to_meet_the_log(spark):
    from mnemo.streaming.history import History

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        past = History(people(spark), _mixed_log(spark), NOW)
        plan = past.still_nodes._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(r.memory_id for r in past.still_nodes.collect()) == [1, 3]
        assert sorted((r.memory_id, r.f, r.t) for r in past.states.collect()) == [(2, -2, 0), (50, 2, 3)]
        seeds = spark.createDataFrame([("x", 0, 3, 1), ("y", 9, 3, 2)], "req_key string, at bigint, memory_id bigint, depth int")
        got = sorted((r.req_key, r.related_id, r.first_edge, r.distance) for r in past.expand(seeds).collect())
        assert got == [("x", 1, 10, 1), ("x", 1, 11, 1), ("x", 2, 12, 1), ("y", 1, 10, 1), ("y", 1, 11, 1), ("y", 3, 10, 2), ("y", 3, 11, 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
