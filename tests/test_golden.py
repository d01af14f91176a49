"""Golden cases: the reference's own test records (FIXTURES §A) and the
hand-made edge cases (§C), each on a tiny in-memory graph."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from mnemo.functions.values import pv_string
from mnemo.model import Graph
from mnemo.operators import mutate, stats
from mnemo.operators.expand import adjacency, expand
from mnemo.operators.filters import search_candidates
from mnemo.operators.order import effective_limit, parse_order_by
from mnemo.plans.search import nest_result, search_memories
from mnemo.sources.requests import graph_from_records, local_props

NOW = datetime(2025, 6, 1, 12, 0, 0, tzinfo=timezone.utc)


def iso(d: datetime) -> str:
    return d.strftime("%Y-%m-%dT%H:%M:%S.") + f"{d.microsecond // 1000:03d}Z"


def ids(df, col="memory_id"):
    return [r[0] for r in df.select(col).collect()]


def seed_ids(df):
    return [r.memory_id for r in df.select("memory_id", "seed_rank").distinct().orderBy("seed_rank").collect()]


PEOPLE = [
    (1, ["person"], {"name": "Ben Weeks", "occupation": "Software Engineer", "company": "TechCorp"}),
    (2, ["person"], {"name": "Sarah Ben", "occupation": "Data Scientist", "company": "DataCo"}),
    (3, ["person"], {"name": "John Weeks", "occupation": "Project Manager", "department": "Engineering"}),
    (4, ["person"], {"name": "Alice Johnson", "occupation": "Designer", "skills": ["UI", "UX", "Figma"]}),
]


@pytest.fixture(scope="module")
def people(spark):
    return graph_from_records(spark, PEOPLE)


def test_a1_any_word(people):
    assert sorted(ids(search_candidates(people.nodes, "Ben Weeks", "person"))) == [1, 2, 3]


def test_a2_substring(people):
    got = set(ids(search_candidates(people.nodes, "Engineer", "person")))
    assert {1, 3} <= got


def test_a3_a4(people):
    assert {1, 2} <= set(ids(search_candidates(people.nodes, "Software Data")))
    assert 4 in ids(search_candidates(people.nodes, "UI Figma"))


def test_c13_labels_not_searched(people):
    assert ids(search_candidates(people.nodes, "person")) == []


@pytest.fixture(scope="module")
def events(spark):
    return graph_from_records(spark, [
        (5, ["event"], {"name": "Old Event", "description": "This happened long ago",
                        "created_at": "2023-01-01T00:00:00Z"}),
        (6, ["event"], {"name": "Recent Event", "description": "This happened recently",
                        "created_at": iso(NOW)}),
        (7, ["event"], {"name": "Last Week Event", "description": "This happened last week",
                        "created_at": iso(NOW - timedelta(days=7))}),
    ])


def test_a5_default_order(events):
    r = search_memories(events, query="", label="event", depth=0)
    assert seed_ids(r) == [6, 7, 5]


def test_a6_a7_a8_since(events):
    s30, s3 = iso(NOW - timedelta(days=30)), iso(NOW - timedelta(days=3))
    assert sorted(seed_ids(search_memories(events, since_date=s30, depth=0))) == [6, 7]
    assert seed_ids(search_memories(events, since_date=s3, depth=0)) == [6]
    assert sorted(seed_ids(search_memories(events, query="happened", since_date=s30, depth=0))) == [6, 7]


def test_a9_arrays_depth0(spark):
    g = graph_from_records(spark, [(8, ["person"], {
        "name": "Test Developer", "skills": ["Python", "FastAPI", "Docker", "Graphs", "SQL"],
        "interests": ["hiking", "photography", "machine learning"],
        "tags": ["developer", "backend", "ai-enthusiast"], "experience_years": 5})])
    for q in ["Python", "Graphs", "hiking", "backend"]:
        flat = search_memories(g, query=q, depth=0)
        assert seed_ids(flat) == [8]
        nested = nest_result(flat, g, depth=0, part_size=100).collect()
        assert nested[0].connections == []


def test_a10_label_summary(spark):
    g = graph_from_records(spark, [(14, ["person"], {"name": "Alice Test"}), (15, ["place"], {"name": "Test City"}),
                                   (16, ["person"], {"name": "Bob Test"}), (17, ["project"], {"name": "Test Project"})])
    row = stats.label_summary(g.nodes).first()
    assert [(x.label, x["count"]) for x in row.labels] == [("person", 2), ("place", 1), ("project", 1)]
    assert row.totalMemories == 4


def test_c21_empty_label_summary(spark):
    g = graph_from_records(spark, [(1, [], {"name": "x"})])
    row = stats.label_summary(g.nodes.where("false")).first()
    assert row.labels == [] and row.totalMemories == 0


def props_of(g, memory_id):
    r = g.nodes.where(F.col("memory_id") == memory_id).first()
    return {k: (v.text if v.kind != "number" else v.num) for k, v in r.props.items()}


def test_a11_c16_update_memory(spark):
    g = graph_from_records(spark, [(18, ["person"], {"name": "TestPerson", "age": 25}),
                                   (19, ["x"], {"a": 1, "c": 3})])
    req = local_props(spark, [(1, 18, {"job_title": "Senior Engineer", "department": "Engineering"}),
                              (2, 19, {"a": None, "b": 2}), (3, 99, {"a": 1})], "req_id bigint, memory_id bigint")
    ch = mutate.update_memories(g, req)
    assert props_of(ch.graph, 18) == {"name": "TestPerson", "age": 25.0, "job_title": "Senior Engineer",
                                      "department": "Engineering"}
    assert props_of(ch.graph, 19) == {"c": 3.0, "b": 2.0}
    st = {r.req_id: r.status for r in ch.result.collect()}
    assert st == {1: "applied", 2: "applied", 3: "no_match"}
    # derived text follows the new properties
    assert "senior engineer" in ch.graph.nodes.where("memory_id = 18").first().search_text


def test_a12_update_connection(spark):
    g = graph_from_records(spark, [(1, ["person"], {"name": "TestEmployee"}), (2, ["company"], {"name": "TestCompany"})],
                           [(10, 1, 2, "WORKS_AT", {"role": "Engineer", "since": "2020", "created_at": "2024"}),
                            (11, 1, 2, "WORKS_AT", {"role": "Engineer"})])
    req = local_props(spark, [(1, 1, 2, "WORKS_AT", {"role": "Senior Engineer", "since": "2020", "promoted": "2024"})],
                      "req_id bigint, from_id bigint, to_id bigint, type string")
    ch = mutate.update_connections(g, req)
    e = {r.edge_id: {k: v.text for k, v in r.props.items()} for r in ch.graph.edges.collect()}
    assert e[10] == {"role": "Senior Engineer", "since": "2020", "created_at": "2024", "promoted": "2024"}
    assert e[11]["role"] == "Senior Engineer"
    r = ch.result.first()
    assert (r.n_matched, r.edge_id, r.status) == (2, 10, "applied")


def test_a13_c20_delete_connection(spark):
    g = graph_from_records(spark, [(1, ["a"], {}), (2, ["b"], {})],
                           [(1, 1, 2, "LIVES_IN", {}), (2, 1, 2, "LIVES_IN", {}), (3, 1, 2, "LIVES_IN", {}),
                            (4, 2, 1, "LIVES_IN", {})])
    req = local_props(spark, [(1, 1, 2, "LIVES_IN", None), (2, 1, 2, "LIVES_IN", None)],
                      "req_id bigint, from_id bigint, to_id bigint, type string").drop("props")
    ch = mutate.delete_connections(g, req)
    assert sorted(ids(ch.graph.edges, "edge_id")) == [4]
    assert ch.graph.nodes.count() == 2
    assert {r.req_id: r.deletedCount for r in ch.result.collect()} == {1: 3, 2: 0}


def test_c19_detach_delete(spark):
    g = graph_from_records(spark, [(1, ["a"], {}), (2, ["b"], {}), (3, ["c"], {})],
                           [(1, 1, 2, "X", {}), (2, 3, 1, "Y", {}), (3, 2, 3, "Z", {})])
    req = spark.createDataFrame([(1, 1), (2, 1), (3, 42)], "req_id bigint, memory_id bigint")
    ch = mutate.delete_memories(g, req)
    assert sorted(ids(ch.graph.nodes)) == [2, 3]
    assert ids(ch.graph.edges, "edge_id") == [3]
    assert {r.req_id: r.deletedCount for r in ch.result.collect()} == {1: 1, 2: 0, 3: 0}


def test_c15_create_default_created_at(spark):
    g = graph_from_records(spark, [(1, ["a"], {})])
    req = local_props(spark, [(1, 100, "note", {"created_at": ""}), (2, 101, "note", {"created_at": 0}),
                              (3, 102, "note", {"x": 1}), (4, 103, "note", {"created_at": "2024-05-05"}),
                              (5, 104, "note", {"created_at": False})],
                      "req_id bigint, memory_id bigint, label string")
    ch = mutate.create_memories(g, req, now="2026-01-01T00:00:00.000Z")
    got = {r.memory_id: r.created_at for r in ch.graph.nodes.where("memory_id >= 100").collect()}
    assert got == {100: "2026-01-01T00:00:00.000Z", 101: "2026-01-01T00:00:00.000Z",
                   102: "2026-01-01T00:00:00.000Z", 103: "2024-05-05", 104: "2026-01-01T00:00:00.000Z"}


def test_create_assigns_fresh_ids(spark):
    g = graph_from_records(spark, [(7, ["a"], {})])
    req = local_props(spark, [(1, "n", {"name": "x"}), (2, "n", {"name": "y"})], "req_id bigint, label string")
    ch = mutate.create_memories(g, req, now="2026-01-01T00:00:00.000Z")
    new = ids(ch.result)
    assert len(set(new)) == 2 and min(new) > 7
    assert ch.graph.nodes.count() == 3


def test_c17_c18_connect(spark):
    g = graph_from_records(spark, [(1, ["a"], {}), (2, ["b"], {})])
    req = local_props(spark, [(1, 50, 1, 2, "KNOWS", None), (2, 51, 1, 2, "KNOWS", {"since": "2020"}),
                              (3, 52, 1, 99, "KNOWS", None), (4, 53, 1, 1, "SELF", None)],
                      "req_id bigint, edge_id bigint, from_id bigint, to_id bigint, type string")
    ch = mutate.create_connections(g, req, now="2026-01-01T00:00:00.000Z")
    e = {r.edge_id: sorted(r.props.keys()) for r in ch.graph.edges.collect()}
    assert e == {50: ["created_at"], 51: ["since"], 53: ["created_at"]}
    assert {r.req_id: r.status for r in ch.result.collect()} == {1: "created", 2: "created", 3: "no_match",
                                                                4: "created"}


def trails(g, seed, depth):
    seeds = g.nodes.where(F.col("memory_id") == seed).select("memory_id")
    r = expand(seeds, adjacency(g.edges), depth, seeds_small=True)
    return sorted((x.related_id, x.first_edge, x.distance) for x in r.collect())


def test_c1_triangle(spark):
    g = graph_from_records(spark, [(1, ["n"], {}), (2, ["n"], {}), (3, ["n"], {})],
                           [(1, 1, 2, "E", {}), (2, 2, 3, "E", {}), (3, 3, 1, "E", {})])
    a, b, c = 1, 2, 3
    assert trails(g, a, 3) == sorted([(b, 1, 1), (c, 3, 1), (c, 1, 2), (b, 3, 2), (a, 1, 3), (a, 3, 3)])


def test_c2_parallel(spark):
    g = graph_from_records(spark, [(1, ["n"], {}), (2, ["n"], {})], [(1, 1, 2, "E", {}), (2, 1, 2, "E", {})])
    assert trails(g, 1, 2) == sorted([(2, 1, 1), (2, 2, 1), (1, 1, 2), (1, 2, 2)])


def test_c3_self_loop(spark):
    g = graph_from_records(spark, [(1, ["n"], {})], [(1, 1, 1, "E", {})])
    assert trails(g, 1, 1) == [(1, 1, 1)]


def test_c4_isolated(spark):
    g = graph_from_records(spark, [(1, ["n"], {"name": "a"})])
    flat = search_memories(g, depth=1)
    rows = flat.collect()
    assert len(rows) == 1 and rows[0].related_id is None
    nested = nest_result(flat, g, depth=1, part_size=100).first()
    assert len(nested.connections) == 1 and nested.connections[0].memory is None
    nested0 = nest_result(search_memories(g, depth=0), g, depth=0, part_size=100).first()
    assert nested0.connections == []


def test_c5_nulls(spark):
    g = graph_from_records(spark, [(1, ["n"], {"created_at": "2024"}), (2, ["n"], {}),
                                   (3, ["n"], {"created_at": "2023"})])
    assert seed_ids(search_memories(g, depth=0)) == [2, 1, 3]
    assert seed_ids(search_memories(g, order_by="created_at ASC", depth=0)) == [3, 1, 2]


def test_c6_mixed_types(spark):
    g = graph_from_records(spark, [(1, ["n"], {"x": "b"}), (2, ["n"], {"x": 2}), (3, ["n"], {"x": True}),
                                   (4, ["n"], {"x": [1]})])
    assert seed_ids(search_memories(g, order_by="x ASC", depth=0)) == [4, 1, 3, 2]
    assert seed_ids(search_memories(g, order_by="x DESC", depth=0)) == [2, 3, 1, 4]


def test_c7_order_by_parse():
    assert parse_order_by("name").prop == "created_at"
    assert parse_order_by("name1 ASC").prop == "created_at"
    assert parse_order_by("name ASC; x").prop == "created_at"
    spec = parse_order_by("n.name desc")
    assert (spec.prop, spec.descending) == ("name", True)
    with pytest.raises(ValueError):
        parse_order_by("name", strict=True)


def test_c8_limit():
    assert effective_limit(0) == 0 and effective_limit(None) == 10 and effective_limit(500) == 200
    with pytest.raises(ValueError):
        effective_limit(-1)


def test_c9_c10_since_lexical(spark):
    g = graph_from_records(spark, [(1, ["n"], {"created_at": "2024-01-01T00:00:00.000Z"}),
                                   (2, ["n"], {"created_at": "2024-01-01T00:00:00Z"})])
    assert ids(search_candidates(g.nodes, since_date="2024-01-01T00:00:00Z")) == [2]


def test_c11_c12_blank_and_unicode_ws(people):
    for q in ["  ", " ", ""]:
        assert len(ids(search_candidates(people.nodes, q))) == 4
    assert sorted(ids(search_candidates(people.nodes, "ben weeks"))) == [1, 2, 3]


def test_c14_number_text(spark):
    g = graph_from_records(spark, [(1, ["n"], {"age": 25}), (2, ["n"], {"big": 1e7}), (3, ["n"], {"v": 5.0})])
    assert ids(search_candidates(g.nodes, "25")) == [1]
    assert ids(search_candidates(g.nodes, "10000000")) == [2]
    assert ids(search_candidates(g.nodes, "5.0")) == []


def test_number_text_of_extreme_values(spark):
    from mnemo.functions.values import js_number_text
    cases = [(1e-7, "1e-7"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.5e300, "1.5e+300"), (-2.5e-9, "-2.5e-9"), (0.000001, "0.000001"),
             (123456789.125, "123456789.125"), (1e16, "10000000000000000"), (0.1, "0.1"), (-5.0, "-5"), (3.14e-5, "0.0000314")]
    got = spark.createDataFrame(cases, "v double, text string").select(js_number_text(F.col("v")).alias("got"), "text").collect()
    assert [r.got for r in got] == [r.text for r in got]


def test_c22_resolve_tie_break(spark):
    g = graph_from_records(spark, [(12, ["n"], {"name": "x"}), (30, ["n"], {"name": "12"}),
                                   (40, ["n"], {"name": "dup"}), (41, ["n"], {"name": "dup"})])
    req = spark.createDataFrame([(1, "12"), (2, "dup"), (3, "nope")], "req_id bigint, ref string")
    got = {r.req_id: r.memory_id for r in mutate.resolve_name_or_id(g.nodes, req).collect()}
    assert got == {1: 12, 2: 40}
    err = mutate.unresolved_references(g.nodes, req, "ref", "Source").collect()
    assert [(r.req_id, r.error) for r in err] == [(3, "Source memory 'nope' not found")]


def test_remember_and_connect_by_name(spark):
    g = graph_from_records(spark, [(1, ["person"], {"name": "Alice"})])
    req = local_props(spark, [(1, 100, "place", "Paris", "trip", "Alice", {"country": "FR"})],
                      "req_id bigint, memory_id bigint, type string, name string, context string, relates_to string")
    ch = mutate.remember(g, req, now="2026-01-01T00:00:00.000Z")
    n = ch.graph.nodes.where("memory_id = 100").first()
    assert n.labels == ["Place"] and n.props["type"].text == "place" and n.props["country"].text == "FR"
    e = ch.graph.edges.first()
    assert (e.src, e.dst, e.type) == (100, 1, "RELATES_TO")
    req2 = spark.createDataFrame([(1, "Paris", "Alice", "VISITED_BY"), (2, "Paris", "Bob", "KNOWS")],
                                 "req_id bigint, from_ref string, to_ref string, relationship string")
    ch2 = mutate.connect_by_name(ch.graph, req2, now="2026-01-01T00:00:00.000Z")
    res = {r.req_id: (r.status, r.error) for r in ch2.result.collect()}
    assert res == {1: ("created", None), 2: ("error", "Target memory 'Bob' not found")}
    assert ch2.graph.edges.count() == 2


def test_depth_isolated_graph_nested_order(spark):
    g = graph_from_records(spark, [(1, ["n"], {"created_at": "2024"}), (2, ["n"], {"created_at": "2023"})],
                           [(5, 1, 2, "E", {"w": 1})])
    flat = search_memories(g, depth=1)
    nested = nest_result(flat, g, depth=1, part_size=100).collect()
    assert [r.memory._id for r in nested] == [1, 2]
    assert nested[0].connections[0].relationship._type == "E"
    assert nested[1].connections[0].memory._id == 1


def test_c8_limit_zero_and_cap(spark, people):
    assert search_memories(people, limit=0, depth=1).count() == 0
    assert len(seed_ids(search_memories(people, limit=500, depth=0))) == 4
    with pytest.raises(ValueError):
        search_memories(people, depth=1.5)


def test_create_rejects_taken_ids(spark):
    g = graph_from_records(spark, [(7, ["a"], {})], [(70, 7, 7, "E", {})])
    req = local_props(spark, [(1, 7, "n", {}), (2, 8, "n", {}), (3, 8, "n", {})],
                      "req_id bigint, memory_id bigint, label string")
    ch = mutate.create_memories(g, req, now="2026-01-01T00:00:00.000Z")
    assert {r.req_id: r.status for r in ch.result.collect()} == {1: "id_exists", 2: "created", 3: "id_exists"}
    assert sorted(ids(ch.graph.nodes)) == [7, 8]
    creq = local_props(spark, [(1, 70, 7, 7, "E", None), (2, 71, 7, 7, "E", None)],
                       "req_id bigint, edge_id bigint, from_id bigint, to_id bigint, type string")
    ch2 = mutate.create_connections(g, creq, now="2026-01-01T00:00:00.000Z")
    assert {r.req_id: r.status for r in ch2.result.collect()} == {1: "id_exists", 2: "created"}
    assert sorted(ids(ch2.graph.edges, "edge_id")) == [70, 71]


def test_nested_reply_parts(spark):
    g = graph_from_records(spark, [(1, ["hub"], {"name": "h"})] + [(i, ["n"], {}) for i in range(2, 12)],
                           [(100 + i, 1, i, "E", {}) for i in range(2, 12)])
    flat = search_memories(g, label="hub", depth=1)
    rows = nest_result(flat, g, depth=1, part_size=3).collect()
    assert rows[0].parts == 4 and 1 < len(rows) <= 4  # entries spread over up to 4 parts by hash
    assert sorted(c.memory._id for r in rows for c in r.connections) == list(range(2, 12))
    from mnemo.plans.search import reply_json
    import json
    docs = reply_json(flat, g, depth=1, part_size=3).collect()
    assert sorted(c["memory"]["_id"] for d in docs for c in json.loads(d.json)["connections"]) == list(range(2, 12))


def test_changes_on_a_stored_snapshot(spark, tmp_path):
    from mnemo.sources.snapshot import read_graph, write_graph
    g0 = graph_from_records(spark, [(1, ["person"], {"name": "a"}), (2, ["place"], {"name": "b"})],
                            [(10, 1, 2, "AT", {})])
    g = read_graph(spark, write_graph(g0, str(tmp_path / "snap")))
    assert [r.memory_id for r in search_candidates(g.nodes, "a", "person").collect()] == [1]
    req = local_props(spark, [(1, 3, "note", {"name": "c"})], "req_id bigint, memory_id bigint, label string")
    ch = mutate.create_memories(g, req, now="2026-01-01T00:00:00.000Z")
    assert sorted(ids(ch.graph.nodes)) == [1, 2, 3]
    ch2 = mutate.delete_memories(g, spark.createDataFrame([(1, 2)], "req_id bigint, memory_id bigint"))
    assert sorted(ids(ch2.graph.nodes)) == [1] and ch2.graph.edges.count() == 0


def test_bulk_search_batches_of_words_give_same_result(spark, people, monkeypatch):
    from mnemo.plans import bulk
    reqs = spark.createDataFrame([("a", "ben", "person", None, 5), ("b", "engineer", None, None, 2),
                                  ("c", "", None, None, 3), ("d", "zz", None, None, 1), ("e", "Ben engineer ben", None, None, 9)],
                                 "req_key string, query string, label string, since_date string, limit int")
    whole = sorted(tuple(r) for r in bulk.bulk_search(people.nodes, reqs).collect())
    monkeypatch.setattr(bulk, "FEW", 1)      # by trigrams, labels and names not listed
    split = sorted(tuple(r) for r in bulk.bulk_search(people.nodes, reqs).collect())
    assert whole == split and len([r for r in whole if r[0] != "e"]) == 2 + 2 + 3
    # every request equals its single search
    for r in reqs.collect():
        single = seed_ids(search_memories(people, query=r.query, label=r.label, limit=r.limit, depth=0))
        assert [m for k, m, _ in sorted(whole, key=lambda x: x[2]) if k == r.req_key] == single


def test_bulk_plan_has_no_nested_loop_join(spark, people):
    import contextlib
    import io

    from mnemo.plans.bulk import bulk_search
    reqs = spark.createDataFrame([("a", "ben", None, None, 5)], "req_key string, query string, label string, since_date string, limit int")
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        bulk_search(people.nodes, reqs).explain()
    assert "NestedLoop" not in text.getvalue() and "Cartesian" not in text.getvalue()


def test_fresh_ids_neither_collide_nor_come_back(spark, tmp_path):
    from mnemo.operators.delta import apply_delta
    from mnemo.sources.snapshot import read_graph, write_graph
    g = graph_from_records(spark, [(1, ["n"], {}), (2, ["n"], {}), (9, ["n"], {})])
    req = local_props(spark, [(1, None, "n", {}), (2, 10, "n", {}), (3, None, "n", {})], "req_id bigint, memory_id bigint, label string")
    made = {r.req_id: (r.memory_id, r.status) for r in mutate.create_memories(g, req, now="2026").result.collect()}
    assert made[2] == (10, "created") and {s for _, s in made.values()} == {"created"}
    assert len({i for i, _ in made.values()}) == 3 and min(made[1][0], made[3][0]) > 10
    one = local_props(spark, [(1, None, "n", {})], "req_id bigint, memory_id bigint, label string")
    gone = mutate.delete_memories(g, spark.createDataFrame([(1, 9)], "req_id bigint, memory_id bigint")).graph
    assert mutate.create_memories(gone, one, now="2026").result.first().memory_id > 9
    # the mark is stored with a snapshot and survives further ones
    stored = read_graph(spark, write_graph(gone, str(tmp_path / "a")))
    assert (stored.node_high, stored.edge_high) == (9, 0)
    again = read_graph(spark, write_graph(apply_delta(stored, mutate.create_memories(stored, one, now="2026").delta), str(tmp_path / "b")))
    assert again.node_high == 10


def test_snapshots_are_written_once_with_their_adjacency(spark, tmp_path):
    from mnemo.sources.snapshot import read_graph, write_graph
    g = graph_from_records(spark, [(1, ["n"], {}), (2, ["n"], {})], [(5, 1, 2, "E", {}), (6, 2, 2, "E", {})])
    path = write_graph(g, str(tmp_path / "s"))
    assert read_graph(spark, path).adj.count() == 3
    with pytest.raises(Exception, match="exist"):
        write_graph(g, path)


def test_remember_links_inside_a_batch(spark):
    g = graph_from_records(spark, [(1, ["Person"], {"name": "Old"})])
    req = local_props(spark, [(1, 10, "person", "Ann", None, None, {}), (2, 11, "person", "Bob", None, "Ann", {}),
                              (3, 12, "person", "Cid", None, "Dora", {}), (4, 13, "person", "Dora", None, "Old", {}),
                              (5, 14, "person", "Eve", None, "10", {}), (6, 1, "person", "Fay", None, "Old", {})],
                      "req_id bigint, memory_id bigint, type string, name string, context string, relates_to string")
    ch = mutate.remember(g, req, now="2026")
    links = sorted((r.src, r.dst) for r in ch.graph.edges.collect())
    assert links == [(11, 10), (13, 1), (14, 10)]      # Cid comes before Dora
    status = {r.req_id: r.status for r in ch.result.collect()}
    assert status[6] == "id_exists" and set(status.values()) == {"created", "id_exists"}
    assert sorted(ids(ch.graph.nodes)) == [1, 10, 11, 12, 13, 14]


def test_recent_memories_stand_bad_dates(spark):
    from mnemo.operators.filters import recent_memories
    g = graph_from_records(spark, [(1, ["n"], {"created_at": "yesterday"}), (2, ["n"], {"created_at": "2025-05-31T23:00:00Z"}),
                                   (3, ["n"], {"created_at": 5}), (4, ["n"], {"created_at": "2025-05-01"})])
    assert ids(recent_memories(g.nodes, "2025-06-01T00:00:00Z", days=7)) == [2]


def test_number_arrays_keep_their_type_and_order(spark):
    from mnemo.sources.snapshot import pv_json
    g = graph_from_records(spark, [(1, ["n"], {"a": [10]}), (2, ["n"], {"a": [9]}), (3, ["n"], {"a": ["10"]}), (4, ["n"], {"a": [True]}),
                                   (5, ["n"], {"a": [9, 1]}), (6, ["n"], {"a": []}), (7, ["n"], {"a": [1e-7, 1e21]})])
    assert seed_ids(search_memories(g, order_by="a ASC", depth=0)) == [6, 3, 4, 7, 2, 5, 1]
    text = {r.memory_id: r.j for r in g.nodes.select("memory_id", pv_json(F.col("props")["a"]).alias("j")).collect()}
    assert text == {1: "[10]", 2: "[9]", 3: '["10"]', 4: "[true]", 5: "[9,1]", 6: "[]", 7: "[1e-7,1e+21]"}


def test_reply_lines_name_every_connection(spark):
    import json

    from mnemo.plans.search import reply_lines
    g = graph_from_records(spark, [(1, ["n"], {"a": [1]}), (2, ["n"], {}), (3, ["n"], {})], [(5, 1, 2, "E", {"w": 1})])
    rows = {(r.memory_id, r.related_id): json.loads(r.connection) for r in reply_lines(search_memories(g, depth=1), g).collect()}
    assert rows[1, 2] == {"memory": {"_id": 2, "_labels": ["n"]}, "relationship": {"w": 1, "_id": 5, "_type": "E"}, "distance": 1}
    assert rows[3, None] == {"memory": None, "relationship": None, "distance": None}


def test_a_shared_name_and_a_toggled_key_cost_their_rows(spark):
    from mnemo.streaming.replay import replay
    n = 20_000
    nodes = graph_from_records(spark, [(1, ["n"], {"name": "x"}), (2, ["n"], {})])
    same = spark.range(n).select((F.col("id") + 10).alias("memory_id"), F.create_map(F.lit("name"), pv_string(F.lit("x"))).alias("props"))
    req = spark.range(n).select(F.col("id").alias("req_id"), F.lit("x").alias("ref"))
    assert mutate.resolve_name_or_id(same, req).agg(F.min("memory_id"), F.max("memory_id"), F.count("*")).first()[:] == (10, 10, n)
    kinds = F.element_at(F.array(F.lit("create_connection"), F.lit("update_connection"), F.lit("delete_connection")), (F.col("id") % 3 + 1).cast("int"))
    ops = spark.range(3 * n + 1).select(
        F.col("id").alias("seq"), kinds.alias("op"), F.lit(None).cast("bigint").alias("memory_id"), (F.col("id") + 100).alias("edge_id"),
        F.lit(1).cast("bigint").alias("from_id"), F.lit(2).cast("bigint").alias("to_id"), F.lit(None).cast("string").alias("label"),
        F.lit("E").alias("type"), F.create_map(F.lit("k"), pv_string(F.col("id").cast("string"))).alias("props"), F.lit(None).cast("string").alias("now"))
    ch = replay(nodes, ops, "2026")
    assert [(r.edge_id, r.props["k"].text) for r in ch.graph.edges.collect()] == [(3 * n + 100, str(3 * n))]
    assert ch.result.groupBy("op").agg(F.sum("deletedCount"), F.sum("n_matched")).where("op <> 'create_connection'").collect().__len__() == 2
    assert ch.result.agg(F.sum("deletedCount"), F.sum("n_matched")).first()[:] == (n, n)


def test_legacy_recall_rules(spark):
    from mnemo.operators.filters import phrase_search_all_props, recent_memories
    from mnemo.plans.search import recall
    g = graph_from_records(spark, [(1, ["Person"], {"name": "Ann Lee", "created_at": "2025-05-30T00:00:00.000Z"}),
                                   (2, ["person"], {"name": "Ann Roe", "created_at": "2025-01-01T00:00:00.000Z"}),
                                   (3, ["Person"], {"name": "Bob", "context": "met Ann"})],
                           [(9, 1, 3, "KNOWS", {})])
    # the type is capitalised before it is compared with the first label
    assert sorted(ids(phrase_search_all_props(g.nodes, "Ann", "person"))) == [1, 3]
    # case-sensitive phrase, any property
    assert ids(phrase_search_all_props(g.nodes, "ann")) == []
    with pytest.raises(ValueError):
        recall(g, "Ann", order_by="name")                       # strict order_by
    flat = recall(g, "Ann", type_="person", order_by="n.name ASC", depth=0)
    assert seed_ids(flat) == [1, 3] and flat.where("distance = 1").count() == 2   # depth 0 reads as 1
    recent = recent_memories(g.nodes, "2025-06-01T00:00:00Z", days=7)
    assert ids(recent) == [1]
