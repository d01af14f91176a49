"""Registered change jobs, resolution, audits and restructuring, with
their plain-SQL oracles. Request tables are derived from the test tables
by predicates with a meaning in the data (urgent orders, debtors, returned
lines, the highest balances, ...)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemo.functions.values import PROPS_DDL, null_pv, pv_array, pv_boolean, pv_number, pv_string, props_map
from mnemo.operators import audit, mutate
from mnemo.plans.oracle import iso as iso_sql
from mnemo.plans.oracle import jsnum
from mnemo.plans.registry import FLAG_WHERE, g, register, search_sql, seeds_sql, stored, trails_sql
from mnemo.plans.search import search_memories
from mnemo.sources.testgraph import K, contains_line_number, iso, read_table

# The job clock of these change jobs.
NOW = "2026-01-01T00:00:00.000Z"


def _t(spark, sf, name):
    return read_table(spark, sf, name)


# ------------------------------------------------------------------ creates

def _note_requests(spark, sf):
    o = _t(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    created = F.when(F.col("o_orderstatus") == "F", iso(F.col("o_orderdate"))).otherwise(F.lit(""))
    return o.select(F.col("o_orderkey").alias("req_id"), (F.lit(11 * K) + F.col("o_orderkey")).alias("memory_id"),
                    F.lit("note").alias("label"),
                    props_map(("text", pv_string(F.concat(F.lit("follow up "), F.col("o_orderpriority")))),
                              ("status", pv_string(F.col("o_orderstatus"))),
                              ("created_at", pv_string(created))).alias("props"))


@register("create_memories", f"""
, r AS (SELECT o_orderkey AS req_id, CAST({11 * K} AS BIGINT) + o_orderkey AS memory_id, o_orderpriority, o_orderstatus,
        CASE WHEN o_orderstatus = 'F' THEN {iso_sql('o_orderdate')} ELSE '{NOW}' END AS created_at
        FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT req_id, memory_id, 'created' AS status, created_at,
       lower(concat_ws(chr(10), 'follow up ' || o_orderpriority, o_orderstatus, created_at)) AS search_text FROM r""")
def q_create_memories(spark, sf):
    """A follow-up note per urgent order (ids given by the request)."""
    ch = mutate.create_memories(g(spark, sf), _note_requests(spark, sf), NOW)
    return ch.result.join(ch.graph.nodes.select("memory_id", "created_at", "search_text"), "memory_id")


@register("create_default_created_at", f"""
SELECT CAST({11 * K} AS BIGINT) + o_orderkey AS memory_id,
       CASE WHEN o_orderpriority = '5-LOW' THEN {iso_sql('o_orderdate')} ELSE '{NOW}' END AS created_at FROM orders""")
def q_create_default_created_at(spark, sf):
    """created_at given as '', 0, false, absent or a date, by priority."""
    o = _t(spark, sf, "orders")
    p = F.col("o_orderpriority")
    created = (F.when(p == "1-URGENT", pv_string(F.lit(""))).when(p == "2-HIGH", pv_number(F.lit(0)))
               .when(p == "3-MEDIUM", pv_boolean(F.lit(False))).when(p == "5-LOW", pv_string(iso(F.col("o_orderdate")))))
    req = o.select(F.col("o_orderkey").alias("req_id"), (F.lit(11 * K) + F.col("o_orderkey")).alias("memory_id"),
                   F.lit("note").alias("label"),
                   props_map(("priority", pv_string(p)), ("created_at", created)).alias("props"))
    ch = mutate.create_memories(g(spark, sf), req, NOW)
    return ch.graph.nodes.where(F.col("first_label") == "note").select("memory_id", "created_at")


def _connection_requests(spark, sf):
    o = _t(spark, sf, "orders")
    to = F.when(F.col("o_orderstatus") == "P", F.lit(-1)).otherwise(F.lit(6 * K) + F.col("o_orderkey"))
    props = F.when(F.col("o_orderpriority") != "1-URGENT",
                   props_map(("priority", pv_string(F.col("o_orderpriority"))))).otherwise(
        F.lit(None).cast(PROPS_DDL))
    return o.select(F.col("o_orderkey").alias("req_id"), (F.lit(12 * K) + F.col("o_orderkey")).alias("edge_id"),
                    (F.lit(3 * K) + F.col("o_custkey")).alias("from_id"), to.alias("to_id"),
                    F.lit("ORDERED").alias("type"), props.alias("props"))


@register("create_connections", f"""
SELECT o_orderkey AS req_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST({12 * K} AS BIGINT) + o_orderkey END
       AS edge_id, CASE WHEN o_orderstatus = 'P' THEN 'no_match' ELSE 'created' END AS status,
       CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'created_at'
            ELSE 'priority' END AS prop_keys FROM orders""")
def q_create_connections(spark, sf):
    """Customer -> order per order; pending orders name a missing node;
    urgent ones give no properties (so they get created_at)."""
    ch = mutate.create_connections(g(spark, sf), _connection_requests(spark, sf), NOW)
    keys = ch.graph.edges.select("edge_id", F.array_join(F.array_sort(F.map_keys("props")), ",").alias("prop_keys"))
    return ch.result.join(keys, "edge_id", "left").select("req_id", "edge_id", "status", "prop_keys")


@register("create_connection_defaults", f"""
SELECT CAST({12 * K} AS BIGINT) + o_orderkey AS edge_id,
       CASE WHEN o_orderpriority = '1-URGENT' THEN '{NOW}' END AS created_at,
       CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS priority
FROM orders WHERE o_orderstatus <> 'P'""")
def q_create_connection_defaults(spark, sf):
    """Created connections: ``{created_at: now}`` only where no properties
    were given; given properties get no timestamp."""
    ch = mutate.create_connections(g(spark, sf), _connection_requests(spark, sf), NOW)
    p = F.col("props")
    return ch.graph.edges.where(F.col("type") == "ORDERED").select(
        "edge_id", p["created_at"]["text"].alias("created_at"), p["priority"]["text"].alias("priority"))


@register("resolve_endpoints", f"""
SELECT o_orderkey AS req_id, CAST({3 * K} AS BIGINT) + o_custkey AS from_id, CAST({6 * K} AS BIGINT) + o_orderkey AS to_id
FROM orders WHERE o_orderstatus <> 'P'""")
def q_resolve_endpoints(spark, sf):
    """Connection requests whose two ends both exist."""
    nodes = g(spark, sf).nodes.select("memory_id")
    req = _connection_requests(spark, sf)
    return (req.join(nodes.withColumnRenamed("memory_id", "from_id"), "from_id")
            .join(nodes.withColumnRenamed("memory_id", "to_id"), "to_id").select("req_id", "from_id", "to_id"))


@register("create_memory_reply", f"""
SELECT o_orderkey AS req_id, '{{"memory":{{"text":"follow up ' || o_orderpriority || '","status":"' || o_orderstatus || '","created_at":"' ||
       CASE WHEN o_orderstatus = 'F' THEN {iso_sql('o_orderdate')} ELSE '{NOW}' END || '","_id":' ||
       CAST(CAST({11 * K} AS BIGINT) + o_orderkey AS VARCHAR) || ',"_labels":["note"]}}}}' AS json
FROM orders WHERE o_orderpriority = '1-URGENT'""")
def q_create_memory_reply(spark, sf):
    """The reply of each create: the whole new record."""
    return mutate.memory_reply(mutate.create_memories(g(spark, sf), _note_requests(spark, sf), NOW))


@register("create_connection_reply", f"""
SELECT o_orderkey AS req_id, '{{"relationship":{{' || CASE WHEN o_orderpriority = '1-URGENT' THEN '"created_at":"{NOW}"'
       ELSE '"priority":"' || o_orderpriority || '"' END || ',"_id":' || CAST(CAST({12 * K} AS BIGINT) + o_orderkey AS VARCHAR) ||
       ',"_type":"ORDERED"}}}}' AS json FROM orders WHERE o_orderstatus <> 'P'""")
def q_create_connection_reply(spark, sf):
    return mutate.connection_reply(mutate.create_connections(g(spark, sf), _connection_requests(spark, sf), NOW))


# ------------------------------------------------------------------ updates

def _debtor_updates(spark, sf):
    c = _t(spark, sf, "customer")
    debt = c.where(F.col("c_acctbal") < 0).select(
        F.col("c_custkey").alias("req_id"), (F.lit(3 * K) + F.col("c_custkey")).alias("memory_id"),
        F.create_map(F.lit("tier"), pv_string(F.lit("watch")), F.lit("mktsegment"), null_pv()).alias("props"))
    missing = c.where(F.col("c_acctbal") > 9000).select(
        (F.lit(10 ** 9) + F.col("c_custkey")).alias("req_id"),
        (F.lit(3 * K + 10 ** 9) + F.col("c_custkey")).alias("memory_id"),
        F.create_map(F.lit("tier"), pv_string(F.lit("gold"))).alias("props"))
    return debt.unionByName(missing)


@register("update_memories", f"""
SELECT c_custkey AS req_id, CAST({3 * K} AS BIGINT) + c_custkey AS memory_id, 'applied' AS status,
       lower(concat_ws(chr(10), c_name, {jsnum('c_acctbal')}, 'watch')) AS search_text FROM customer WHERE c_acctbal < 0
UNION ALL
SELECT 1000000000 + c_custkey, CAST({3 * K + 10 ** 9} AS BIGINT) + c_custkey, 'no_match', NULL
FROM customer WHERE c_acctbal > 9000""")
def q_update_memories(spark, sf):
    """Debtors get tier 'watch' and lose mktsegment; ids that do not exist
    report no_match."""
    ch = mutate.update_memories(g(spark, sf), _debtor_updates(spark, sf))
    return ch.result.join(ch.graph.nodes.select("memory_id", "search_text"), "memory_id", "left")


@register("update_memory_reply", f"""
SELECT c_custkey AS req_id, '{{"memory":{{"name":"' || c_name || '","acctbal":' || {jsnum('c_acctbal')} || ',"tier":"watch","_id":' ||
       CAST(CAST({3 * K} AS BIGINT) + c_custkey AS VARCHAR) || ',"_labels":["customer","debtor"]}}}}' AS json
FROM customer WHERE c_acctbal < 0""")
def q_update_memory_reply(spark, sf):
    """The reply of each update that found its memory: the merged record."""
    return mutate.memory_reply(mutate.update_memories(g(spark, sf), _debtor_updates(spark, sf)))


LINES_SQL = f"""
, li AS (SELECT l_orderkey, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey
         ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem),
keyed AS (SELECT l_orderkey * 1000 + rn AS req_id, CAST({6 * K} AS BIGINT) + l_orderkey AS from_id,
          CAST({5 * K} AS BIGINT) + l_partkey AS to_id, 'CONTAINS' AS type, l_returnflag FROM li)"""


@register("update_connections", LINES_SQL + """,
r AS (SELECT * FROM keyed WHERE l_returnflag = 'R'),
nreq AS (SELECT from_id, to_id, count(*) AS nr FROM r GROUP BY 1, 2),
eid AS (SELECT src AS from_id, dst AS to_id, count(*) AS ne, min(edge_id) AS min_edge FROM edges
        WHERE type = 'CONTAINS' GROUP BY 1, 2)
SELECT r.req_id, r.from_id, r.to_id, r.type,
       CASE WHEN n.nr > 1 THEN 0 ELSE eid.ne END AS n_matched,
       CASE WHEN n.nr > 1 THEN NULL ELSE eid.min_edge END AS edge_id,
       CASE WHEN n.nr > 1 THEN 'rejected_duplicate' ELSE 'applied' END AS status
FROM r JOIN nreq n USING (from_id, to_id) JOIN eid USING (from_id, to_id)""")
def q_update_connections(spark, sf):
    """Returned lines mark their CONTAINS connections (every parallel edge
    of the pair); two requests on one pair are rejected as duplicates."""
    return mutate.update_connections(g(spark, sf), _line_updates(spark, sf)).result


def _line_updates(spark, sf):
    li = _t(spark, sf, "lineitem").withColumn("rn", contains_line_number()).where(F.col("l_returnflag") == "R")
    return li.select((F.col("l_orderkey") * 1000 + F.col("rn")).alias("req_id"),
                    (F.lit(6 * K) + F.col("l_orderkey")).alias("from_id"),
                    (F.lit(5 * K) + F.col("l_partkey")).alias("to_id"), F.lit("CONTAINS").alias("type"),
                    F.create_map(F.lit("returnflag"), pv_string(F.lit("R-checked")),
                                 F.lit("discount"), null_pv()).alias("props"))


@register("update_connections_rows", LINES_SQL.replace("l_returnflag FROM li)", "l_returnflag, l_linenumber FROM li)").replace(
    "SELECT l_orderkey, l_partkey, l_returnflag, row_number()", "SELECT l_orderkey, l_partkey, l_returnflag, l_linenumber, row_number()") + """,
once AS (SELECT from_id, to_id FROM keyed WHERE l_returnflag = 'R' GROUP BY 1, 2 HAVING count(*) = 1)
SELECT e.edge_id, e.src, e.dst, e.type, TRUE AS checked, CAST(0 AS BIGINT) AS with_discount
FROM edges e JOIN once o ON o.from_id = e.src AND o.to_id = e.dst WHERE e.type = 'CONTAINS'""")
def q_update_connections_rows(spark, sf):
    """The connections after the update above: every parallel one of an
    accepted pair is marked and has lost its discount; no other is."""
    rows = mutate.update_connections(g(spark, sf), _line_updates(spark, sf)).graph.edges
    p = F.col("props")
    marked = rows.where(p["returnflag"]["text"] == "R-checked")
    return marked.select("edge_id", "src", "dst", "type", (p["returnflag"]["kind"] == "string").alias("checked"),
                         F.when(p["discount"].isNotNull(), 1).otherwise(0).cast("bigint").alias("with_discount"))


# ------------------------------------------------------------------ deletes

def _delete_requests(spark, sf):
    c = _t(spark, sf, "customer").where(F.col("c_acctbal") > 9890)
    first = c.select(F.col("c_custkey").alias("req_id"), (F.lit(3 * K) + F.col("c_custkey")).alias("memory_id"))
    again = c.select((F.lit(10 ** 9) + F.col("c_custkey")).alias("req_id"),
                     (F.lit(3 * K) + F.col("c_custkey")).alias("memory_id"))
    missing = _t(spark, sf, "nation").select((F.lit(2 * 10 ** 9) + F.col("n_nationkey")).alias("req_id"),
                                             (F.lit(-1) - F.col("n_nationkey")).alias("memory_id"))
    return first.unionByName(again).unionByName(missing)


@register("delete_counts", f"""
SELECT c_custkey AS req_id, CAST({3 * K} AS BIGINT) + c_custkey AS memory_id, 1 AS deletedCount
FROM customer WHERE c_acctbal > 9890
UNION ALL SELECT 1000000000 + c_custkey, CAST({3 * K} AS BIGINT) + c_custkey, 0 FROM customer WHERE c_acctbal > 9890
UNION ALL SELECT 2000000000 + n_nationkey, -1 - n_nationkey, 0 FROM nation""")
def q_delete_counts(spark, sf):
    """deletedCount per request: 1 for the first request naming an
    existing node, 0 for repeats and unknown ids."""
    return mutate.delete_memories(g(spark, sf), _delete_requests(spark, sf)).result


@register("delete_memories", f"""
, gone AS (SELECT CAST({3 * K} AS BIGINT) + c_custkey AS id FROM customer WHERE c_acctbal > 9890)
SELECT 'edge' AS kind, edge_id AS id FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'node', memory_id FROM nodes WHERE memory_id NOT IN (SELECT id FROM gone)""")
def q_delete_memories(spark, sf):
    """Detach-delete the customers with the highest balances (about 1%):
    every remaining node and connection."""
    return _graph_ids(mutate.delete_memories(g(spark, sf), _delete_requests(spark, sf)).graph)


def _graph_ids(graph):
    return graph.edges.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id")).unionByName(
        graph.nodes.select(F.lit("node").alias("kind"), F.col("memory_id").alias("id")))


@register("delete_memories_delta", f"""
, gone AS (SELECT CAST({3 * K} AS BIGINT) + c_custkey AS id FROM customer WHERE c_acctbal > 9890)
SELECT 'edge' AS kind, edge_id AS id FROM edges WHERE src IN (SELECT id FROM gone) OR dst IN (SELECT id FROM gone)
UNION ALL SELECT 'node', id FROM gone""")
def q_delete_memories_delta(spark, sf):
    """What the same deletion writes: the ids that go, nothing else."""
    d = mutate.delete_memories(g(spark, sf), _delete_requests(spark, sf)).delta
    return d.edge_deletes.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id")).unionByName(
        d.node_deletes.select(F.lit("node").alias("kind"), F.col("memory_id").alias("id")))


PARALLEL_KEYS_SQL = f"""
, pk AS (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1),
dreq AS (SELECT l_orderkey * 100000 + l_partkey AS req_id, CAST({6 * K} AS BIGINT) + l_orderkey AS from_id,
         CAST({5 * K} AS BIGINT) + l_partkey AS to_id, 'CONTAINS' AS type, 1 AS first FROM pk
         UNION ALL SELECT 1000000000000 + l_orderkey * 100000 + l_partkey, CAST({6 * K} AS BIGINT) + l_orderkey,
         CAST({5 * K} AS BIGINT) + l_partkey, 'CONTAINS', 0 FROM pk
         JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT')"""


def _parallel_delete_requests(spark, sf):
    pk = _t(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n")) \
        .where("n > 1")
    base = lambda extra: pk.select(
        (F.lit(extra) + F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("req_id"),
        (F.lit(6 * K) + F.col("l_orderkey")).alias("from_id"), (F.lit(5 * K) + F.col("l_partkey")).alias("to_id"),
        F.lit("CONTAINS").alias("type"), "l_orderkey")
    urgent = _t(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT") \
        .select(F.col("o_orderkey").alias("l_orderkey"))
    again = base(10 ** 12).join(urgent, "l_orderkey", "left_semi")
    return base(0).unionByName(again).drop("l_orderkey")


@register("delete_connections", PARALLEL_KEYS_SQL + """,
cnt AS (SELECT src AS from_id, dst AS to_id, count(*) AS n FROM edges WHERE type = 'CONTAINS' GROUP BY 1, 2)
SELECT d.req_id, d.from_id, d.to_id, d.type, CAST(CASE WHEN d.first = 1 THEN c.n ELSE 0 END AS BIGINT) AS deletedCount
FROM dreq d JOIN cnt c USING (from_id, to_id)""")
def q_delete_connections(spark, sf):
    """Delete the parallel CONTAINS connections of each (order, part) pair;
    urgent orders repeat the request (deletedCount 0)."""
    return mutate.delete_connections(g(spark, sf), _parallel_delete_requests(spark, sf)).result


@register("delete_connections_rows", PARALLEL_KEYS_SQL + """
SELECT e.edge_id, e.src, e.dst, e.type FROM edges e
WHERE NOT (e.type = 'CONTAINS' AND EXISTS (SELECT 1 FROM dreq d WHERE d.from_id = e.src AND d.to_id = e.dst))""")
def q_delete_connections_rows(spark, sf):
    """Every connection that remains after the deletion above."""
    return mutate.delete_connections(g(spark, sf), _parallel_delete_requests(spark, sf)).graph.edges.select("edge_id", "src", "dst", "type")


# ------------------------------------------------------------------ resolution (legacy)

def _resolve_requests(spark, sf):
    c, n = _t(spark, sf, "customer"), _t(spark, sf, "nation")
    by_nation = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("req_id"), F.col("n_name").alias("ref"))
    parts = _t(spark, sf, "part").select((F.lit(10 ** 7) + F.col("p_partkey")).alias("req_id"),
                                         F.col("p_name").alias("ref"))
    urgent = _t(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(
        (F.lit(2 * 10 ** 7) + F.col("o_orderkey")).alias("req_id"), F.col("o_orderpriority").alias("ref"))
    sup = _t(spark, sf, "supplier").select((F.lit(3 * 10 ** 7) + F.col("s_suppkey")).alias("req_id"),
                                           (F.lit(4 * K) + F.col("s_suppkey")).cast("string").alias("ref"))
    return by_nation.unionByName(parts).unionByName(urgent).unionByName(sup)


RESOLVE_REQ_SQL = f"""
, rq AS (SELECT c_custkey AS req_id, n_name AS ref FROM customer JOIN nation ON c_nationkey = n_nationkey
         UNION ALL SELECT 10000000 + p_partkey, p_name FROM part
         UNION ALL SELECT 20000000 + o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'
         UNION ALL SELECT 30000000 + s_suppkey, CAST(CAST({4 * K} AS BIGINT) + s_suppkey AS VARCHAR) FROM supplier),
hits AS (SELECT rq.req_id, p.memory_id FROM rq JOIN props_long p ON p.key = 'name' AND p.kind = 'string'
         AND p.text = rq.ref
         UNION ALL SELECT rq.req_id, n.memory_id FROM rq JOIN nodes n
         ON n.memory_id = TRY_CAST(TRY_CAST(rq.ref AS DOUBLE) AS BIGINT)),
res AS (SELECT req_id, min(memory_id) AS memory_id FROM hits GROUP BY req_id)"""


@register("resolve_name_or_id", RESOLVE_REQ_SQL + "\nSELECT req_id, memory_id FROM res")
def q_resolve_name_or_id(spark, sf):
    """By name (nation names, part names shared by several parts -> lowest
    id) or by id text (suppliers)."""
    return mutate.resolve_name_or_id(g(spark, sf).nodes, _resolve_requests(spark, sf))


@register("unresolved_references", RESOLVE_REQ_SQL + """
SELECT req_id, 'Source memory ''' || ref || ''' not found' AS error FROM rq WHERE req_id NOT IN (SELECT req_id FROM res)""")
def q_unresolved_references(spark, sf):
    return mutate.unresolved_references(g(spark, sf).nodes, _resolve_requests(spark, sf), "ref", "Source")


def _remember_requests(spark, sf):
    s = _t(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("req_id"), (F.lit(13 * K) + F.col("s_suppkey")).alias("memory_id"),
                    F.lit("vendor").alias("type"), F.concat(F.col("s_name"), F.lit(" contact")).alias("name"),
                    F.lit("supplier directory").alias("context"),
                    props_map(("acctbal", pv_number(F.col("s_acctbal")))).alias("props"),
                    F.col("s_name").alias("relates_to"))


@register("remember_batch", f"""
SELECT s_suppkey AS req_id, CAST({13 * K} AS BIGINT) + s_suppkey AS memory_id, 'Vendor' AS label, TRUE AS has_link,
       lower(concat_ws(chr(10), 'vendor', '{NOW}', s_name || ' contact', 'supplier directory', {jsnum('s_acctbal')}))
       AS search_text FROM supplier""")
def q_remember_batch(spark, sf):
    """Legacy remember: a 'Vendor' contact per supplier, linked to it by
    RELATES_TO through the supplier's name."""
    ch = mutate.remember(g(spark, sf), _remember_requests(spark, sf), NOW)
    new = ch.graph.nodes.select("memory_id", F.col("first_label").alias("label"), "search_text")
    return ch.result.join(new, "memory_id").select(
        "req_id", "memory_id", "label", F.col("relates_to_edge").isNotNull().alias("has_link"), "search_text")


def _connect_requests(spark, sf):
    c, n = _t(spark, sf, "customer"), _t(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("req_id"), F.col("c_name").alias("from_ref"),
        F.when(F.col("c_acctbal") >= 0, F.col("n_name")).otherwise(F.lit("Atlantis")).alias("to_ref"),
        F.lit("resides_in").alias("relationship"))


@register("connect_by_name", """
SELECT c_custkey AS req_id, CASE WHEN c_acctbal >= 0 THEN 'created' ELSE 'error' END AS status,
       CASE WHEN c_acctbal >= 0 THEN NULL ELSE 'Target memory ''Atlantis'' not found' END AS error FROM customer""")
def q_connect_by_name(spark, sf):
    """Legacy connect_memories by names; debtors name an unknown place."""
    return mutate.connect_by_name(g(spark, sf), _connect_requests(spark, sf), NOW).result.select(
        "req_id", "status", "error")


# ------------------------------------------------------------------ audits and restructuring

@register("audit_label_case", """
SELECT 'Vendor' AS label, CAST(count(*) AS BIGINT) AS count FROM supplier""")
def q_audit_label_case(spark, sf):
    """Labels not in lower case, after the legacy remember job (which
    capitalises them)."""
    ch = mutate.remember(g(spark, sf), _remember_requests(spark, sf), NOW)
    return audit.audit_label_case(ch.graph.nodes)


@register("audit_type_case", """
SELECT 'resides_in' AS type, CAST(count(*) AS BIGINT) AS count FROM customer WHERE c_acctbal >= 0""")
def q_audit_type_case(spark, sf):
    """Connection types not in UPPERCASE, after connecting by name with a
    lower-case type."""
    ch = mutate.connect_by_name(g(spark, sf), _connect_requests(spark, sf), NOW)
    return audit.audit_type_case(ch.graph.edges)


@register("audit_isolated", """
SELECT memory_id, first_label FROM nodes WHERE memory_id NOT IN (SELECT src FROM edges)
AND memory_id NOT IN (SELECT dst FROM edges)""")
def q_audit_isolated(spark, sf):
    return audit.audit_isolated(g(spark, sf))


@register("audit_duplicate_names", """
SELECT first_label AS label, lower(trim(name)) AS norm_name, CAST(count(*) AS BIGINT) AS n, min(memory_id) AS first_id
FROM nodes WHERE name IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def q_audit_duplicate_names(spark, sf):
    return audit.audit_duplicate_names(g(spark, sf).nodes)


@register("audit_missing_name", """
SELECT first_label AS label, CAST(count(*) AS BIGINT) AS n FROM nodes WHERE name IS NULL GROUP BY 1""")
def q_audit_missing_name(spark, sf):
    return audit.audit_missing_name(g(spark, sf).nodes)


@register("connection_patterns", """
SELECT s.first_label AS src_label, e.type, d.first_label AS dst_label, CAST(count(*) AS BIGINT) AS count
FROM edges e JOIN nodes s ON s.memory_id = e.src JOIN nodes d ON d.memory_id = e.dst GROUP BY 1, 2, 3""")
def q_connection_patterns(spark, sf):
    return audit.connection_patterns(g(spark, sf))


@register("promote_property", """
SELECT c_mktsegment AS segment, CAST(count(*) AS BIGINT) AS members, CAST(0 AS BIGINT) AS still_holding
FROM customer GROUP BY 1""")
def q_promote_property(spark, sf):
    """Market segments of customers become 'segment' nodes with IN_SEGMENT
    connections; the property leaves the customers."""
    graph = audit.promote_property(g(spark, sf), "mktsegment", "customer", "segment", "IN_SEGMENT")
    seg = graph.nodes.where(F.col("first_label") == "segment").select(
        F.col("memory_id").alias("dst"), F.col("props")["name"]["text"].alias("segment"))
    members = graph.edges.where(F.col("type") == "IN_SEGMENT").join(seg, "dst").groupBy("segment") \
        .agg(F.count(F.lit(1)).alias("members"))
    holding = graph.nodes.where((F.col("first_label") == "customer") & F.col("props")["mktsegment"].isNotNull()) \
        .agg(F.count(F.lit(1)).alias("still_holding"))
    # one scalar, computed first and attached as a literal
    return members.withColumn("still_holding", F.lit(holding.first()[0]).cast("bigint"))


@register("migrate_content_to_name", """
SELECT n.memory_id, coalesce(n.name, t.text) AS name,
       CASE WHEN n.name IS NULL THEN NULL ELSE t.text END AS text, length(n.search_text) AS text_length
FROM nodes n LEFT JOIN (SELECT memory_id, text FROM props_long WHERE key = 'text') t USING (memory_id)""")
def q_migrate_content_to_name(spark, sf):
    """Move the legacy text property to ``name`` where a node has none
    (documents and messages): every node's name and old key afterwards."""
    graph = audit.migrate_property(g(spark, sf), "text", "name")
    p = F.col("props")
    return graph.nodes.select("memory_id", p["name"]["text"].alias("name"), p["text"]["text"].alias("text"),
                              F.length("search_text").cast("bigint").alias("text_length"))


# ------------------------------------------------------------------ mixed-type order

def _ranked_customers(spark, sf):
    c = _t(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    rank = (F.when(seg == "AUTOMOBILE", pv_string(F.col("c_name")))
            .when(seg == "BUILDING", pv_number(F.col("c_acctbal")))
            .when(seg == "FURNITURE", pv_boolean(F.col("c_acctbal") > 0))
            .when(seg == "MACHINERY", pv_array(F.array(seg, F.col("c_name")))))
    req = c.select(F.col("c_custkey").alias("req_id"), (F.lit(3 * K) + F.col("c_custkey")).alias("memory_id"),
                   F.create_map(F.lit("rank"), rank).alias("props"))
    return mutate.update_memories(g(spark, sf), req).graph


MIXED_SOURCE = f"""(SELECT n.*, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'AUTOMOBILE' THEN 1 WHEN 'FURNITURE' THEN 2
    WHEN 'BUILDING' THEN 3 END AS rk, CASE WHEN c_mktsegment = 'MACHINERY' THEN [c_mktsegment, c_name] END AS ritems,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN c_name WHEN 'FURNITURE' THEN CAST(c_acctbal > 0 AS VARCHAR) END AS rtext,
    CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS rnum
    FROM nodes n JOIN customer ON n.memory_id = CAST({3 * K} AS BIGINT) + c_custkey) nn"""
MIXED_WHERE = "first_label = 'customer'"


@register("topk_mixed_types", search_sql(MIXED_WHERE, 200, 0, order=(
    "rk ASC NULLS LAST, ritems ASC NULLS LAST, rtext ASC NULLS LAST, rnum ASC NULLS LAST, memory_id"),
    source=MIXED_SOURCE))
def q_topk_mixed_types(spark, sf):
    """A property holding arrays, strings, booleans and numbers (set per
    market segment), ascending: arrays < strings < booleans < numbers < missing."""
    graph = _ranked_customers(spark, sf)
    return search_memories(graph, label="customer", order_by="rank ASC",
                           limit=200, depth=0)


@register("topk_mixed_types_desc", search_sql(MIXED_WHERE, 200, 0, order=(
    "rk DESC NULLS FIRST, ritems DESC NULLS FIRST, rtext DESC NULLS FIRST, rnum DESC NULLS FIRST, memory_id"),
    source=MIXED_SOURCE))
def q_topk_mixed_types_desc(spark, sf):
    """Same, descending: missing values first, then numbers, ..."""
    graph = _ranked_customers(spark, sf)
    return search_memories(graph, label="customer", order_by="rank DESC",
                           limit=200, depth=0)



def _number_lists(spark, sf):
    """Parts with an array property: [size, -size] by number, as text, or of
    booleans, by brand."""
    p = _t(spark, sf, "part")
    size = F.col("p_size").cast("double")
    kind = F.pmod(F.col("p_partkey"), F.lit(3))
    value = (F.when(kind == 0, pv_array(F.array(size, -size), "number"))
             .when(kind == 1, pv_array(F.array(F.col("p_size").cast("string"))))
             .otherwise(pv_array(F.array(F.col("p_size") > 25), "boolean")))
    req = p.select(F.col("p_partkey").alias("req_id"), (F.lit(5 * K) + F.col("p_partkey")).alias("memory_id"),
                   F.create_map(F.lit("a"), value).alias("props"))
    return mutate.update_memories(g(spark, sf), req).graph


@register("topk_number_arrays", search_sql("first_label = 'part'", 200, 0, order="rk ASC, tx ASC, nm ASC, memory_id", source=f"""(
    SELECT n.*, CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS rk, CASE p_partkey % 3 WHEN 1 THEN CAST(p_size AS VARCHAR)
    WHEN 2 THEN CAST(p_size > 25 AS VARCHAR) END AS tx, CASE p_partkey % 3 WHEN 0 THEN p_size END AS nm
    FROM nodes n JOIN part ON n.memory_id = CAST({5 * K} AS BIGINT) + p_partkey) nn"""))
def q_topk_number_arrays(spark, sf):
    """Array properties ascending: arrays of strings < of booleans < of
    numbers, and numbers as numbers ([9] before [10])."""
    return search_memories(_number_lists(spark, sf), label="part", order_by="a ASC", limit=200, depth=0)


@register("number_array_json", f"""
SELECT CAST({5 * K} AS BIGINT) + p_partkey AS memory_id, CASE p_partkey % 3
       WHEN 0 THEN '[' || CAST(p_size AS VARCHAR) || ',' || CASE WHEN p_size = 0 THEN '0' ELSE CAST(-p_size AS VARCHAR) END || ']'
       WHEN 1 THEN '["' || CAST(p_size AS VARCHAR) || '"]' ELSE '[' || CAST(p_size > 25 AS VARCHAR) || ']' END AS json FROM part""")
def q_number_array_json(spark, sf):
    """How a reply prints arrays of numbers, strings and booleans."""
    from mnemo.sources.snapshot import pv_json
    nodes = _number_lists(spark, sf).nodes.where(F.col("first_label") == "part")
    return nodes.select("memory_id", pv_json(F.col("props")["a"]).alias("json"))


@register("number_text", "SELECT l_orderkey, l_linenumber, l_partkey, " + jsnum("CASE l_linenumber % 3 WHEN 0 THEN l_extendedprice * 1000.0 "
          "WHEN 1 THEN l_extendedprice / 100000.0 ELSE l_quantity * l_discount END") + " AS text FROM lineitem")
def q_number_text(spark, sf):
    """Number text as JavaScript prints it: prices and quantities of all line
    items at several scales (tests/test_golden.py has the extreme values)."""
    from mnemo.functions.values import js_number_text
    turn = F.col("l_linenumber") % 3
    value = (F.when(turn == 0, F.col("l_extendedprice") * F.lit(1000.0)).when(turn == 1, F.col("l_extendedprice") / F.lit(100000.0))
             .otherwise(F.col("l_quantity") * F.col("l_discount")))
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", js_number_text(value).alias("text"))


# ------------------------------------------------------------------ bulk search

def _bulk_requests(spark, sf):
    t = lambda n: _t(spark, sf, n)
    s = lambda c: F.lit(c)
    ev = t("events").select("event_type").distinct().select(
        F.concat(s("event:"), "event_type").alias("req_key"), F.col("event_type").alias("query"),
        s("event").alias("label"), F.lit(None).cast("string").alias("since_date"), s(5).alias("limit"))
    br = t("part").select("p_brand").distinct().select(
        F.concat(s("brand:"), "p_brand").alias("req_key"), F.col("p_brand").alias("query"),
        s("part").alias("label"), F.lit(None).cast("string").alias("since_date"), s(3).alias("limit"))
    sg = t("customer").select("c_mktsegment").distinct().select(
        F.concat(s("segment:"), "c_mktsegment").alias("req_key"), F.lower("c_mktsegment").alias("query"),
        s("customer").alias("label"), F.lit(None).cast("string").alias("since_date"), s(4).alias("limit"))
    pr = t("orders").select("o_orderpriority").distinct().select(
        F.concat(s("priority:"), "o_orderpriority").alias("req_key"),
        F.substring_index("o_orderpriority", "-", -1).alias("query"), s("order").alias("label"),
        s("2000-01-01").alias("since_date"), s(10).alias("limit"))
    rg = t("region").select(
        F.concat(s("any:"), "r_name").alias("req_key"), F.col("r_name").alias("query"),
        F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("since_date"), s(7).alias("limit"))
    al = t("region").agg(F.count("*")).select(s("nations").alias("req_key"), s("").alias("query"), s("nation").alias("label"),
                                     F.lit(None).cast("string").alias("since_date"), s(30).alias("limit"))
    su = t("supplier").select(
        F.concat(s("supplier:"), "s_name").alias("req_key"), F.col("s_name").alias("query"), s("supplier").alias("label"),
        F.lit(None).cast("string").alias("since_date"), s(2).alias("limit"))
    return ev.unionByName(br).unionByName(sg).unionByName(pr).unionByName(rg).unionByName(al).unionByName(su)


BULK_SQL = """
, req AS (SELECT DISTINCT 'event:' || event_type AS req_key, event_type AS query, 'event' AS label,
                 CAST(NULL AS VARCHAR) AS since, 5 AS lim FROM events
          UNION ALL SELECT DISTINCT 'brand:' || p_brand, p_brand, 'part', NULL, 3 FROM part
          UNION ALL SELECT DISTINCT 'segment:' || c_mktsegment, lower(c_mktsegment), 'customer', NULL, 4 FROM customer
          UNION ALL SELECT DISTINCT 'priority:' || o_orderpriority, split_part(o_orderpriority, '-', 2), 'order',
                 '2000-01-01', 10 FROM orders
          UNION ALL SELECT 'any:' || r_name, r_name, NULL, NULL, 7 FROM region
          UNION ALL SELECT 'nations', '', 'nation', NULL, 30
          UNION ALL SELECT 'supplier:' || s_name, s_name, 'supplier', NULL, 2 FROM supplier),
rw AS (SELECT req_key, unnest(string_split(lower(trim(query)), ' ')) AS w FROM req WHERE trim(query) <> ''),
hits AS (SELECT DISTINCT r.req_key, n.memory_id, n.created_at, r.lim FROM req r JOIN nodes n
           ON (r.label IS NULL OR n.first_label = r.label) AND (r.since IS NULL OR n.created_at >= r.since)
         WHERE trim(r.query) = '' OR EXISTS (SELECT 1 FROM rw WHERE rw.req_key = r.req_key
                                             AND contains(n.search_text, rw.w))),
ranked AS (SELECT req_key, memory_id, lim, row_number() OVER (PARTITION BY req_key
           ORDER BY created_at DESC NULLS FIRST, memory_id) AS rank FROM hits)
SELECT req_key, memory_id, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= lim"""


@register("bulk_search", BULK_SQL)
def q_bulk_search(spark, sf):
    """Searches derived from the data (per event type, brand, market segment,
    priority, region and supplier, and one match-all) in one job."""
    from mnemo.plans.bulk import bulk_search
    return bulk_search(g(spark, sf).nodes, _bulk_requests(spark, sf))


# ------------------------------------------------------------------ request log, replay, streaming

def _log_lines(spark, sf):
    from functools import reduce as _reduce

    from mnemo.sources.testlog import log_blocks
    return _reduce(lambda a, b: a.unionByName(b), log_blocks(spark, sf, NOW))


def _graph_rows(graph):
    """Every connection with its ends and type, every memory with its text."""
    none = F.lit(None).cast("bigint")
    return graph.edges.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), "src", "dst", F.col("type").alias("text")).unionByName(
        graph.nodes.select(F.lit("node").alias("kind"), F.col("memory_id").alias("id"), none.alias("src"), none.alias("dst"), F.col("search_text").alias("text")))


B = 10 ** 12
LOG_KEYS_SQL = f"""
, urgent AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'),
pk AS (SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)"""

# states of memories and spans of connections by block of the derived log: f <= block < t
STATES_SQL = LOG_KEYS_SQL + f"""
, gone AS (SELECT CAST({3 * K} AS BIGINT) + c_custkey AS id FROM customer WHERE c_acctbal > 9890),
debt AS (SELECT CAST({3 * K} AS BIGINT) + c_custkey AS id, c_name, c_acctbal FROM customer WHERE c_acctbal < 0),
pairs AS (SELECT CAST({6 * K} AS BIGINT) + l_orderkey AS src, CAST({5 * K} AS BIGINT) + l_partkey AS dst, l_orderkey * 100000 + l_partkey AS pk FROM pk),
st AS (
  SELECT memory_id, labels, created_at, search_text, 0 AS f, CASE WHEN g.id IS NOT NULL THEN 4 WHEN d.id IS NOT NULL THEN 3 ELSE 99 END AS t
  FROM nodes n LEFT JOIN gone g ON g.id = memory_id LEFT JOIN debt d ON d.id = memory_id
  UNION ALL SELECT id, ['customer', 'debtor'], NULL, lower(concat_ws(chr(10), {jsnum('c_acctbal')}, c_name, 'gold')), 3, 99 FROM debt
  UNION ALL SELECT CAST({11 * K} AS BIGINT) + o_orderkey, ['note'], '{NOW}', lower('follow up ' || o_orderpriority || chr(10) || '{NOW}'), 1,
         CASE WHEN o_orderstatus = 'F' THEN 8 ELSE 99 END FROM urgent),
sp AS (
  SELECT e.edge_id, e.src, e.dst, e.type, 0 AS f, CASE WHEN x.id IS NOT NULL OR y.id IS NOT NULL THEN 4 WHEN e.type = 'CONTAINS' AND p.src IS NOT NULL THEN 5 ELSE 99 END AS t
  FROM edges e LEFT JOIN gone x ON x.id = e.src LEFT JOIN gone y ON y.id = e.dst LEFT JOIN pairs p ON p.src = e.src AND p.dst = e.dst
  UNION ALL SELECT CAST({15 * K} AS BIGINT) + pk, src, dst, 'CONTAINS', 6, 99 FROM pairs
  UNION ALL SELECT CAST({12 * K} AS BIGINT) + o_orderkey, CAST({11 * K} AS BIGINT) + o_orderkey, CAST({6 * K} AS BIGINT) + o_orderkey, 'ABOUT', 2,
         CASE WHEN o_orderstatus = 'F' THEN 8 ELSE 99 END FROM urgent),
ad AS (SELECT src AS a, dst AS b, edge_id, f, t FROM sp UNION ALL SELECT dst, src, edge_id, f, t FROM sp WHERE src <> dst)"""


def rows_at_sql(block: int) -> str:
    """Every connection and memory of the derived graph after a block of the derived log."""
    return STATES_SQL + f"""
SELECT 'edge' AS kind, edge_id AS id, src, dst, type AS text FROM sp WHERE f <= {block} AND {block} < t
UNION ALL SELECT 'node', memory_id, NULL, NULL, search_text FROM st WHERE f <= {block} AND {block} < t"""


VALIDATE_SQL = LOG_KEYS_SQL + f"""
, v AS (
  SELECT {B} + o_orderkey AS seq, 'create_memory' AS name FROM urgent
  UNION ALL SELECT {2 * B} + o_orderkey, 'create_connection' FROM urgent
  UNION ALL SELECT {3 * B} + c_custkey, 'update_memory' FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT {4 * B} + c_custkey, 'delete_memory' FROM customer WHERE c_acctbal > 9890
  UNION ALL SELECT {5 * B} + l_orderkey * 100000 + l_partkey, 'delete_connection' FROM pk
  UNION ALL SELECT {6 * B} + l_orderkey * 100000 + l_partkey, 'create_connection' FROM pk
  UNION ALL SELECT {7 * B} + l_orderkey * 100000 + l_partkey, 'update_connection' FROM pk
  UNION ALL SELECT {8 * B} + o_orderkey, 'delete_memory' FROM urgent WHERE o_orderstatus = 'F'
  UNION ALL SELECT {9 * B} + o_orderkey, 'create_connection' FROM urgent WHERE o_orderstatus = 'F'
  UNION ALL SELECT {10 * B} + n_nationkey * 2, 'update_memory' FROM nation
  UNION ALL SELECT {10 * B} + n_nationkey * 2 + 1, 'delete_memory' FROM nation
  UNION ALL SELECT {11 * B} + r_regionkey * 10 + 3, 'search_memories' FROM region
  UNION ALL SELECT {11 * B} + r_regionkey * 10 + 4, 'list_memory_labels' FROM region)"""


@register("validate_requests", VALIDATE_SQL + f"""
SELECT seq, name, TRUE AS valid, CAST(NULL AS VARCHAR) AS reason FROM v
UNION ALL SELECT {11 * B} + r_regionkey * 10, 'forget_memory', FALSE, 'Unknown tool: forget_memory' FROM region
UNION ALL SELECT {11 * B} + r_regionkey * 10 + 1, 'create_memory', FALSE, 'Invalid create_memory arguments' FROM region
UNION ALL SELECT {11 * B} + r_regionkey * 10 + 2, 'update_memory', FALSE, 'property values must be scalars or arrays'
          FROM region
UNION ALL SELECT NULL, NULL, FALSE, 'Invalid JSON' FROM region""")
def q_validate_requests(spark, sf):
    """Every call of the derived log with its validity and the reason."""
    from mnemo.sources.requests import parse_log_lines, validate_requests
    return validate_requests(parse_log_lines(_log_lines(spark, sf))).select("seq", "name", "valid", "reason")


@register("load_request_log", VALIDATE_SQL + f"""
SELECT seq, name FROM v
UNION ALL SELECT {11 * B} + r_regionkey * 10, 'forget_memory' FROM region
UNION ALL SELECT {11 * B} + r_regionkey * 10 + 1, 'create_memory' FROM region
UNION ALL SELECT {11 * B} + r_regionkey * 10 + 2, 'update_memory' FROM region
UNION ALL SELECT NULL, NULL FROM region""")
def q_load_request_log(spark, sf):
    """The derived log written as JSON-lines files, read back."""
    from mnemo.sources.requests import read_request_log
    from mnemo.sources.snapshot import scratch_path
    from mnemo.sources.testlog import write_log
    path = write_log(spark, sf, scratch_path(spark, "request-log"), NOW)
    return read_request_log(spark, f"{path}/*").select("seq", "name")


@register("replay_log", rows_at_sql(11))
def q_replay_log(spark, sf):
    """R2: the derived log replayed onto the derived graph: every memory and
    connection that is left."""
    from mnemo.sources.requests import parse_log_lines
    from mnemo.streaming.replay import replay_log
    change, _ = replay_log(g(spark, sf), parse_log_lines(_log_lines(spark, sf)), NOW)
    return _graph_rows(change.graph)


@register("replay_as_of", rows_at_sql(4))
def q_replay_as_of(spark, sf):
    """The graph as of the end of block 4 of the derived log (notes
    created and linked, debtors updated, top-balance customers deleted;
    later calls ignored)."""
    from mnemo.sources.requests import change_ops, checked_requests, parse_log_lines
    from mnemo.sources.testlog import BLOCK
    from mnemo.streaming.replay import replay_as_of
    ops = change_ops(checked_requests(parse_log_lines(_log_lines(spark, sf))))
    return _graph_rows(replay_as_of(g(spark, sf), ops, NOW, 5 * BLOCK - 1).graph)


@register("replay_results", LOG_KEYS_SQL + f"""
SELECT {B} + o_orderkey AS seq, 'create_memory' AS op, 'created' AS status, CAST(NULL AS BIGINT) AS deletedCount,
       CAST(NULL AS BIGINT) AS n_matched FROM urgent
UNION ALL SELECT {2 * B} + o_orderkey, 'create_connection', 'created', NULL, NULL FROM urgent
UNION ALL SELECT {3 * B} + c_custkey, 'update_memory', 'applied', NULL, NULL FROM customer WHERE c_acctbal < 0
UNION ALL SELECT {4 * B} + c_custkey, 'delete_memory', 'applied', 1, NULL FROM customer WHERE c_acctbal > 9890
UNION ALL SELECT {5 * B} + l_orderkey * 100000 + l_partkey, 'delete_connection', 'applied', n, NULL FROM pk
UNION ALL SELECT {6 * B} + l_orderkey * 100000 + l_partkey, 'create_connection', 'created', NULL, NULL FROM pk
UNION ALL SELECT {7 * B} + l_orderkey * 100000 + l_partkey, 'update_connection', 'applied', NULL, 1 FROM pk
UNION ALL SELECT {8 * B} + o_orderkey, 'delete_memory', 'applied', 1, NULL FROM urgent WHERE o_orderstatus = 'F'
UNION ALL SELECT {9 * B} + o_orderkey, 'create_connection', 'no_match', NULL, NULL FROM urgent
          WHERE o_orderstatus = 'F'
UNION ALL SELECT {10 * B} + n_nationkey * 2, 'update_memory', 'no_match', NULL, NULL FROM nation
UNION ALL SELECT {10 * B} + n_nationkey * 2 + 1, 'delete_memory', 'applied', 0, NULL FROM nation""")
def q_replay_results(spark, sf):
    """R2: one result per valid change call of the derived log."""
    from mnemo.sources.requests import parse_log_lines
    from mnemo.streaming.replay import replay_log
    change, _ = replay_log(g(spark, sf), parse_log_lines(_log_lines(spark, sf)), NOW)
    return change.result


@register("replay_props", f"""
SELECT CAST({3 * K} AS BIGINT) + c_custkey AS memory_id,
       lower(concat_ws(chr(10), {jsnum('c_acctbal')}, c_name, 'gold')) AS search_text
FROM customer WHERE c_acctbal < 0""")
def q_replay_props(spark, sf):
    """R2: debtors after the replay: tier set, market segment removed."""
    from mnemo.sources.requests import parse_log_lines
    from mnemo.streaming.replay import replay_log
    change, _ = replay_log(g(spark, sf), parse_log_lines(_log_lines(spark, sf)), NOW)
    return change.graph.nodes.where(F.array_contains("labels", "debtor") & (F.col("first_label") == "customer")) \
        .select("memory_id", "search_text")


def _awkward_log(spark, sf):
    """A log per customer and nation with what an ordered log can get wrong:
    connection ids that stored or earlier connections have, repeated calls,
    ids beyond 2**53, missing ids beside supplied ones."""
    from mnemo.sources.testlog import _line
    c, lit, key = F.col, F.lit, F.col("c_custkey")
    cust, nation = _t(spark, sf, "customer"), _t(spark, sf, "nation")
    far = lit(BIG) + key
    me, home = lit(3 * K) + key, lit(2 * K) + c("c_nationkey")
    link = lambda s, frm, to, type_, id_: _line(s, "create_connection", F.struct(
        frm.alias("fromMemoryId"), to.alias("toMemoryId"), lit(type_).alias("type"), id_.alias("connectionId"),
        F.struct(lit(type_).alias("t")).alias("properties")))
    # 1: LIVES_IN has this id already; 2, 3: one new id, twice
    clash = cust.select(link(lit(B) + key, me, home, "TAKEN", lit(2 * K) + key))
    fresh = cust.select(link(lit(2 * B) + key, me, home, "FRESH", lit(21 * K) + key))
    again = cust.select(link(lit(3 * B) + key, me, home, "AGAIN", lit(21 * K) + key))
    # 4: ids beyond 2**53, next to each other; 5: every odd one deleted; the call comes twice
    create = cust.select(_line(lit(4 * B) + key, "create_memory", F.struct(
        lit("big").alias("label"), far.alias("memoryId"), F.struct(c("c_name").alias("name"), lit("2020").alias("created_at")).alias("properties"))))
    drop = cust.where("c_custkey % 2 = 1").select(_line(lit(5 * B) + key, "delete_memory", F.struct(far.alias("nodeId"))))
    # 6: creates without an id; 7: a supplied id, far above
    noid = nation.select(_line(lit(6 * B) + c("n_nationkey"), "create_memory", F.struct(
        lit("noid").alias("label"), F.struct(c("n_name").alias("name"), lit("2020").alias("created_at")).alias("properties"))))
    # 8: toggle FRESH: deleted, made anew, updated
    off = cust.select(_line(lit(8 * B) + key, "delete_connection", F.struct(me.alias("fromMemoryId"), home.alias("toMemoryId"), lit("FRESH").alias("type"))))
    on = cust.select(link(lit(9 * B) + key, me, home, "FRESH", lit(22 * K) + key))
    mark = cust.select(_line(lit(10 * B) + key, "update_connection", F.struct(
        me.alias("fromMemoryId"), home.alias("toMemoryId"), lit("FRESH").alias("type"), F.struct(c("c_name").alias("by"), lit(None).cast("string").alias("t")).alias("properties"))))
    parts = [clash, fresh, again, create, drop, drop, noid, off, on, mark]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


BIG = (1 << 53) + 1000


def _awkward_replay(spark, sf):
    from mnemo.sources.requests import parse_log_lines
    from mnemo.streaming.replay import replay_log
    return replay_log(g(spark, sf), parse_log_lines(_awkward_log(spark, sf)), NOW)


@register("replay_edges", f"""
SELECT edge_id, src, dst, type, CAST(NULL AS VARCHAR) AS t, CAST(NULL AS VARCHAR) AS by FROM edges
UNION ALL SELECT CAST({22 * K} AS BIGINT) + c_custkey, CAST({3 * K} AS BIGINT) + c_custkey, CAST({2 * K} AS BIGINT) + c_nationkey, 'FRESH',
       NULL, c_name FROM customer""")
def q_replay_edges(spark, sf):
    """Every connection after the awkward log: stored ones untouched by
    creates that name their ids, the toggled one made anew and updated."""
    p = F.col("props")
    return _awkward_replay(spark, sf)[0].graph.edges.select("edge_id", "src", "dst", "type", p["t"]["text"].alias("t"), p["by"]["text"].alias("by"))


@register("replay_nodes", f"""
SELECT memory_id, first_label, search_text FROM nodes
UNION ALL SELECT CAST({BIG} AS BIGINT) + c_custkey, 'big', '2020' || chr(10) || lower(c_name) FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT greatest((SELECT max(memory_id) FROM nodes), CAST({BIG} AS BIGINT) + (SELECT max(c_custkey) FROM customer)) + 1
       + n_nationkey - (SELECT min(n_nationkey) FROM nation), 'noid', '2020' || chr(10) || lower(n_name) FROM nation""")
def q_replay_nodes(spark, sf):
    """Every memory after the awkward log: exact ids beyond 2**53, fresh ids
    above every id given or supplied, in seq order."""
    return _awkward_replay(spark, sf)[0].graph.nodes.select("memory_id", "first_label", "search_text")


@register("replay_awkward_results", f"""
SELECT {B} + c_custkey AS seq, 'id_exists' AS status FROM customer
UNION ALL SELECT {2 * B} + c_custkey, 'created' FROM customer
UNION ALL SELECT {3 * B} + c_custkey, 'id_exists' FROM customer
UNION ALL SELECT {4 * B} + c_custkey, 'created' FROM customer
UNION ALL SELECT {5 * B} + c_custkey, 'applied' FROM customer WHERE c_custkey % 2 = 1
UNION ALL SELECT {5 * B} + c_custkey, 'repeated seq' FROM customer WHERE c_custkey % 2 = 1
UNION ALL SELECT {6 * B} + n_nationkey, 'created' FROM nation
UNION ALL SELECT {8 * B} + c_custkey, 'applied' FROM customer
UNION ALL SELECT {9 * B} + c_custkey, 'created' FROM customer
UNION ALL SELECT {10 * B} + c_custkey, 'applied' FROM customer""")
def q_replay_awkward_results(spark, sf):
    """One result per call of the awkward log; the second copy of a call is
    quarantined."""
    change, quarantine = _awkward_replay(spark, sf)
    return change.result.select("seq", "status").unionByName(quarantine.select("seq", F.col("reason").alias("status")))


@register("stream_replay", rows_at_sql(11))
def q_stream_replay(spark, sf):
    """The same log as a growing folder, replayed by Structured
    Streaming as its blocks arrive, one delta per micro-batch; the last
    state equals the batch replay."""
    from mnemo.sources.snapshot import materialize, scratch_path, write_graph
    from mnemo.sources.testlog import parallel_pairs, write_log
    from mnemo.streaming.replay import stream_replay, stream_state
    base = scratch_path(spark, "stream-replay")
    write_graph(g(spark, sf), f"{base}/snapshot0")
    pairs = materialize(spark, parallel_pairs(spark, sf), "log-pairs")
    # small compaction interval so the run exercises both deltas and snapshots
    for blocks in (range(1, 4), range(4, 6), range(6, 9), range(9, 12)):
        write_log(spark, sf, f"{base}/log", NOW, blocks, pairs)
        last = stream_replay(spark, f"{base}/log", f"{base}/snapshot0", f"{base}/out", NOW,
                             checkpoint=f"{base}/_checkpoint", max_files_per_trigger=1_000_000, compact_every=3)
    return _graph_rows(stream_state(spark, f"{base}/snapshot0", f"{base}/out", last + 1, 3))


REPLY_SQL = seeds_sql(FLAG_WHERE, 10) + trails_sql(1) + """
, hit AS (SELECT s.memory_id, c.related_id, c.first_edge AS edge_id, c.distance FROM seeds s LEFT JOIN conns c USING (memory_id)),
ep AS (SELECT edge_id, type FROM edges)
SELECT h.memory_id, h.related_id, h.edge_id, h.distance, 'memory' AS owner, p.key, p.kind, p.text FROM hit h JOIN props_long p ON p.memory_id = h.memory_id
UNION ALL SELECT h.memory_id, h.related_id, h.edge_id, h.distance, 'related', p.key, p.kind, p.text FROM hit h JOIN props_long p ON p.memory_id = h.related_id
UNION ALL SELECT h.memory_id, h.related_id, h.edge_id, h.distance, 'type', '_type', 'string', e.type FROM hit h JOIN ep e USING (edge_id)"""


@register("search_result_json", REPLY_SQL)
def q_search_result_json(spark, sf):
    """The flagship search in the reference's nested reply shape, one
    JSON document per memory, read back: each property of the memory and of
    its related memories, and each connection's type."""
    from mnemo.functions.values import js_number_text
    from mnemo.plans.search import reply_json
    graph = g(spark, sf)
    flat = search_memories(graph, query="urgent high", label="order", since_date="1998-01-01", limit=10, depth=1)
    docs = reply_json(flat, graph, depth=1, part_size=10_000).select(F.parse_json("json").alias("v"))
    get = F.try_variant_get
    one = docs.select(get("v", "$.memory", "map<string,variant>").alias("m"), F.explode(get("v", "$.connections", "array<variant>")).alias("c"))
    one = one.select(
        F.col("m"), get(F.col("m")["_id"], "$", "bigint").alias("memory_id"), get("c", "$.memory", "map<string,variant>").alias("r"),
        get("c", "$.relationship", "map<string,variant>").alias("e"), get("c", "$.distance", "int").alias("distance"))
    one = one.withColumns({"related_id": get(F.col("r")["_id"], "$", "bigint"), "edge_id": get(F.col("e")["_id"], "$", "bigint")})
    part = lambda owner, col: one.select("memory_id", "related_id", "edge_id", "distance", F.lit(owner).alias("owner"),
                                         F.explode(col).alias("key", "value"))
    rows = part("memory", "m").unionByName(part("related", "r")).unionByName(part("type", "e"))
    named = F.when(F.col("owner") == "type", F.col("key") == "_type").otherwise(~F.col("key").isin("_id", "_labels"))
    schema = F.schema_of_variant("value")
    kind = (F.when(schema == "STRING", "string").when(schema.startswith("ARRAY"), "array").when(schema == "BOOLEAN", "boolean").otherwise("number"))
    text = (F.when(kind == "number", js_number_text(get("value", "$", "double")))
            .when(kind == "array", F.array_join(get("value", "$", "array<string>"), " ")).otherwise(get("value", "$", "string")))
    return rows.where(named).select("memory_id", "related_id", "edge_id", "distance", "owner", "key", kind.alias("kind"), text.alias("text"))


@register("bulk_request_errors", """
SELECT 'limit -1:' || c_name AS req_key, 'invalid limit: -1.0' AS reason FROM customer
UNION ALL SELECT 'limit 1.5:' || c_name, 'invalid limit: 1.5' FROM customer
UNION ALL SELECT 'depth 1.5:' || c_name, 'invalid depth: 1.5' FROM customer""")
def q_bulk_request_errors(spark, sf):
    """Requests whose limit or depth a single search would refuse, five for
    each customer."""
    from mnemo.plans.bulk import request_errors
    return request_errors(_odd_requests(spark, sf))


def _odd_requests(spark, sf):
    cases = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(lim).cast("double").alias("limit"), F.lit(d).cast("double").alias("depth"))
                      for n, lim, d in (("limit -1:", -1.0, None), ("limit 1.5:", 1.5, None), ("limit 0:", 0.0, None),
                                        ("depth 1.5:", 2.0, 1.5), ("good:", 2.0, 0.0))))
    return _t(spark, sf, "customer").select("c_name", F.explode(cases).alias("c")).select(
        F.concat("c.n", "c_name").alias("req_key"), F.col("c_name").alias("query"), F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("string").alias("since_date"), "c.limit", "c.depth")


@register("bulk_odd_limits", """
, hits AS (SELECT c.c_name, n.memory_id, row_number() OVER (PARTITION BY c.c_name ORDER BY n.created_at DESC NULLS FIRST, n.memory_id) AS rank
  FROM customer c JOIN nodes n ON contains(n.search_text, lower(c.c_name)))
SELECT 'good:' || c_name AS req_key, memory_id, CAST(rank AS INTEGER) AS rank FROM hits WHERE rank <= 2""")
def q_bulk_odd_limits(spark, sf):
    """Of the same requests only the good ones (and limit 0, without rows)
    are answered: a search for every customer's name."""
    from mnemo.plans.bulk import bulk_search
    return bulk_search(g(spark, sf).nodes, _odd_requests(spark, sf))


@register("bulk_order_by", f"""
, hits AS (SELECT r.r_regionkey, n.memory_id, n.name, p.num, row_number() OVER (PARTITION BY r.r_regionkey
       ORDER BY CASE WHEN r_regionkey % 2 = 0 THEN p.num END DESC NULLS FIRST, CASE WHEN r_regionkey % 2 = 1 THEN n.name END ASC NULLS LAST,
       n.memory_id) AS rank
  FROM region r JOIN nodes n ON n.first_label = 'customer'
  JOIN customer c ON n.memory_id = CAST({3 * K} AS BIGINT) + c_custkey JOIN props_long p ON p.memory_id = n.memory_id AND p.key = 'acctbal'
  WHERE contains(n.search_text, CASE r_regionkey WHEN 0 THEN 'building' WHEN 1 THEN 'machinery' ELSE 'customer' END))
SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS req_key, memory_id, CAST(rank AS INTEGER) AS rank FROM hits WHERE rank <= 20""")
def q_bulk_order_by(spark, sf):
    """Bulk searches with their own order: balance descending, or name ascending."""
    from mnemo.plans.bulk import bulk_search
    key = F.col("r_regionkey")
    reqs = _t(spark, sf, "region").select(
        F.concat(F.lit("r"), key.cast("string")).alias("req_key"),
        F.when(key == 0, "Building").when(key == 1, "machinery Machinery").otherwise("customer").alias("query"), F.lit("customer").alias("label"),
        F.lit(None).cast("string").alias("since_date"), F.lit(20).alias("limit"),
        F.when(key % 2 == 0, "memory.acctbal DESC").otherwise("n.name asc").alias("order_by"))
    return bulk_search(g(spark, sf).nodes, reqs)


READ_BLOCKS = (1, 3, 4, 5, 8)     # of the derived log, after which every supplier reads


def _read_lines(spark, sf):
    """Two reads per supplier after each of some blocks: a search for what
    the log marks or makes, and a label listing."""
    from mnemo.sources.testlog import BLOCK, _line
    blocks = F.explode(F.array(*(F.lit(b) for b in READ_BLOCKS))).alias("b")
    calls = _t(spark, sf, "supplier").select("s_suppkey", blocks)
    at = (F.col("b") + 1) * F.lit(BLOCK) - F.lit(1) - F.col("s_suppkey") * 2
    search = F.struct(F.lit("gold Follow").alias("query"), (F.col("s_suppkey") % 7).alias("limit"), F.lit(1).alias("depth"))
    return (calls.select(_line(at, "search_memories", search))
            .unionByName(calls.select(_line(at - 1, "list_memory_labels", F.struct(F.lit(None).cast("string").alias("unused"))))))


@register("answer_request_log", STATES_SQL + f"""
, late AS (SELECT s_suppkey, unnest({list(READ_BLOCKS)}) AS b FROM supplier),
rq AS (
  SELECT (b + 1) * {B} - 1 - s_suppkey * 2 AS seq, b, 'gold' AS w1, 'follow' AS w2, s_suppkey % 7 AS lim FROM late
  UNION ALL SELECT {11 * B} + r_regionkey * 10 + 3, 11, split_part(lower(r_name), ' ', 1),
         CASE WHEN contains(r_name, ' ') THEN split_part(lower(r_name), ' ', 2) ELSE split_part(lower(r_name), ' ', 1) END, 10 FROM region),
ask AS (SELECT DISTINCT b, w1, w2 FROM rq),
best AS (SELECT a.b, a.w1, s.memory_id, CAST(row_number() OVER (PARTITION BY a.b, a.w1 ORDER BY s.created_at DESC NULLS FIRST, s.memory_id) AS INTEGER) AS rank
  FROM ask a JOIN st s ON s.f <= a.b AND a.b < s.t AND (contains(s.search_text, a.w1) OR contains(s.search_text, a.w2))),
hits AS (SELECT rq.seq, rq.b, h.memory_id, h.rank FROM rq JOIN best h ON h.b = rq.b AND h.w1 = rq.w1 AND h.rank <= rq.lim),
conn AS (SELECT h.seq, h.memory_id, a.b AS related_id, a.edge_id FROM hits h JOIN ad a ON a.a = h.memory_id AND a.f <= h.b AND h.b < a.t),
lst AS (SELECT (b + 1) * {B} - 2 - s_suppkey * 2 AS seq, b FROM late UNION ALL SELECT {11 * B} + r_regionkey * 10 + 4, 11 FROM region),
cnt AS (SELECT b, label, CAST(count(*) AS BIGINT) AS n FROM (SELECT q.b, unnest(s.labels) AS label FROM (SELECT DISTINCT b FROM lst) q JOIN st s ON s.f <= q.b AND q.b < s.t) GROUP BY ALL)
SELECT h.seq, 'search_memories' AS tool, h.memory_id, h.rank, c.related_id, c.edge_id AS first_edge,
       CASE WHEN c.edge_id IS NULL THEN NULL ELSE 1 END AS distance, CAST(NULL AS VARCHAR) AS label,
       CAST(NULL AS BIGINT) AS count, CAST(NULL AS VARCHAR) AS reason
FROM hits h LEFT JOIN conn c ON c.seq = h.seq AND c.memory_id = h.memory_id
UNION ALL
SELECT l.seq, 'list_memory_labels', NULL, NULL, NULL, NULL, NULL, c.label, c.n, NULL FROM lst l JOIN cnt c ON c.b = l.b""")
def q_answer_request_log(spark, sf):
    """The searches and label listings of the derived log, with reads of
    every supplier between its blocks, each answered on the graph as the
    calls before it left it."""
    from mnemo.plans.bulk import answer_reads
    from mnemo.sources.requests import checked_requests, parse_log_lines
    lines = _log_lines(spark, sf).unionByName(_read_lines(spark, sf))
    return answer_reads(stored(spark, sf), checked_requests(parse_log_lines(lines)), NOW)


def _visit_lines(spark, sf):
    """Three updates of every debtor, the second of which takes a property away."""
    from mnemo.sources.testlog import BLOCK, _line
    debtors = _t(spark, sf, "customer").where("c_acctbal < 0")
    turns = (F.struct(F.lit(0.0).alias("visit"), F.lit("a").alias("flag")), F.struct(F.lit(1.0).alias("visit"), F.lit(None).cast("string").alias("flag")),
             F.struct(F.lit(2.0).alias("visit")))
    out = [debtors.select(_line(F.lit(12 * BLOCK) + F.col("c_custkey") * 10 + i, "update_memory", F.struct(
        (F.lit(3 * K) + F.col("c_custkey")).alias("nodeId"), props.alias("properties")))) for i, props in enumerate(turns)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("replay_replies", LOG_KEYS_SQL + f"""
, debt AS (SELECT c_custkey, CAST({3 * K} AS BIGINT) + c_custkey AS id, c_name, {jsnum('c_acctbal')} AS bal FROM customer WHERE c_acctbal < 0),
dseq AS (SELECT {3 * B} + c_custkey AS seq, -1 AS turn, * FROM debt UNION ALL SELECT {12 * B} + c_custkey * 10 + i, i, debt.* FROM debt, range(3) r(i)),
pr AS (SELECT l_orderkey * 100000 + l_partkey AS pk, n FROM pk),
fin AS (SELECT * FROM urgent WHERE o_orderstatus = 'F')
SELECT {B} + o_orderkey AS seq, 'create_memory' AS op, 'created' AS status, CAST({11 * K} AS BIGINT) + o_orderkey AS id, 'text' AS key, 'follow up ' || o_orderpriority AS text FROM urgent
UNION ALL SELECT {B} + o_orderkey, 'create_memory', 'created', CAST({11 * K} AS BIGINT) + o_orderkey, 'created_at', '{NOW}' FROM urgent
UNION ALL SELECT {2 * B} + o_orderkey, 'create_connection', 'created', CAST({12 * K} AS BIGINT) + o_orderkey, 'created_at', '{NOW}' FROM urgent
UNION ALL SELECT seq, 'update_memory', 'applied', id, 'name', c_name FROM dseq
UNION ALL SELECT seq, 'update_memory', 'applied', id, 'acctbal', bal FROM dseq
UNION ALL SELECT seq, 'update_memory', 'applied', id, 'tier', 'gold' FROM dseq
UNION ALL SELECT seq, 'update_memory', 'applied', id, 'visit', CAST(turn AS VARCHAR) FROM dseq WHERE turn >= 0
UNION ALL SELECT seq, 'update_memory', 'applied', id, 'flag', 'a' FROM dseq WHERE turn = 0
UNION ALL SELECT {4 * B} + c_custkey, 'delete_memory', 'applied', NULL, 'deletedCount', '1' FROM customer WHERE c_acctbal > 9890
UNION ALL SELECT {5 * B} + pk, 'delete_connection', 'applied', NULL, 'deletedCount', CAST(n AS VARCHAR) FROM pr
UNION ALL SELECT {6 * B} + pk, 'create_connection', 'created', CAST({15 * K} AS BIGINT) + pk, 'note', 're-added' FROM pr
UNION ALL SELECT {7 * B} + pk, 'update_connection', 'applied', CAST({15 * K} AS BIGINT) + pk, 'note', 're-added' FROM pr
UNION ALL SELECT {7 * B} + pk, 'update_connection', 'applied', CAST({15 * K} AS BIGINT) + pk, 'checked', 'true' FROM pr
UNION ALL SELECT {8 * B} + o_orderkey, 'delete_memory', 'applied', NULL, 'deletedCount', '1' FROM fin
UNION ALL SELECT {9 * B} + o_orderkey, 'create_connection', 'no_match', NULL, NULL, NULL FROM fin
UNION ALL SELECT {10 * B} + n_nationkey * 2, 'update_memory', 'no_match', NULL, NULL, NULL FROM nation
UNION ALL SELECT {10 * B} + n_nationkey * 2 + 1, 'delete_memory', 'applied', NULL, 'deletedCount', '0' FROM nation""")
def q_replay_replies(spark, sf):
    """The reply to every change call of the derived log and of three more
    updates per debtor, read back from its JSON: each property of the record
    as it was right after the call."""
    from mnemo.functions.values import js_number_text
    from mnemo.sources.requests import parse_log_lines
    from mnemo.streaming.history import replay_replies
    log = parse_log_lines(_log_lines(spark, sf).unionByName(_visit_lines(spark, sf)))
    get = F.try_variant_get
    told = replay_replies(stored(spark, sf), log, NOW).withColumn("v", F.parse_json("json"))
    told = told.withColumn("r", F.coalesce(get("v", "$.memory", "variant"), get("v", "$.relationship", "variant"), F.col("v")))
    rows = told.select("seq", "op", "status", get("r", "$._id", "bigint").alias("id"), F.explode_outer(get("r", "$", "map<string,variant>")).alias("key", "value"))
    number = F.schema_of_variant("value").rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    text = F.when(number, js_number_text(get("value", "$", "double"))).otherwise(get("value", "$", "string"))
    return rows.where(F.col("key").isNull() | ~F.col("key").isin("_id", "_labels", "_type")).select("seq", "op", "status", "id", "key", text.alias("text"))


@register("bulk_search_expand", BULK_SQL.replace(
    "SELECT req_key, memory_id, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= lim",
    "") + """, hits2 AS (SELECT req_key, memory_id, CAST(rank AS INTEGER) AS rank,
    CASE WHEN req_key = 'nations' THEN 0 WHEN req_key LIKE 'priority:%' THEN 2 ELSE 1 END AS d
    FROM ranked WHERE rank <= lim)""".replace("\n", "\n") + trails_sql(2, "(SELECT DISTINCT memory_id FROM hits2)") + """
, linked AS (SELECT h.req_key, h.memory_id, h.rank, c.related_id, c.first_edge, c.first_type, c.first_outgoing,
             c.distance FROM hits2 h JOIN conns c ON c.memory_id = h.memory_id AND c.distance <= h.d)
SELECT * FROM linked
UNION ALL SELECT h.req_key, h.memory_id, h.rank, NULL, NULL, NULL, NULL, NULL FROM hits2 h
WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.req_key = h.req_key AND l.memory_id = h.memory_id)""")
def q_bulk_search_expand(spark, sf):
    """The bulk searches with expansion: depth 2 for the priority
    searches, 0 for the match-all, 1 (default) for the rest."""
    from mnemo.operators.expand import adjacency
    from mnemo.plans.bulk import bulk_search_expand
    graph = g(spark, sf)
    reqs = _bulk_requests(spark, sf).withColumn("depth", F.when(F.col("req_key") == "nations", 0)
                                                 .when(F.col("req_key").startswith("priority:"), 2))
    return bulk_search_expand(graph.nodes, adjacency(graph.edges), reqs)
