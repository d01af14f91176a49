"""Registered queries: one per operator of the inventory, each with its
plain-SQL oracle when one can be written.

Every query reads the given tables (through the derived graph of
``mnemo.sources.testgraph``) over their whole extent; request tables for
lookups and changes are derived from the same data by predicates that
mean something for the data (urgent orders, returned lines, ...).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.functions.text import tokenize_col
from mnemo.operators import filters as flt
from mnemo.operators import stats
from mnemo.operators.expand import adjacency, expand
from mnemo.model import Graph
from mnemo.plans.oracle import jsnum, with_graph
from mnemo.plans.search import recall, search_memories
from mnemo.sources.testgraph import K, build_graph, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_graph(sql)
        return fn
    return deco


# ---------------------------------------------------------------- SQL helpers

DEFAULT_ORDER_SQL = "created_at DESC NULLS FIRST, memory_id"


def words_sql(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(search_text, '{w}')" for w in words) + ")"


def seeds_sql(where: str, limit: int, order: str = DEFAULT_ORDER_SQL, source: str = "nodes") -> str:
    return (f", seeds AS (SELECT memory_id, created_at, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) "
            f"AS seed_rank FROM {source} WHERE {where} ORDER BY {order} LIMIT {limit})")


def trails_sql(depth: int, seeds: str = "seeds") -> str:
    """Trail levels l1..ld and their distinct union ``conns``."""
    if depth <= 0:
        return (", conns AS (SELECT CAST(NULL AS BIGINT) AS memory_id, CAST(NULL AS BIGINT) AS related_id, "
                "CAST(NULL AS BIGINT) AS first_edge, CAST(NULL AS VARCHAR) AS first_type, "
                "CAST(NULL AS BOOLEAN) AS first_outgoing, CAST(NULL AS INTEGER) AS distance WHERE FALSE)")
    parts = [f", l1 AS (SELECT s.memory_id, a.b AS node, a.edge_id AS first_edge, a.type AS first_type, "
             f"a.outgoing AS first_outgoing, [a.edge_id] AS path FROM {seeds} s JOIN adj a ON a.a = s.memory_id)"]
    for k in range(2, depth + 1):
        parts.append(f", l{k} AS (SELECT p.memory_id, a.b AS node, p.first_edge, p.first_type, p.first_outgoing, "
                     f"list_append(p.path, a.edge_id) AS path FROM l{k - 1} p JOIN adj a ON a.a = p.node "
                     f"WHERE NOT list_contains(p.path, a.edge_id))")
    union = " UNION ".join(
        f"SELECT memory_id, node AS related_id, first_edge, first_type, first_outgoing, "
        f"CAST({k} AS INTEGER) AS distance FROM l{k}" for k in range(1, depth + 1))
    parts.append(f", conns AS ({union})")
    return "".join(parts)


FLAT_SELECT_SQL = ("SELECT s.memory_id, s.seed_rank, s.created_at, c.related_id, c.first_edge, c.first_type, "
                   "c.first_outgoing, c.distance FROM seeds s LEFT JOIN conns c ON c.memory_id = s.memory_id")


def search_sql(where: str, limit: int, depth: int, order: str = DEFAULT_ORDER_SQL,
               source: str = "nodes") -> str:
    return seeds_sql(where, limit, order, source) + trails_sql(depth) + "\n" + FLAT_SELECT_SQL


def g(spark: SparkSession, sf: str):
    return build_graph(spark, sf)


_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf: str) -> Graph:
    """The derived graph as a snapshot in the session's shared folder,
    written when first asked for: for queries that read it many times."""
    from mnemo.sources.snapshot import read_graph, run_folder, scratch_path, write_graph

    key = run_folder(spark), sf
    if key not in _STORED:
        _STORED[key] = write_graph(build_graph(spark, sf), scratch_path(spark, "derived-graph"))
    return read_graph(spark, _STORED[key])


# ---------------------------------------------------------------- Q1 flagship

FLAG = dict(query="urgent high", label="order", since_date="1998-01-01", limit=10)
FLAG_WHERE = "first_label = 'order' AND created_at >= '1998-01-01' AND " + words_sql(["urgent", "high"])


@register("search_memories", search_sql(FLAG_WHERE, 10, 1))
def q_search_memories(spark, sf):
    return search_memories(g(spark, sf), depth=1, **FLAG)


@register("search_depth0", search_sql(FLAG_WHERE, 10, 0))
def q_search_depth0(spark, sf):
    return search_memories(g(spark, sf), depth=0, **FLAG)


@register("expand_depth2", search_sql(FLAG_WHERE, 10, 2))
def q_expand_depth2(spark, sf):
    return search_memories(g(spark, sf), depth=2, **FLAG)


@register("expand_depth3", search_sql(FLAG_WHERE, 10, 3))
def q_expand_depth3(spark, sf):
    return search_memories(g(spark, sf), depth=3, **FLAG)


@register("expand_depth1", search_sql("first_label = 'nation'", 25, 1))
def q_expand_depth1(spark, sf):
    """Every nation (hubs of customers and suppliers), one hop."""
    return search_memories(g(spark, sf), label="nation", limit=25, depth=1)


@register("expand_first_edge", search_sql("first_label = 'message' AND " + words_sql(["que"]), 30, 2))
def q_expand_first_edge(spark, sf):
    """Reply chains walked both ways: the first edge's stored direction."""
    return search_memories(g(spark, sf), query="que", label="message", limit=30, depth=2)


@register("expand_isolated", search_sql("first_label = 'document' AND " + words_sql(["the"]), 10, 1))
def q_expand_isolated(spark, sf):
    """Documents have no connections: one all-null connection row each."""
    return search_memories(g(spark, sf), query="the", label="document", limit=10, depth=1)


@register("expand_collect", seeds_sql(FLAG_WHERE, 10) + trails_sql(2) + """
SELECT s.memory_id, CAST(count(c.related_id) AS BIGINT) AS n_connections,
       CAST(count(DISTINCT c.related_id) AS BIGINT) AS n_related, max(c.distance) AS max_distance
FROM seeds s LEFT JOIN conns c ON c.memory_id = s.memory_id GROUP BY s.memory_id""")
def q_expand_collect(spark, sf):
    """Per-seed summary of the distinct connections (depth 2)."""
    flat = search_memories(g(spark, sf), depth=2, **FLAG)
    return flat.groupBy("memory_id").agg(
        F.count("related_id").alias("n_connections"),
        F.countDistinct("related_id").alias("n_related"),
        F.max("distance").alias("max_distance"))


PARALLEL_SEEDS_SQL = f""", pseeds AS (SELECT DISTINCT CAST({6 * K} AS BIGINT) + l_orderkey AS memory_id
    FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1)"""


@register("expand_parallel", PARALLEL_SEEDS_SQL + trails_sql(2, "pseeds") + """
SELECT memory_id, related_id, first_edge, first_type, first_outgoing, distance FROM conns""")
def q_expand_parallel(spark, sf):
    """Orders holding parallel edges to one part, depth 2: the order itself
    comes back at distance 2 through the second parallel edge."""
    graph = g(spark, sf)
    seeds = (read_table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey")
             .agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .select((F.lit(6 * K) + F.col("l_orderkey")).alias("memory_id")).distinct())
    return expand(seeds, adjacency(graph.edges), 2)


# ---------------------------------------------------------------- scans and filters

@register("scan_nodes", "SELECT memory_id, first_label, created_at, search_text FROM nodes")
def q_scan_nodes(spark, sf):
    return g(spark, sf).nodes.select("memory_id", "first_label", "created_at", "search_text")


@register("nodes_with_label", "SELECT memory_id, first_label FROM nodes WHERE list_contains(labels, 'debtor')")
def q_nodes_with_label(spark, sf):
    return flt.nodes_with_label(g(spark, sf).nodes, "debtor").select("memory_id", "first_label")


@register("filter_first_label", "SELECT memory_id, first_label FROM nodes WHERE first_label = 'customer'")
def q_filter_first_label(spark, sf):
    return g(spark, sf).nodes.where(flt.label_pred("customer")).select("memory_id", "first_label")


@register("filter_since_date",
          "SELECT memory_id, created_at FROM nodes WHERE created_at >= '2024-01-15T00:00:00.000Z'")
def q_filter_since_date(spark, sf):
    return g(spark, sf).nodes.where(flt.since_pred("2024-01-15T00:00:00.000Z")) \
        .select("memory_id", "created_at")


@register("nodes_by_id", f"""
SELECT n.memory_id, n.first_label FROM nodes n
WHERE n.memory_id IN (SELECT CAST({3 * K} AS BIGINT) + o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def q_nodes_by_id(spark, sf):
    """Customers of urgent orders, looked up by id."""
    ids = read_table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT") \
        .select((F.lit(3 * K) + F.col("o_custkey")).alias("memory_id"))
    return flt.nodes_by_id(g(spark, sf).nodes, ids).select("memory_id", "first_label")


@register("edges_by_key", f"""
SELECT e.edge_id, e.src, e.dst, e.type FROM edges e
WHERE (e.src, e.dst, e.type) IN (SELECT (CAST({6 * K} AS BIGINT) + l_orderkey, CAST({5 * K} AS BIGINT) + l_partkey,
                                 'CONTAINS') FROM lineitem WHERE l_returnflag = 'R')""")
def q_edges_by_key(spark, sf):
    """Every parallel CONTAINS edge of the (order, part) pairs of returned lines."""
    keys = read_table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        (F.lit(6 * K) + F.col("l_orderkey")).alias("src"), (F.lit(5 * K) + F.col("l_partkey")).alias("dst"),
        F.lit("CONTAINS").alias("type"))
    return flt.edges_by_key(g(spark, sf).edges, keys).select("edge_id", "src", "dst", "type")


@register("stringify_properties", "SELECT memory_id, key, kind, text FROM props_long")
def q_stringify_properties(spark, sf):
    return flt.stringify_properties(g(spark, sf).nodes)


SAW_WORDS = ["brand#13", "widget", "urgent"]


@register("search_any_word", "SELECT memory_id FROM nodes WHERE " + words_sql(SAW_WORDS))
def q_search_any_word(spark, sf):
    """Every memory with any of the words in any property (no limit)."""
    return flt.search_candidates(g(spark, sf).nodes, "Brand#13  WIDGET urgent").select("memory_id")


_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


@register("tokenize_query", f"""
, t AS (SELECT CAST({10 * K} AS BIGINT) + conv_id * 1000 + turn AS memory_id,
        regexp_replace(lower(text), '^{_WS}+|{_WS}+$', '', 'g') AS q FROM conversations),
w AS (SELECT memory_id, CASE WHEN q = '' THEN [] ELSE regexp_split_to_array(q, '{_WS}+') END AS words FROM t)
SELECT memory_id, CAST(i - 1 AS INTEGER) AS pos, words[i] AS word
FROM w, generate_series(1, len(words)) AS s(i)""")
def q_tokenize_query(spark, sf):
    """Every message text split into query words, as search would."""
    conv = read_table(spark, sf, "conversations")
    return conv.select((F.lit(10 * K) + F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"),
                       F.posexplode(tokenize_col("text")).alias("pos", "word"))


@register("search_empty", search_sql("first_label = 'order' AND " + words_sql(["zzqx"]), 10, 1))
def q_search_empty(spark, sf):
    """No candidate: the result is empty (no expansion runs)."""
    return search_memories(g(spark, sf), query="zzqx", label="order", limit=10, depth=1)


@register("search_match_all", search_sql("first_label = 'event'", 200, 0))
def q_search_match_all(spark, sf):
    """A blank query keeps every event; newest 200."""
    return search_memories(g(spark, sf), query=" \u00a0\t\u3000", label="event", limit=200, depth=0)


@register("search_label_since", search_sql(
    "first_label = 'event' AND created_at >= '2024-01-20' AND " + words_sql(["click", "purchase"]), 10, 1))
def q_search_label_since(spark, sf):
    return search_memories(g(spark, sf), query="click purchase", label="event", since_date="2024-01-20",
                           limit=10, depth=1)


@register("phrase_search", """
SELECT DISTINCT memory_id FROM props_long
WHERE key IN ('name', 'context', 'description') AND kind = 'string' AND contains(text, 'user_1')""")
def q_phrase_search(spark, sf):
    return flt.phrase_search(g(spark, sf).nodes, "user_1").distinct()


@register("phrase_search_all_props", """
SELECT DISTINCT memory_id FROM props_long WHERE kind <> 'number' AND contains(text, 'Brand#1')""")
def q_phrase_search_all_props(spark, sf):
    return flt.phrase_search_all_props(g(spark, sf).nodes, "Brand#1").select("memory_id")


RECALL_WHERE = "memory_id IN (SELECT memory_id FROM props_long WHERE kind <> 'number' AND contains(text, 'Brand#1'))"


@register("recall", search_sql(RECALL_WHERE, 20, 1, order="name ASC NULLS LAST, memory_id"))
def q_recall(spark, sf):
    """Legacy recall: phrase anywhere, ordered by name, 20 hits, one hop."""
    return recall(g(spark, sf), "Brand#1", order_by="n.name ASC", limit=20, depth=1)


@register("recent_memories", """
SELECT memory_id, first_label, created_at FROM nodes
WHERE strptime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') > TIMESTAMP '2024-01-24 00:00:00'""")
def q_recent_memories(spark, sf):
    return flt.recent_memories(g(spark, sf).nodes, "2024-01-31T00:00:00Z", days=7)


@register("project_memory", f"""
SELECT CAST({6 * K} AS BIGINT) + o_orderkey AS _id, o_orderstatus AS status, o_orderpriority AS priority,
       {jsnum('o_totalprice')} AS totalprice FROM orders""")
def q_project_memory(spark, sf):
    nodes = g(spark, sf).nodes.where(flt.label_pred("order"))
    return flt.project_memory(nodes, ["status", "priority", "totalprice"]).drop("_labels")


# ---------------------------------------------------------------- order and limit

@register("topk_default_order", search_sql("first_label = 'event' AND " + words_sql(["error"]), 50, 0))
def q_topk_default_order(spark, sf):
    return search_memories(g(spark, sf), query="error", label="event", limit=50, depth=0)


@register("topk_order_by", search_sql(
    "first_label = 'order' AND " + words_sql(["urgent"]), 25, 0, order="totalprice DESC NULLS FIRST, memory_id",
    source="(SELECT n.*, p.num AS totalprice FROM nodes n LEFT JOIN props_long p "
           "ON p.memory_id = n.memory_id AND p.key = 'totalprice') nn"))
def q_topk_order_by(spark, sf):
    return search_memories(g(spark, sf), query="urgent", label="order", order_by="memory.totalprice DESC",
                           limit=25, depth=0)


@register("topk_nulls", search_sql("TRUE", 200, 0))
def q_topk_nulls(spark, sf):
    """Default order is DESC, so memories without created_at come first."""
    return search_memories(g(spark, sf), limit=200, depth=0)


@register("topk_nulls_asc", search_sql("first_label IN ('nation', 'order')", 200, 0,
                                       order="name ASC NULLS LAST, memory_id"))
def q_topk_nulls_asc(spark, sf):
    """Ascending order puts missing values last: named nations, then
    orders (no name) by id."""
    graph = g(spark, sf)
    nodes = graph.nodes.where(F.col("first_label").isin("nation", "order"))
    return search_memories(Graph(nodes, graph.edges), order_by="name ASC", limit=200, depth=0)


@register("topk_limit_cap", search_sql("first_label = 'event' AND " + words_sql(["view"]), 200, 0))
def q_topk_limit_cap(spark, sf):
    return search_memories(g(spark, sf), query="view", label="event", limit=500, depth=0)


# ---------------------------------------------------------------- statistics

@register("label_counts", """
SELECT label, CAST(count(*) AS BIGINT) AS count FROM (SELECT unnest(labels) AS label FROM nodes) GROUP BY label""")
def q_label_counts(spark, sf):
    return stats.label_counts(g(spark, sf).nodes)


@register("label_summary", """
, c AS (SELECT label, count(*) AS cnt FROM (SELECT unnest(labels) AS label FROM nodes) GROUP BY label)
SELECT string_agg(label || ':' || CAST(cnt AS VARCHAR), ',' ORDER BY cnt DESC, label) AS labels_text,
       CAST(coalesce(sum(cnt), 0) AS BIGINT) AS totalMemories FROM c""")
def q_label_summary(spark, sf):
    s = stats.label_summary(g(spark, sf).nodes)
    return s.select(F.array_join(F.transform("labels", lambda x: F.concat(
        x["label"], F.lit(":"), x["count"].cast("string"))), ",").alias("labels_text"), "totalMemories")


@register("count_memories", "SELECT CAST(count(*) AS BIGINT) AS count FROM nodes")
def q_count_memories(spark, sf):
    return stats.count_memories(g(spark, sf).nodes)


@register("distinct_labels", "SELECT DISTINCT unnest(labels) AS label FROM nodes")
def q_distinct_labels(spark, sf):
    return stats.distinct_labels(g(spark, sf).nodes)


@register("relationship_type_counts", "SELECT type, CAST(count(*) AS BIGINT) AS count FROM edges GROUP BY type")
def q_relationship_type_counts(spark, sf):
    return stats.relationship_type_counts(g(spark, sf).edges)


# Further registrations live in their own modules.
from mnemo.plans import change_queries  # noqa: E402,F401
