"""Plain-SQL oracles (DuckDB dialect) for the registered queries.

Each oracle is one statement over the base tables: it rebuilds the derived
graph with a shared CTE prefix (``nodes``, ``edges``, ``props_long``,
``adj``) written independently of the Spark code, then answers the query.
"""

from __future__ import annotations

K = 1_000_000_000_000


def jsnum(x: str) -> str:
    """JavaScript number text (same rule as ``js_number_text``)."""
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE regexp_replace(CAST(CAST(CAST(CAST({x} AS DOUBLE) "
            f"AS VARCHAR) AS DECIMAL(38,18)) AS VARCHAR), '\\.?0+$', '') END")


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def nid(base: int, key: str) -> str:
    return f"(CAST({base * K} AS BIGINT) + CAST({key} AS BIGINT))"


def _st(*parts: str) -> str:
    return "lower(concat_ws(chr(10), " + ", ".join(parts) + "))"


# (label, select body) -- one row per node: memory_id, labels, first_label,
# created_at, search_text, name
_NODE_BRANCHES = [
    f"""SELECT {nid(1, 'r_regionkey')} AS memory_id, ['region'] AS labels, 'region' AS first_label,
        CAST(NULL AS VARCHAR) AS created_at, {_st('r_name')} AS search_text, r_name AS name FROM region""",
    f"""SELECT {nid(2, 'n_nationkey')}, ['nation'], 'nation', NULL, {_st('n_name')}, n_name FROM nation""",
    f"""SELECT {nid(3, 'c_custkey')}, CASE WHEN c_acctbal < 0 THEN ['customer', 'debtor'] ELSE ['customer'] END,
        'customer', NULL, {_st('c_name', 'c_mktsegment', jsnum('c_acctbal'))}, c_name FROM customer""",
    f"""SELECT {nid(4, 's_suppkey')}, CASE WHEN s_acctbal < 0 THEN ['supplier', 'debtor'] ELSE ['supplier'] END,
        'supplier', NULL, {_st('s_name', jsnum('s_acctbal'))}, s_name FROM supplier""",
    f"""SELECT {nid(5, 'p_partkey')}, ['part'], 'part', NULL,
        {_st('p_name', "coalesce(p_brand, '') || ' ' || coalesce(p_type, '')", jsnum('p_size'), jsnum('p_retailprice'))},
        p_name FROM part""",
    f"""SELECT {nid(6, 'o_orderkey')}, ['order'], 'order', {iso('o_orderdate')},
        {_st('o_orderstatus', 'o_orderpriority', jsnum('o_totalprice'), iso('o_orderdate'))}, NULL FROM orders""",
    f"""SELECT {nid(7, 'user_id')}, ['user'], 'user', NULL, {_st("'user_' || CAST(user_id AS VARCHAR)")},
        'user_' || CAST(user_id AS VARCHAR) FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)""",
    f"""SELECT {nid(8, 'event_id')}, ['event'], 'event', {iso('ts')},
        {_st('event_type', jsnum('value'), iso('ts'))}, NULL FROM events""",
    f"""SELECT {nid(9, 'doc_id')}, ['document'], 'document', NULL,
        {_st('text', 'lang', 'source', jsnum('n_chars'))}, NULL FROM documents""",
    f"""SELECT {nid(10, 'conv_id * 1000 + turn')}, ['message'], 'message', NULL, {_st('text', 'role')}, NULL
        FROM conversations""",
]

# long form of every property: memory_id, key, kind, text, num
_PROP_BRANCHES = [
    ("region", "r_regionkey", [("name", "string", "r_name")]),
    ("nation", "n_nationkey", [("name", "string", "n_name")]),
    ("customer", "c_custkey", [("name", "string", "c_name"), ("mktsegment", "string", "c_mktsegment"),
                               ("acctbal", "number", "c_acctbal")]),
    ("supplier", "s_suppkey", [("name", "string", "s_name"), ("acctbal", "number", "s_acctbal")]),
    ("part", "p_partkey", [("name", "string", "p_name"),
                           ("tags", "array", "coalesce(p_brand, '') || ' ' || coalesce(p_type, '')"),
                           ("size", "number", "p_size"), ("retailprice", "number", "p_retailprice")]),
    ("orders", "o_orderkey", [("status", "string", "o_orderstatus"), ("priority", "string", "o_orderpriority"),
                              ("totalprice", "number", "o_totalprice"), ("created_at", "string", iso("o_orderdate"))]),
    ("(SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)", "user_id",
     [("name", "string", "'user_' || CAST(user_id AS VARCHAR)")]),
    ("events", "event_id", [("event_type", "string", "event_type"), ("value", "number", "value"),
                            ("created_at", "string", iso("ts"))]),
    ("documents", "doc_id", [("text", "string", "text"), ("lang", "string", "lang"),
                             ("source", "string", "source"), ("n_chars", "number", "n_chars")]),
    ("conversations", "conv_id * 1000 + turn", [("text", "string", "text"), ("role", "string", "role")]),
]
_BASES = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "orders": 6, "events": 8,
          "documents": 9, "conversations": 10}


def _prop_sql() -> str:
    out = []
    for table, key, props in _PROP_BRANCHES:
        base = _BASES.get(table, 7)
        for k, kind, expr in props:
            text = jsnum(expr) if kind == "number" else expr
            num = f"CAST({expr} AS DOUBLE)" if kind == "number" else "CAST(NULL AS DOUBLE)"
            out.append(f"SELECT {nid(base, key)} AS memory_id, '{k}' AS key, '{kind}' AS kind, "
                       f"{text} AS text, {num} AS num FROM {table} WHERE ({expr}) IS NOT NULL")
    return "\n    UNION ALL ".join(out)


_EDGE_SQL = f"""
    SELECT {nid(1, 'n_nationkey')} AS edge_id, {nid(2, 'n_nationkey')} AS src, {nid(1, 'n_regionkey')} AS dst,
           'PART_OF' AS type FROM nation
    UNION ALL SELECT {nid(2, 'c_custkey')}, {nid(3, 'c_custkey')}, {nid(2, 'c_nationkey')}, 'LIVES_IN' FROM customer
    UNION ALL SELECT {nid(3, 's_suppkey')}, {nid(4, 's_suppkey')}, {nid(2, 's_nationkey')}, 'LOCATED_IN' FROM supplier
    UNION ALL SELECT {nid(4, 'o_orderkey')}, {nid(6, 'o_orderkey')}, {nid(3, 'o_custkey')}, 'PLACED_BY' FROM orders
    UNION ALL SELECT {nid(5, 'l_orderkey * 1000 + rn')}, {nid(6, 'l_orderkey')}, {nid(5, 'l_partkey')}, 'CONTAINS'
      FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem)
    UNION ALL SELECT {nid(6, 'event_id')}, {nid(7, 'user_id')}, {nid(8, 'event_id')}, 'EMITTED'
      FROM events WHERE user_id IS NOT NULL
    UNION ALL SELECT {nid(7, 'conv_id * 1000 + turn')}, {nid(10, 'conv_id * 1000 + turn')},
           {nid(10, 'conv_id * 1000 + turn - 1')}, 'REPLIES_TO' FROM conversations WHERE turn > 0"""

GRAPH_CTE = (
    "WITH nodes AS (\n    " + "\n    UNION ALL ".join(_NODE_BRANCHES) + "\n),\n"
    "props_long AS (\n    " + _prop_sql() + "\n),\n"
    "edges AS (" + _EDGE_SQL + "\n),\n"
    "adj AS (SELECT src AS a, dst AS b, edge_id, type, TRUE AS outgoing FROM edges\n"
    "        UNION ALL SELECT dst, src, edge_id, type, FALSE FROM edges WHERE src <> dst)"
)


def with_graph(sql: str) -> str:
    """Prefix a query body (which may start with more ``, name AS (...)``
    CTEs) with the graph CTEs."""
    body = sql.strip()
    if body.startswith(","):
        return GRAPH_CTE + body
    return GRAPH_CTE + "\n" + body
