"""Derive a memory graph from the TPC-H-like test tables.

Node ids are ``k * 10**12 + natural key`` with one ``k`` per label, edge
ids likewise per type, so every id can be recomputed by plain SQL from the
same tables (the DuckDB oracles do exactly that).

Every branch is a narrow projection of one table; the union needs no
shuffle. The only shuffles are the distinct users of ``events`` (partial
aggregation first) and the numbering of order lines (window on
``l_orderkey``; the id formula itself requires fewer than 1000 lines per
order, so that window partition is bounded).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemo.fixed import ISO_MILLIS
from mnemo.functions.values import empty_props, props_map, pv_array, pv_number, pv_string
from mnemo.model import Graph, edge_row, node_row

# Id spaces of the derived graph.
K = 10 ** 12
NODE_ID_BASE = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5,
                "order": 6, "user": 7, "event": 8, "document": 9, "message": 10}
EDGE_ID_BASE = {"PART_OF": 1, "LIVES_IN": 2, "LOCATED_IN": 3, "PLACED_BY": 4,
                "CONTAINS": 5, "EMITTED": 6, "REPLIES_TO": 7}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def iso(ts_col) -> F.Column:
    """ISO-8601 text with milliseconds (micro-seconds truncated), as
    JavaScript's ``toISOString`` prints it. Session time zone is UTC."""
    return F.date_format(ts_col, ISO_MILLIS)


def _nid(label: str, key) -> F.Column:
    return F.lit(NODE_ID_BASE[label] * K) + key.cast("bigint")


def _eid(type_: str, key) -> F.Column:
    return F.lit(EDGE_ID_BASE[type_] * K) + key.cast("bigint")


def _node(df: DataFrame, label: str, key, props, labels=None) -> DataFrame:
    labels = labels if labels is not None else F.array(F.lit(label))
    # the properties are a column of their own before the derived columns
    # use them, so that they are computed once
    made = df.select(_nid(label, key).alias("memory_id"), labels.alias("labels"), props.alias("props"))
    return made.select(*node_row(F.col("memory_id"), F.col("labels"), F.col("props"), first_label=F.lit(label)))


def _debtor_labels(label: str, balance) -> F.Column:
    return F.when(balance < 0, F.array(F.lit(label), F.lit("debtor"))).otherwise(F.array(F.lit(label)))


def build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read_table(spark, sf_dir, n)
    c = F.col
    parts = [
        _node(t("region"), "region", c("r_regionkey"), props_map(("name", pv_string(c("r_name"))), inputs=[c("r_name")])),
        _node(t("nation"), "nation", c("n_nationkey"), props_map(("name", pv_string(c("n_name"))), inputs=[c("n_name")])),
        _node(t("customer"), "customer", c("c_custkey"), props_map(
            ("name", pv_string(c("c_name"))), ("mktsegment", pv_string(c("c_mktsegment"))),
            ("acctbal", pv_number(c("c_acctbal"))), inputs=[c("c_name"), c("c_mktsegment"), c("c_acctbal")]),
            labels=_debtor_labels("customer", c("c_acctbal"))),
        _node(t("supplier"), "supplier", c("s_suppkey"), props_map(
            ("name", pv_string(c("s_name"))), ("acctbal", pv_number(c("s_acctbal"))),
            inputs=[c("s_name"), c("s_acctbal")]),
            labels=_debtor_labels("supplier", c("s_acctbal"))),
        _node(t("part"), "part", c("p_partkey"), props_map(
            ("name", pv_string(c("p_name"))),
            ("tags", pv_array(F.array(c("p_brand"), c("p_type")))),
            ("size", pv_number(c("p_size"))), ("retailprice", pv_number(c("p_retailprice"))),
            inputs=[c("p_name"), c("p_size"), c("p_retailprice")])),
        _node(t("orders"), "order", c("o_orderkey"), props_map(
            ("status", pv_string(c("o_orderstatus"))), ("priority", pv_string(c("o_orderpriority"))),
            ("totalprice", pv_number(c("o_totalprice"))), ("created_at", pv_string(iso(c("o_orderdate")))),
            inputs=[c("o_orderstatus"), c("o_orderpriority"), c("o_totalprice"), c("o_orderdate")])),
        _node(t("events").where(c("user_id").isNotNull()).select("user_id").distinct(), "user",
              c("user_id"), props_map(("name", pv_string(F.concat(F.lit("user_"), c("user_id").cast("string")))),
                                    inputs=[c("user_id")])),
        _node(t("events"), "event", c("event_id"), props_map(
            ("event_type", pv_string(c("event_type"))), ("value", pv_number(c("value"))),
            ("created_at", pv_string(iso(c("ts")))), inputs=[c("event_type"), c("value"), c("ts")])),
        _node(t("documents"), "document", c("doc_id"), props_map(
            ("text", pv_string(c("text"))), ("lang", pv_string(c("lang"))),
            ("source", pv_string(c("source"))), ("n_chars", pv_number(c("n_chars"))),
            inputs=[c("text"), c("lang"), c("source"), c("n_chars")])),
        _node(t("conversations"), "message", c("conv_id") * 1000 + c("turn"), props_map(
            ("text", pv_string(c("text"))), ("role", pv_string(c("role"))), inputs=[c("text"), c("role")])),
    ]
    return reduce(DataFrame.unionByName, parts)


def _edge(df: DataFrame, type_: str, key, src, dst, props=None) -> DataFrame:
    return df.select(*edge_row(_eid(type_, key), src, dst, F.lit(type_),
                               props if props is not None else empty_props()))


def contains_line_number() -> F.Column:
    """Position of a line inside its order (1-based, total order)."""
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return F.row_number().over(w)


def _edge_tables(spark: SparkSession, sf_dir: str, in_order: bool = False) -> dict[str, DataFrame]:
    """The connections of each type. ``in_order``: order lines are dealt out by
    ranges of their order instead of its hash."""
    t = lambda n: read_table(spark, sf_dir, n)
    c = F.col
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                              "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    li = (li.repartitionByRange("l_orderkey") if in_order else li).withColumn("rn", contains_line_number())
    conv = t("conversations").where(c("turn") > 0)
    return {
        "PART_OF": _edge(t("nation"), "PART_OF", c("n_nationkey"), _nid("nation", c("n_nationkey")),
                         _nid("region", c("n_regionkey"))),
        "LIVES_IN": _edge(t("customer"), "LIVES_IN", c("c_custkey"), _nid("customer", c("c_custkey")),
                          _nid("nation", c("c_nationkey"))),
        "LOCATED_IN": _edge(t("supplier"), "LOCATED_IN", c("s_suppkey"), _nid("supplier", c("s_suppkey")),
                            _nid("nation", c("s_nationkey"))),
        "PLACED_BY": _edge(t("orders"), "PLACED_BY", c("o_orderkey"), _nid("order", c("o_orderkey")),
                           _nid("customer", c("o_custkey"))),
        "CONTAINS": _edge(li, "CONTAINS", c("l_orderkey") * 1000 + c("rn"), _nid("order", c("l_orderkey")),
                          _nid("part", c("l_partkey")), props_map(
                              ("quantity", pv_number(c("l_quantity"))),
                              ("extendedprice", pv_number(c("l_extendedprice"))),
                              ("discount", pv_number(c("l_discount"))),
                              ("returnflag", pv_string(c("l_returnflag"))),
                              inputs=[c("l_quantity"), c("l_extendedprice"), c("l_discount"), c("l_returnflag")])),
        "EMITTED": _edge(t("events").where(c("user_id").isNotNull()), "EMITTED", c("event_id"),
                         _nid("user", c("user_id")), _nid("event", c("event_id"))),
        "REPLIES_TO": _edge(conv, "REPLIES_TO", c("conv_id") * 1000 + c("turn"),
                            _nid("message", c("conv_id") * 1000 + c("turn")),
                            _nid("message", c("conv_id") * 1000 + c("turn") - 1)),
    }


def build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, _edge_tables(spark, sf_dir).values())


def edges_by_order(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same connections as two tables: the order lines, which numbering by
    ranges of orders leaves in order of (src, edge_id), and all others."""
    tables = _edge_tables(spark, sf_dir, in_order=True)
    return tables.pop("CONTAINS"), reduce(DataFrame.unionByName, tables.values())


def build_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The derived graph as lazy DataFrames over the test tables."""
    return Graph(build_nodes(spark, sf_dir), build_edges(spark, sf_dir), edge_parts=lambda: edges_by_order(spark, sf_dir))
