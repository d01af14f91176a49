"""Data-quality audits and restructuring jobs over the whole graph.

The reference states these rules as advice to its caller (lower-case
labels, UPPERCASE connection types, search before creating, always set a
name, connect what you store, promote rich properties to entities, move
legacy ``content`` to ``name``); here they run as distributed jobs.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.functions.values import empty_props, pv_string
from mnemo.model import EDGE_COLUMNS, NODE_COLUMNS, Graph, edge_row, node_row
from mnemo.operators.delta import GraphDelta, apply_delta
from mnemo.operators.mutate import assign_ids


def audit_label_case(nodes: DataFrame) -> DataFrame:
    """G1: labels that are not lower-case, with how many nodes carry them."""
    return (nodes.select(F.explode("labels").alias("label")).where(F.col("label") != F.lower("label"))
            .groupBy("label").agg(F.count(F.lit(1)).alias("count")))


def audit_type_case(edges: DataFrame) -> DataFrame:
    """Connection types that are not UPPERCASE."""
    return (edges.where(F.col("type") != F.upper("type"))
            .groupBy("type").agg(F.count(F.lit(1)).alias("count")))


def audit_isolated(graph: Graph) -> DataFrame:
    """Memories with no connection in either direction."""
    # distinct with a partial (map-side) step: a hub's many edges leave each
    # task as one row
    ends = graph.edges.select(F.col("src").alias("memory_id")).unionByName(
        graph.edges.select(F.col("dst").alias("memory_id"))).distinct()
    return graph.nodes.select("memory_id", "first_label").join(ends, "memory_id", "left_anti")


def _name() -> F.Column:
    pv = F.col("props")["name"]
    return F.when(pv["kind"] == "string", pv["text"])


def audit_duplicate_names(nodes: DataFrame) -> DataFrame:
    """Duplicate candidates: same first label and same name after
    trimming and lower-casing. Partial aggregation keeps a popular name
    cheap."""
    return (nodes.where(_name().isNotNull())
            .groupBy(F.col("first_label").alias("label"), F.lower(F.trim(_name())).alias("norm_name"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("memory_id").alias("first_id"))
            .where(F.col("n") > 1))


def audit_missing_name(nodes: DataFrame) -> DataFrame:
    """Per first label, memories without a string ``name``."""
    return (nodes.where(_name().isNull())
            .groupBy(F.col("first_label").alias("label")).agg(F.count(F.lit(1)).alias("n")))


def connection_patterns(graph: Graph) -> DataFrame:
    """(source label, type, target label, count) over first labels."""
    lab = graph.nodes.select("memory_id", "first_label")
    return (graph.edges.select("src", "dst", "type")
            .join(lab.withColumnRenamed("memory_id", "src").withColumnRenamed("first_label", "src_label"), "src")
            .join(lab.withColumnRenamed("memory_id", "dst").withColumnRenamed("first_label", "dst_label"), "dst")
            .groupBy("src_label", "type", "dst_label").agg(F.count(F.lit(1)).alias("count")))


def promote_property(graph: Graph, key: str, holder_label: str, new_label: str, edge_type: str,
                     name_key: str = "name") -> Graph:
    """Distinct string values of ``key`` on nodes whose first label is
    ``holder_label`` become nodes (``new_label``, ``{name: value}``), each
    holder gets an ``edge_type`` connection to its value's node, and the
    property is removed from the holders, by a rewrite of the rows in one
    scan. Ids of new nodes and edges are assigned above all given out.
    """
    pv = F.col("props")[key]
    holders = (graph.nodes.where((F.col("first_label") == holder_label) & (pv["kind"] == "string"))
               .select("memory_id", pv["text"].alias("value")))
    values = holders.select("value").distinct().withColumn("memory_id", F.lit(None).cast("bigint"))
    values, node_high = assign_ids(values, graph, "memory_id", "promoted-values")
    new_nodes = values.select(*node_row(F.col("memory_id"), F.array(F.lit(new_label)),
                                        F.create_map(F.lit(name_key), pv_string(F.col("value")))))
    links = (holders.withColumnRenamed("memory_id", "src")
             .join(values.withColumnRenamed("memory_id", "dst"), "value")
             .withColumn("edge_id", F.lit(None).cast("bigint")))
    links, edge_high = assign_ids(links, graph, "edge_id", "promoted-links")
    new_edges = links.select(*edge_row(F.col("edge_id"), F.col("src"), F.col("dst"), F.lit(edge_type),
                                       empty_props()))
    holds = (F.col("first_label") == holder_label) & (pv["kind"] == "string")
    nodes = _rewritten(graph.nodes, holds, F.map_filter("props", lambda k, v: k != F.lit(key)))
    return apply_delta(replace(graph, nodes=nodes), GraphDelta(
        node_inserts=new_nodes.select(*NODE_COLUMNS), edge_inserts=new_edges.select(*EDGE_COLUMNS), node_high=node_high, edge_high=edge_high))


def _rewritten(nodes: DataFrame, where: F.Column, props: F.Column) -> DataFrame:
    """All nodes in one scan, with ``props`` for those that match ``where``
    (their derived columns are recomputed, the others' are kept)."""
    todo = F.coalesce(where, F.lit(False))
    fresh = dict(zip(NODE_COLUMNS, node_row(F.col("memory_id"), F.col("labels"), props)))
    return nodes.select(*(F.when(todo, fresh[c]).otherwise(F.col(c)).alias(c) for c in NODE_COLUMNS))


def migrate_property(graph: Graph, src_key: str = "content", dst_key: str = "name") -> Graph:
    """Where ``dst_key`` is missing and ``src_key`` present, move the
    value to ``dst_key`` (legacy ``content`` -> ``name``)."""
    props = F.col("props")
    todo = props[src_key].isNotNull() & props[dst_key].isNull()
    moved = F.map_from_entries(F.concat(
        F.filter(F.map_entries(props), lambda e: ~e["key"].isin(src_key, dst_key)),
        F.array(F.struct(F.lit(dst_key).alias("key"), props[src_key].alias("value")))))
    return replace(graph, nodes=_rewritten(graph.nodes, todo, moved))


__all__ = ["audit_label_case", "audit_type_case", "audit_isolated", "audit_duplicate_names",
           "audit_missing_name", "connection_patterns", "promote_property", "migrate_property"]
