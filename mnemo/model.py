"""The graph data model: node and edge tables.

``nodes``: one row per memory

    memory_id BIGINT, labels ARRAY<STRING>, first_label STRING,
    created_at STRING, created_pv PV, search_text STRING, props MAP<STRING, PV>

``edges``: one row per connection (a multigraph: parallel edges and
self-loops are legal, so edges are keyed by ``edge_id`` only)

    edge_id BIGINT, src BIGINT, dst BIGINT, type STRING, props MAP<STRING, PV>

``first_label``, ``created_at``, ``created_pv`` and ``search_text`` are
derived from ``labels`` and ``props`` (see :func:`with_node_derived`);
every job that changes ``labels`` or ``props`` recomputes them. They let
label, date and text filters run on narrow columns, so a scan never has to
read the property maps to find candidates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.functions.values import PROPS_DDL, PV_DDL, search_text

NODE_COLUMNS = ["memory_id", "labels", "first_label", "created_at", "created_pv",
                "search_text", "props"]
EDGE_COLUMNS = ["edge_id", "src", "dst", "type", "props"]

NODE_DDL = (
    "memory_id bigint, labels array<string>, first_label string, created_at string, "
    f"created_pv {PV_DDL}, search_text string, props {PROPS_DDL}"
)
EDGE_DDL = f"edge_id bigint, src bigint, dst bigint, type string, props {PROPS_DDL}"


def first_label_of(labels: Column) -> Column:
    # get() returns null on an empty array; labels[0] would throw under ANSI.
    return F.get(labels, 0)


def created_at_of(props: Column) -> Column:
    """``created_at`` as a string, or null when missing or not a string
    (a comparison with a non-string is null in the reference, so such a
    node never passes a date filter)."""
    pv = props["created_at"]
    return F.when(pv["kind"] == "string", pv["text"])


def node_row(memory_id: Column, labels: Column, props: Column,
             first_label: Column | None = None) -> list[Column]:
    """Select list for a node row, derived columns included."""
    return [
        memory_id.cast("bigint").alias("memory_id"),
        labels.alias("labels"),
        (first_label if first_label is not None else first_label_of(labels)).alias("first_label"),
        created_at_of(props).alias("created_at"),
        props["created_at"].alias("created_pv"),
        search_text(props).alias("search_text"),
        props.alias("props"),
    ]


def with_node_derived(df: DataFrame) -> DataFrame:
    """Recompute the derived columns after ``labels``/``props`` changed."""
    return df.select(*node_row(F.col("memory_id"), F.col("labels"), F.col("props")))


def edge_row(edge_id: Column, src: Column, dst: Column, type_: Column, props: Column) -> list[Column]:
    return [edge_id.cast("bigint").alias("edge_id"), src.cast("bigint").alias("src"),
            dst.cast("bigint").alias("dst"), type_.cast("string").alias("type"),
            props.alias("props")]


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    # both directions of every edge, stored sorted by node id in snapshots
    # (see mnemo.operators.expand.adjacency); derived from edges when absent
    adj: DataFrame | None = None
    # the highest ids ever given out, as stored with a snapshot; ids are not
    # reused after a deletion, so these may lie above the highest stored ids
    node_high: int | None = None
    edge_high: int | None = None
    # the graph that this one was made from by a change, while the marks of
    # that graph are not known as numbers
    older: "Graph | None" = None
    # the edges as two tables, those that lie in order of (src, edge_id) as they
    # are made and the others, so that a snapshot need not shuffle the former
    edge_parts: "Callable[[], tuple[DataFrame, DataFrame]] | None" = None

    def high_water(self, id_col: str) -> int:
        """The highest id ever given out (0 without any): the stored mark, or
        the maximum over this graph's table and those of the graphs before."""
        known = self.node_high if id_col == "memory_id" else self.edge_high
        if known is not None:
            return known
        table = self.nodes if id_col == "memory_id" else self.edges
        top = table.agg(F.max(id_col)).first()[0] or 0
        return max(int(top), self.older.high_water(id_col) if self.older is not None else 0)

    def register(self, prefix: str = "") -> "Graph":
        """Expose the tables to ``spark.sql`` as ``nodes`` and ``edges``."""
        self.nodes.createOrReplaceTempView(prefix + "nodes")
        self.edges.createOrReplaceTempView(prefix + "edges")
        return self
