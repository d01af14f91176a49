"""What a change does to a graph: the rows it adds, replaces and removes.

Every change job and the replay return a delta, whose size follows the
requests. Merging it into the graph's tables (:func:`apply_delta`) and
writing it (:func:`write_delta`) are separate steps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.model import EDGE_COLUMNS, EDGE_DDL, NODE_COLUMNS, NODE_DDL, Graph


@dataclass(frozen=True)
class GraphDelta:
    """Full rows of new (``inserts``: their ids are not in the graph) and of
    new or changed (``upserts``) nodes and edges, and the ids that are gone.
    None stands for no rows. The marks are the highest ids given out after
    the change, where known."""
    node_inserts: DataFrame | None = None
    node_upserts: DataFrame | None = None
    node_deletes: DataFrame | None = None   # memory_id
    edge_inserts: DataFrame | None = None
    edge_upserts: DataFrame | None = None
    edge_deletes: DataFrame | None = None   # edge_id
    node_high: int | None = None
    edge_high: int | None = None
    # ids of all stored rows that are replaced or gone, where they are at hand
    # without reading the graph
    node_gone: DataFrame | None = None      # memory_id
    edge_gone: DataFrame | None = None      # edge_id


PARTS = ("node_inserts", "node_upserts", "node_deletes", "edge_inserts", "edge_upserts", "edge_deletes")


@dataclass(frozen=True)
class Change:
    """A change of ``base`` and one result row per request."""
    base: Graph
    delta: GraphDelta
    result: DataFrame

    @property
    def graph(self) -> Graph:
        return apply_delta(self.base, self.delta)


def _merged(table: DataFrame, columns: list[str], key: str, inserts, upserts, deletes, known=None) -> DataFrame:
    out = table.select(*columns)
    gone = [d.select(key) for d in ((upserts, deletes) if known is None else (known,)) if d is not None]
    if gone:
        ids = gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])
        out = out.join(ids, key, "left_anti").select(*columns)
    for new in (inserts, upserts):
        if new is not None:
            out = out.unionByName(new.select(*columns))
    return out


def _merged_adjacency(adj: DataFrame, d: GraphDelta) -> DataFrame:
    """The stored adjacency less the connections that are gone and with the
    new ones: the stored table is read as it lies, clustered on the node, and
    never made anew from all edges. Changed connections keep their ends."""
    from mnemo.operators.expand import ADJ_COLUMNS, adjacency

    out = adj.select(*ADJ_COLUMNS)
    if d.edge_deletes is not None:
        out = out.join(d.edge_deletes.select("edge_id"), "edge_id", "left_anti").select(*ADJ_COLUMNS)
    if d.edge_inserts is not None:
        out = out.unionByName(adjacency(d.edge_inserts).select(*ADJ_COLUMNS))
    return out


def apply_delta(graph: Graph, d: GraphDelta) -> Graph:
    """The graph after a delta. Untouched rows pass through; a table that a
    delta does not name is the same table."""
    nodes, edges, adj = graph.nodes, graph.edges, graph.adj
    if any(x is not None for x in (d.node_inserts, d.node_upserts, d.node_deletes)):
        nodes = _merged(nodes, NODE_COLUMNS, "memory_id", d.node_inserts, d.node_upserts, d.node_deletes, d.node_gone)
    if any(x is not None for x in (d.edge_inserts, d.edge_upserts, d.edge_deletes)):
        edges = _merged(edges, EDGE_COLUMNS, "edge_id", d.edge_inserts, d.edge_upserts, d.edge_deletes, d.edge_gone)
        adj = None if adj is None else _merged_adjacency(adj, d)
    high = [None if h is None else max(h, new or 0)
            for h, new in ((graph.node_high, d.node_high), (graph.edge_high, d.edge_high))]
    return Graph(nodes, edges, adj, *high, older=None if None not in high else graph)


# Ids of stored rows that are replaced or gone are sent to every task up to
# this number (about 100 MB there), so that the stored rows stay where they are.
SENT_IDS = 2_000_000


def sent_if_few(ids: DataFrame, most: int | None = None) -> DataFrame:
    """A written table of ids, to be sent to every task if it has at most
    ``most`` rows (``SENT_IDS``), whatever the planner takes its bytes for."""
    return F.broadcast(ids) if ids.count() <= (SENT_IDS if most is None else most) else ids


@dataclass(frozen=True)
class NetDelta:
    """What a series of deltas comes to on the graph before the first one:
    ids of its rows that are replaced or gone (``deletes``) and full rows
    (``inserts``). Bounded: few enough ids are gone to be sent to every task."""
    delta: GraphDelta
    nodes_bounded: bool
    edges_bounded: bool


def net_delta(spark: SparkSession, deltas: list[GraphDelta]) -> NetDelta:
    """Fold deltas, the first one first. Only tables as large as the deltas
    are joined; the ids gone are written, which also counts them."""
    from mnemo.sources.snapshot import materialize_all

    def fold(kind: str, columns: list[str], key: str, ddl: str) -> tuple[DataFrame, DataFrame]:
        none = spark.range(0).select(F.from_json(F.lit(None).cast("string"), ddl).alias("row")).select("row.*")
        rows, events = none, none.select(key, F.lit(-1).alias("at"), F.lit(False).alias("made"))
        for i, d in enumerate(deltas):
            parts = [getattr(d, f"{kind}_{p}") for p in ("inserts", "upserts", "deletes")]
            rows = _merged(rows, columns, key, *parts)
            for part, made in zip(parts, (True, False, False)):
                if part is not None:
                    events = events.unionByName(part.select(key, F.lit(i).alias("at"), F.lit(made).alias("made")))
        # a row that a delta made is no row of the graph before
        first = events.groupBy(key).agg(F.min(F.struct("at", "made")).alias("first"))
        return rows, first.where(~F.col("first.made")).select(key)

    node_rows, nodes_gone = fold("node", NODE_COLUMNS, "memory_id", NODE_DDL)
    edge_rows, edges_gone = fold("edge", EDGE_COLUMNS, "edge_id", EDGE_DDL)
    gone = materialize_all(spark, [(nodes_gone, "net-nodes-gone"), (edges_gone, "net-edges-gone")])
    bounded = [x.count() <= SENT_IDS for x in gone]
    nodes_gone, edges_gone = [F.broadcast(x) if small else x for x, small in zip(gone, bounded)]
    highs = [max((h for h in marks if h is not None), default=None)
             for marks in ([d.node_high for d in deltas], [d.edge_high for d in deltas])]
    return NetDelta(GraphDelta(node_rows, None, nodes_gone, edge_rows, None, edges_gone, *highs), *bounded)


def write_delta(d: GraphDelta, path: str, mode: str = "overwrite", **extra: DataFrame) -> str:
    """Write the parts of a delta (and ``extra`` tables) side by side."""
    from mnemo.sources.snapshot import run_parallel

    tables = {p: getattr(d, p) for p in PARTS if getattr(d, p) is not None} | extra
    spark = next(iter(tables.values())).sparkSession
    tables["meta"] = spark.createDataFrame([(d.node_high, d.edge_high, ",".join(p for p in PARTS if getattr(d, p) is not None))],
                                           "node_high bigint, edge_high bigint, parts string").coalesce(1)
    run_parallel(*[(lambda df=df, name=name: df.write.mode(mode).parquet(f"{path}/{name}")) for name, df in tables.items()])
    return path


def read_delta(spark: SparkSession, path: str) -> GraphDelta:
    meta = spark.read.parquet(f"{path}/meta").first()
    parts = {p: spark.read.parquet(f"{path}/{p}") for p in meta.parts.split(",") if p}
    return GraphDelta(**parts, node_high=meta.node_high, edge_high=meta.edge_high)


def top_id(df: DataFrame, id_col: str) -> int:
    return int(df.agg(F.max(id_col)).first()[0] or 0)
