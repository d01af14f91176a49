"""Graph snapshots on shared storage (Parquet), and result sinks.

A snapshot is a folder with ``nodes/`` (partitioned by a fixed number of
label buckets, so a label filter prunes to one folder however many labels
exist, and range-clustered on (label, ``created_at``) so label and date
filters skip files and row groups by min/max statistics),
``edges/`` (range-clustered on ``src``), ``adjacency/`` (both directions of every
edge, each range-clustered on the node id, for expansion lookups) and ``meta/`` (the
highest ids given out). Snapshots are immutable: a change is a delta, and merging
deltas writes a new snapshot, which doubles as the lineage cut of long job chains.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.functions.values import search_text
from mnemo.model import EDGE_COLUMNS, EDGE_DDL, NODE_COLUMNS, NODE_DDL, Graph
from mnemo.session import checkpoint_dir

LABEL_BUCKETS = 64
# snapshots are written whole and read often
CODEC = "zstd"
# a compaction clusters a table anew once more than one in LOOSE of its rows
# lies beside the clustered ones
LOOSE = 5


def run_parallel(*jobs) -> None:
    """Run independent write jobs concurrently (Spark schedules jobs from
    several threads side by side, filling idle task slots)."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        for f in [pool.submit(j) for j in jobs]:
            f.result()


def label_bucket_of(label) -> F.Column:
    """Partition bucket of a first label. On a literal label Catalyst folds
    it to a constant, which prunes the snapshot's partition folders."""
    return F.pmod(F.xxhash64(label), F.lit(LABEL_BUCKETS)).cast("int")


def _with_blooms(writer, *columns: str):
    """Bloom filters let a lookup of scattered ids skip row groups."""
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return writer


def _write_nodes(nodes: DataFrame, path: str, mode: str) -> None:
    # Files and row groups cover narrow (label, created_at) ranges, so the
    # search's label and since-date filters skip whole files and row groups
    # by their statistics; ties (and the many nodes without created_at)
    # are split by id, so no range is a hot spot. The texts repeat what the
    # properties hold, so they are made after the shuffle and the sort.
    order = ["label_bucket", "first_label", "created_at", "memory_id"]
    df = (nodes.select("memory_id", "labels", "first_label", "created_at", "props", label_bucket_of(F.col("first_label")).alias("label_bucket"))
          .repartitionByRange(*order).sortWithinPartitions(*order)
          .withColumns({"created_pv": F.col("props")["created_at"], "search_text": search_text("props")}))
    _with_blooms(df.select(*NODE_COLUMNS, "label_bucket").write.mode(mode).option("compression", CODEC), "memory_id") \
        .option("partitionOverwriteMode", "static").partitionBy("label_bucket").parquet(f"{path}/nodes")


def _copy_nodes(stored: DataFrame, gone: DataFrame, path: str) -> None:
    """Append the stored nodes that stay, one label bucket (of at most
    ``LABEL_BUCKETS``) at a time: files keep the order of their rows, where
    one write of all buckets would sort the rows by bucket first."""
    for (bucket,) in sorted(stored.select("label_bucket").distinct().collect()):
        kept = stored.where(F.col("label_bucket") == bucket).select(*NODE_COLUMNS).join(gone, "memory_id", "left_anti").select(*NODE_COLUMNS)
        _with_blooms(kept.write.mode("append").option("compression", CODEC), "memory_id").parquet(f"{path}/nodes/label_bucket={bucket}")


def _write_edges(edges: DataFrame, path: str, mode: str) -> None:
    _with_blooms(edges.write.mode(mode).option("compression", CODEC), "edge_id").parquet(f"{path}/edges")


def _write_adjacency(adj: DataFrame, path: str, mode: str) -> None:
    from mnemo.operators.expand import ADJ_COLUMNS

    adj.select(*ADJ_COLUMNS).write.mode(mode).option("compression", CODEC).parquet(f"{path}/adjacency")


def _clustered(df: DataFrame, *order: str) -> DataFrame:
    """Range bounds on (node, edge_id): a hub node can span several files."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def _write_meta(spark: SparkSession, path: str, mode: str, *marks: int) -> None:
    spark.createDataFrame([marks], "node_high bigint, edge_high bigint, loose_nodes bigint, loose_edges bigint").coalesce(1) \
        .write.mode(mode).parquet(f"{path}/meta")


def write_graph(graph: Graph, path: str, mode: str = "errorifexists") -> str:
    """Write nodes, edges, the adjacency table and the id marks.

    A snapshot is written once, to a new folder. The edge and adjacency
    tables are range-partitioned and sorted on the node id, so each file and
    row group covers a narrow id range and a lookup of a few hundred seeds
    reads only the row groups (and in them the pages) whose min/max include
    them; nodes are clustered for searches and carry Bloom filters for
    lookups by id. The number of files follows the data (adaptive partition
    sizes). Edges that the graph has in order already (``edge_parts``) are not
    shuffled for it.
    """
    from mnemo.operators.expand import steps_back, steps_out

    spark = graph.edges.sparkSession

    def edges() -> None:
        if graph.edge_parts is None:
            _write_edges(_clustered(graph.edges.select(*EDGE_COLUMNS), "src", "edge_id"), path, mode)
        else:
            in_order, others = graph.edge_parts()
            _write_edges(in_order.select(*EDGE_COLUMNS), path, mode)
            _write_edges(_clustered(others.select(*EDGE_COLUMNS), "src", "edge_id"), path, "append")
        # from the stored edges: these lie in the order of the steps along
        # them, so only the steps back are shuffled
        stored = spark.read.schema(EDGE_DDL).parquet(f"{path}/edges")
        _write_adjacency(steps_out(stored), path, mode)
        _write_adjacency(_clustered(steps_back(stored), "a", "edge_id"), path, "append")

    run_parallel(lambda: _write_nodes(graph.nodes, path, mode), edges)
    top = [graph.high_water("memory_id") if graph.node_high is not None or graph.older is not None else
           spark.read.schema(NODE_DDL).parquet(f"{path}/nodes").agg(F.max("memory_id")).first()[0] or 0,
           graph.high_water("edge_id") if graph.edge_high is not None or graph.older is not None else
           spark.read.schema(EDGE_DDL).parquet(f"{path}/edges").agg(F.max("edge_id")).first()[0] or 0]
    _write_meta(spark, path, mode, *top, 0, 0)
    return path


def write_compacted(spark: SparkSession, stored_path: str, net, path: str, mode: str = "overwrite") -> str:
    """Write the whole graph of a stored snapshot and the net change since
    (``operators.delta.NetDelta``) as a new snapshot.

    Rows that stay are copied as they lie, clustered as before, so they are
    neither shuffled nor sorted again; the new ones are clustered among
    themselves and lie beside them. A table of which those come to more than
    one in ``LOOSE``, or more rows are gone than are sent to every task, is
    clustered anew, as in :func:`write_graph`."""
    from mnemo.operators.delta import apply_delta
    from mnemo.operators.expand import adjacency

    stored = read_graph(spark, stored_path)
    graph = apply_delta(stored, net.delta)
    marks = spark.read.parquet(f"{stored_path}/meta").first().asDict()
    new_nodes, new_edges = net.delta.node_inserts, net.delta.edge_inserts.select(*EDGE_COLUMNS)
    nodes_gone, edges_gone = net.delta.node_deletes, net.delta.edge_deletes
    loose_nodes = (marks.get("loose_nodes") or 0) + new_nodes.count()
    loose_edges = (marks.get("loose_edges") or 0) + new_edges.count()
    copy_nodes = net.nodes_bounded and loose_nodes * LOOSE <= stored.nodes.count()
    copy_edges = net.edges_bounded and loose_edges * LOOSE <= stored.edges.count()

    def nodes() -> None:
        if not copy_nodes:
            return _write_nodes(graph.nodes, path, mode)
        _write_nodes(new_nodes, path, mode)
        _copy_nodes(stored.nodes, nodes_gone, path)

    def edges() -> None:
        if not copy_edges:
            return _write_edges(_clustered(graph.edges.select(*EDGE_COLUMNS), "src", "edge_id"), path, mode)
        _write_edges(stored.edges.join(edges_gone, "edge_id", "left_anti").select(*EDGE_COLUMNS), path, mode)
        _write_edges(_clustered(new_edges, "src", "edge_id"), path, "append")

    def steps() -> None:
        if not copy_edges:
            return _write_adjacency(_clustered(graph.adj, "a", "edge_id"), path, mode)
        _write_adjacency(stored.adj.join(edges_gone, "edge_id", "left_anti"), path, mode)
        _write_adjacency(_clustered(adjacency(new_edges), "a", "edge_id"), path, "append")

    run_parallel(nodes, edges, steps)
    _write_meta(spark, path, mode, graph.high_water("memory_id"), graph.high_water("edge_id"),
                loose_nodes if copy_nodes else 0, loose_edges if copy_edges else 0)
    return path


def read_graph(spark: SparkSession, path: str) -> Graph:
    from mnemo.operators.expand import ADJ_COLUMNS

    # label_bucket stays visible so label filters can prune folders
    nodes = spark.read.parquet(f"{path}/nodes").select(*NODE_COLUMNS, "label_bucket")
    edges = spark.read.parquet(f"{path}/edges").select(*EDGE_COLUMNS)
    adj = spark.read.parquet(f"{path}/adjacency").select(*ADJ_COLUMNS)
    meta = spark.read.parquet(f"{path}/meta").first()
    return Graph(nodes, edges, adj, meta.node_high, meta.edge_high)


_RUNS: dict[str, str] = {}


def run_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, under the shared
    checkpoint directory."""
    base = checkpoint_dir(spark).rstrip("/")
    app = f"{spark.sparkContext.applicationId}@{base}"
    return _RUNS.setdefault(app, f"{base}/mnemo-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}")


def release_run(spark: SparkSession) -> None:
    """Delete the intermediate tables written so far by this application.
    Call it when no result that was built on them is needed any more."""
    folder = run_folder(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table (see :func:`run_folder`)."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut
    that survives executor loss (unlike cached or locally checkpointed
    blocks)."""
    p = scratch_path(spark, name)
    df.write.parquet(p)
    return spark.read.parquet(p)


def materialize_all(spark: SparkSession, items: list[tuple[DataFrame, str]]) -> list[DataFrame]:
    """:func:`materialize` several independent tables concurrently."""
    paths = [scratch_path(spark, name) for _, name in items]
    run_parallel(*[(lambda df=df, p=p: df.write.parquet(p)) for (df, _), p in zip(items, paths)])
    return [spark.read.parquet(p) for p in paths]


def _json_string(s) -> F.Column:
    """A string as a JSON string literal (quoted and escaped)."""
    j = F.to_json(F.array(s))
    return j.substr(F.lit(2), F.length(j) - 2)


def pv_json(pv) -> F.Column:
    """A property value as ``JSON.stringify`` prints it: strings quoted,
    numbers in JavaScript text (NaN/Infinity become null), booleans, arrays
    of their items."""
    pv = F.col(pv) if isinstance(pv, str) else pv
    return (F.when(pv["kind"] == "string", _json_string(pv["text"]))
            .when((pv["kind"] == "number") & (F.isnan(pv["num"]) | (F.abs(pv["num"]) == float("inf"))),
                  F.lit("null"))
            .when(pv["kind"].isin("number", "boolean"), pv["text"])
            .when((pv["kind"] == "array") & pv["item_kind"].isin("number", "boolean"),
                  F.concat(F.lit("["), F.array_join(pv["items"], ","), F.lit("]")))
            .when(pv["kind"] == "array", F.to_json(pv["items"]))
            .otherwise(F.lit("null")))


def object_json(props, extra: list[tuple[str, F.Column]]) -> F.Column:
    """``{...props, <extra keys>}`` as JSON text; an extra key replaces a
    property of the same name (the reference spreads properties first)."""
    props = F.col(props) if isinstance(props, str) else props
    names = [k for k, _ in extra]
    kept = F.filter(F.map_entries(props), lambda e: ~e["key"].isin(*names))
    parts = F.transform(kept, lambda e: F.concat(_json_string(e["key"]), F.lit(":"), pv_json(e["value"])))
    extras = [F.concat(F.lit(f'"{k}":'), v) for k, v in extra]
    return F.concat(F.lit("{"), F.array_join(F.concat(parts, F.array(*extras)), ","), F.lit("}"))


def memory_json(memory_id, labels, props) -> F.Column:
    return object_json(props, [("_id", F.col(memory_id).cast("string") if isinstance(memory_id, str)
                                else memory_id.cast("string")),
                               ("_labels", F.to_json(F.col(labels) if isinstance(labels, str) else labels))])


def connection_json(edge_id, type_, props) -> F.Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return object_json(props, [("_id", c(edge_id).cast("string")), ("_type", _json_string(c(type_)))])
