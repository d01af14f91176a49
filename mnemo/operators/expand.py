"""Bounded undirected trail expansion around seed memories.

Semantics (variable-length match ``(seed)-[*1..d]-(related)``): a trail
walks edges in either direction, may revisit nodes but never repeats an
edge. Each result row is ``(memory_id, related_id, first_edge, distance)``
where ``first_edge`` is the trail's edge at the seed and ``distance`` the
trail's length; rows are distinct on those four columns.

Plan: level ``k`` is ``frontier(k-1) JOIN adjacency ON node = a``. What a
trail can still do depends on its seed, first edge, end and the *set* of its
edges, so that is the state: the edges beside the first as a sorted array,
made only where a further level follows and kept once per level however many
orders of walking them lead there. Up to depth 2 there is no array at all.
The adjacency table holds every edge once per direction (a self-loop
once) and, in a snapshot, is sorted by ``a`` so the first level reads only
the row groups around the seeds. Seeds are at most the search limit, so
a search's first level broadcasts them. Larger seed sets and later
frontiers carry no hint: adaptive execution measures their bytes and either
broadcasts them or shuffles both sides on the node id, splitting skewed hubs.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels between lineage cuts of long expansions (each cut writes the
# frontier to the shared checkpoint folder).
CHECKPOINT_EVERY = 3
RESULT_DDL = ("memory_id bigint, related_id bigint, first_edge bigint, first_type string, "
              "first_outgoing boolean, distance int")
ADJ_COLUMNS = ["a", "b", "edge_id", "type", "outgoing"]


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge as ``(a, b, edge_id, type, outgoing)``
    (``outgoing``: the edge is stored as a -> b); a self-loop appears once,
    since both of its directions are the same step."""
    out = F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("outgoing"))
    back = F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(False).alias("outgoing"))
    steps = F.when(F.col("src") == F.col("dst"), F.array(out)).otherwise(F.array(out, back))
    return edges.select("edge_id", "type", F.explode(steps).alias("s")).select("s.a", "s.b", "edge_id", "type", "s.outgoing")


def steps_out(edges: DataFrame) -> DataFrame:
    """The half of :func:`adjacency` along the edges."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "edge_id", "type", F.lit(True).alias("outgoing"))


def steps_back(edges: DataFrame) -> DataFrame:
    """The half of :func:`adjacency` against the edges, without self-loops."""
    return edges.where(F.coalesce(F.col("src") != F.col("dst"), F.lit(True))).select(
        F.col("dst").alias("a"), F.col("src").alias("b"), "edge_id", "type", F.lit(False).alias("outgoing"))


def _out(level: DataFrame, k: int) -> DataFrame:
    return level.select("memory_id", F.col("node").alias("related_id"), "first_edge",
                        "first_type", "first_outgoing", F.lit(k).alias("distance"))


def _first_level(seeds: DataFrame, adj: DataFrame, seed_ids: list[int] | None,
                 small: bool) -> DataFrame:
    if seed_ids is not None:
        # A literal id list lets the scan skip row groups of a sorted
        # adjacency table (Parquet min/max statistics).
        adj = adj.where(F.col("a").isin(seed_ids))
    s = seeds.select(F.col("memory_id").alias("a"))
    return (adj.join(F.broadcast(s) if small else s, "a")
            .select(F.col("a").alias("memory_id"), F.col("b").alias("node"),
                    F.col("edge_id").alias("first_edge"), F.col("type").alias("first_type"),
                    F.col("outgoing").alias("first_outgoing")))


STATE = ["memory_id", "first_edge", "node", "others"]


def unused(k: int) -> Column:
    """Whether ``edge_id`` is new to the trail that it would make k long."""
    new = F.col("edge_id") != F.col("first_edge")
    return new if k == 2 else new & ~F.array_contains("others", F.col("edge_id"))


def others_after(k: int) -> Column:
    """The set of a k long trail's edges beside the first, sorted."""
    return F.array("edge_id") if k == 2 else F.array_sort(F.concat("others", F.array("edge_id")))


def _next_level(frontier: DataFrame, adj: DataFrame, k: int, last: bool) -> DataFrame:
    columns = ["memory_id", F.col("b").alias("node"), "first_edge", "first_type", "first_outgoing"]
    f = frontier.withColumnRenamed("node", "a")
    step = f.join(adj.select("a", "b", "edge_id"), "a").where(unused(k))
    if last:
        return step.select(*columns)
    step = step.select(*columns, others_after(k).alias("others"))
    # two edges can be walked in two orders from the third level on
    return step if k == 2 else step.dropDuplicates(STATE)


def expand(seeds: DataFrame, adj: DataFrame, depth: int, seed_ids: list[int] | None = None,
           seeds_small: bool = False, first_level: list | None = None,
           persisted: list | None = None, depths: DataFrame | None = None) -> DataFrame:
    """All trails of length 1..depth from each seed (``seeds.memory_id``).

    ``seeds`` must hold distinct ids. Pass ``seeds_small=True`` when their
    number has a known small bound (a search's top-k, at most the limit
    cap); only then are they broadcast by a hint. ``depths`` (memory_id,
    depth) stops each seed's trails at its own depth.
    Returns distinct ``(memory_id, related_id, first_edge, first_type,
    first_outgoing, distance)`` (type and direction belong to the first
    edge, so they do not change distinctness).
    Frontier levels are persisted while the plan is built; executor loss
    recomputes them from the (short) lineage, and expansions deeper than
    ``CHECKPOINT_EVERY`` levels cut lineage through the checkpoint folder.
    When ``first_level`` is a list, the level-1 trails (persisted when
    deeper levels follow) are appended to it for reuse by the caller. The
    persisted levels are appended to ``persisted`` (when given) so the
    caller can release them once the result is written; see
    :func:`release`.
    """
    spark = seeds.sparkSession
    if depth <= 0:
        return spark.createDataFrame([], RESULT_DDL)
    level = _first_level(seeds, adj, seed_ids, seeds_small or seed_ids is not None)
    outs = [_out(level, 1)]
    first = level
    for k in range(2, depth + 1):
        if (k - 1) % CHECKPOINT_EVERY == 0:
            level = level.checkpoint(eager=True)
        else:
            level = level.persist(StorageLevel.MEMORY_AND_DISK)
            if persisted is not None:
                persisted.append(level)
        if level.limit(1).isEmpty():
            break
        if k == 2:
            first = level
        wanted = level if depths is None else level.join(depths.where(F.col("depth") >= k).select("memory_id"), "memory_id", "left_semi")
        level = _next_level(wanted, adj, k, last=k == depth)
        outs.append(_out(level, k))
    if first_level is not None:
        first_level.append(first)
    result = reduce(DataFrame.unionByName, outs)
    # Length-1 trails are distinct by construction (one per edge and
    # direction); longer ones can repeat on (end node, first edge).
    return result if depth == 1 else result.distinct()


def release(frames: list) -> None:
    """Unpersist cached frontier levels (after their result was written)."""
    for df in frames:
        df.unpersist()
    frames.clear()
