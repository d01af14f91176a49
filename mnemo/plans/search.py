"""``search_memories`` and its legacy and bulk variants.

Plan of one search (the reference ships every candidate to a client and
loops over properties; here it is one distributed scan):

1. filter: first label, ``created_at >= since``, any word in
   ``search_text`` -- narrow columns, the label and date comparisons
   pushed into the Parquet scan;
2. top-k on the order keys (limit <= 200) -- each task keeps its best k,
   one task merges k x tasks rows;
3. only then the trail expansion around those <= 200 seeds.

The limit counts memories and the order uses only memory properties, so
cutting to top-k before expanding gives the same result as the reference's
"expand, collect, then order and limit", with far less work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemo.model import Graph
from mnemo.operators.expand import adjacency, expand, release
from mnemo.sources.snapshot import connection_json, materialize, memory_json
from mnemo.operators.filters import phrase_search_all_props, search_candidates
from mnemo.operators.order import (
    LEGACY_DEFAULT_LIMIT, MAX_LIMIT, OrderSpec, effective_depth, effective_limit, order_columns, parse_order_by,
    top_k,
)

FLAT_COLUMNS = ["memory_id", "seed_rank", "created_at", "related_id", "first_edge",
                "first_type", "first_outgoing", "distance"]


def select_seeds(candidates: DataFrame, spec: OrderSpec, limit: int,
                 collect: bool = True) -> tuple[DataFrame, list[int] | None]:
    """Top-k candidates with their 1-based ``seed_rank``.

    With ``collect`` the (at most 200) seed rows come to the driver once and
    return as a local table plus the literal id list that later lets the
    expansion skip row groups; otherwise they stay a lazy plan ranked by a
    window over the k rows.
    """
    spark = candidates.sparkSession
    top = top_k(candidates, spec, limit)
    if not collect:
        ranked = top.withColumn("seed_rank", F.row_number().over(Window.orderBy(*order_columns(spec))))
        return ranked.select("memory_id", "seed_rank", "created_at"), None
    rows = top.select("memory_id", "created_at").collect()
    seeds = spark.createDataFrame(
        [(r.memory_id, i + 1, r.created_at) for i, r in enumerate(rows)],
        "memory_id bigint, seed_rank int, created_at string")
    return seeds, [r.memory_id for r in rows]


def attach_connections(seeds: DataFrame, adj: DataFrame, depth: int,
                       seed_ids: list[int] | None) -> DataFrame:
    """Flat search result: one row per (seed, connection); a seed without
    connections (or ``depth <= 0``) keeps one row with null connection
    columns."""
    nulls = [F.lit(None).cast(t).alias(c) for c, t in
             (("related_id", "bigint"), ("first_edge", "bigint"), ("first_type", "string"),
              ("first_outgoing", "boolean"), ("distance", "int"))]
    if depth <= 0:
        return seeds.select("memory_id", "seed_rank", "created_at", *nulls).select(*FLAT_COLUMNS)
    lv1: list = []
    cached: list = []
    conns = expand(seeds.select("memory_id"), adj, depth, seed_ids, seeds_small=True, first_level=lv1,
                   persisted=cached)
    # ``seeds`` and the ids of seeds having connections hold at most the
    # limit cap (200) rows each, so both joins broadcast them and the
    # connections are never shuffled (an outer join would have to shuffle
    # them, since the preserved side of a broadcast join cannot be built).
    # a seed has connections iff it has a trail of length 1
    found = lv1[0].select("memory_id").distinct() if lv1 else conns.select("memory_id").distinct()
    linked = conns.join(F.broadcast(seeds), "memory_id")
    lonely = seeds.join(F.broadcast(found), "memory_id", "left_anti")
    flat = linked.select(*FLAT_COLUMNS).unionByName(
        lonely.select("memory_id", "seed_rank", "created_at", *nulls).select(*FLAT_COLUMNS))
    if not cached:
        return flat
    # Deeper expansions cached their frontier levels: write the result (its
    # size is the reply's) to the shared folder and release the cache, so a
    # service running many searches does not accumulate cached blocks.
    out = materialize(seeds.sparkSession, flat, "search-result")
    release(cached)
    return out


def search_memories(graph: Graph, query: str | None = None, label: str | None = None,
                    since_date: str | None = None, order_by: str | None = None,
                    limit: int | None = None, depth: int | None = None,
                    adj: DataFrame | None = None, collect_seeds: bool = True) -> DataFrame:
    """Search, order, limit, then expand each hit's neighbourhood.

    Returns the flat form ``FLAT_COLUMNS``; see :func:`nest_result` for the
    reference's nested reply shape.
    """
    d = effective_depth(depth)
    k = effective_limit(limit)
    spec = parse_order_by(order_by)
    cands = search_candidates(graph.nodes, query, label, since_date)
    seeds, ids = select_seeds(cands, spec, k, collect=collect_seeds)
    return attach_connections(seeds, _adj(graph, adj), d, ids)


def _adj(graph: Graph, adj: DataFrame | None) -> DataFrame:
    if adj is not None:
        return adj
    return graph.adj if graph.adj is not None else adjacency(graph.edges)


def recall(graph: Graph, query: str, type_: str | None = None, depth: int | None = None,
           order_by: str | None = None, limit: int | None = None,
           adj: DataFrame | None = None, collect_seeds: bool = True) -> DataFrame:
    """Legacy recall: phrase in name/context/any property, optional
    capitalised label, strict ``order_by``, limit ``min(limit ?? 50, 200)``,
    depth ``depth || 1`` (so 0 becomes 1)."""
    d = effective_depth(depth or None)
    k = effective_limit(limit, default=LEGACY_DEFAULT_LIMIT)
    spec = parse_order_by(order_by, strict=True, legacy=True)
    cands = phrase_search_all_props(graph.nodes, query, type_)
    seeds, ids = select_seeds(cands, spec, k, collect=collect_seeds)
    return attach_connections(seeds, _adj(graph, adj), d, ids)


def _reply_tables(flat: DataFrame, graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flat, memories, connections): the written flat result and the full
    rows of the memories and connections that it names. The ids of a search's
    memories, at most 200, go to the node scan as literals, where Bloom
    filters and statistics skip row groups; their neighbours and connections
    are joined on their distinct ids."""
    spark = flat.sparkSession
    flat = materialize(spark, flat, "reply-flat")
    nodes = graph.nodes.select("memory_id", "labels", "props")
    seeds = [r[0] for r in flat.select("memory_id").distinct().limit(MAX_LIMIT + 1).collect()]
    near = flat.select(F.col("related_id").alias("memory_id")).where("memory_id is not null").distinct()
    if len(seeds) <= MAX_LIMIT:
        memories = nodes.where(F.col("memory_id").isin(seeds)).unionByName(
            nodes.join(near.where(~F.col("memory_id").isin(seeds)), "memory_id"))
    else:       # not the result of one search
        memories = nodes.join(near.unionByName(flat.select("memory_id")).distinct(), "memory_id")
    used = flat.select(F.col("first_edge").alias("edge_id")).where("edge_id is not null").distinct()
    return flat, materialize(spark, memories, "reply-memories"), materialize(spark, graph.edges.join(used, "edge_id"), "reply-connections")


def reply_lines(flat: DataFrame, graph: Graph) -> DataFrame:
    """The reply in flat form, the one for results of any size: one JSON
    document ``{"memory", "relationship", "distance"}`` per connection,
    beside its memory's ``memory_id``, ``seed_rank`` and ``memory`` JSON."""
    flat, memories, edges = _reply_tables(flat, graph)
    text = memories.select("memory_id", memory_json("memory_id", "labels", "props").alias("memory"))
    rel = text.select(F.col("memory_id").alias("related_id"), F.col("memory").alias("rm"))
    used = edges.select(F.col("edge_id").alias("first_edge"), connection_json("edge_id", "type", "props").alias("rj"))
    entry = F.concat(F.lit('{"memory":'), F.coalesce("rm", F.lit("null")), F.lit(',"relationship":'),
                     F.coalesce("rj", F.lit("null")), F.lit(',"distance":'),
                     F.coalesce(F.col("distance").cast("string"), F.lit("null")), F.lit("}"))
    return (flat.join(rel, "related_id", "left").join(used, "first_edge", "left").join(text, "memory_id")
            .select("memory_id", "seed_rank", "memory", "distance", "related_id", "first_edge", entry.alias("connection")))


def _parts(lines: DataFrame, part_size: int) -> DataFrame:
    """Spread each memory's connections over parts of at most about
    ``part_size`` entries: the number of parts comes from a count per
    memory (partial aggregation), entries are assigned to parts by hash."""
    parts = lines.groupBy("memory_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(part_size)).cast("int").alias("parts"))
    return (lines.join(parts, "memory_id")
            .withColumn("part", F.pmod(F.xxhash64("related_id", "first_edge", "distance"), F.col("parts")).cast("int")))


def nest_result(flat: DataFrame, graph: Graph, depth: int, part_size: int) -> DataFrame:
    """The reference's reply shape: ``memory`` plus ``connections``
    (``array<struct<memory, relationship, distance>>``), in seed order.

    With ``depth <= 0`` every seed gets ``[]``; at ``depth >= 1`` a seed
    without connections gets one entry whose fields are all null. A nested
    reply is one group per memory: the caller names the ``part_size`` up to
    which that may grow, and a memory with more connections is split into
    several rows (``part`` of ``parts``), each with a share of them.
    """
    flat, memories, edges = _reply_tables(flat, graph)
    node = F.struct(F.col("memory_id").alias("_id"), F.col("labels").alias("_labels"), F.col("props"))
    seeds = flat.select("memory_id", "seed_rank").distinct().join(memories, "memory_id").select(
        "memory_id", "seed_rank", node.alias("memory"))
    rel = memories.select(F.col("memory_id").alias("related_id"), F.col("labels").alias("r_labels"), F.map_entries("props").alias("r_props"))
    used = edges.select(F.col("edge_id").alias("first_edge"), F.col("type").alias("e_type"),
                        F.col("src").alias("e_src"), F.col("dst").alias("e_dst"), F.map_entries("props").alias("e_props"))
    # Sort on ids while property maps are held as entry arrays (a struct
    # holding a map cannot be sorted), then rebuild the maps.
    entries = _parts(flat.select("memory_id", "related_id", "first_edge", "distance"), part_size)
    entries = (entries.join(rel, "related_id", "left").join(used, "first_edge", "left")
               .groupBy("memory_id", "part", "parts")
               .agg(F.array_sort(F.collect_list(F.struct(
                   "distance", "related_id", "first_edge", "r_labels", "r_props",
                   "e_type", "e_src", "e_dst", "e_props"))).alias("c")))

    def entry(x):
        memory = F.when(x["related_id"].isNotNull(), F.struct(
            x["related_id"].alias("_id"), x["r_labels"].alias("_labels"),
            F.map_from_entries(x["r_props"]).alias("props")))
        relationship = F.when(x["first_edge"].isNotNull(), F.struct(
            x["first_edge"].alias("_id"), x["e_type"].alias("_type"), x["e_src"].alias("src"),
            x["e_dst"].alias("dst"), F.map_from_entries(x["e_props"]).alias("props")))
        return F.struct(memory.alias("memory"), relationship.alias("relationship"),
                        x["distance"].alias("distance"))

    conns = F.transform("c", entry)
    if depth <= 0:
        conns = F.filter(conns, lambda x: F.lit(False))
    entries = entries.select("memory_id", "part", "parts", conns.alias("connections"))
    return seeds.join(entries, "memory_id", "left").orderBy("seed_rank", "part")


def reply_json(flat: DataFrame, graph: Graph, depth: int, part_size: int) -> DataFrame:
    """The reference's reply, one JSON document per memory (in seed order):
    ``{"memory": {...props, "_id", "_labels"}, "connections": [{"memory":
    {...}, "relationship": {...props, "_id", "_type"}, "distance": d}]}``.
    Connections are listed by distance, related id, first edge; a memory
    without connections gets one entry of nulls, ``depth <= 0`` gives [].
    ``part_size`` as in :func:`nest_result`; :func:`reply_lines` needs none.
    """
    lines = _parts(reply_lines(flat, graph), part_size)
    entries = F.array_sort(F.collect_list(F.struct("distance", "related_id", "first_edge", "connection")))
    nested = lines.groupBy("memory_id", "seed_rank", "memory", "part", "parts").agg(entries.alias("c"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("c", lambda x: x["connection"]), ","), F.lit("]"))
    if depth <= 0:
        listed = F.lit("[]")
    return (nested.select("seed_rank", "part", "parts", F.concat(
        F.lit('{"memory":'), F.col("memory"), F.lit(',"connections":'), listed, F.lit("}")).alias("json"))
        .orderBy("seed_rank", "part").select("json", "part", "parts"))
