"""Graph changes as set-based jobs.

Each job takes the current tables and a DataFrame of requests and returns a
``Change``: the delta (rows added, replaced and removed; its size follows the
requests), one result row per request with a ``status``, and, when asked for,
``graph``: the merged tables (nothing is changed in place).

Request tables (``props`` is ``MAP<STRING, PV>``; in updates a null value
removes the key):

* create memories:     req_id, [memory_id], label, props
* create connections:  req_id, [edge_id], from_id, to_id, type, [props]
* update memories:     req_id, memory_id, props
* update connections:  req_id, from_id, to_id, type, props
* delete memories:     req_id, memory_id
* delete connections:  req_id, from_id, to_id, type

Joins against the node table are written as inner joins on the unique
``memory_id`` (not as semi-joins) so that the planner may build the hash
table from the request side when it is the small one. The request-side
tables that meet the whole node or edge table are written to the shared
folder first (``materialize``): the planner then sees their real size and
broadcasts them when small, instead of shuffling the graph to meet a
table whose size it could only guess; large request tables still get a
shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.fixed import RELATES_TO, SOURCE_NOT_FOUND, TARGET_NOT_FOUND
from mnemo.functions.values import PROPS_DDL, is_falsy, props_map, pv_string
from mnemo.model import EDGE_COLUMNS, NODE_COLUMNS, Graph, edge_row, node_row
from mnemo.operators.delta import Change, GraphDelta, apply_delta
from mnemo.operators.ordered import running
from mnemo.sources.snapshot import connection_json, materialize, memory_json


def merge_props(old, new) -> Column:
    """Merge-update: keys of ``new`` overwrite, a null value removes the
    key, keys only in ``old`` stay. (``map_concat`` would fail on the
    duplicate keys, so the entries are combined explicitly.)"""
    old = F.col(old) if isinstance(old, str) else old
    new = F.col(new) if isinstance(new, str) else new
    new_keys = F.map_keys(new)
    kept = F.filter(F.map_entries(F.coalesce(old, F.create_map().cast(PROPS_DDL))),
                    lambda e: ~F.array_contains(new_keys, e["key"]))
    added = F.filter(F.map_entries(new), lambda e: e["value"].isNotNull())
    return F.map_from_entries(F.concat(kept, added))


def drop_null_values(props) -> Column:
    props = F.col(props) if isinstance(props, str) else props
    return F.map_filter(props, lambda k, v: v.isNotNull())


def with_created_at(props, now: str) -> Column:
    """``created_at`` replaced by ``now`` when missing or falsy ('', 0,
    false), as the create path does."""
    props = drop_null_values(props)
    return merge_props(props, F.when(is_falsy(props["created_at"]),
                                     F.create_map(F.lit("created_at"), pv_string(F.lit(now))))
                       .otherwise(F.create_map().cast(PROPS_DDL)))


def assign_ids(req: DataFrame, graph: Graph, id_col: str, name: str) -> tuple[DataFrame, int | None]:
    """Give rows without ``id_col`` a fresh id, above every id that was ever
    given out and above every id supplied in the same batch. Rows are
    counted inside each task and numbered on from the counts of the tasks
    before (one row per task). They are written to the shared folder first,
    so every later use (new rows, result rows, links) sees the same ids even
    if tasks are re-run. Returns the table and the new high-water mark (None
    while the graph's own mark is unknown and was not needed)."""
    seen = req.agg(F.count(F.when(F.col(id_col).isNull(), 1)).alias("missing"), F.max(id_col).alias("top")).first()
    known = graph.node_high if id_col == "memory_id" else graph.edge_high
    if not seen.missing:
        return req, None if known is None else max(known, seen.top or 0)
    start = max(graph.high_water(id_col), seen.top or 0) + 1
    rows = materialize(req.sparkSession, req.withColumn("_at", F.monotonically_increasing_id()), name)
    bare = rows.where(F.col(id_col).isNull()).withColumn("_task", F.shiftright("_at", 33))
    tasks = bare.groupBy("_task").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    begin = tasks.select("_task", (F.sum("n").over(Window.orderBy("_task")) - F.col("n")).alias("_before"))
    # place among the rows of its task that lack an id
    place = F.row_number().over(Window.partitionBy("_task").orderBy("_at")) - 1
    filled = (bare.withColumn("_place", place).join(F.broadcast(begin), "_task")
              .withColumn(id_col, (F.lit(start) + F.col("_before") + F.col("_place")).cast("bigint")))
    out = rows.where(F.col(id_col).isNotNull()).select(*req.columns).unionByName(filled.select(*req.columns))
    return out, start + seen.missing - 1


def _node_ids(nodes: DataFrame, alias: str) -> DataFrame:
    return nodes.select(F.col("memory_id").alias(alias))


def _first_per_key(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Flag the first request (lowest ``req_id``) per target key. A min
    aggregate (partial, map-side) and a join instead of a window, so a key
    named by a huge share of the requests never lands in one task."""
    first = requests.groupBy(*keys).agg(F.min("req_id").alias("first_req"))
    return (requests.join(first, keys, "left")
            .withColumn("first_of_key", F.col("req_id") == F.col("first_req")).drop("first_req"))


# ------------------------------------------------------------------ creates

def _id_clash(req: DataFrame, table: DataFrame, id_col: str) -> DataFrame:
    """Requests whose supplied id is taken: by an existing row, or by an
    earlier request (lower ``req_id``) of the same batch. Ids are never
    reused, so those rows are not created."""
    first = materialize(req.sparkSession, req.groupBy(id_col).agg(F.min("req_id").alias("first_req")),
                        "requested-ids")
    # the requested ids are written first, so meeting the whole table is a
    # broadcast join whenever they are few
    taken = table.select(id_col).join(first.select(id_col), id_col).withColumn("taken", F.lit(True))
    return (req.join(first, id_col).join(taken, id_col, "left")
            .where(F.col("taken").isNotNull() | (F.col("req_id") != F.col("first_req")))
            .select("req_id"))


def create_memories(graph: Graph, requests: DataFrame, now: str) -> Change:
    """M1/M2: one new node per request (never de-duplicated), ``created_at``
    defaulted to ``now``. Ids come from ``memory_id`` when given (an id
    already in use is reported ``id_exists`` and not created), otherwise
    they are assigned above every id ever given out."""
    req = requests if "memory_id" in requests.columns else requests.withColumn(
        "memory_id", F.lit(None).cast("bigint"))
    req, high = assign_ids(req, graph, "memory_id", "new-memory-ids")
    clash = materialize(req.sparkSession, _id_clash(req, graph.nodes, "memory_id"), "create-clash")
    ok = req.join(clash, "req_id", "left_anti")
    new = ok.select(*node_row(F.col("memory_id"), F.array(F.col("label")),
                              with_created_at(F.col("props"), now)))
    result = (req.join(clash.withColumn("clash", F.lit(True)), "req_id", "left")
              .select("req_id", "memory_id",
                      F.when(F.col("clash"), "id_exists").otherwise("created").alias("status")))
    return Change(graph, GraphDelta(node_inserts=new.select(*NODE_COLUMNS), node_high=high), result)


def create_connections(graph: Graph, requests: DataFrame, now: str) -> Change:
    """M3/M4: an edge per request whose two endpoints exist (missing
    endpoint: no edge, status ``no_match``). Properties default to
    ``{created_at: now}`` only when absent; duplicates and self-loops are
    allowed."""
    req = requests
    for c, t in (("edge_id", "bigint"), ("props", PROPS_DDL)):
        if c not in req.columns:
            req = req.withColumn(c, F.lit(None).cast(t))
    spark = requests.sparkSession
    req = materialize(spark, req, "connect-requests")
    # both ends are looked up in one pass over the nodes
    named = materialize(spark, req.select(F.explode(F.array("from_id", "to_id")).alias("memory_id")).distinct(), "connect-named")
    ends = materialize(spark, graph.nodes.select("memory_id").join(named, "memory_id"), "connect-ends")
    found = req.join(_node_ids(ends, "from_id"), "from_id").join(_node_ids(ends, "to_id"), "to_id")
    ok, high = assign_ids(found, graph, "edge_id", "new-edge-ids")
    # ids given out here are above all others: only supplied ones can be taken
    clash = (materialize(spark, _id_clash(found.where(F.col("edge_id").isNotNull()), graph.edges, "edge_id"), "connect-clash")
             if "edge_id" in requests.columns else req.select("req_id").where(F.lit(False)))
    ok = ok.join(clash, "req_id", "left_anti")
    props = F.coalesce(drop_null_values("props"),
                       F.create_map(F.lit("created_at"), pv_string(F.lit(now))))
    new = ok.select(*edge_row(F.col("edge_id"), F.col("from_id"), F.col("to_id"), F.col("type"), props))
    result = (req.select("req_id").join(ok.select("req_id", "edge_id"), "req_id", "left")
              .join(clash.withColumn("clash", F.lit(True)), "req_id", "left")
              .select("req_id", "edge_id",
                      F.when(F.col("clash"), "id_exists")
                      .when(F.col("edge_id").isNull(), "no_match").otherwise("created").alias("status")))
    return Change(graph, GraphDelta(edge_inserts=new.select(*EDGE_COLUMNS), edge_high=high), result)


# ------------------------------------------------------------------ updates

def changed_nodes(nodes: DataFrame, upd: DataFrame, replace: bool = False) -> DataFrame:
    """The rows of ``nodes`` named by ``upd(memory_id, new_props)`` (unique
    ids) with the properties merged (or, with ``replace``, substituted) and
    the derived columns recomputed."""
    j = nodes.join(upd, "memory_id")
    props = F.col("new_props") if replace else merge_props("props", "new_props")
    return j.select(*node_row(F.col("memory_id"), F.col("labels"), props)).select(*NODE_COLUMNS)


def update_memories(graph: Graph, requests: DataFrame) -> Change:
    """M5: merge-update properties of existing nodes; unknown ids are
    ``no_match``; a second request for the same node in one batch is
    ``rejected_duplicate`` (ordered changes on one node are the replay's
    job)."""
    req = _first_per_key(requests, ["memory_id"])
    dup_ids = req.where(~F.col("first_of_key")).select("memory_id").distinct()
    good = materialize(requests.sparkSession, req.where("first_of_key").join(dup_ids, "memory_id", "left_anti"),
                       "update-requests")
    hit = materialize(requests.sparkSession, good.join(_node_ids(graph.nodes, "memory_id"), "memory_id"),
                      "update-hits")
    upd = hit.select("memory_id", F.col("props").alias("new_props"))
    result = (req.join(hit.select("req_id", F.lit(True).alias("hit")), "req_id", "left")
              .join(dup_ids.withColumn("dup", F.lit(True)), "memory_id", "left")
              .select("req_id", "memory_id",
                      F.when(F.col("dup"), "rejected_duplicate")
                      .when(F.col("hit"), "applied").otherwise("no_match").alias("status")))
    return Change(graph, GraphDelta(node_upserts=changed_nodes(graph.nodes, upd)), result)


def update_connections(graph: Graph, requests: DataFrame) -> Change:
    """M6: merge-update every parallel edge of (from, to, type), directed.
    Reports the number of edges changed and the lowest of their ids."""
    key = ["src", "dst", "type"]
    spark = requests.sparkSession
    # written once: the requests may be costly to derive, and every step
    # below reads them
    req = materialize(spark, requests.select("req_id", F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "type", "props"),
                      "update-connection-requests")
    dup = materialize(spark, req.groupBy(*key).agg(F.min("req_id").alias("lo"), F.max("req_id").alias("hi"))
                      .where("hi > lo").select(*key), "update-connection-repeats")
    # a request without req_id is no request; one without a key meets nothing
    upd = (req.where(F.col("req_id").isNotNull()).join(dup, key, "left_anti")
           .select(*key, F.col("props").alias("new_props")))
    changed = materialize(spark, graph.edges.join(upd, key).withColumn(
        "props", merge_props("props", "new_props")).select(*EDGE_COLUMNS), "changed-connections")
    touched = changed.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_matched"), F.min("edge_id").alias("edge_id"))
    result = (req.join(touched, key, "left").join(dup.withColumn("dup", F.lit(True)), key, "left")
              .select("req_id", F.col("src").alias("from_id"), F.col("dst").alias("to_id"), "type",
                      F.coalesce("n_matched", F.lit(0)).alias("n_matched"), "edge_id",
                      F.when(F.col("dup"), "rejected_duplicate")
                      .when(F.col("n_matched") > 0, "applied").otherwise("no_match").alias("status")))
    return Change(graph, GraphDelta(edge_upserts=changed), result)


# ------------------------------------------------------------------ deletes

def delete_memories(graph: Graph, requests: DataFrame) -> Change:
    """M7: detach-delete: the node and every edge touching it, either
    direction. ``deletedCount`` is 1 for the first request naming an
    existing node, 0 otherwise."""
    ids = materialize(requests.sparkSession, requests.select("memory_id").distinct(), "delete-ids")
    found = materialize(requests.sparkSession, graph.nodes.select("memory_id").join(ids, "memory_id"), "deleted-ids")
    req = _first_per_key(requests, ["memory_id"])
    result = (req.join(found.withColumn("found", F.lit(True)), "memory_id", "left")
              .select("req_id", "memory_id",
                      F.when(F.col("found") & F.col("first_of_key"), 1).otherwise(0).alias("deletedCount")))
    return Change(graph, GraphDelta(node_deletes=found, edge_deletes=edges_at(graph, found)), result)


def edges_at(graph: Graph, ids: DataFrame) -> DataFrame:
    """Ids of the connections that touch ``ids(memory_id)``, either
    direction; from the adjacency table where there is one, since that is
    clustered by node id."""
    at = ids.select(F.col("memory_id").alias("a"))
    if graph.adj is not None:
        return graph.adj.select("a", "edge_id").join(at, "a").select("edge_id").distinct()
    ends = graph.edges.select("edge_id", F.explode(F.array("src", "dst")).alias("a"))
    return ends.join(at, "a").select("edge_id").distinct()


def delete_connections(graph: Graph, requests: DataFrame) -> Change:
    """M8: delete every parallel edge of (from, to, type), directed; nodes
    stay. ``deletedCount`` = number of edges removed (0 on a repeat)."""
    key = ["src", "dst", "type"]
    req = requests.withColumnRenamed("from_id", "src").withColumnRenamed("to_id", "dst")
    keys = materialize(requests.sparkSession, req.select(*key).distinct(), "delete-connection-keys")
    gone = materialize(requests.sparkSession, graph.edges.select("edge_id", *key).join(keys, key), "deleted-connections")
    counts = gone.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    result = (_first_per_key(req, key).join(counts, key, "left")
              .select("req_id", F.col("src").alias("from_id"), F.col("dst").alias("to_id"), "type",
                      F.when(F.col("first_of_key"), F.coalesce("n", F.lit(0))).otherwise(0)
                      .cast("bigint").alias("deletedCount")))
    return Change(graph, GraphDelta(edge_deletes=gone.select("edge_id")), result)


# ------------------------------------------------------------------ replies

def memory_reply(change: Change) -> DataFrame:
    """(req_id, json) for the requests of a create or update of memories
    that were carried out: ``{"memory": {...props, "_id", "_labels"}}``."""
    rows = change.delta.node_inserts if change.delta.node_inserts is not None else change.delta.node_upserts
    done = change.result.where(F.col("status").isin("created", "applied")).select("req_id", "memory_id")
    return done.join(rows, "memory_id").select("req_id", F.concat(
        F.lit('{"memory":'), memory_json("memory_id", "labels", "props"), F.lit("}")).alias("json"))


def connection_reply(change: Change) -> DataFrame:
    """(req_id, json): ``{"relationship": {...props, "_id", "_type"}}`` for
    each connection created or (the one of lowest id) updated."""
    rows = change.delta.edge_inserts if change.delta.edge_inserts is not None else change.delta.edge_upserts
    done = change.result.where(F.col("status").isin("created", "applied")).select("req_id", "edge_id")
    return done.join(rows.select("edge_id", F.col("type").alias("t"), "props"), "edge_id").select("req_id", F.concat(
        F.lit('{"relationship":'), connection_json("edge_id", "t", "props"), F.lit("}")).alias("json"))


# ------------------------------------------------------------------ legacy

def name_text() -> Column:
    pv = F.col("props")["name"]
    return F.when(pv["kind"] == "string", pv["text"])


def id_text(ref) -> Column:
    """A reference read as an id: whole numbers exactly, other number text
    (``5.0``, ``1e3``) through DOUBLE where that holds every whole number."""
    ref = F.col(ref) if isinstance(ref, str) else ref
    d = ref.try_cast("double")
    return F.coalesce(ref.try_cast("bigint"), F.when(F.abs(d) <= F.lit(float(1 << 53)), d.try_cast("bigint")))


def _matches(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, memory_id): the lowest id among the nodes named ``ref`` or whose
    id it is. References are distinct, so a node meets at most one by name;
    the minimum is partially aggregated, so a name that many nodes share is
    cheap however many requests use it."""
    by_name = nodes.select(name_text().alias("ref"), "memory_id").join(refs, "ref")
    by_id = (refs.select("ref", id_text("ref").alias("memory_id")).where(F.col("memory_id").isNotNull())
             .join(_node_ids(nodes, "memory_id"), "memory_id"))
    return by_name.select("ref", "memory_id").unionByName(by_id.select("ref", "memory_id")) \
        .groupBy("ref").agg(F.min("memory_id").alias("memory_id"))


def resolve_name_or_id(nodes: DataFrame, requests: DataFrame, ref_col: str = "ref") -> DataFrame:
    """The node whose string ``name`` equals the reference, or whose id
    equals it read as an integer; the lowest id when several match (the
    legacy lookup took an arbitrary first). Distinct references are resolved
    once and joined back to their requests.
    Returns (req_id, memory_id) for resolved requests only."""
    refs = requests.select("req_id", F.col(ref_col).alias("ref")).where(F.col("ref").isNotNull())
    found = materialize(nodes.sparkSession, _matches(nodes, refs.select("ref").distinct()), "resolved-references")
    return refs.join(found, "ref").select("req_id", "memory_id")


def _not_found(template: str, ref: Column) -> Column:
    before, after = template.split("{ref}")
    return F.concat(F.lit(before), ref, F.lit(after))


def unresolved_references(nodes: DataFrame, requests: DataFrame, ref_col: str, role: str) -> DataFrame:
    """Requests whose reference resolves to nothing, with the legacy
    error text (``role`` "Source" or "Target")."""
    hit = resolve_name_or_id(nodes, requests, ref_col)
    template = SOURCE_NOT_FOUND if role == "Source" else TARGET_NOT_FOUND
    return (requests.join(hit, "req_id", "left_anti")
            .select("req_id", _not_found(template, F.col(ref_col)).alias("error")))


def capitalize_first(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def remember(graph: Graph, requests: DataFrame, now: str) -> Change:
    """M9 (legacy ``remember``): a node labelled with the capitalised type,
    properties ``{type, created_at: now, name?, context?, ...properties}``
    (later keys win), plus a RELATES_TO edge to the node that
    ``relates_to`` resolves to (skipped silently when nothing resolves).

    Requests: req_id, [memory_id], type, name, context, props, relates_to.
    The legacy code linked through a field the create reply lacks; this
    builds the intended link from the new node. Requests apply in ``req_id``
    order, each creating before it looks up: a reference finds stored nodes
    and those of this request and the requests before it. A supplied id that
    is taken creates nothing (``id_exists``).
    """
    base = props_map(("type", pv_string(F.col("type"))), ("created_at", pv_string(F.lit(now))),
                     ("name", F.when(F.col("name") != "", pv_string(F.col("name")))),
                     ("context", F.when(F.col("context") != "", pv_string(F.col("context")))))
    req = requests.withColumn("props", merge_props(base, F.coalesce(
        F.col("props"), F.create_map().cast(PROPS_DDL))))
    if "memory_id" not in req.columns:
        req = req.withColumn("memory_id", F.lit(None).cast("bigint"))
    spark = req.sparkSession
    req, high = assign_ids(req, graph, "memory_id", "remember-ids")
    clash = materialize(spark, _id_clash(req, graph.nodes, "memory_id"), "remember-clash")
    new = materialize(spark, req.join(clash, "req_id", "left_anti").select("req_id", "relates_to", *node_row(
        F.col("memory_id"), F.array(capitalize_first("type")), F.col("props"))), "remembered")
    asking = new.where(F.col("relates_to").isNotNull()).select("req_id", F.col("memory_id").alias("from_id"), F.col("relates_to").alias("ref"))
    stored = _matches(graph.nodes, asking.select("ref").distinct()).withColumnRenamed("memory_id", "stored")
    # what finds a new node, and what a request looks for: a name or an id
    by = lambda name, id_: F.array(F.concat(F.lit("name "), name), F.concat(F.lit("id "), id_.cast("string")))
    none = F.lit(None).cast("bigint")
    events = (asking.select("req_id", "from_id", "ref", none.alias("memory_id"), F.explode(by(F.col("ref"), id_text("ref"))).alias("key"))
              .unionByName(new.select("req_id", none.alias("from_id"), F.lit(None).cast("string").alias("ref"), "memory_id",
                                      F.explode(by(name_text(), F.col("memory_id"))).alias("key"))).where(F.col("key").isNotNull()))
    fresh = (running(events, ["key"], "req_id", {"fresh": ("min", F.col("memory_id"))}, inclusive=True)
             .where(F.col("from_id").isNotNull()).groupBy("req_id", "from_id", "ref").agg(F.min("fresh").alias("fresh")))
    links = (fresh.join(stored, "ref", "left").withColumn("to_id", F.least("fresh", "stored")).where(F.col("to_id").isNotNull())
             .select("req_id", "from_id", "to_id", F.lit(RELATES_TO).alias("type"),
                     F.create_map(F.lit("created_at"), pv_string(F.lit(now))).alias("props")))
    inserts = new.select(*NODE_COLUMNS)
    ch = create_connections(apply_delta(graph, GraphDelta(node_inserts=inserts)), materialize(spark, links, "remember-links"), now)
    result = (req.select("req_id", "memory_id").join(ch.result.select("req_id", F.col("edge_id").alias("relates_to_edge")), "req_id", "left")
              .join(clash.withColumn("clash", F.lit(True)), "req_id", "left")
              .select("req_id", "memory_id", "relates_to_edge", F.when(F.col("clash"), "id_exists").otherwise("created").alias("status")))
    return Change(graph, GraphDelta(node_inserts=inserts, edge_inserts=ch.delta.edge_inserts, node_high=high,
                                    edge_high=ch.delta.edge_high), result)


def connect_by_name(graph: Graph, requests: DataFrame, now: str) -> Change:
    """M10 (legacy ``connect_memories``): resolve ``from``/``to`` by name
    or id (J9), then connect with ``{created_at: now}``; unresolved ends
    give an error row (J10) and no edge.

    Requests: req_id, from_ref, to_ref, relationship.
    """
    spark = requests.sparkSession
    requests = materialize(spark, requests.select("req_id", "from_ref", "to_ref", "relationship"), "requests-by-name")
    # the references of both ends are resolved in one pass over the nodes
    refs = materialize(spark, requests.select(F.explode(F.array("from_ref", "to_ref")).alias("ref")).where(F.col("ref").isNotNull())
                       .distinct(), "references")
    known = materialize(spark, _matches(graph.nodes, refs), "resolved-references")
    end = lambda ref, id_: requests.select("req_id", F.col(ref).alias("ref")).join(known, "ref").select(
        "req_id", F.col("memory_id").alias(id_))
    src, dst = end("from_ref", "from_id"), end("to_ref", "to_id")
    links = (requests.join(src, "req_id").join(dst, "req_id")
             .select("req_id", "from_id", "to_id", F.col("relationship").alias("type"),
                     F.create_map(F.lit("created_at"), pv_string(F.lit(now))).alias("props")))
    ch = create_connections(graph, links, now)
    errors = (requests.join(src, "req_id", "left").join(dst, "req_id", "left")
              .select("req_id", F.when(F.col("from_id").isNull(), _not_found(SOURCE_NOT_FOUND, F.col("from_ref")))
                      .when(F.col("to_id").isNull(), _not_found(TARGET_NOT_FOUND, F.col("to_ref"))).alias("error")))
    result = (errors.join(ch.result.select("req_id", "edge_id"), "req_id", "left")
              .select("req_id", "edge_id", "error",
                      F.when(F.col("error").isNotNull(), "error").otherwise("created").alias("status")))
    return Change(graph, ch.delta, result)
