"""Scans, lookups, filters and projections over node/edge tables.

All predicates are plain Column expressions: Catalyst pushes the label and
date comparisons into the Parquet scan (and prunes a snapshot's
label-bucket folders), and the text match runs as generated code over
the narrow ``search_text`` column.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.fixed import PHRASE_FIELDS
from mnemo.functions.text import any_word_matches, is_blank_query, tokenize


def label_pred(label: str | None) -> Column | None:
    """First label equals ``label`` (exact, case-sensitive). A missing or
    empty label means no filter."""
    return (F.col("first_label") == F.lit(label)) if label else None


def since_pred(since_date: str | None) -> Column | None:
    """``created_at >= since_date`` as a string comparison (inclusive, no
    parsing). Nodes without a string ``created_at`` never pass."""
    return (F.col("created_at") >= F.lit(since_date)) if since_date else None


def text_pred(query: str | None) -> Column | None:
    """Any query word is a substring of any property value (lower-cased).
    A blank query means no filter (match all)."""
    if is_blank_query(query):
        return None
    return any_word_matches("search_text", tokenize(query))


def all_of(*preds: Column | None) -> Column:
    present = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, present) if present else F.lit(True)


def bucket_pred(nodes: DataFrame, label: str | None) -> Column | None:
    """On a snapshot, the label's partition bucket (folds to a constant and
    prunes folders); nothing on other node tables."""
    if not label or "label_bucket" not in nodes.columns:
        return None
    from mnemo.sources.snapshot import label_bucket_of
    return F.col("label_bucket") == label_bucket_of(F.lit(label))


def search_candidates(nodes: DataFrame, query: str | None = None, label: str | None = None,
                      since_date: str | None = None) -> DataFrame:
    """Nodes passing the label, date and word filters that are present."""
    return nodes.where(all_of(bucket_pred(nodes, label), label_pred(label), since_pred(since_date),
                              text_pred(query)))


def nodes_with_label(nodes: DataFrame, label: str) -> DataFrame:
    """Nodes carrying ``label`` anywhere in their label list."""
    return nodes.where(F.array_contains("labels", label))


def nodes_by_id(nodes: DataFrame, ids: DataFrame, id_col: str = "memory_id") -> DataFrame:
    """Semi-join on ids; the id table is not assumed small (AQE chooses
    broadcast at run time when it is)."""
    return nodes.join(ids.select(F.col(id_col).cast("bigint").alias("memory_id")).distinct(),
                      "memory_id", "left_semi")


def edges_by_key(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Directed lookup of every parallel edge of each (src, dst, type)."""
    k = keys.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"),
                    F.col("type").cast("string")).distinct()
    return edges.join(k, ["src", "dst", "type"], "left_semi")


def _string_prop(name: str) -> Column:
    pv = F.col("props")[name]
    return F.when(pv["kind"] == "string", pv["text"])


def phrase_search(nodes: DataFrame, query: str | None = None, label: str | None = None,
                  since_date: str | None = None) -> DataFrame:
    """Fallback search: the raw query (not trimmed or lower-cased) as a
    case-sensitive substring of the ``name``, ``context`` or
    ``description`` string property, plus the label/date filters.
    Returns distinct ``memory_id``."""
    text = None
    if not is_blank_query(query):
        text = reduce(lambda a, b: a | b, [_string_prop(f).contains(query) for f in PHRASE_FIELDS])
    return nodes.where(all_of(text, label_pred(label), since_pred(since_date))).select("memory_id")


def cypher_text(pv: Column) -> Column:
    """``toString`` as the graph store prints a stored value: floats keep
    a fraction (``5.0``, ``1.0E7``), as Java does; arrays print their
    joined text."""
    return F.when(pv["kind"] == "number", pv["num"].cast("string")).otherwise(pv["text"])


def phrase_search_all_props(nodes: DataFrame, query: str, label: str | None = None) -> DataFrame:
    """Legacy recall filter: case-sensitive phrase in ``name``, in
    ``context`` or in the text of any property, and (when given) the
    capitalised ``label`` as first label.

    The legacy text wrote ``A OR B OR any(..) AND label``, which binds the
    label only to the last term; this builds the intended
    ``(A OR B OR any(..)) AND label``.
    """
    q = F.lit(query)
    text = (_string_prop("name").contains(q) | _string_prop("context").contains(q)
            | F.exists(F.map_values("props"), lambda v: cypher_text(v).contains(q)))
    lab = None
    if label:
        lab = F.col("first_label") == F.lit(label[:1].upper() + label[1:])
    return nodes.where(all_of(text, lab))


def recent_memories(nodes: DataFrame, asof: str, days: int = 7) -> DataFrame:
    """Created less than ``days`` before ``asof`` (an ISO-8601 text, a job
    parameter so results are reproducible), newest first. A text that is no
    timestamp is not recent. The day before the window's first day is also
    pushed to the scan as text: stored times are ISO-8601, which sorts as
    text, and a time zone moves a time by less than a day."""
    start = F.to_timestamp(F.lit(asof)) - F.make_interval(days=F.lit(days))
    ts = F.try_to_timestamp("created_at")
    floor = (datetime.fromisoformat(asof.replace("Z", "+00:00")) - timedelta(days=days + 1)).strftime("%Y-%m-%d")
    return (nodes.where((F.col("created_at") >= floor) & (ts > start))
            .select("memory_id", "first_label", "created_at")
            .orderBy(F.col("created_at").desc_nulls_first(), "memory_id"))


def project_memory(nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Flat projection ``{...props, _id, _labels}``: the id and labels plus
    the text of chosen properties as columns."""
    cols = [F.col("memory_id").alias("_id"), F.col("labels").alias("_labels")]
    for k in keys or []:
        cols.append(F.col("props")[k]["text"].alias(k))
    return nodes.select(*cols)


def stringify_properties(nodes: DataFrame) -> DataFrame:
    """Long form (memory_id, key, kind, text): the search text of every
    property value."""
    return nodes.select("memory_id", F.explode("props").alias("key", "pv")) \
        .select("memory_id", "key", F.col("pv.kind").alias("kind"), F.col("pv.text").alias("text"))


__all__ = [
    "label_pred", "since_pred", "text_pred", "all_of", "search_candidates", "nodes_with_label",
    "nodes_by_id", "edges_by_key", "phrase_search", "phrase_search_all_props", "recent_memories",
    "project_memory", "stringify_properties",
]
