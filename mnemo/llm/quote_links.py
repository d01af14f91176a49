"""Chat formatting: quotations linked to the messages they quote.

A line that begins with ``>`` marks (spaces between them allowed) is quoted;
the number of marks is its level. Consecutive lines of one level make a
passage. Passages and the messages' own text are cut into sentences, which
are normalised (lower case, single spaces) and hashed. A quoted sentence is
joined to the latest earlier message of its conversation that says it; a
passage belongs to the message that most of its sentences were joined to
(the later of equals). A message replies to the message of its first linked
passage of least level, else to the message before it. Reply order is the
preorder of that tree, replies in turn order, and the text is given without
quotes and without the line that introduces them.

A null text is empty, a null conv_id is a conversation of its own, nulls
come first among turns. Equal rows are one message of several copies, given
back as often. Extra columns are ignored. Messages are numbered by one
distributed sort; neighbours are found by number, by joins, and by windows
cut into blocks of ``BLOCK`` numbers, so neither a long conversation nor a
sentence that everybody repeats has to fit into a task.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.words import arrow
from mnemo.sources.snapshot import materialize

BLOCK = 4096
_MARKS = re.compile(r"[ \t]*>(?:[ \t]*>)*[ \t]?")
_END = re.compile(r"(?<=[.!?…])\s+")
# Ends of a line that introduces a quote.
_INTRODUCES = re.compile(r"\b(?:wrote|writes|said|schrieb|escribió|a écrit)\s*:\s*$", re.I)


def sentences(text: str) -> list[str]:
    """The normalised sentences of a text."""
    return [s for s in _END.split(" ".join(text.lower().split())) if s]


def _hashes(text: str) -> list[int]:
    return [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63) for s in sentences(text)]


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(own text without quotes, [(level, passage), ...])."""
    lines = text.split("\n")
    marks = [_MARKS.match(line) for line in lines]
    if not any(marks):
        return text, []
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for line, m in zip(lines, marks):
        level = m[0].count(">") if m else 0
        if not level:
            own.append(line)
        else:
            if before == 0 and own and _INTRODUCES.search(own[-1]):
                own.pop()
            if level != before:
                passages.append((level, []))
            passages[-1][1].append(line[m.end():])
        before = level
    return "\n".join(own).strip("\n"), [(level, "\n".join(p)) for level, p in passages if "".join(p).strip()]


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``n``: 0, 1, 2, ... in the order given, across partitions."""
    rows = materialize(df.sparkSession, df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    parts = rows.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("_c"))
    # one row per partition of the sort
    begin = parts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_b"))
    return (rows.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(begin), "_p")
            .withColumn("n", F.col("_b") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_b"))


def _parsed(messages: DataFrame) -> DataFrame:
    """Distinct messages with their own text, sentences and quotes."""
    arrow(messages.sparkSession)
    columns = ["conv_id", "turn", "role", "text"]
    once = messages.select(*columns).groupBy(*columns).agg(F.count("*").alias("copies"))
    names = [c for c in once.columns if c != "text"]
    schema = ", ".join(f"{c} {t}" for c, t in once.drop("text").dtypes) + (
        ", own string, passages int, said array<bigint>, quoted array<struct<passage: int, level: int, hash: bigint>>")

    def run(batches):
        for b in batches:
            own, passages, said, quoted = [], [], [], []
            for text in b.column("text").to_pylist():
                mine, found = parse(text or "")
                own.append(mine)
                passages.append(len(found))
                said.append(_hashes(mine))
                quoted.append([{"passage": k, "level": level, "hash": h} for k, (level, p) in enumerate(found) for h in _hashes(p)])
            cells = [pa.array(own, pa.string()), pa.array(passages, pa.int32()), pa.array(said, pa.list_(pa.int64())),
                     pa.array(quoted, pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("hash", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + cells, [*names, "own", "passages", "said", "quoted"])

    parsed = once.mapInArrow(run, schema)
    return materialize(messages.sparkSession, numbered(parsed, F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(),
                                                       F.col("role").asc_nulls_first(), F.col("own"), F.col("quoted").cast("string")), "messages")


def _latest_saying(parsed: DataFrame) -> DataFrame:
    """(n, passage, level, origin): the latest earlier message that says each quoted sentence."""
    quoting = parsed.where(F.size("quoted") > 0)
    asked = quoting.select("conv_id", "n", F.explode("quoted").alias("q")).select(
        "conv_id", "n", "q.hash", "q.passage", "q.level")
    talks = quoting.select(F.col("conv_id").alias("talk")).distinct()
    said = (parsed.join(talks, F.col("conv_id").eqNullSafe(F.col("talk")), "left_semi")
            .select("conv_id", "n", F.explode(F.array_distinct("said")).alias("hash"))
            .select("conv_id", "n", "hash", F.lit(None).cast("int").alias("passage"), F.lit(None).cast("int").alias("level")))
    both = asked.unionByName(said).withColumn("block", F.floor(F.col("n") / BLOCK))
    key = ["conv_id", "hash"]
    own = F.when(F.col("passage").isNull(), F.col("n"))
    inside = Window.partitionBy(*key, "block").orderBy("n").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max(own).over(inside)).where(F.col("passage").isNotNull())
    blocks = both.groupBy(*key, "block").agg(F.max(own).alias("last"))
    far = blocks.withColumn("far", F.max("last").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    far = far.select(F.col("conv_id").alias("talk"), F.col("hash").alias("sentence"), F.col("block").alias("part"), "far")
    same = F.col("conv_id").eqNullSafe(F.col("talk")) & (F.col("hash") == F.col("sentence")) & (F.col("block") == F.col("part"))
    return near.join(far, same).select("n", "passage", "level", F.coalesce("near", "far").alias("origin")).where("origin is not null")


def links(parsed: DataFrame) -> DataFrame:
    """(n, passage, level, origin): the message each quoted passage comes from."""
    votes = _latest_saying(parsed).groupBy("n", "passage", "level", "origin").agg(F.count("*").alias("votes"))
    return votes.groupBy("n", "passage", "level").agg(F.max_by("origin", F.struct("votes", "origin")).alias("origin"))


def _reply_order(tree: DataFrame) -> DataFrame:
    """(n, position, depth) of a table (n, parent): the preorder per tree.

    The tour that goes down to a message, through its replies and up again
    is a linked list of two places per message; their distances to the end
    are found by doubling the pointers, log2(longest tour) joins.
    """
    spark = tree.sparkSession
    kids = tree.where("parent is not null").withColumn("block", F.floor(F.col("n") / BLOCK))
    beside = kids.withColumn("beside", F.lead("n").over(Window.partitionBy("parent", "block").orderBy("n")))
    heads = kids.groupBy("parent", "block").agg(F.min("n").alias("head"))
    later = heads.withColumn("later", F.lead("head").over(Window.partitionBy("parent").orderBy("block"))).select("parent", "block", "later")
    sibling = beside.join(later, ["parent", "block"]).select("n", F.coalesce("beside", "later").alias("sibling"))
    first = kids.groupBy("parent").agg(F.min("n").alias("child")).withColumnRenamed("parent", "n")
    full = tree.join(sibling, "n", "left").join(first, "n", "left")
    down = full.select((2 * F.col("n")).alias("at"), F.coalesce(2 * F.col("child"), 2 * F.col("n") + 1).alias("next"),
                       F.lit(1).cast("long").alias("downs"), F.lit(1).cast("long").alias("deep"))
    up = full.select((2 * F.col("n") + 1).alias("at"), F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1).alias("next"),
                     F.lit(0).cast("long").alias("downs"), F.lit(-1).cast("long").alias("deep"))
    # downs, deep: sums over the places from this one up to before the next
    tour = materialize(spark, down.unionByName(up), "tour")
    while not tour.where("next is not null").limit(1).isEmpty():
        # places that have reached the end of their list stay as they are
        ahead = tour.select(F.col("at").alias("next"), F.col("next").alias("then"), F.col("downs").alias("d"), F.col("deep").alias("e"))
        nearer = tour.where("next is not null").join(ahead, "next").select(
            "at", F.col("then").alias("next"), (F.col("downs") + F.col("d")).alias("downs"), (F.col("deep") + F.col("e")).alias("deep"))
        tour = materialize(spark, tour.where("next is null").unionByName(nearer), "tour")
    # downs: messages from here to the end of the tree; deep: minus the depth
    return tour.where(F.col("at") % 2 == 0).select((F.col("at") / 2).cast("long").alias("n"), "downs", (-F.col("deep")).alias("depth"))


def reply_ordered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, position, depth, reply_to, n_quotes, n_linked and
    text (without quotes) of every message.

    position counts distinct messages from 1 in reply order (copies share
    theirs); reply_to is the turn replied to (null for the first message);
    depth is 0 there.
    """
    spark = messages.sparkSession
    parsed = _parsed(messages)
    found = materialize(spark, links(parsed), "quote-links")
    per = found.groupBy("n").agg(F.min_by("origin", F.struct("level", "passage")).alias("origin"), F.count("*").alias("n_linked"))
    before = parsed.select((F.col("n") + 1).alias("n"), F.col("conv_id").alias("before"), F.lit(True).alias("any"))
    tree = (parsed.select("n", "conv_id", "copies").join(before, "n", "left").join(per, "n", "left")
            .withColumn("first", F.col("any").isNull() | ~F.col("conv_id").eqNullSafe(F.col("before")))
            .select("n", "conv_id", "copies", F.coalesce("origin", F.when(~F.col("first"), F.col("n") - 1)).alias("parent"),
                    F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked")))
    tree = materialize(spark, tree, "reply-tree")
    order = materialize(spark, tree.join(_reply_order(tree.select("n", "parent")), "n"), "reply-order")
    size = order.groupBy(F.col("conv_id").alias("talk")).agg(F.max("downs").alias("size"))
    placed = order.join(size, F.col("conv_id").eqNullSafe(F.col("talk"))).select(
        "n", "parent", "depth", "n_linked", (F.col("size") - F.col("downs")).alias("rank"))
    answered = parsed.select(F.col("n").alias("parent"), F.col("turn").alias("reply_to"))
    full = parsed.join(placed, "n").join(answered, "parent", "left")
    return full.select("conv_id", "turn", "role", (F.col("rank") + 1).alias("position"), "depth", "reply_to",
                       F.col("passages").cast("long").alias("n_quotes"), "n_linked", F.col("own").alias("text"),
                       F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
