"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated in Spark to one
row per membership pattern; a flow on the driver routes each pattern's words
to the quotas of its sources, where the k-th pass over a pattern costs more
than the one before (convex repetition costs). The result says how often
each pattern is taken whole and how many words it gives beyond; documents
are then chosen in a seeded order by a threshold per pattern.

The choice is the plain greedy rule: in seeded order every document is taken
that is no longer than the words still wanted of its pattern. It takes one
step for each run of documents that fit, and as what is still wanted falls
below the document that ended the run, few steps (about the logarithm of the
largest size) until no document fits.

The driver sees one row per pattern, at most ``MAX_PATTERNS`` (an error
beyond: these are combinations of named sources, not data). A null or empty
text has size 0 and is taken 0 words. Sources may be null. Rows that share a
doc_id share their place in the seeded order, so they are taken alike. Extra
columns are ignored, or kept where rows are returned.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.sources.snapshot import materialize

WEIGHTS = (5, 2, 1)     # fixed by the contract, repeating over the sources
PASSES = 3              # no document is taken more often
SEED = "mix-1"
MAX_PATTERNS = 100_000
PREFIX = 4              # hexadecimal digits of the order's hash: 65,536 buckets
LAST = "g"              # above every hexadecimal hash


def n_words(text: Column) -> Column:
    """Matches of [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(seed: str = SEED) -> Column:
    """The document's place in the seeded order."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def targets(sizes: dict, weights=WEIGHTS, passes: int = PASSES) -> dict:
    """Words wanted of each source: shares by weight of all words, none above
    ``passes`` times the source, the excess shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, rest = float(sum(sizes.values())), float(sum(weight.values()))
    out, full = {}, True
    for s in sorted(order, key=lambda s: (passes * sizes[s] / weight[s], order.index(s))):
        if full and passes * sizes[s] * rest <= left * weight[s]:
            out[s] = float(passes * sizes[s])
            left -= out[s]
            rest -= weight[s]
        else:
            full = False
            out[s] = left * weight[s] / rest
    return {s: round(t, 6) for s, t in out.items()}


def flow(sizes: dict, quotas: dict, costs=tuple(range(1, PASSES + 1))) -> dict:
    """Words taken of each pattern by a min-cost flow of largest value.

    ``sizes`` maps a pattern (tuple of sources) to its words. The k-th pass
    over any pattern costs ``costs[k - 1]`` a word (ascending). All paths
    with a cheaper pass are filled before a dearer pass is opened, which for
    such costs is the min-cost flow. Returns {pattern: [words of each pass]}.
    """
    patterns, sources = list(sizes), list(quotas)
    start, end = 0, 1
    node = {("p", p): 2 + i for i, p in enumerate(patterns)}
    node |= {("s", s): 2 + len(patterns) + i for i, s in enumerate(sources)}
    graph: list[list[int]] = [[] for _ in range(2 + len(node))]
    to: list[int] = []
    room: list[float] = []

    def edge(a: int, b: int, capacity: float) -> int:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((float(capacity), 0.0))
        return len(to) - 2

    for p in patterns:
        for s in dict.fromkeys(p):
            if s in quotas:
                edge(node["p", p], node["s", s], len(costs) * sizes[p])
    for s in sources:
        edge(node["s", s], end, quotas[s])
    tiny = 1e-7
    taken: dict = {p: [] for p in patterns}
    for _ in costs:
        opened = {p: edge(start, node["p", p], sizes[p]) for p in patterns}
        while True:
            level = {start: 0}
            queue = deque([start])
            while queue:
                a = queue.popleft()
                for e in graph[a]:
                    if room[e] > tiny and to[e] not in level:
                        level[to[e]] = level[a] + 1
                        queue.append(to[e])
            if end not in level:
                break
            at = [0] * len(graph)
            path: list[int] = []
            a = start
            while True:     # blocking flow, without recursion
                if a == end:
                    pushed = min(room[e] for e in path)
                    for e in path:
                        room[e] -= pushed
                        room[e ^ 1] += pushed
                    path, a = [], start
                    continue
                while at[a] < len(graph[a]):
                    e = graph[a][at[a]]
                    if room[e] > tiny and level.get(to[e]) == level[a] + 1:
                        break
                    at[a] += 1
                if at[a] < len(graph[a]):
                    path.append(graph[a][at[a]])
                    a = to[path[-1]]
                elif not path:
                    break
                else:
                    a = to[path.pop() ^ 1]
                    at[a] += 1
        for p, e in opened.items():
            taken[p].append(room[e ^ 1])
    return taken


def plan(sized: DataFrame, wanted) -> tuple[DataFrame, dict, dict]:
    """(cuts, source sizes, targets) for a table (pattern, size, place).

    cuts has one row per pattern: ``whole`` passes, and ``steps`` (most,
    after, stop): a document is taken once more if its size is at most the
    limit of a step and its place between the step's ends. This is the greedy
    choice in seeded order of every document that still fits. ``wanted``
    makes the targets from the source sizes.
    """
    spark = sized.sparkSession
    rows = sized.groupBy("pattern").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; name fewer sources")
    sizes = {tuple(r.pattern): int(r.words) for r in rows}
    by_source: dict = {}
    for p, words in sizes.items():
        for s in dict.fromkeys(p):
            by_source[s] = by_source.get(s, 0) + words
    goal = wanted(by_source)
    whole, state, steps = {}, {}, {p: [] for p in sizes}
    for p, passes in flow(sizes, goal).items():
        whole[p] = sum(1 for x in passes if x >= sizes[p] - 1e-4) if sizes[p] else 0
        state[p] = sum(passes[whole[p]:]), ""
    while state:
        found = {tuple(r.pattern): r for r in _step(sized, state).collect()}
        for p, r in found.items():
            rest, after = state[p]
            steps[p].append((rest, after, r.stop))
            state[p] = rest - float(r.words), r.stop
        # patterns of which nothing fits any more are done
        state = {p: state[p] for p in found if state[p][0] >= 1 and state[p][1] != LAST}
    schema = "pattern array<string>, whole int, steps array<struct<most: double, after: string, stop: string>>"
    return spark.createDataFrame([(list(p), whole[p], steps[p]) for p in sizes], schema), by_source, goal


def _step(sized: DataFrame, state: dict) -> DataFrame:
    """(pattern, stop, words): the first place whose documents do not fit the
    rest of their pattern, and the words of those that fit before it.

    The sums run over buckets of places; documents are ordered only inside
    the one bucket of a pattern in which the rest runs out (a 65,536th).
    """
    levels = F.broadcast(sized.sparkSession.createDataFrame(
        [(list(p), float(rest), stop) for p, (rest, stop) in state.items() if rest >= 1], "pattern array<string>, rest double, stop string"))
    fit = (sized.join(levels, "pattern").where("size > 0 and size <= rest and place > stop")
           .withColumn("bucket", F.substring("place", 1, PREFIX)))
    sums = fit.groupBy("pattern", "bucket", "rest").agg(F.sum("size").alias("words"))
    ends = sums.withColumn("after", F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket")))
    cut = ends.select("pattern", "bucket", (F.col("after") - F.col("words")).alias("before"), "after", "rest")
    inside = (fit.drop("rest").join(F.broadcast(cut.where("after > rest and before <= rest")), ["pattern", "bucket"])
              .withColumn("sum", F.col("before") + F.sum("size").over(Window.partitionBy("pattern", "bucket").orderBy("place"))))
    stop = inside.groupBy("pattern").agg(F.min(F.when(F.col("sum") > F.col("rest"), F.col("place"))).alias("stop"),
                                         F.coalesce(F.max(F.when(F.col("sum") <= F.col("rest"), F.col("sum"))), F.min("before")).alias("words"))
    short = ends.groupBy("pattern", "rest").agg(F.max("after").alias("words")).where("words <= rest").select(
        "pattern", F.lit(LAST).alias("stop"), "words")
    return stop.unionByName(short)


def _repeats(df: DataFrame, cuts: DataFrame) -> DataFrame:
    """``df`` (pattern, size, place, ...) with ``times``: how often a row is taken."""
    more = F.exists("steps", lambda s: (F.col("size") <= s["most"]) & (F.col("place") > s["after"]) & (F.col("place") < s["stop"]))
    least = F.least(F.col("whole") + more.cast("int"), F.lit(PASSES))
    return df.join(F.broadcast(cuts), "pattern").withColumn("times", least).drop("whole", "steps")


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    spark = docs.sparkSession
    sized = materialize(spark, docs.select("doc_id", F.array(F.col("source").cast("string")).alias("pattern"),
                                           n_words(F.col("text")).alias("size"), place().alias("place")), "mix-sizes")
    cuts, sizes, goal = plan(sized, targets)
    facts = spark.createDataFrame([([s], sizes[s], goal[s]) for s in sizes], "pattern array<string>, source_size long, target double")
    return _repeats(sized, cuts).join(F.broadcast(facts), "pattern").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix(docs: DataFrame, members: Column | None = None, wanted=targets) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    ``members`` is the array of sources of a document (default: its one
    source); a document of size 0 is taken once, as it uses no words.
    """
    spark = docs.sparkSession
    members = members if members is not None else F.array(F.col("source").cast("string"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.array_sort(F.array_distinct(members)).alias("pattern"),
                        n_words(F.col("text")).alias("size"), place().alias("place"))
    sized = materialize(spark, keyed.select("pattern", "size", "place"), "mix-sizes")
    cuts, _, _ = plan(sized, wanted)
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("times"))
    return (_repeats(keyed, cuts).withColumn("copy", F.explode(F.array_repeat(F.lit(1), times))).select("row.*"))


# The greedy rule document by document.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(concat('mix-1:', coalesce(doc_id::VARCHAR, ''))) AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS z, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((rn - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
r AS (
  SELECT *, row_number() OVER o AS k,
         (SELECT sum(z) FROM s)::DOUBLE - coalesce(sum(3 * z) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS free,
         sum(w) OVER (ORDER BY 3 * z / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w WINDOW o AS (ORDER BY 3 * z / w, rn)),
f AS (SELECT free, rest FROM r WHERE 3 * z * rest > free * w ORDER BY k LIMIT 1),
t AS (
  SELECT r.source, r.z, round(CASE WHEN f.rest IS NULL OR 3 * r.z * f.rest <= f.free * r.w THEN 3.0 * r.z ELSE f.free * r.w / f.rest END, 6) AS target
  FROM r LEFT JOIN f ON true),
b AS (
  SELECT source, z, target, CASE WHEN z > 0 THEN floor(target / z)::BIGINT ELSE 0 END AS whole,
         target - CASE WHEN z > 0 THEN floor(target / z) ELSE 0 END * z AS rest
  FROM t),
o AS (SELECT source, doc_id, size, row_number() OVER (PARTITION BY source ORDER BY place) AS i FROM d WHERE size > 0),
walk(source, i, rest, took) AS (
  SELECT source, 0::BIGINT, rest::DOUBLE, false FROM b
  UNION ALL
  SELECT w.source, o.i, CASE WHEN o.size <= w.rest THEN w.rest - o.size ELSE w.rest END, o.size <= w.rest
  FROM walk w JOIN o ON o.source IS NOT DISTINCT FROM w.source AND o.i = w.i + 1)
SELECT d.doc_id, d.size, b.z AS source_size, b.target, d.size * (b.whole + CASE WHEN walk.took THEN 1 ELSE 0 END) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
LEFT JOIN o ON o.doc_id = d.doc_id AND o.source IS NOT DISTINCT FROM d.source
LEFT JOIN walk ON walk.source IS NOT DISTINCT FROM d.source AND walk.i = o.i
"""
