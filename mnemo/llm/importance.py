"""Target-distribution importance resampling by a distributed quickselect.

Documents and the texts of a target are read as hashed n-grams. A bucket's
gain is the logarithm of its smoothed frequency in the target over that in
the documents, a document's weight the floored mean of its gains, and its
score the weight plus Gumbel noise from a hash of its doc_id. So drawing the
highest scores is sampling without replacement in proportion to the
importance of each document.

* Bucket counts are summed per task in an array of ``BUCKETS`` numbers, then
  in Spark. Only these sums come to the driver; the gains go back as an array
  with which tasks score Arrow batches.
* The k highest keys (score, doc_id, ...) are found by a quickselect: a few
  random keys of the rows still open are pivots, one aggregation counts
  exactly how many rows lie below, at and above each, and the rows between
  the two pivots around the k-th are the next round's. Each round divides
  them by about ``PIVOTS``; the driver sees the pivots and their counts.
* Only the winners are sorted. Their ranks are the row's place inside its
  range of keys plus the sizes of the ranges before.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became
a-z. doc_ids are whole numbers. A null or empty text has no features and weight 0. A null doc_id is
hashed as the empty text and comes after all others among equal scores. Rows
that share a doc_id share their noise; among equal scores and ids the row of
fewer features goes first, and rows equal in all columns take the ranks
between them in any order. Extra columns are ignored. Without documents there
are no rows; without target texts all buckets count as unseen there.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mnemo.llm.words import arrow, raw, runs
from mnemo.sources.snapshot import materialize

BUCKETS = 10_000     # these five are fixed by the contract
WIDTH = 1
SEED = "2024"
MIN_WORDS = 20
PERCENT = 10
PIVOTS = 15
SCALE = 1000         # gains and noise are whole thousandths

_INK = np.zeros(256, dtype=bool)
_INK[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    """The byte table of the reflected CRC-32 polynomial (zlib's)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_TABLE = _crc_table()
_LONG = 64           # spans of more bytes are handed to zlib one by one


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """zlib's crc32 of each span start[i]:end[i], all spans side by side."""
    size = end - start
    out = np.zeros(len(size), dtype=np.uint32)
    at = np.flatnonzero((size > 0) & (size <= _LONG))
    at = at[np.argsort(-size[at], kind="stable")]
    place, left = start[at], size[at]
    crc = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
    live = np.searchsorted(-left, -np.arange(1, _LONG + 1), side="right")     # spans of at least k bytes
    for k in range(_LONG):
        n = live[k]
        if not n:
            break
        c = crc[:n]
        crc[:n] = _TABLE[(c ^ data[place[:n] + k]) & 0xFF] ^ (c >> np.uint32(8))
    out[at] = crc ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > _LONG).tolist():
        out[k] = zlib.crc32(data[start[k]: end[k]].tobytes())
    return out


def features(texts: pa.Array, buckets: int = BUCKETS, width: int = WIDTH):
    """(first text, end, words of each, bucket and text of every feature) of
    runs of texts; features are all runs of 1 to ``width`` words."""
    buf, off = raw(texts)
    for i, j in runs(off):
        data = buf[off[i]: off[j]]
        data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
        bounds = off[i: j + 1] - off[i]
        ink = _INK[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        before = np.concatenate([[False], ink[:-1]])
        after = np.concatenate([ink[1:], [False]])
        start = np.flatnonzero(ink & (~before | edge[:-1]))
        end = np.flatnonzero(ink & (~after | edge[1:])) + 1
        doc = np.searchsorted(bounds, start, side="right") - 1
        words = np.bincount(doc, minlength=j - i)
        found = [(crc32(data, start, end), doc)]
        if width > 1:     # words joined by one space, each followed by one
            size = end - start + 1
            to = np.concatenate([[0], np.cumsum(size)])
            joined = np.full(int(to[-1]), 0x20, dtype=np.uint8)
            joined[np.arange(len(joined)) - np.repeat(to[:-1], size) < np.repeat(size - 1, size)] = data[ink]
            for n in range(2, width + 1):
                at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1:]) if len(doc) >= n else np.zeros(0, dtype=np.int64)
                found.append((crc32(joined, to[at], to[at + n] - 1), doc[at]))
        yield i, j, words, np.concatenate([c for c, _ in found]) % np.uint32(buckets), np.concatenate([d for _, d in found])


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS, width: int = WIDTH) -> np.ndarray:
    """Features of all texts by bucket: one array of counts per task, summed
    in Spark; ``buckets`` numbers come to the driver."""
    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for *_, bucket, _ in features(b.column(0), buckets, width):
                total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])

    arrow(texts.sparkSession)
    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.select(column).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of ln of the smoothed frequencies' quotient."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(SCALE * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n))))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise of a doc_id in whole thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    u = (h.cast("double") + 0.5) / 4294967296
    return F.floor(F.lit(-float(SCALE)) * F.ln(-F.ln(u))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, width: int = WIDTH, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight and score of every document."""
    arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    names = ["doc_id", "n_features", "n_words", "weight"]

    def run(batches):
        for b in batches:
            gain = shared.value
            out = np.zeros((3, b.num_rows), dtype=np.int64)
            for i, j, words, bucket, doc in features(b.column("text"), len(gain), width):
                n = np.bincount(doc, minlength=j - i)
                order = np.argsort(doc, kind="stable")
                total = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
                ends = np.cumsum(n)
                out[:, i:j] = n, words, (total[ends] - total[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x) for x in out)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{n} long" for n in names)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def literal(row, kind: StructType) -> Column:
    """A collected struct as a literal of its type."""
    return F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind.fields)))


def kth_key(rows: DataFrame, key: Column, k: int, pivots: int = PIVOTS, seed: int = 0):
    """The k-th smallest value (k from 1) of the struct ``key`` over ``rows``,
    whose keys must all differ and hold no null; None if there are fewer.

    Distributed quickselect. Every round counts all rows still open three
    ways around each pivot, so the answer is exact whatever the pivots. What
    is left is written anew each round.
    """
    spark = rows.sparkSession
    left, turn = rows.select(key.alias("key")), seed
    kind = left.schema["key"].dataType
    while True:
        turn += 1
        chosen = sorted(r.key for r in left.orderBy(F.xxhash64("key", F.lit(turn))).limit(pivots).collect())
        marks = [literal(c, kind) for c in chosen]
        sums = [f for i, m in enumerate(marks) for f in (F.count_if(F.col("key") < m).alias(f"below{i}"), F.count_if(F.col("key") == m).alias(f"at{i}"))]
        found = left.agg(F.count("*").alias("n"), *sums).first()
        if not 0 < k <= found["n"]:
            return None
        i = sum(found[f"below{i}"] < k for i in range(len(marks)))      # pivots at or before the k-th key
        done = found[f"below{i - 1}"] + found[f"at{i - 1}"] if i else 0
        if k <= done:
            return chosen[i - 1]
        if i:
            left = left.where(F.col("key") > marks[i - 1])
        if i < len(marks):
            left = left.where(F.col("key") < marks[i])
        left, k = materialize(spark, left, "quickselect"), k - done


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, ...) in the given total order, ranges of
    the order side by side. One number per range comes to the driver."""
    spark = rows.sparkSession
    shift = 33      # of monotonically_increasing_id: partition above, row below
    placed = materialize(spark, rows.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_at", F.monotonically_increasing_id()), "ranked")
    sizes = placed.groupBy(F.shiftright("_at", shift).alias("part")).count().orderBy("part").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r.part, total))
        total += r["count"]
    before = spark.createDataFrame(starts, "_part long, _before long")
    return (placed.withColumn("_part", F.shiftright("_at", shift)).join(F.broadcast(before), "_part")
            .withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << shift) - 1)) + 1).drop("_at", "_part", "_before"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS,
             width: int = WIDTH, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document.

    Of the N documents with at least ``min_words`` words the
    ``percent * N // 100`` of highest score are drawn and ranked; the rank of
    the others is null. ``target`` has a column ``text``.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, "text", buckets, width), bucket_counts(target, "text", buckets, width))
    # the written table gives each row a number that stays, so all keys differ
    scored = materialize(spark, weigh(docs, gain, width, seed).withColumn("_row", F.monotonically_increasing_id()), "importance")
    last = F.struct((-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("z"), F.coalesce("doc_id", F.lit(0)).alias("i"),
                    F.col("n_features").alias("n"), F.col("_row").alias("r"))
    able = scored.where(F.col("n_words") >= min_words)
    k = percent * able.count() // 100
    end = kth_key(able, last, k) if k else None
    names = ["doc_id", "n_features", "weight", "score"]
    rest = F.lit(None).cast("long").alias("rank")
    if end is None:
        return scored.select(*names, rest)
    drawn = (F.col("n_words") >= min_words) & (last <= literal(end, able.select(last.alias("k")).schema["k"].dataType))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("_row")]
    first = ranked(scored.where(drawn), order).select(*names, "rank")
    return first.unionByName(scored.where(~drawn).select(*names, rest))


# SQL computes the CRC of every distinct word by the byte table.
ORACLE = """
WITH bits AS (
  SELECT list(list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) r(i)),
texts AS (
  SELECT 0 AS side, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
split AS (
  SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts),
w AS (SELECT side, row, unnest(words) AS word FROM split),
coded AS (
  SELECT word, list_transform(range(0, (length(hex(word)) // 2)::BIGINT), lambda k: ('0x' || substr(hex(word), (2 * k + 1)::BIGINT, 2))::UBIGINT) AS bytes
  FROM (SELECT DISTINCT word FROM w)),
b AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255)::INT + 1])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM coded, bits),
n AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM w JOIN b USING (word) GROUP BY bucket),
total AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM n),
gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain FROM n, total),
mean AS (
  SELECT row, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM w JOIN b USING (word) JOIN gain USING (bucket) WHERE side = 0 GROUP BY row),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM split LEFT JOIN mean USING (row) WHERE side = 0),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS able
  FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= able * 10 // 100 THEN rank END AS rank
FROM scored LEFT JOIN drawn ON scored.doc_id = drawn.doc_id
"""
