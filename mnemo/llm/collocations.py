"""Phrase collocation mining with mergeable Misra-Gries summaries.

Phrases of up to ``MOST_WORDS`` consecutive words that occur at least
``LEAST`` times in a language are found in two passes:

1. Every block of documents sends its distinct phrases as hashes with their
   counts to hash partitions (see :mod:`mnemo.llm.exchange`). A partition
   merges these into one Misra-Gries summary whose capacity exceeds the
   partition's mass divided by ``LEAST``. Such a summary underestimates by
   less than ``LEAST``, so every frequent phrase keeps a counter above 0. The
   partition answers each block with one bit per phrase: survived or not.
2. Blocks count the survivors exactly, by their text, and Spark adds up.
   Phrases below ``LEAST`` that survived are dropped here.

A hash collision can only let more survive. A block's count of one phrase is
cut to ``LEAST`` in its message, which keeps the guarantee (the cut counts of
a frequent phrase still add up to ``LEAST``) and bounds the mass that a very
common phrase brings. The number of partitions follows the bytes of the
texts, so a partition's work and memory do not grow with the input.

Scoring, the choice of a cut, and the removal of phrases that lie in a longer
one are joins and aggregations over the table of frequent phrases; products
are computed as decimals, which do not overflow.

A null text counts as empty, a null lang as ``und``; empty tables and tables
without frequent phrases give no rows. Every row counts, repeated ones too.
Extra columns are ignored. Among equal scores and counts the phrase of the
least UTF-8 bytes goes first, so ranks never tie.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.exchange import blocks, name, narrow, pack, parts_of, unpack
from mnemo.llm.words import arrow, hash_spans, mix, raw, windows
from mnemo.sources.snapshot import materialize

MOST_WORDS = 4       # these four are fixed by the contract
LEAST = 30
TOP = 2000
COVER = (100, 80)    # dropped if 100 * f(longer) >= 80 * f(phrase)
SCALE = 2_000_000
BLOCK_BYTES = 3_000_000       # of text that a block has, or one longer text
SALTS = 64           # parts of a language that are ranked before the whole

_U = np.uint64
_SHARD_BITS = 24     # at most 2**24 hash partitions
_PIECE_END = np.zeros(256, dtype=bool)
_PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = _PIECE_END.copy()
_BLANK[[0x20, 0x09]] = True


class Phrases:
    """The words of a block, in lower case, and its phrases as positions."""

    def __init__(self, texts: pa.Array, langs: list[str]):
        buf, off = raw(texts)
        data = buf[off[0]: off[-1]]
        data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
        bounds = off - off[0]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        ink = ~_BLANK[data]
        start = np.flatnonzero(ink & (np.concatenate([[True], ~ink[:-1]]) | edge[:-1]))
        end = np.flatnonzero(ink & (np.concatenate([~ink[1:], [True]]) | edge[1:])) + 1
        self.doc = np.searchsorted(bounds, start, side="right") - 1
        # words of one piece of one document have the same number
        self.piece = np.cumsum(_PIECE_END[data])[start] + self.doc
        size = end - start + 1
        self.to = np.concatenate([[0], np.cumsum(size)])        # words joined by one space
        self.data = np.full(int(self.to[-1]), 0x20, dtype=np.uint8)
        self.data[np.arange(len(self.data)) < np.repeat(self.to[1:] - 1, size)] = data[ink]
        self.langs = langs

    def grams(self, seed: int = 0):
        """(hash, first word) of all phrases of 1, 2, ... words."""
        h = hash_spans(self.data, self.to[:-1], self.to[1:] - 1, seed=seed)
        tags = [np.frombuffer(t.encode(), np.uint8) for t in self.langs]
        of_lang = {t: hash_spans(d, np.array([0]), np.array([len(d)]), seed=seed + 1)[0] for t, d in zip(self.langs, tags)}
        tag = np.array([of_lang[t] for t in self.langs], dtype=_U)[self.doc]
        for n in range(1, MOST_WORDS + 1):
            g, at = windows(h, self.piece, n)
            yield mix(g + tag[at] * _U(2 * n + 1)), at

    def texts(self, at: np.ndarray, n: np.ndarray) -> pa.Array:
        """The phrases of n[i] words from word at[i] on."""
        start = self.to[at]
        size = self.to[at + n] - 1 - start
        off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        flat = self.data[np.arange(off[-1]) + np.repeat(start - off[:-1], size)]
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(flat.tobytes())])


def _shard(key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(partition, 32-bit key inside it), both ascending with the key."""
    p = (key >> _U(_SHARD_BITS)) * _U(shards)
    rest = 64 - _SHARD_BITS
    return (p >> _U(rest)).astype(np.int64), ((p & _U((1 << rest) - 1)) >> _U(rest - 32)).astype("<u4")


def merge(keys: list[np.ndarray], counts: list[np.ndarray], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One Misra-Gries summary of several: at most ``capacity`` counters, and
    what was taken off each.

    Equal keys are added; if more than ``capacity`` remain, the count of rank
    capacity + 1 is taken off all. Each unit taken off goes with at least
    capacity + 1 units of mass, so a summary of mass m, merged in any order,
    underestimates by at most m / (capacity + 1).
    """
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(back, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)
    cut = 0
    if len(k) > capacity:
        cut = int(np.partition(n, len(n) - capacity - 1)[len(n) - capacity - 1])
        n -= cut
        k, n = k[n > 0], n[n > 0]
    return k, n, cut


def survivors(messages, mass: int, least: int = LEAST) -> np.ndarray:
    """The keys in the merged summary of (keys, counts) messages that may
    have ``least`` occurrences; every key that has them is among these.

    A key occurs at most as often as its counter and all that was taken off
    say, so what is below ``least`` with that is left out as well.
    """
    capacity = mass // least + 1
    keys, counts, held, lost = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], 0, 0
    for k, n in messages:
        keys.append(k)
        counts.append(n)
        held += len(k)
        if held > 4 * capacity + 100_000:
            k, n, cut = merge(keys, counts, capacity)
            keys, counts, held, lost = [k], [n], len(k), lost + cut
    k, n, cut = merge(keys, counts, capacity)
    return k[n + lost + cut >= least]


def _question(block: pa.Table, shards: int, least: int) -> dict[int, bytes]:
    """{partition: keys and counts of the block's distinct phrases}."""
    found = Phrases(block.column("text"), block.column("lang").to_pylist())
    keys, counts = np.unique(np.concatenate([g for g, _ in found.grams()]), return_counts=True)
    shard, key = _shard(keys, shards)
    counts = np.minimum(counts, least)
    ends = np.searchsorted(shard, np.arange(shards + 1)) if shards < 4 * len(keys) else None
    out = {}
    for s in np.unique(shard).tolist():
        a, b = (ends[s], ends[s + 1]) if ends is not None else (np.searchsorted(shard, s), np.searchsorted(shard, s, side="right"))
        k, n = key[a:b], counts[a:b]
        out[s] = struct.pack("<Q", int(n.sum())) + pack(np.diff(k, prepend=k.dtype.type(0)), narrow(n))
    return out


def _message(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = unpack(payload[8:])
    return np.cumsum(steps, dtype=np.uint64).astype("<u4"), counts.astype(np.int64)


def _answer(payloads: list[bytes], least: int) -> list[bytes]:
    """One bit per phrase of each message."""
    mass = sum(struct.unpack_from("<Q", p)[0] for p in payloads)
    left = survivors(map(_message, payloads), mass, least)
    out = []
    for p in payloads:
        keys, _ = _message(p)
        at = np.minimum(np.searchsorted(left, keys), max(len(left) - 1, 0))
        out.append(np.packbits(left[at] == keys if len(left) else np.zeros(len(keys), dtype=bool)).tobytes())
    return out


def _state(block: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema) as w:
        w.write_table(block)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def _count(state: bytes, replies: dict[int, bytes], shards: int) -> pa.Table:
    """(tagged, n) of the block's surviving phrases, counted exactly by their
    text: the phrase, a tab (no word has one) and the lang. The row of the
    empty phrase has all words."""
    block = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(state)).read_all()
    found = Phrases(block.column("text"), block.column("lang").to_pylist())
    levels = list(found.grams())
    keys = np.unique(np.concatenate([g for g, _ in levels]))
    shard, _ = _shard(keys, shards)
    bits = []
    for s, n in zip(*(x.tolist() for x in np.unique(shard, return_counts=True))):
        if s not in replies:
            raise RuntimeError("the answers to a block are missing; read the documents from storage")
        bits.append(np.unpackbits(np.frombuffer(replies[s], np.uint8), count=n).astype(bool))
    kept = keys[np.concatenate(bits)] if bits else keys
    place, first, length = [], [], []
    for n, (g, at) in enumerate(levels, 1):
        i = np.searchsorted(kept, g)
        hit = np.flatnonzero(kept[np.minimum(i, max(len(kept) - 1, 0))] == g) if len(kept) else np.zeros(0, dtype=np.int64)
        place.append(i[hit])
        first.append(at[hit])
        length.append(hit)
    # a second hash tells apart what the first one does not
    other = np.concatenate([g[h] for (g, _), h in zip(found.grams(seed=7), length)])
    length = np.concatenate([np.full(len(h), n) for n, h in enumerate(length, 1)])
    place, first = np.concatenate(place), np.concatenate(first)
    example = np.zeros(len(kept), dtype=np.int64)
    example[place[::-1]] = np.arange(len(place))[::-1]
    if (other != other[example[place]]).any():
        order = np.lexsort((other, place))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (place[order][1:] != place[order][:-1]) | (other[order][1:] != other[order][:-1])
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        example = np.zeros(int(new.sum()), dtype=np.int64)
        example[place[::-1]] = np.arange(len(place))[::-1]
    times = np.bincount(place, minlength=len(example))
    example, times = example[times > 0], times[times > 0]
    langs = pa.array(found.langs, pa.string())
    words = np.bincount(found.doc, minlength=len(found.langs))
    phrase = pa.concat_arrays([found.texts(first[example], length[example]).cast(pa.string()), pa.array([""] * len(langs), pa.string())])
    lang = pa.concat_arrays([langs.take(pa.array(found.doc[first[example]])), langs])
    rows = pa.table({"tagged": pc.binary_join_element_wise(phrase, lang, "\t"),
                     "n": pa.concat_arrays([pa.array(times.astype(np.int64)), pa.array(words.astype(np.int64))])})
    # neighbours that begin alike shuffle in fewer bytes
    return rows.group_by("tagged").aggregate([("n", "sum")]).rename_columns(["tagged", "n"]).sort_by("tagged")


def frequent(docs: DataFrame, least: int = LEAST, shards: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, phrase, n): all phrases of 1 to ``MOST_WORDS`` words that occur
    ``least`` times or more in their language, and for each language the
    empty phrase with the number of its words."""
    spark = docs.sparkSession
    arrow(spark)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if shards is None:
        shards = min(parts_of(docs), 1 << _SHARD_BITS)

    def ask(batches):
        for block in blocks(batches, block_bytes):
            messages = sorted(_question(block, shards, least).items())
            yield pa.RecordBatch.from_arrays([pa.array([name(block)] * len(messages), pa.string()), pa.array([s for s, _ in messages], pa.int32()),
                                              pa.array([p for _, p in messages], pa.binary())], ["block", "shard", "payload"])

    def keep(batches):
        for block in blocks(batches, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([name(block)], pa.string()), pa.array([_state(block)], pa.binary())], ["block", "payload"])

    def reply(table: pa.Table) -> pa.Table:
        asked = table.column("payload").to_pylist()
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "payload": pa.array(_answer(asked, least), pa.binary())})

    def meet(states: pa.Table, answers: pa.Table) -> pa.Table:
        got = dict(zip(answers.column("shard").to_pylist(), answers.column("payload").to_pylist()))
        found = [_count(s, got, shards) for s in states.column("payload").to_pylist()]
        return pa.concat_tables(found) if found else pa.table({"tagged": pa.array([], pa.string()), "n": pa.array([], pa.int64())})

    asked = docs.mapInArrow(ask, "block string, shard int, payload binary")
    answers = asked.groupBy("shard").applyInArrow(reply, "block string, shard int, payload binary")
    states = docs.mapInArrow(keep, "block string, payload binary")
    counted = states.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, "tagged string, n long")
    tab = F.instr("tagged", "\t")
    return (counted.groupBy("tagged").agg(F.sum("n").alias("n")).select(
        F.substring(F.col("tagged"), tab + 1, F.length("tagged")).alias("lang"), F.substring(F.col("tagged"), F.lit(1), tab - 1).alias("phrase"), "n")
        .where((F.col("n") >= least) | (F.col("phrase") == "")))


def _part(first: int, n: int):
    return F.array_join(F.slice("words", first, n), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that stay.

    ``counts`` is a table as of :func:`frequent`. One join gives the counts
    of all parts, one aggregation brings them and the most frequent longer
    phrase around each candidate together.
    """
    longer = counts.where(F.col("phrase") != "").withColumn("words", F.split("phrase", " ", -1)).withColumn("size", F.size("words")).where("size >= 2")
    cuts = [F.when(F.col("size") > k, F.array(
        F.struct(F.lit(f"l{k}").alias("as"), _part(1, k).alias("part")),
        F.struct(F.lit(f"r{k}").alias("as"), F.array_join(F.slice("words", F.lit(k + 1), F.col("size") - k), " ").alias("part"))))
        for k in range(1, MOST_WORDS)]
    parts = (longer.select("lang", "phrase", "n", F.explode(F.flatten(F.filter(F.array(*cuts), lambda x: x.isNotNull()))).alias("cut"))
             .select("lang", "phrase", "n", "cut.as", "cut.part"))
    known = counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("m"))
    inside = [F.when((F.col("size") > n) & (F.col("size") > first + n - 2), _part(first, n))
              for n in range(2, MOST_WORDS) for first in range(1, MOST_WORDS - n + 2)]
    around = longer.where("size > 2").select("lang", F.explode(F.array_distinct(F.filter(F.array(*inside), lambda x: x.isNotNull()))).alias("phrase"),
                                             F.lit(None).cast("long").alias("n"), F.lit("around").alias("as"), F.col("n").alias("m"))
    both = parts.join(known, ["lang", "part"]).select("lang", "phrase", "n", "as", "m").unionByName(around)
    names = [f"{side}{k}" for k in range(1, MOST_WORDS) for side in "lr"]
    met = both.groupBy("lang", "phrase").agg(F.max("n").alias("a"), F.max(F.when(F.col("as") == "around", F.col("m"))).alias("around"),
                                             *(F.max(F.when(F.col("as") == x, F.col("m"))).alias(x) for x in names))

    def score(k: int):
        return F.expr(f"({SCALE}BD * cast(a as decimal(20,0))) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))")

    best = F.array_min(F.filter(F.array(*(F.when(F.col(f"l{k}").isNotNull(), F.struct(
        score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, MOST_WORDS))),
        lambda x: x.isNotNull()))
    covered = F.lit(COVER[0]) * F.col("around").cast("decimal(20,0)") >= F.lit(COVER[1]) * F.col("a").cast("decimal(20,0)")
    return (met.where(~F.coalesce(covered, F.lit(False))).withColumn("best", best)
            .select("lang", "phrase", "a", "best.l", "best.r", "best.score"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first
    ``top`` phrases. Parts of a language are ranked before the whole, so the
    last ranking sees ``SALTS * top`` rows of a language at most."""
    counts = materialize(docs.sparkSession, frequent(docs, least), "phrases")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored(counts).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = counts.where(F.col("phrase") == "").select("lang", F.col("n").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH pieces AS (
  SELECT row, lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
  FROM w, range(1, 5) r(k) WHERE len(words) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k >= 2),
halves AS MATERIALIZED (
  SELECT lang, size, phrase, a, t.k, array_to_string(words[1:t.k], ' ') AS head, array_to_string(words[t.k + 1:], ' ') AS rest
  FROM c, range(1, 4) t(k) WHERE t.k < size),
heads AS MATERIALIZED (SELECT h.*, x.f AS l FROM halves h JOIN f x ON x.lang = h.lang AND x.phrase = h.head),
cut AS MATERIALIZED (
  SELECT h.lang, h.size, h.phrase, h.a, h.k, h.l, y.f AS r, (2000000 * h.a::HUGEINT) // (h.l + y.f) AS score
  FROM heads h JOIN f y ON y.lang = h.lang AND y.phrase = h.rest),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT c.lang, c.a AS around, array_to_string(c.words[i:i + n - 1], ' ') AS phrase
  FROM c, range(2, 4) s(n), range(1, 4) t(i) WHERE n < c.size AND i + n - 1 <= c.size),
covered AS (SELECT DISTINCT b.lang, b.phrase FROM best b JOIN inner_ USING (lang, phrase) WHERE 100 * around::HUGEINT >= 80 * b.a::HUGEINT),
kept AS (SELECT * FROM best ANTI JOIN covered USING (lang, phrase)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
