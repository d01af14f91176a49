"""SimHash near-duplicate groups by Golay-code fuzzy hashing.

Fingerprint: lower-case A-Z, words ``[^\\x20\\x09-\\x0D]+``, three-word
shingles with repeats (fewer words: the whole sequence), XXH64 with seed 42;
a bit is set where over half of the shingles have it. A text without words
(null, empty, white space) has fingerprint zero and is linked like any other.

Links at two or fewer differing bits are found on the distinct
fingerprints. The 64 bits are cut into three segments of at most 23 bits.
Two differing bits leave one segment untouched, and the next segment
(cyclically) has at most two errors. The perfect binary Golay code
[23,12,7] gives every 23-bit word the codewords within distance 4 of it:
one, or six. Two words at distance two or less have a word halfway, whose
codeword (within 3) lies within 4 of both, so they share a key. A
fingerprint's keys are, for each segment, its exact bits with each Golay
index of the next segment: 3 to 18 keys of 34 bits. Rows that share a key
are joined and verified by their bits.

A key shared by more than ``PAIRS`` fingerprints is not paired off: its
members are linked through the fingerprints one bit away. Two fingerprints
differ in at most two bits exactly if some fingerprint is within one bit of
both, so grouping by these 65 neighbours finds the same components in
linear work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.llm.components import components
from mnemo.llm.words import arrow, releasing
from mnemo.sources.snapshot import materialize

SHINGLE = 3
SEED = 42
BITS = 2           # largest distance of a link
PAIRS = 24         # keys with more fingerprints are linked through neighbours
SEGMENTS = ((0, 22), (22, 21), (43, 21))   # (lowest bit, width)
GENERATOR = 0b101011100011                 # x^11+x^9+x^7+x^6+x^5+x+1
STEP = 1 << 16     # shingles whose bits are counted at once


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of one text in UTF-8."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - SHINGLE + 1].tolist()
    end = end[SHINGLE - 1:].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(start), STEP):
        h = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(start[at: at + STEP], end[at: at + STEP])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, tie: bool = False) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp is the fingerprint as a
    signed long. With ``tie`` also a hash of the text."""
    arrow(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column("text").cast(pa.large_binary())], dtype=np.uint64)
            more = [b.column("tie")] if tie else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64)), *more], schema.fieldNames())

    schema = docs.select("doc_id").schema.add("fp", "long")
    if tie:
        schema = schema.add("tie", "long")
    more = [F.xxhash64(docs["text"]).alias("tie")] if tie else []
    return docs.select("doc_id", "text", *more).mapInArrow(releasing(run), schema)


class Golay:
    """Decoder tables of the perfect binary Golay code [23,12,7]."""

    def __init__(self) -> None:
        self.rest = np.zeros((3, 256), dtype=np.int64)
        for k in range(3):
            for b in range(256):
                self.rest[k, b] = self._modulo(b << (8 * k))
        near: list[list[int]] = [[] for _ in range(2048)]
        bits = [self._modulo(1 << i) for i in range(23)]
        # all error patterns of weight 4 or less, by syndrome
        errors = [(0, 0, -1)]
        for _ in range(5):
            for e, s, _top in errors:
                near[s].append(e)
            errors = [(e | 1 << i, s ^ bits[i], i) for e, s, top in errors for i in range(top + 1, 23)]
        width = max(map(len, near))
        self.errors = np.array([x + [-1] * (width - len(x)) for x in near], dtype=np.int64)

    @staticmethod
    def _modulo(x: int) -> int:
        for i in range(x.bit_length() - 1, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    def indices(self, x: np.ndarray) -> np.ndarray:
        """Indices (12 bits) of the codewords within distance 4 of each x, padded with -1."""
        s = self.rest[0, x & 255] ^ self.rest[1, x >> 8 & 255] ^ self.rest[2, x >> 16]
        e = self.errors[s]
        return np.where(e < 0, -1, (x[:, None] ^ e) >> 11)


def _keys(distinct: DataFrame) -> DataFrame:
    """(key, fp) for every key of every distinct fingerprint."""
    def run(batches):
        golay = Golay()
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            u = fp.view(np.uint64)
            part = [((u >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
            for i in range(3):
                near = golay.indices(part[(i + 1) % 3])
                key = np.where(near < 0, -1, i << 34 | near << 22 | part[i][:, None])
                row, col = np.nonzero(key >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(key[row, col]), pa.array(fp[row])], ["key", "fp"])

    return distinct.mapInArrow(releasing(run), "key long, fp long")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(distinct: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(u, v) edges whose components are those of all links at ``BITS`` bits."""
    spark = distinct.sparkSession
    keys = materialize(spark, _keys(distinct), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(spark, keys.join(sizes, "key"), "golay-shared")
    few, many = shared.where(F.col("n") <= pairs), shared.where(F.col("n") > pairs)
    near = (few.select("key", F.col("fp").alias("v")).join(few.select("key", F.col("fp").alias("u")), "key")
            .where((F.col("u") > F.col("v")) & (_distance("u", "v") <= BITS)).select("u", "v"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)))
    around = many.select("fp").distinct().select("fp", F.explode(flips).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    heads = around.groupBy("z").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("z", "v")
    through = around.join(heads, "z").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return near.unionByName(through).distinct()


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest
    doc_id reachable over links (null only if no member has a doc_id)."""
    spark = docs.sparkSession
    prints = materialize(spark, fingerprints(docs), "simhash")
    first = materialize(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(first.select("fp")))
    placed = first.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    member = placed.join(least, "root").select("fp", "component_id")
    return prints.join(member, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every
    document: one row per row, repeated ones too. Extra columns are ignored,
    an empty table gives no rows."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group: that of its smallest doc_id (rows
    without one come last), and of these that of the smallest text hash.

    Rows are told apart by doc_id and text, so a doc_id that occurs with
    different texts may stay once for each group.
    """
    spark = docs.sparkSession
    prints = materialize(spark, fingerprints(docs, tie=True), "simhash")
    head = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"))
    first = materialize(spark, prints.groupBy("fp").agg(F.min(head).alias("head")), "simhash-distinct")
    roots = components(links(first.select("fp")))
    heads = materialize(spark, first.join(roots.withColumnRenamed("u", "fp"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
                        .agg(F.min("head").alias("head")).select("head._id", "head._tie"), "simhash-heads")
    rows = prints.groupBy(F.col("doc_id").alias("id"), "tie").agg(F.count("*").alias("n"))
    is_head = rows["id"].eqNullSafe(heads["_id"]) & (rows["tie"] == heads["_tie"])
    # only the rows that go, written first: where they are few, the planner
    # sends them to the documents instead of shuffling the texts
    losers = materialize(spark, rows.join(heads, is_head, "left_anti").select(F.col("id").alias("_id"), F.col("tie").alias("_tie")), "simhash-losers")

    def same(x: DataFrame) -> Column:
        # columns by reference: the documents may have columns of any name
        return docs["doc_id"].eqNullSafe(x["_id"]) & (F.xxhash64(docs["text"]) == x["_tie"])

    kept = docs.join(losers, same(losers), "left_anti")
    repeated = materialize(spark, rows.where("n > 1").join(heads, is_head, "left_semi").select(
        F.col("id").alias("_id"), F.col("tie").alias("_tie")), "simhash-repeated")
    if not repeated.isEmpty():
        one = (kept.join(repeated, same(repeated), "left_semi")
               .select(F.struct(*docs.columns).alias("row"), docs["doc_id"].alias("_id"), F.xxhash64(docs["text"]).alias("_tie"))
               .dropDuplicates(["_id", "_tie"]).select("row.*"))
        kept = kept.join(repeated, same(repeated), "left_anti").unionByName(one)
    return kept
