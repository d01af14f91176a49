"""Questions and answers between blocks of documents and shards of keys.

Many per-document sums need a value for each of a text's keys (pre-tokens,
words, word pairs), where the value is made once per distinct key of the
whole corpus. Shuffling a row per key and document costs several times the
input. Here a *block* (about ``BLOCK_BYTES`` of documents of one task) sends
one packed message to each *shard* with its distinct keys, a shard answers
every block in the same order, and the answers meet the block's documents
again in one cogroup. All shuffles are Spark's; payloads are numpy arrays.

Keys go to shards by hash and are distinct within a block, so a frequent key
costs a shard one entry per block. The number of shards follows the bytes of
the texts (:func:`parts_of`), so that a shard's work and memory stay the same
however large the input is and whatever the session's settings are.

With ``keep`` the blocks are made once and written to the shared checkpoint
folder (less work, more disk); without, they are made twice, once for the
messages and once for the documents' side. A block is named by a hash of its
content, and a block whose answers are missing raises an error, so an input
that is not read in the same order each time fails and never gives wrong
sums; pass tables read from storage.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.words import arrow
from mnemo.sources.snapshot import materialize

BLOCK_BYTES = 6_000_000
PART_BYTES = 16_000_000      # of text for each part that a task takes up whole
MESSAGE = "block string, shard int, payload binary"
_DTYPES = ["<u1", "<u2", "<u4", "<u8", "<i8", "<f4"]


def parts_of(docs: DataFrame, column: str = "text") -> int:
    """In how many parts of ``PART_BYTES`` the texts of a table are worked on."""
    size = docs.agg(F.sum(F.octet_length(column).cast("long")).alias("n")).first()["n"] or 0
    return max(1, -(-size // PART_BYTES))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays to one compressed payload, byte planes apart."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        kind = a.dtype.newbyteorder("<").str.replace("|", "<")
        head.append(struct.pack("<BQ", _DTYPES.index(kind), len(a)))
        body.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(payload: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(payload)
    at, out, kinds = 1, [], []
    for _ in range(data[0]):
        kinds.append(struct.unpack_from("<BQ", data, at))
        at += 9
    for kind, n in kinds:
        t = np.dtype(_DTYPES[kind])
        planes = np.frombuffer(data, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(t) if n else np.zeros(0, t))
        at += n * t.itemsize
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers from zero in the smallest unsigned type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def blocks(batches: Iterable[pa.RecordBatch], most: int | None = None) -> Iterator[pa.Table]:
    """Tables of about ``most`` bytes, in input order."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= (most or BLOCK_BYTES):
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def name(block: pa.Table) -> str:
    """A hash of the block's content."""
    h = xxhash.xxh3_128()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema) as w:
        w.write_table(block)
    h.update(memoryview(sink.getvalue()))
    return h.hexdigest()


def ask(docs: DataFrame, questions: Callable, answer: Callable, combine: Callable, schema, shards: int | None = None,
        block_bytes: int | None = None, keep: bool = False) -> DataFrame:
    """Rows of ``schema`` made from every block and its answers.

    ``questions(block, shards)`` gives (state, {shard: message}) for a
    table of documents. ``answer(shard, [message, ...])`` gives one reply
    per message. ``combine(state, {shard: reply})`` gives a pandas frame.
    State, messages and replies are bytes.
    """
    spark = docs.sparkSession
    arrow(spark)
    shards = shards or parts_of(docs)

    def rows(batches, what: str):
        for block in blocks(batches, block_bytes):
            state, messages = questions(block, shards)
            mine = [(-1, state)] * (what != "messages") + sorted(messages.items()) * (what != "states")
            yield pa.RecordBatch.from_arrays([pa.array([name(block)] * len(mine), pa.string()), pa.array([s for s, _ in mine], pa.int32()),
                                              pa.array([p for _, p in mine], pa.binary())], ["block", "shard", "payload"])

    def reply(pdf):
        import pandas as pd

        replies = answer(int(pdf["shard"].iloc[0]), list(pdf["payload"]))
        out = pd.DataFrame({"block": pdf["block"].values, "shard": pdf["shard"].values, "payload": replies})
        return out.drop_duplicates("block")

    def meet(states, answers):
        import pandas as pd

        got = dict(zip(answers["shard"].tolist(), answers["payload"]))
        return pd.concat([combine(s, got) for s in states["payload"]]) if len(states) else pd.DataFrame(columns=names)

    if keep:
        both = materialize(spark, docs.mapInArrow(lambda it: rows(it, "both"), MESSAGE), "blocks")
        messages, states = both.where("shard >= 0"), both.where("shard < 0")
    else:
        messages = docs.mapInArrow(lambda it: rows(it, "messages"), MESSAGE)
        states = docs.mapInArrow(lambda it: rows(it, "states"), MESSAGE)
    answers = messages.groupBy("shard").applyInPandas(reply, MESSAGE)
    names = schema.fieldNames()
    return states.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(meet, schema)
