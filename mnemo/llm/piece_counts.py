"""Token counts without ids: pieces are counted once per distinct pre-token.

A pre-token is a run of spaces with the characters up to the next space, as
no piece of the model has a space after another character; each is therefore
encoded on its own. Every block of documents keeps the frequency of each
pre-token in each document and asks the shards for the pieces of its distinct
pre-tokens; a shard encodes each distinct pre-token of the corpus once. A
document's count is the sum of frequency times pieces.

A null or empty text has no tokens. Repeated rows are counted one by one, a
null doc_id stays null, extra columns are ignored, an empty table gives no
rows. ``model`` is a sentencepiece file that
every executor can read (installed with the workers).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.exchange import ask, narrow, pack, unpack

LIMIT = 4096        # fixed by the contract
SPACE = "▁"    # how the model writes a space
_PIECE = re.compile(" +[^ ]*")


@lru_cache(maxsize=2)
def processor(model: str):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    late = [p.id_to_piece(i) for i in range(p.get_piece_size()) if SPACE in p.id_to_piece(i).lstrip(SPACE)]
    marked = p.encode(" x", out_type=str)[0].startswith(SPACE * 2)
    if late or not (marked or p.encode(" x", out_type=str)[:2] == [SPACE, SPACE + "x"]):
        raise ValueError("this model joins or drops spaces; its texts cannot be cut at spaces")
    return p


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first space (which the
    model adds to whatever it is given)."""
    return [p[1:] for p in _PIECE.findall(" " + text.replace(SPACE, " "))] if text else []


def pieces(model: str, distinct: list[str]) -> np.ndarray:
    """Pieces of each pre-token. A lone space is one piece."""
    ids = processor(model).encode(distinct, num_threads=1)
    return np.array([len(i) if t else 1 for t, i in zip(distinct, ids)], dtype=np.int64)


def _send(keys: list[str]) -> bytes:
    data = [k.encode("utf-8", "surrogatepass") for k in keys]
    return pack(narrow(np.array([len(d) for d in data], dtype=np.int64)), np.frombuffer(b"".join(data), np.uint8))


def _received(message: bytes) -> list[str]:
    size, data = unpack(message)
    end = np.cumsum(size, dtype=np.int64)
    data = data.tobytes()
    return [data[e - n: e].decode("utf-8", "surrogatepass") for e, n in zip(end.tolist(), size.tolist())]


def _shares(block: pa.Table, shards: int) -> tuple[dict[str, int], dict[int, list[str]], list[Counter]]:
    seen: dict[str, int] = {}
    counts = []
    for text in block.column("text").to_pylist():
        c = Counter(pre_tokens(text or ""))
        counts.append(c)
        for k in c:
            if k not in seen:
                seen[k] = len(seen)
    parts: dict[int, list[str]] = {}
    for k in sorted(seen):
        parts.setdefault(zlib.crc32(k.encode("utf-8", "surrogatepass")) % shards, []).append(k)
    return seen, parts, counts


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    docs = docs.select("doc_id", "text")

    def questions(block: pa.Table, shards: int):
        seen, parts, counts = _shares(block, shards)
        # number the pre-tokens as the shards' answers will list them
        at = {k: i for i, k in enumerate(k for s in sorted(parts) for k in parts[s])}
        n, idx, freq = [], [], []
        for c in counts:
            order = sorted((at[k], f) for k, f in c.items())
            i = np.array([x for x, _ in order], dtype=np.int64)
            idx.append(np.diff(i, prepend=0))
            freq.append(np.array([f for _, f in order], dtype=np.int64))
            n.append(len(order))
        ids = block.column("doc_id")
        size = pc.fill_null(pc.binary_length(block.column("text")), 0).to_numpy().astype(np.int64)
        state = pack(pc.fill_null(ids, 0).to_numpy().astype("<i8"), ids.is_null().to_numpy().astype(np.uint8), narrow(size),
                     narrow(np.array(n, dtype=np.int64)), narrow(np.concatenate(idx)), narrow(np.concatenate(freq)))
        return state, {s: _send(keys) for s, keys in parts.items()}

    def answer(shard: int, messages: list[bytes]) -> list[bytes]:
        asked = [_received(m) for m in messages]
        distinct = sorted({k for keys in asked for k in keys})
        known = dict(zip(distinct, pieces(model, distinct).tolist()))
        return [pack(narrow(np.array([known[k] for k in keys], dtype=np.int64))) for keys in asked]

    def combine(state: bytes, replies: dict[int, bytes]):
        import pandas as pd

        ids, null, size, n, idx, freq = unpack(state)
        value = np.concatenate([unpack(replies[s])[0].astype(np.int64) for s in sorted(replies)] or [np.zeros(0, np.int64)])
        first = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        # the gaps start anew in every document
        step = np.cumsum(idx, dtype=np.int64)
        before = np.concatenate([[0], step])[first[:-1]]
        at = step - np.repeat(before, n)
        if len(at) and (not len(value) or at.max() >= len(value)):
            raise RuntimeError("the answers to a block are missing; read the documents from storage")
        total = np.concatenate([[0], np.cumsum(freq.astype(np.int64) * value[at])])
        return pd.DataFrame({"doc_id": pd.array(np.where(null, 0, ids), dtype="Int64").copy() if not null.any() else
                             pd.array([None if z else int(i) for i, z in zip(ids, null)], dtype="Int64"),
                             "n_bytes": size.astype(np.int64), "n_tokens": total[first[1:]] - total[first[:-1]]})

    schema = docs.select(F.col("doc_id").cast("long").alias("doc_id")).schema.add("n_bytes", "long").add("n_tokens", "long")
    counted = ask(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), questions, answer, combine, schema, keep=True)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
