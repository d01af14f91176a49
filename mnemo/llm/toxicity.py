"""Toxicity: a logistic regression that is trained to ignore which group a
sentence is about.

Features are the presence (not the number) of words and of five-byte pieces
of words with their edges, hashed; so a few hostile words weigh the same in
a short and in a long text. Training is follow-the-regularised-leader with a
strong L1 penalty, which leaves a few hundred weights that are not 0.

Counterfactuals: every labelled text that names a group (``GROUPS``) is
copied with its terms exchanged for other terms of the same kind. The model
is updated with the gradient of ``strength / 2 * (margin(text) -
margin(copy))**2`` beside that of its log loss, so a group's name cannot gain
a weight of its own from being frequent in the toxic rows, and neutral
mentions of the group are no longer taken for toxic.

A null or empty text has only the bias. Repeated rows are scored one by one,
extra columns are ignored, labels that are null are no labels, and of a
doc_id labelled twice the larger label counts. Without training rows every
score is 0.5; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.llm.features import fitted, labelled_texts, remainder
from mnemo.llm.quality_classifier import Ftrl, sigmoid
from mnemo.llm.words import arrow, hash_spans, mix, raw, runs

BITS = 20          # 2**20 buckets: a model of 4 MB whatever the input
SAMPLE = 8000      # at most about so many labelled rows are learnt from
EPOCHS = 6
SWAPS = 3          # counterfactual copies of a text that names a group
STRENGTH = 4.0     # of the penalty on score changes
THRESHOLD = 0.7    # fixed by the contract
HELD_OUT, FOLD = 3, 1      # rows whose crc32(doc_id) mod 3 is 1 are never learnt from
PIECE = 5

# Terms that name groups of people, one line for each kind and language. A
# term is exchanged for others of its line only.
GROUPS = (
    "women men", "woman man", "girls boys", "girl boy", "she he", "her his", "mothers fathers", "female male",
    "muslims christians jews hindus buddhists atheists", "muslim christian jewish hindu buddhist atheist",
    "black white asian latino arab native", "africans europeans asians americans arabs",
    "gay straight lesbian bisexual", "transgender cisgender", "immigrants refugees foreigners locals",
    "deaf blind disabled", "old young elderly", "poor rich",
    "frauen männer", "frau mann", "mädchen jungen", "muslime christen juden hindus", "muslimisch christlich jüdisch",
    "ausländer einheimische flüchtlinge einwanderer", "schwule lesben", "schwarze weiße", "gehörlose blinde behinderte", "alte junge",
    "femmes hommes", "femme homme", "filles garçons", "musulmans chrétiens juifs hindous", "musulman chrétien juif",
    "immigrés réfugiés étrangers", "noirs blancs arabes", "sourds aveugles handicapés", "vieux jeunes",
    "mujeres hombres", "mujer hombre", "niñas niños", "musulmanes cristianos judíos hindúes", "musulmán cristiano judío",
    "inmigrantes refugiados extranjeros", "negros blancos árabes", "sordos ciegos discapacitados", "viejos jóvenes",
)

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_U = np.uint64


def _lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the capital letters of Latin-1 in lower case, other bytes that
    are no letters as spaces."""
    up = (data >= 0x41) & (data <= 0x5A)
    up[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data = np.where(up, data | 0x20, data)
    return np.where(_LETTER[data], data, 0x20).astype(np.uint8)


def _features(buf: np.ndarray, off: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, document) of the words and of the pieces of words of a run."""
    bounds = off - off[0]
    data = np.insert(_lower(buf[off[0]: off[-1]]), bounds, 0x20)     # a space before every text and after the last
    bounds = bounds + np.arange(len(bounds))
    doc = np.searchsorted(bounds, np.arange(len(data)), side="right") - 1
    ink = data != 0x20
    start = np.flatnonzero(ink[1:] & ~ink[:-1]) + 1
    end = np.flatnonzero(ink[:-1] & ~ink[1:]) + 1
    shift = _U(64 - bits)
    out = [((hash_spans(data, start, end, seed=1) >> shift).astype(np.int64), doc[start])]
    n = len(data) - PIECE + 1
    if n > 0:
        inner = ink[1: n + 1] & ink[2: n + 2] & ink[3: n + 3]      # spaces only at the edges of a piece
        at = np.flatnonzero(inner)
        key = np.zeros(len(at), dtype=_U)
        for k in range(PIECE):
            key |= data[at + k].astype(_U) << _U(8 * k)
        out.append(((mix(key ^ _U(0x746F786963)) >> shift).astype(np.int64), doc[at + 1]))
    return out


def text_features(text: str | None) -> np.ndarray:
    """The distinct buckets of one text, in order; the bias comes last."""
    buf, off = raw(pa.array([text], pa.string()))
    return np.append(np.unique(np.concatenate([b for b, _ in _features(buf, off)])), 1 << BITS)


def margins(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of the distinct features of every text, and the bias."""
    buf, off = raw(texts)
    out = np.full(len(off) - 1, float(weights[-1]))
    known = weights[:-1] != 0
    for i, j in runs(off):
        found = []
        for bucket, doc in _features(buf, off[i: j + 1]):
            some = known[bucket]
            found.append(doc[some] << BITS | bucket[some])
        found = np.unique(np.concatenate(found))
        out[i:j] += np.bincount(found >> BITS, weights=weights[found & ((1 << BITS) - 1)], minlength=j - i)
    return out


def _next_terms(groups) -> dict[str, list[str]]:
    """Of each term the terms of its line that follow it, cyclically."""
    out: dict[str, list[str]] = {}
    for line in groups:
        terms = line.split()
        for i, t in enumerate(terms):
            out.setdefault(t, terms[i + 1:] + terms[:i])
    return out


def swapped(text: str | None, turn: int, groups=GROUPS) -> str | None:
    """The text with each group term (whole words, any case) exchanged for
    the ``turn``-th other term of its line; None if it names no group."""
    import re

    following = _next_terms(groups)
    named = False

    def exchange(m) -> str:
        nonlocal named
        others = following.get(m[0].lower())
        if not others:
            return m[0]
        named = True
        new = others[turn % len(others)]
        return new.upper() if m[0].isupper() and len(m[0]) > 1 else new.capitalize() if m[0][0].isupper() else new

    out = re.sub(r"[^\W\d_]+", exchange, text or "")
    return out if named else None


def counterfactuals(text: str | None, swaps: int = SWAPS, groups=GROUPS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, -1 or 1) of the features that each exchange removes or adds."""
    own, out, seen = None, [], {text}
    for turn in range(swaps):
        other = swapped(text, turn, groups)
        if other is None:
            return []
        if other in seen:
            continue
        seen.add(other)
        own = text_features(text) if own is None else own
        new = text_features(other)
        idx = np.setxor1d(own, new, assume_unique=True)
        out.append((idx, np.where(np.isin(idx, new, assume_unique=True), 1.0, -1.0)))
    return out


class Fair(Ftrl):
    """Follow-the-regularised-leader with a penalty on score changes."""

    def equalise(self, idx: np.ndarray, sign: np.ndarray, strength: float) -> None:
        """A step down the gradient of strength / 2 * (change of the margin)**2."""
        w = self.weights(idx)
        g = strength * float(w @ sign) * sign
        n = self.n[idx]
        step = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[idx] += g - step * w
        self.n[idx] = n + g * g


def learn(rows: list[tuple[np.ndarray, int, list]], strength: float = STRENGTH, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the bias last) from (buckets, label, counterfactuals)."""
    model = Fair((1 << BITS) + 1, alpha=1.0, l1=6.0, l2=0.0)
    for _ in range(epochs):
        for idx, y, others in rows:
            model.update(idx, np.ones(len(idx)), y)
            for changed, sign in others if strength else ():
                model.equalise(changed, sign, strength)
    return model.weights().astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, eligible: Column | None = None, strength: float = STRENGTH,
        groups=GROUPS) -> np.ndarray:
    """Weights learnt from a bounded sample of labelled rows and their
    counterfactual copies. Features and copies are made where the rows are;
    one task learns from them."""
    def featurise(batches):
        for b in batches:
            idx, others = [], []
            for text in b.column("text").to_pylist():
                idx.append(text_features(text).astype(np.int32).tobytes())
                others.append([(i.astype(np.int32) * np.where(s > 0, 1, -1) - (s < 0)).astype(np.int32).tobytes()
                               for i, s in counterfactuals(text, groups=groups)])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("y").cast(pa.int32()), pa.array(idx, pa.binary()),
                                              pa.array(others, pa.list_(pa.binary()))], ["key", "y", "idx", "val"])

    def train(pdf) -> bytes:
        rows = []
        for _, r in pdf.sort_values(["key", "y", "idx"], kind="stable").iterrows():
            changes = [np.frombuffer(c, np.int32) for c in r.val]      # a removed feature i is stored as -i - 1
            rows.append((np.frombuffer(r.idx, np.int32), int(r.y), [(np.where(c < 0, -c - 1, c), np.where(c < 0, -1.0, 1.0)) for c in changes]))
        return learn(rows, strength).tobytes()

    arrow(docs.sparkSession)
    features = labelled_texts(docs, labels, "toxic", sample, eligible).mapInArrow(featurise, "key long, y int, idx binary, val array<binary>")
    return np.frombuffer(fitted(features, train), np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every document."""
    arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sigmoid(margins(b.column("text"), shared.value)))], ["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("score", "double"))


def score_toxicity(docs: DataFrame, labels: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held_out = remainder(HELD_OUT) == FOLD
    scored = score(docs, fit(docs, labels, eligible=~held_out, strength=strength))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
