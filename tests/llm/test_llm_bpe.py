import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import ODD_TEXTS, documents, empty

from mnemo.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    c = byte_bpe.Codec(PATH, public_tokenizers.PATTERN)
    return c, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.transducer.ranks, special_tokens={})


def _ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(text=st.one_of(st.text(max_size=80), st.text(alphabet="aehint =-_\n.é漢🙂", max_size=120)))
def test_encodes_as_the_library(both, text):
    codec, library = both
    assert _ids(codec, text) == library.encode_ordinary(text)
    assert b"".join(codec.decode(codec.encode(text))) == text.encode()


def test_awkward_texts_and_restarts(both, monkeypatch):
    codec, library = both
    monkeypatch.setattr(byte_bpe, "STATES", 50)
    monkeypatch.setattr(byte_bpe, "WORDS", 5)
    for text in filter(None, ODD_TEXTS):
        assert _ids(codec, text) == library.encode_ordinary(text)


def test_pairs_are_stable_as_plain_merging_says(both):
    t = both[0].transducer
    rnd = random.Random(5)
    ids = sorted(t.word)
    for _ in range(3000):
        u, v = rnd.choice(ids), rnd.choice(ids)
        pair = [t.word[u], t.word[v]]
        assert t.stable(u, v) == (t.merged(b"".join(pair)) == pair)


def test_streaming_decode_of_any_portions(both):
    codec, _ = both
    text = "naïve 日本語🙂 text " * 30
    ids = np.frombuffer(codec.encode(text), "<u4")
    rnd = random.Random(2)
    out, at = [], 0
    while at < len(ids):
        n = rnd.randint(1, 4)
        out.append(codec.decoder.feed(ids[at: at + n]))
        out[-1].decode()      # whole code points only
        at += n
    assert b"".join(out) + codec.decoder.finish() == text.encode()
    broken = [i for i, w in codec.transducer.word.items() if w == b"\xe3"]
    assert codec.decoder.feed(np.array(broken)) == b"" and codec.decoder.finish().decode() == "�"


def test_round_trip_rows(spark, both):
    codec, library = both
    docs = documents(spark)
    rows = byte_bpe.round_trip(docs, PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(rows) == docs.count()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rows:
        ids = library.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids == ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert byte_bpe.round_trip(empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(data=st.lists(st.one_of(st.binary(max_size=6), st.text(max_size=4).map(str.encode), st.sampled_from(
    [b"\xf0\x9f", b"\x99\x82", b"\xe0\x80", b"\xed\xa0\x80", b"\xf4\x90", b"\xc0", b"\xe6\x97"])), max_size=12), cuts=st.lists(st.integers(1, 3)))
def test_any_split_of_any_bytes_decodes_as_the_library(both, data, cuts):
    """Words of one byte, and real words, in portions of any size."""
    codec, library = both
    ids = [i for part in data for i in (library.encode_ordinary(part.decode()) if len(part) % 2 and _is_utf8(part) else [codec.transducer.ranks[bytes((b,))] for b in part])]
    decoder, out, at = byte_bpe.StreamDecoder.__new__(byte_bpe.StreamDecoder), [], 0
    decoder.__dict__.update(codec.decoder.__dict__, state=byte_bpe.START, pending=b"")
    cuts = [*cuts, *[5] * len(ids)]
    while at < len(ids):
        n = cuts.pop(0)
        out.append(decoder.feed(np.array(ids[at: at + n], dtype=np.int64)))
        out[-1].decode()        # whole code points only
        at += n
    out.append(decoder.finish())
    whole = b"".join(codec.words[i] for i in ids)
    assert b"".join(out) == whole.decode("utf-8", "replace").encode()


def _is_utf8(part):
    try:
        part.decode()
        return True
    except UnicodeDecodeError:
        return False


def test_effect_of_every_word_on_every_state(both):
    """The kept rows equal the machine run byte by byte."""
    decoder = both[0].decoder
    rnd = random.Random(1)
    odd = np.flatnonzero(~decoder.whole).tolist()
    for i in odd + rnd.sample(range(len(decoder.words)), 2000):
        for state in range(8):
            now = state
            for byte in decoder.words[i]:
                now = byte_bpe._UTF8[now, byte]
            assert decoder.after[state, i] == now
