import public_tokenizers
import sentencepiece
from conftest import SF001
from llm_cases import ODD_TEXTS, documents, empty

from mnemo.llm import exchange, piece_counts, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 1000)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = documents(spark)
    got = piece_counts.token_counts(docs, MODEL, limit=20).collect()
    assert len(got) == docs.count()
    for r in got:
        text = "no id at all here" if r.doc_id is None else ODD_TEXTS[r.doc_id] or ""
        n = len(library.encode(text))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text.encode()), n > 20)
    assert piece_counts.token_counts(empty(spark), MODEL).count() == 0


def test_whole_table(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = queries.op4_token_counts(spark, SF001).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(library.encode(t)) for i, t in text.items()}


def test_packed_arrays():
    import numpy as np

    for arrays in ([np.zeros(0, "<u4")], [np.arange(300, dtype="<u2"), np.array([-5, 1 << 60], "<i8"), np.array([1 << 63], "<u8")]):
        out = exchange.unpack(exchange.pack(*arrays))
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, out, strict=True))
