from collections import Counter

import public_tokenizers
import tiktoken
from conftest import SF001
from llm_cases import documents, empty

import corpus_pipeline
from mnemo.llm import byte_bpe, mixing, quality_classifier, quality_rules, simhash
from mnemo.llm.features import remainder


def test_run_equals_the_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    verdict = {r.doc_id: r.kept for r in quality_rules.rule_verdicts(docs, labels).collect()}
    good = {r.doc_id: r.predicted for r in quality_classifier.score_quality(docs, labels).collect()}
    left = [i for i in text if verdict[i] and good[i]]
    prints = {i: simhash.fingerprint(text[i].encode()) for i in left}
    group = {i: i for i in left}
    changed = True
    while changed:
        changed = False
        for a in left:
            for b in left:
                if a < b and group[a] != group[b] and bin(prints[a] ^ prints[b]).count("1") <= 2:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    heads = docs.where(docs.doc_id.isin(sorted(set(group.values()))))
    copies = {r.doc_id: r.taken // r.size if r.size else 1 for r in mixing.mixture(heads).collect()}
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.run(spark, SF001).collect()
    assert Counter(r.doc_id for r in got) == Counter({i: n for i, n in copies.items() if n})
    assert all(r.ids == library.encode_ordinary(text[r.doc_id]) for r in got)


def test_stages_keep_columns_and_stand_odd_rows(spark):
    assert len(corpus_pipeline.STAGES) == 5
    for docs in (documents(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF001)
            assert out.columns == docs.columns and out.count() <= 3 * docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF001).count() == docs.count()
    assert remainder(5) is not None
