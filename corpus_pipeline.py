"""A training-data pipeline over the documents table.

Each stage gets (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. The quality models of the
first two stages learn from the labelled rows of the whole documents table,
so that the second is not left with the few poor texts that the first lets
through; both judge every row of their own input. An empty table gives an empty result
at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mnemo.llm import byte_bpe, mixing, quality_classifier, quality_rules, simhash
from mnemo.llm.features import remainder
from mnemo.sources.snapshot import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that pass the base rules and the calibrated rule model. Rows keep
    their columns; null and empty texts go, repeated rows are judged alike."""
    weights = quality_rules.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, weights)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the quality classifier predicts to be good. Rows keep their
    columns; a null text is judged as an empty one, repeated rows alike."""
    weights = quality_classifier.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"),
                                     eligible=remainder(quality_classifier.HELD_OUT) != 0)
    return quality_classifier.keep_good(docs, weights)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each SimHash group: one row, with its columns. Of
    rows that are equal in doc_id and text one stays; null and empty texts are
    one group."""
    return simhash.keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix, with their columns; a document that is taken twice
    is there twice, one without words once. A null source is a source."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with the digests of the ids and of their decoding.
    One row per row; a null text has no ids. Other columns do not go on."""
    # smaller tables than by default: executors still hold memory of the stages before
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True,
                               most_words=120_000, most_states=50_000)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("simhash", near_duplicates), ("mixing", mixture), ("byte_bpe", tokens)]

# SQL cannot train the models or link the fingerprints; tests/llm compares
# run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
