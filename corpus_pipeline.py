"""The training-data pipeline: documents to mixed, packed token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; run() writes every stage's rows as Parquet and reads them
again for the next.  All stages but the last return the columns that they were
given, whatever their names beside doc_id, text, lang and source.  Null, empty and
very long texts, null ids, repeated rows and empty tables are handled as each
operator says: language ID rejects texts without letters, so those leave first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logmill.llm import common, decontamination, language_id, mixing, ngram_join, token_output


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID doesn't reject; it learns from the labelled ones."""
    return language_id.known(docs, language_id.learn(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.dedup(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontamination.clean(docs, common.read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the shards of packed ids hold, by document."""
    import public_tokenizers

    return token_output.token_output(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("language_id", known_language),
    ("ngram_join", one_of_near_copies),
    ("decontamination", clean_of_benchmark),
    ("mixing", mixed),
    ("token_output", packed),
]

#: Training, hashing and tokenising aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of sf_dir."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
