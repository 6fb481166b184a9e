"""The registered queries of this subpackage: each applies one operator to its whole table.

The operators keep interfaces of their own; what a query returns beyond that
(counts, digests) is derived here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common, decontamination, embedding_dedup, html_extraction, language_id, line_dedup, lm_scoring, mixing, ngram_join, pii, token_output


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.read(spark, sf_dir, "documents")
    return token_output.token_output(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_html_extraction": html_extraction.query,
    "op3_embedding_dedup": embedding_dedup.query,
    "embedding_dedup_stretched": embedding_dedup.query_stretched,
    "op4_language_id": language_id.query,
    "op5_lm_scoring": lm_scoring.query,
    "op6_line_dedup": line_dedup.query,
    "op7_pii": pii.query,
    "op8_ngram_join": ngram_join.query,
    "op9_decontamination": decontamination.query,
    "op10_mixing": mixing.query,
}

ORACLES: dict[str, str] = {
    "op3_embedding_dedup": embedding_dedup.ORACLE,
    "embedding_dedup_stretched": embedding_dedup.ORACLE_STRETCHED,
    "op6_line_dedup": line_dedup.ORACLE,
    "op8_ngram_join": ngram_join.ORACLE,
    "op9_decontamination": decontamination.ORACLE,
}
