"""The corpus pipeline: quality, exact copies, near copies, personal data, packing.

Every stage takes any documents table with doc_id and text: other columns, whatever their names, pass through unchanged up
to the last stage. Empty tables give empty tables. doc_id should be distinct; a row without one is never dropped.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumatrace.llm.common import materialize, table
from lumatrace.llm.exact_dedup import keep_last_copies
from lumatrace.llm.minhash import keep_one_of_each
from lumatrace.llm.packing import pack
from lumatrace.llm.pii import surrogate_text
from lumatrace.llm.quality import keep_good
from lumatrace.llm.queries import PII_KEY
from lumatrace.llm.token_counts import count_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; null texts are scored as empty ones, equal texts alike."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id; null and empty texts are equal."""
    return keep_last_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8 or more), the one with the smallest doc_id; texts without words stay."""
    return keep_one_of_each(docs, shingle_words=5, percent=80)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by surrogates, equal ones alike everywhere; null texts stay null."""
    return surrogate_text(docs, PII_KEY)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token counts of the final texts, packed into sequences; texts without tokens have no row, longer ones several."""
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pack(counted.select("doc_id", "n_tokens"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the packing; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
