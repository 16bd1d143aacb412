"""The corpus pipeline: quality rules, exact and near deduplication, mixing, tokenisation.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the documents of the next one. All but the last return the columns of
documents. Every stage takes all rows that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framelens.llm import byte_bpe, exact_dedup, mixing, ngram_join, quality
from framelens.llm.common import stored

#: The vocabulary of the last stage.
RANKS = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, so do null and empty texts (no words); equal rows stay or go together."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of all documents with the same text but for white space stays: the most code points, then the smallest doc_id (null first); of equal rows one."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays; texts without words and null ids stay."""
    return ngram_join.keep_one_of_each(docs, n=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources (null is one) weigh their number of documents to the power 0.7; a document may be left out or repeated."""
    return mixing.resample(docs, power=0.7)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded bytes of each row; a null text counts as empty."""
    return byte_bpe.encode_and_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality rules", quality_rules), ("exact copies", exact_copies), ("near copies", near_copies), ("mixture", mixture), ("tokens", tokens)]

#: The near-duplicate and tokenisation stages can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
