"""A training-data pipeline over ``documents``: each stage works on all that its predecessor kept.

Each stage but the last returns the columns of its documents, whatever further ones there are and
whatever their names. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanwright.llm import bpe, decontaminate, minhash, pii, toxicity
from spanwright.llm.common import table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not reject; it learns from the labels of the given tables.

    Texts without words, null ones too, have the share of toxic labels as their score. Equal rows
    have equal scores, so all of them stay or go.
    """
    return toxicity.accepted(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least id.

    Texts without words, null ones too, are no duplicates of each other; of rows of one id and text
    one stays.
    """
    return minhash.deduplicated(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item; null texts and repeated rows stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets in their texts masked; null texts and repeated rows stay."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and the digest of the text that they decode to.

    A row for each document: ``doc_id, ids, n_tokens, ids_sha256, decoded_sha256``, no other columns;
    null texts have no tokens.
    """
    return bpe.digests(bpe.encode_documents(docs), "ids")


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", not_in_benchmark),
    ("personal_data", masked),
    ("bpe", encoded),
]
#: No SQL twin: a trained network and a tokenizer are among the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
