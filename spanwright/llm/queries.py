"""The queries of the training-data operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanwright.llm import bpe, decontaminate, divergence, fingerprint, html, licences, merkle, minhash, pii, score, shards, toxicity, twins, urls
from spanwright.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "keep")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.scored(table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(table(spark, sf_dir, "documents"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assigned(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op 3 that SQL can express."""
    return op3_urls(spark, sf_dir).select("page_id", "host", "path", "rule")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op 7 that SQL can express."""
    return op7_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_urls": op3_urls,
    "op4_html": op4_html,
    "op5_fingerprints": op5_fingerprints,
    "op6_bpe": op6_bpe,
    "op7_pii": op7_pii,
    "op8_licences": op8_licences,
    "op9_decontamination": op9_decontamination,
    "op10_lm_score": op10_lm_score,
    "op11_manifest": op11_manifest,
    "op12_shards": op12_shards,
    "op13_divergence": op13_divergence,
    "url_rules": url_rules,
    "pii_base": pii_base,
}

#: The other queries have models or formats that SQL can't express; tests hold them against plain versions.
SQL: dict[str, str] = {
    "op2_near_duplicates": twins.NEAR_DUPLICATES,
    "op9_decontamination": twins.DECONTAMINATION,
    "op11_manifest": twins.MANIFEST,
    "op13_divergence": twins.DIVERGENCE,
    "url_rules": twins.URL_RULES,
    "pii_base": twins.PII_BASE,
}
