"""The corpus pipeline: raw documents to packed training batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parallax.llm import exact_dedup, langid, packing, secret_scan, simhash
from parallax.llm.common import materialise, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model knows."""
    return langid.keep_known(docs, langid.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest doc_id."""
    return exact_dedup.keep_first(docs, exact_dedup.fresh_index(spark))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are masked."""
    return secret_scan.redact(docs)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-budget batches within length buckets."""
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("exact dedup", exact_copies), ("SimHash near-dedup", near_copies), ("secret scans", secrets), ("packing", batches)]

#: A trained model and locality-sensitive links are not SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
