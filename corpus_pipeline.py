"""From raw documents to packed training batches, in five stages.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it
kept. The first four return the columns of documents: the quality classifier drops the
documents it rejects, exact deduplication keeps one row of equal texts, near-deduplication
one document of each component, and the secret scan masks what it finds and keeps every
row. The last one returns a row for each packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bibloom.llm import common, exact_dedup, near_dedup, packing, quality, secret_scan

#: SQL can express neither the classifier nor the dynamic programme; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, common.labels(spark, sf_dir))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def secret_scanning(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_deduplication),
    ("minhash_near_dedup", near_deduplication),
    ("secret_scan", secret_scanning),
    ("packing", length_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are a table in the shared folder before the next one reads them."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
