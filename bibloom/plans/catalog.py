"""Registered queries of the citation operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bibloom.plans import display, documents, figures, fulltext, graph, overviews, records, reports, tables, text, views

MODULES = (graph, text, records, views, fulltext, tables, figures, documents, reports, overviews, display)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.f8(spark, sf_dir)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
