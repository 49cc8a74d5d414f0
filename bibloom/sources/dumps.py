"""Bulk dumps of the providers: JSON lines read with a declared schema.

A declared schema needs no pass over the files to infer one, prunes the many fields that no
operator reads, and makes a missing or null object a null column. Lines that are no JSON
come back whole in ``CORRUPT``; a line of which only some field has another type than
declared keeps its other fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.sources import records

CORRUPT = "_corrupt_record"
#: Schema, and the field without which a line is no record
PROVIDERS = {"openalex": (records.OPENALEX, "id"), "crossref": (records.CROSSREF, "DOI"), "europe_pmc": (records.EUROPE_PMC, "id")}


def read_lines(spark: SparkSession, path: str | list[str], provider: str) -> DataFrame:
    """Every line of a dump (plain or compressed JSON lines), broken ones included, with CORRUPT as the last column."""
    schema = f"{PROVIDERS[provider][0]}, {CORRUPT} STRING"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def _broken(lines: DataFrame) -> DataFrame:
    empty = F.lit(True)
    for c in lines.columns:
        if c != CORRUPT:
            empty = empty & F.col(f"`{c}`").isNull()
    return lines.withColumn("broken", F.col(CORRUPT).isNotNull() & empty)


def read_works(spark: SparkSession, path: str | list[str], provider: str) -> DataFrame:
    """The records of a dump in the provider's own columns; lines of which nothing could be read are left to ``rejected``."""
    return _broken(read_lines(spark, path, provider)).filter("not broken").drop("broken", CORRUPT)


def rejected(spark: SparkSession, path: str | list[str], provider: str) -> DataFrame:
    """(provider, lines, broken, partial): how many lines a dump has, how many are no JSON, and how many lost a field."""
    found = _broken(read_lines(spark, path, provider)).select("broken", F.col(CORRUPT).isNotNull().alias("odd"))
    return found.agg(F.lit(provider).alias("provider"), F.count(F.lit(1)).alias("lines"), F.count_if("broken").alias("broken"), F.count_if(F.col("odd") & ~F.col("broken")).alias("partial"))


def write_works(works: DataFrame, path: str) -> None:
    """Records as JSON lines with explicit nulls, as the providers write them."""
    works.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in works.columns]), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def papers(spark: SparkSession, path: str | list[str], provider: str) -> DataFrame:
    mapped = {"openalex": records.openalex_papers, "crossref": records.crossref_papers, "europe_pmc": records.europe_pmc_papers}
    return mapped[provider](read_works(spark, path, provider))


def references(spark: SparkSession, path: str | list[str], provider: str) -> DataFrame:
    mapped = {"openalex": records.openalex_references, "crossref": records.crossref_references}
    return mapped[provider](read_works(spark, path, provider))
