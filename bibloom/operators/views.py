"""Filters, classes and counts over the tables of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIGH, MEDIUM, LOW = 0.75, 0.45, 0.5
STATUSES = ("resolved", "ambiguous", "missing", "low_confidence", "not_applicable")
# Ordered patterns of run errors
ERRORS = (("unresolved", "(?i)no papers found to merge"), ("timeout", "(?i)timeout|timed out"), ("restart", "(?i)aborted due to server shutdown"), ("rate_limit", "(?i)rate limit"))


def confidence_level(value: Column) -> Column:
    return F.when(value.isNull(), "missing").when(value >= HIGH, "high").when(value >= MEDIUM, "medium").otherwise("low")


def error_class(error: Column) -> Column:
    """The first class whose pattern matches; none without an error."""
    out = F.when(F.coalesce(error, F.lit("")) == "", "none")
    for name, pattern in ERRORS:
        out = out.when(error.rlike(pattern), name)
    return out.otherwise("other")


def strip_markup(text: Column) -> Column:
    """Tags become spaces; white space becomes single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))


def graph_view(vertices: DataFrame, edges: DataFrame, years: tuple[int, int], hide_missing: bool, least_confidence: float, least_weight: float) -> tuple[DataFrame, DataFrame]:
    """Papers in a range of years (an unknown year passes) and the edges between them that are strong enough."""
    kept = vertices.filter(F.col("year").isNull() | F.col("year").between(*years))
    kept = kept.filter(F.col("n_eff").isNotNull()) if hide_missing else kept
    ends = kept.select("paper_id")
    strong = edges.filter((F.coalesce("confidence", F.lit(0.0)) >= least_confidence) & (F.coalesce("final_weight", F.lit(0.0)) >= least_weight))
    for side in ("source_paper_id", "target_paper_id"):
        strong = strong.join(ends.withColumnRenamed("paper_id", side), side, "left_semi")
    return kept, strong


def search(rows: DataFrame, wanted: str, columns: list[str], status: str | None = None) -> DataFrame:
    """Rows of a status with a text in any of the columns, whatever its case."""
    found = rows if status is None else rows.filter(F.col("status") == status)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(wanted.strip().lower())), F.lit(False))
    return found.filter(hit) if wanted.strip() else found


def status_counts(resolutions: DataFrame, group: str) -> DataFrame:
    """A column for each status, 0 where there is none."""
    return resolutions.groupBy(group).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def overview(vertices: DataFrame, group: str) -> DataFrame:
    """Counts and mean confidence of a group's papers (status, population_confidence)."""
    told = F.col("status").isin("resolved", "ambiguous")
    return vertices.groupBy(group).agg(
        F.count(F.lit(1)).alias("papers"), F.count_if(F.col("status") == "resolved").alias("resolved"), F.count_if(F.col("status").isin("ambiguous", "low_confidence")).alias("ambiguous"),
        F.count_if(F.col("status") == "missing").alias("missing"), F.round(F.avg(F.when(told, F.col("population_confidence"))), 9).alias("mean_confidence"),
    )


def link_confidence(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """(paper_id, confidence, low): the greatest confidence of a paper's own references; null without any."""
    best = edges.groupBy(F.col("source_paper_id").alias("paper_id")).agg(F.max("confidence").alias("confidence"))
    return papers.select("paper_id").join(best, "paper_id", "left").withColumn("low", F.coalesce(F.col("confidence") < LOW, F.lit(False)))


def markdown_cell(value: Column) -> Column:
    """Text safe in a table cell: pipes escaped, white space collapsed."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " "))


def report_lines(papers: DataFrame, n: int = 20) -> DataFrame:
    """(section, seq, line) of a report: the summary, then the papers with the largest studies."""
    summary = papers.agg(F.count(F.lit(1)).alias("n"), F.count("n_eff").alias("sized")).select(F.lit("summary").alias("section"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("Papers: "), "n", F.lit(", with a study size: "), "sized").alias("line"))
    largest = papers.filter("n_eff is not null").orderBy(F.col("n_eff").desc(), "paper_id").limit(n)
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", markdown_cell(F.col("title")), F.coalesce(F.col("year").cast("string"), F.lit("")), F.col("n_eff").cast("string")), F.lit(" |"))
    order = Window.orderBy(F.col("n_eff").desc(), "paper_id")  # n rows
    return summary.unionByName(largest.select(F.lit("largest").alias("section"), F.row_number().over(order).cast("long").alias("seq"), cells.alias("line")))
