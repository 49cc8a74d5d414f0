"""Edge weights from the evidence of the cited paper."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA, BETA, REFERENCE = 0.75, 0.25, 100_000
JOURNAL = 0.5


#: Seeds of these domains have no study sizes, and their rankings take none
UNSIZED = ("computer_science", "nonclinical")


def weight_edges(edges: DataFrame, resolutions: DataFrame, applies: Column | None = None) -> DataFrame:
    """Adds n_score, journal_score, base_weight, final_weight.

    Confidence scales the population term only; a target without a resolution row counts
    with confidence 0.5, one with a missing value with its own confidence. Where ``applies``,
    a condition on edges, doesn't hold, every target counts as one without a resolution.
    """
    res = resolutions.select(F.col("paper_id").alias("resolved_id"), "n_eff", F.col("confidence").alias("pop_confidence"), F.lit(True).alias("known"))
    met = F.col("target_paper_id") == F.col("resolved_id")
    joined = edges.join(res, met if applies is None else met & applies, "left").drop("resolved_id")
    score = F.least(F.greatest(F.log1p(F.coalesce("n_eff", F.lit(0))) / math.log1p(REFERENCE), F.lit(0.0)), F.lit(1.0))
    trust = F.when(F.col("known"), F.col("pop_confidence")).otherwise(F.lit(0.5))
    out = joined.withColumns({"n_score": score, "journal_score": F.lit(JOURNAL)})
    return out.withColumns({
        "base_weight": ALPHA * F.col("n_score") + BETA * JOURNAL,
        "final_weight": (ALPHA * F.col("n_score") * trust + BETA * JOURNAL) * F.col("confidence"),
    }).drop("n_eff", "pop_confidence", "known")


def weight_seed_edges(edges: DataFrame, resolutions: DataFrame, seeds: DataFrame) -> DataFrame:
    """weight_edges of many seeds' edges (seed_id, ...) at once; seeds (seed_id, research_domain) outside medicine ignore all resolutions."""
    told = edges.join(seeds.select("seed_id", (~F.coalesce(F.col("research_domain").isin(*UNSIZED), F.lit(False))).alias("sized")), "seed_id")
    return weight_edges(told, resolutions, F.col("sized"))


def build_vertices(papers: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Papers with their study size and its confidence, null where there is none."""
    res = resolutions.select("paper_id", "n_eff", F.col("confidence").alias("population_confidence"), "status")
    return papers.join(res, "paper_id", "left")


def graph_vertices(papers: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Vertices with the attributes of a graph: three authors at most, confidence 0 without a resolution."""
    line = F.concat(F.array_join(F.slice("authors", 1, 3), ", "), F.when(F.size("authors") > 3, "...").otherwise(""))
    wide = build_vertices(papers, resolutions)
    return wide.select("paper_id", "title", "year", line.alias("authors"), "journal", "n_eff", F.coalesce("population_confidence", F.lit(0.0)).alias("population_confidence"), "research_domain", F.lit("paper").alias("type"))


def graph_edges(edges: DataFrame) -> DataFrame:
    """Edges (source_paper_id, target_paper_id, relation, confidence, final_weight, providers, seq) as a graph holds them: the last of a pair stays; a null weight is 1.0, a weight of 0.0 is kept."""
    last = edges.groupBy("source_paper_id", "target_paper_id").agg(F.max_by(F.struct("relation", "confidence", "final_weight", "providers"), "seq").alias("last"))
    return last.select(
        F.col("source_paper_id").alias("source"), F.col("target_paper_id").alias("target"), "last.relation", "last.confidence",
        F.coalesce("last.final_weight", F.lit(1.0)).alias("weight"), F.array_join("last.providers", ",").alias("providers"),
    )
