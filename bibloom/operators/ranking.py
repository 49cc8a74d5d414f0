"""Foundational papers and rankings compared."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def foundational_scores(vertices: DataFrame, ranks: DataFrame, as_of_year: int) -> DataFrame:
    """Every paper of a seed's graph but the seed: influence, age, evidence and the combined score.

    vertices: seed_id, paper_id, title, year, n_eff, population_confidence; ranks: seed_id, paper_id, pagerank.
    """
    base = vertices.join(ranks, ["seed_id", "paper_id"]).filter("paper_id <> seed_id")
    tops = base.groupBy("seed_id").agg(F.max("pagerank").alias("top"))
    influence = F.col("pagerank") / F.when(F.col("top") == 0, 1.0).otherwise(F.col("top"))
    age = F.when(F.coalesce("year", F.lit(0)) == 0, 0.5).otherwise(F.least(F.lit(1.0), (F.lit(as_of_year) - F.col("year")) / 20.0))
    trust = F.coalesce(F.nullif(F.col("population_confidence"), F.lit(0.0)), F.lit(0.5))
    evidence = F.log1p(F.coalesce("n_eff", F.lit(0))) / math.log1p(100_000) * trust
    scored = base.join(tops, "seed_id").withColumns({"influence": influence, "age": age, "evidence": evidence}).drop("top")
    return scored.withColumn("score", 0.5 * F.col("influence") + 0.3 * F.col("age") + 0.2 * F.col("evidence"))


def top_by(scored: DataFrame, group: str, score: Column, tie: str, n: int) -> DataFrame:
    """The n best rows of each group with their rank from 1; ties by ``tie``."""
    order = Window.partitionBy(group).orderBy(score.desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def variants(scored: DataFrame) -> DataFrame:
    """(seed_id, paper_id, variant, score): six ways to weigh the same parts."""
    parts = {
        "combined": "score",
        "influence_only": "influence",
        "age_only": "age",
        "evidence_only": "evidence",
        "no_influence": "0.3D * age + 0.2D * evidence",
        "raw_pagerank": "0.5D * pagerank + 0.3D * age + 0.2D * evidence",
    }
    listed = ", ".join(f"'{k}', {v}" for k, v in parts.items())
    return scored.selectExpr("seed_id", "paper_id", f"stack({len(parts)}, {listed}) AS (variant, score)")


def rank_correlation(ranked: DataFrame, group: list[str], left: str, right: str) -> DataFrame:
    """Spearman's coefficient of two rank columns: 1 - 6 sum(d^2) / (n (n^2 - 1)); null below two rows."""
    d = F.col(left) - F.col(right)
    n = F.count(F.lit(1))
    return ranked.groupBy(*group).agg((1 - F.try_divide(6.0 * F.sum(d * d), (n * (n * n - 1)).cast("double"))).alias("rho"), n.alias("n"))
