"""Simple citation paths from seeds, and the best of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.functions.storage import forget, written


def simple_paths(seeds: DataFrame, edges: DataFrame, hops: int = 4) -> DataFrame:
    """(seed_id, path, sum_w, prod_c, sum_c): every simple path of 1 to ``hops`` edges.

    Each level is one join of the level before with the edges on its last node.
    """
    step = edges.select(F.col("source").alias("at"), F.col("target").alias("next"), F.coalesce("weight", F.lit(1.0)).alias("w"), F.coalesce("confidence", F.lit(1.0)).alias("c"))
    level = seeds.select("seed_id", F.array("seed_id").alias("path"), F.col("seed_id").alias("at"), F.lit(0.0).alias("sum_w"), F.lit(1.0).alias("prod_c"), F.lit(0.0).alias("sum_c"))
    found = None
    for _ in range(hops):
        longer = level.join(step, "at").filter(~F.array_contains("path", F.col("next")))
        level = longer.select(
            "seed_id", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("at"),
            (F.col("sum_w") + F.col("w")).alias("sum_w"), (F.col("prod_c") * F.col("c")).alias("prod_c"), (F.col("sum_c") + F.col("c")).alias("sum_c"),
        )
        found = level if found is None else found.unionByName(level)
    return found.drop("at")


def rank_paths(paths: DataFrame, top_n: int = 10) -> DataFrame:
    """The best paths of each seed: mean weight x product of confidences / sqrt(nodes)."""
    edges = F.size("path") - 1
    scored = paths.select(
        "seed_id", F.array_join("path", ">").alias("path"), edges.alias("path_length"), (F.col("sum_c") / edges).alias("average_confidence"),
        F.round(F.col("sum_w") / edges * F.col("prod_c") / F.sqrt(F.size("path").cast("double")), 9).alias("score"),
    )
    order = Window.partitionBy("seed_id").orderBy(F.col("score").desc(), "path")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)


def _score(sum_w: Column, prod_c: Column, edges: Column | int) -> Column:
    n = F.lit(edges) if isinstance(edges, int) else edges
    return sum_w / n * prod_c / F.sqrt((n + 1).cast("double"))


def best_paths(seeds: DataFrame, edges: DataFrame, hops: int = 4, top_n: int = 10) -> DataFrame:
    """The rows of rank_paths(simple_paths(...)), by branch and bound.

    After each level every seed knows its ``top_n``-th best score so far. A path of k edges whose weights sum to s
    and whose confidences multiply to c scores at most (s + (m - k) W) / m * c C^(m - k) / sqrt(m + 1) when it
    grows to m edges, with W and C the greatest weight and confidence that any edge has (weights and confidences
    are not negative). Paths that cannot reach their seed's score with any m are not grown; the paths of the last
    level are kept only where they reach it. Ties stay, as their order is by path.
    """
    step = written(edges.select(F.col("source").alias("at"), F.col("target").alias("next"), F.coalesce("weight", F.lit(1.0)).alias("w"), F.coalesce("confidence", F.lit(1.0)).alias("c")))
    top = step.agg(F.max("w").alias("w"), F.max("c").alias("c")).first()
    most_w, most_c = top["w"] or 0.0, top["c"] or 0.0
    # what the best edge out of a node can give at once
    ahead = written(step.groupBy("at").agg(F.max("w").alias("next_w"), F.max("c").alias("next_c")))
    level = seeds.select("seed_id", F.array("seed_id").alias("path"), F.col("seed_id").alias("at"), F.lit(0.0).alias("sum_w"), F.lit(1.0).alias("prod_c"), F.lit(0.0).alias("sum_c"))
    best, tables = None, []
    for k in range(1, hops + 1):
        longer = level.join(step, "at").filter(~F.array_contains("path", F.col("next")))
        grown = longer.select(
            "seed_id", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("at"),
            (F.col("sum_w") + F.col("w")).alias("sum_w"), (F.col("prod_c") * F.col("c")).alias("prod_c"), (F.col("sum_c") + F.col("c")).alias("sum_c"), *(["least"] if k > 1 else []),
        )
        if k > 1:
            reaches = F.round(_score(F.col("sum_w"), F.col("prod_c"), k), 9) >= F.coalesce("least", F.lit(float("-inf")))
            grown = (grown.filter(reaches) if k == hops else grown).drop("least")
        grown = written(grown)
        tables.append(grown)
        ranked = rank_paths(grown.select("seed_id", "path", "sum_w", "prod_c", "sum_c"), top_n)
        if best is not None:
            order = Window.partitionBy("seed_id").orderBy(F.col("score").desc(), "path")
            both = best.unionByName(ranked).drop("rank")
            ranked = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
        best = written(ranked)
        if k < hops:
            least = best.filter(F.col("rank") == top_n).select("seed_id", F.col("score").alias("least"))
            level = grown.join(least, "seed_id", "left").join(ahead, "at")
            first = lambda m: (F.col("sum_w") + F.col("next_w") + (m - k - 1) * most_w, F.col("prod_c") * F.col("next_c") * most_c ** (m - k - 1))  # noqa: B023, E731
            bound = [_score(*first(m), m) for m in range(k + 1, hops + 1)]
            highest = F.greatest(*bound) if len(bound) > 1 else bound[0]
            level = level.filter(F.col("least").isNull() | (highest + 1e-9 >= F.col("least"))).drop("next_w", "next_c")
    forget(step, ahead, *tables)
    return best
