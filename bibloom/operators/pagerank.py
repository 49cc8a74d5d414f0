"""Weighted PageRank of many graphs at once, as a loop of joins."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bibloom.functions.storage import forget, shared_folder, written

DAMPING = 0.85
#: Links a bucket of the link table, and the number of links up to which it is a plain table
BUCKET = 1 << 20


def pagerank(
    vertices: DataFrame, edges: DataFrame, iterations: int = 100, tolerance: float | None = 1e-6,
    damping: float = DAMPING,
) -> DataFrame:
    """(graph, id, pagerank): uniform teleport, dangling mass spread uniformly over its graph.

    vertices: graph, id; edges: graph, source, target, weight. A graph is done when its summed
    change is below n * tolerance; it leaves the loop then, and the loop ends with the last one
    or after ``iterations`` steps. tolerance None runs all iterations. What a hot target gains is
    summed on the map side before the shuffle. Each step's ranks are a table, and the one before goes.
    Links are dealt out by their source once, into buckets, so a step moves ranks and gains only.
    """
    weighted = written(edges.select("graph", "source", "target", "weight"))
    n = math.ceil(weighted.count() / BUCKET)
    dealt = weighted.repartition(n, "graph", "source") if n > 1 else weighted
    whole = F.sum("weight").over(Window.partitionBy("graph", "source"))
    share = dealt.withColumn("total", whole).filter("total > 0").select("graph", "source", "target", (F.col("weight") / F.col("total")).alias("p"))
    share, bucketed = _bucketed(share, n) if n > 1 else (written(share), None)
    total = share.select("graph", "source").distinct()
    once = vertices.select("graph", "id").distinct()
    sizes = once.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    linked = total.select("graph", F.col("source").alias("id"), F.lit(True).alias("linked"))
    ranks = written(once.join(linked, ["graph", "id"], "left").join(sizes, "graph").withColumn("pagerank", 1.0 / F.col("n")).withColumn("old", F.lit(None).cast("double")))
    forget(weighted)
    live, done = ranks, []
    for step in range(1, iterations + 1):
        loose = live.filter("linked is null").groupBy("graph").agg(F.sum("pagerank").alias("loose"))
        gained = (
            share.join(live.select("graph", F.col("id").alias("source"), "pagerank"), ["graph", "source"])
            .groupBy("graph", F.col("target").alias("id"))
            .agg(F.sum(F.col("p") * F.col("pagerank")).alias("gain"))
        )
        joined = live.drop("old").withColumnRenamed("pagerank", "old").join(gained, ["graph", "id"], "left").join(loose, "graph", "left")
        zero = F.lit(0.0)
        value = damping * (F.coalesce("gain", zero) + F.coalesce("loose", zero) / F.col("n")) + (1 - damping) / F.col("n")
        fresh = written(joined.select("graph", "id", "linked", "n", value.alias("pagerank"), "old"))
        if not done:
            forget(ranks)  # else finished graphs are still read from it
        ranks = live = fresh
        if tolerance is None:
            continue
        moved = fresh.groupBy("graph", "n").agg(F.sum(F.abs(F.col("pagerank") - F.col("old"))).alias("change"))
        moved = moved.select("graph", (F.col("change") >= F.col("n") * tolerance).alias("open"))
        told = moved.groupBy("open").count().collect()
        if not any(r["open"] for r in told):
            break
        if len(told) > 1:
            still = written(moved.filter("open").select("graph"))
            done.append(fresh.join(still, "graph", "left_anti"))
            live = fresh.join(still, "graph", "left_semi")
    forget(share)
    if bucketed:
        share.sparkSession.sql(f"DROP TABLE {bucketed}")
    found = live.select("graph", "id", "pagerank")
    for part in done:
        found = found.unionByName(part.select("graph", "id", "pagerank"))
    return found


def _bucketed(links: DataFrame, n: int) -> tuple[DataFrame, str]:
    """Links as a table of n buckets by graph and source in the shared folder, and its name."""
    name = f"links_{uuid.uuid4().hex}"
    path = f"{shared_folder(links.sparkSession)}/table-{uuid.uuid4().hex}"
    links.write.bucketBy(n, "graph", "source").sortBy("graph", "source").option("path", path).saveAsTable(name)
    return links.sparkSession.table(name), name
