"""The registered PageRank queries that run to convergence, against a loop."""

import numpy as np
from pyspark.sql import functions as F

from bibloom.plans import catalog, graph
from bibloom.sources.recipes import table

from .conftest import SF


def ranks(ids, edges):
    at = {v: i for i, v in enumerate(ids)}
    n, m = len(ids), np.zeros((len(ids), len(ids)))
    for s, t, w in edges:
        m[at[t], at[s]] += w
    total = m.sum(axis=0)
    r = np.full(n, 1 / n)
    for step in range(1, 101):
        old, r = r, 0.85 * (m / np.where(total, total, 1) @ r + r[total == 0].sum() / n) + 0.15 / n
        if np.abs(r - old).sum() < n * 1e-12:
            break
    return dict(zip(ids, r, strict=True))


def test_ranks_have_converged(spark):
    ids = sorted(r[0] for r in table(spark, SF, "papers").select("paper_id").collect())
    edges = [(r["source"], r["target"], r["weight"]) for r in graph.plain_edges(spark, SF).collect()]
    want = ranks(ids, edges)
    got = {r["paper_id"]: r["pagerank"] for r in catalog.queries()["f7_pagerank_whole"](spark, SF).collect()}
    assert got.keys() == want.keys() and sum(abs(got[k] - want[k]) for k in ids) < len(ids) * 1e-5


def test_each_registered_rank_query_runs_to_convergence(spark, monkeypatch):
    seen = []

    def told(vertices, edges, *limits):
        seen.append(limits)
        return vertices.select("graph", "id", F.lit(0.1).alias("pagerank"))

    monkeypatch.setattr(graph.pr, "pagerank", told)
    for name in ("f7_pagerank", "f8_foundational", "f9_variants", "f10_rank_correlation"):
        catalog.queries()[f"{name}_whole"](spark, SF)
    assert seen == [(100, 1e-6)] * 4
