"""Queries around seeds derive the edges once and leave them where they are."""

import pytest
from pyspark.sql import functions as F

from bibloom.operators import traverse
from bibloom.plans import catalog, documents, graph

from .conftest import SF


@pytest.mark.parametrize("name", ["f1_traverse", "f4_seed_component", "f8_foundational", "a12_walk_documents"])
def test_edges_are_derived_once(spark, monkeypatch, name):
    asked = []

    def told(real):
        def table(session, sf_dir, wanted):
            asked.append(wanted)
            return real(session, sf_dir, wanted)

        return table

    monkeypatch.setattr(graph, "table", told(graph.table))
    monkeypatch.setattr(documents, "table", told(documents.table))
    assert catalog.queries()[name](spark, SF).count() > 0
    assert asked.count("edges") == 1 and "seeds" not in asked and asked.count("resolutions") <= 1


def test_a_walk_sends_its_frontier_to_the_edges(spark, monkeypatch):
    edges = spark.range(2000).select(F.concat(F.lit("p"), F.col("id") % 50).alias("source"), F.concat(F.lit("p"), "id").alias("target"), F.col("id").alias("seq"))
    edges = traverse.written(edges.filter("source <> target"))
    seen = []

    def kept(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return held(df)

    held = traverse.written
    monkeypatch.setattr(traverse, "written", kept)
    monkeypatch.setattr(traverse, "cut", kept, raising=False)
    seeds = spark.createDataFrame([("p1",), ("p2",)], "seed_id string")
    assert traverse.traverse(seeds, edges, 2, 1, 100).count() > 2
    levels = [p for p in seen if "least(" in p or "row_number" in p]
    assert levels and all("BroadcastHashJoin [at" in p for p in levels)


def test_components_hold_each_link_once(spark, monkeypatch):
    pairs = [(f"a{i}", f"a{i + 1}") for i in range(30)] + [(f"a{i + 1}", f"a{i}") for i in range(30)] + [("b", "c"), ("c", "b"), ("d", "d")]
    sizes = []
    held = traverse.written

    def told(df):
        out = held(df)
        if df.columns == ["u", "v"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(traverse, "written", told)
    got = {r["paper_id"]: r["component"] for r in traverse.components(spark.createDataFrame(pairs, "source string, target string")).collect()}
    assert got == {**{f"a{i}": "a0" for i in range(31)}, "b": "b", "c": "b", "d": "d"}
    assert sizes[0] == 31
