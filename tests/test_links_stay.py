"""PageRank over more links than one bucket holds: the links are dealt out once."""

from pyspark.sql import functions as F

from bibloom.operators import pagerank as pr


def test_steps_do_not_move_links(spark, monkeypatch):
    edges = spark.range(3000).select((F.col("id") % 3).cast("string").alias("graph"), F.concat(F.lit("p"), F.col("id") * 7 % 101).alias("source"), F.concat(F.lit("p"), F.col("id") * 13 % 97).alias("target"), (F.col("id") % 5).cast("double").alias("weight"))
    vertices = spark.range(303).select((F.col("id") % 3).cast("string").alias("graph"), F.concat(F.lit("p"), (F.col("id") / 3).cast("int")).alias("id"))
    want = {(r["graph"], r["id"]): r["pagerank"] for r in pr.pagerank(vertices, edges).collect()}
    plans = []
    held = pr.written

    def told(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return held(df)

    monkeypatch.setattr(pr, "BUCKET", 500, raising=False)
    monkeypatch.setattr(pr, "written", told)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r["graph"], r["id"]): r["pagerank"] for r in pr.pagerank(vertices, edges).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12
    steps = [p for p in plans if "gain" in p and "target" in p]
    assert steps
    for plan in steps:  # what stands right above the scan of links is no exchange
        lines = plan.splitlines()
        at = next(i for i, line in enumerate(lines) if "FileScan" in line and "target" in line)
        above = [line for line in reversed(lines[:at])]
        first = next(line for line in above if "Exchange" in line or "Join" in line)
        assert "Join" in first, plan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("links_")]
