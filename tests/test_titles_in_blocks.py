"""Titles matched inside blocks, equal ones compared once."""

from pyspark.sql import functions as F

from bibloom.operators import evaluate, tables
from bibloom.plans import text

from .conftest import SF


def test_titles_meet_in_their_block_only(spark):
    wanted = [("a", 1, "red fox"), ("b", 2, "red fox"), ("a", 3, ""), ("b", 4, None), ("a", 5, "blue"), (None, 6, "red fox"), ("a", 7, "red fox")]
    held = [("a", 10, "red fox den", 5), ("a", 11, "red fox den", 9), ("a", 12, "Red den fox", 9), ("b", 13, "red hen", 1), ("a", 14, "...", 0), ("b", 15, "", 2), (None, 16, "red fox", 7)]
    frames = spark.createDataFrame(wanted, "g string, id long, title string"), spark.createDataFrame(held, "g string, candidate long, title string, cited long")
    got = {r["id"]: (r["candidate"], r["score"]) for r in tables.best_titles(*frames, block=("g",)).collect()}
    assert got == {1: (11, 0.666666667), 7: (11, 0.666666667)}


def test_copies_of_a_title_are_compared_once(spark, tmp_path, monkeypatch):
    n = 200
    part = spark.range(n).select(
        F.col("id").alias("p_partkey"), F.lit("red ring").alias("p_name"), F.lit("B").alias("p_brand"), F.lit("RING").alias("p_type"),
        F.lit(1).alias("p_size"), F.col("id").cast("double").alias("p_retailprice"),
    )
    part.write.parquet(f"{tmp_path}/part.parquet")
    compared = spark.sparkContext.accumulator(0)

    def told(left, right):
        def alike(a, b):
            compared.add(1)
            a, b = set(a.lower().split()), set(b.lower().split())
            return len(a & b) / len(a | b)

        return F.udf(alike, "double")(left, right)

    for module in (evaluate, tables):
        monkeypatch.setattr(module, "title_similarity", told)
    got = text.c8(spark, str(tmp_path)).collect()
    assert len(got) == n and {r["candidate"] for r in got} == {n - 1} and {r["score"] for r in got} == {1.0}
    assert compared.value < n


def test_the_query_agrees_with_every_pair(spark):
    p = spark.read.parquet(f"{SF}/part.parquet").collect()
    words = lambda t: set("".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split())
    want = {}
    for x in p:
        if x["p_size"] == 1:
            every = [(y, words(x["p_name"]), words(y["p_name"] + " " + y["p_type"])) for y in p if (y["p_brand"], y["p_type"]) == (x["p_brand"], x["p_type"])]
            near = [(round(len(a & b) / len(a | b), 3), int(y["p_retailprice"]), -y["p_partkey"]) for y, a, b in every if len(a & b) >= 0.6 * len(a | b)]
            if near:
                want[x["p_partkey"]] = -max(near)[2]
    assert {r["id"]: r["candidate"] for r in text.c8(spark, SF).collect()} == want
