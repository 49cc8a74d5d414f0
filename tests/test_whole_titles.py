"""The title match takes every part, against the titles of all."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from bibloom.operators import tables
from bibloom.plans import catalog

from .conftest import SF

WORDS = lambda t: set("".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split())


def test_the_title_match_leaves_out_no_part_and_no_title(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").collect()
    got = catalog.queries()["c8_title_match"](spark, SF).collect()
    want = {}
    for x in parts:
        shares = [(y, len(WORDS(x["p_name"]) & (b := WORDS(y["p_name"] + " " + y["p_type"]))) / len(WORDS(x["p_name"]) | b)) for y in parts]
        near = [(round(s, 3), int(y["p_retailprice"]), -y["p_partkey"], round(s, 9)) for y, s in shares if s >= 0.6]
        if near:
            want[x["p_partkey"]] = -max(near)[2], max(near)[3]
    assert {r["id"]: (r["candidate"], r["score"]) for r in got} == want and len(got) == len(want)
    assert {p["p_size"] for p in parts if p["p_partkey"] in want} == {p["p_size"] for p in parts}


def test_any_size_meets_titles_of_another_brand_and_type(spark, tmp_path):
    rows = [(1, "red ring", "A", "LARGE", 7, 5.0), (2, "red ring", "B", "RING", 1, 4.0), (3, "blue rod", "A", "BLUE", 9, 1.0), (4, "old bolt gear pin", "A", "SMALL PLATED STEEL", 3, 1.0)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    part.write.parquet(f"{tmp_path}/part.parquet")
    want = {1: (2, 1.0), 2: (2, 1.0), 3: (3, 1.0)}
    assert {r["id"]: (r["candidate"], r["score"]) for r in catalog.queries()["c8_title_match"](spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert {r[0]: (r[1], r[2]) for r in con.execute(catalog.oracle_sql()["c8_title_match"]).fetchall()} == want


def test_long_titles_at_the_edge_lose_no_match(spark):
    rng = np.random.default_rng(5)
    pool = np.array([f"w{i}" for i in range(220)])
    held = [(i, " ".join(rng.choice(pool, rng.integers(1, 130), replace=False)), int(rng.integers(0, 9))) for i in range(60)]
    wanted = []
    for i, (_, title, _) in enumerate(held):
        own, n = title.split(), len(title.split())
        kept = list(rng.permutation(own))[: max(1, int(np.ceil(n * rng.uniform(0.5, 1.0))))]
        wanted.append((i, " ".join(kept + [f"x{i}_{k}" for k in range(int(rng.integers(0, 1 + n // 4)))])))
    frames = spark.createDataFrame(wanted, "id long, title string"), spark.createDataFrame(held, "candidate long, title string, cited long")
    for percent in (60, 75, 100):
        want = {}
        for i, t in wanted:
            near = [(round(len(a & b) / len(a | b), 3), cited, -c) for c, u, cited in held if 100 * len((a := WORDS(t)) & (b := WORDS(u))) >= percent * len(a | b)]
            if near:
                want[i] = -max(near)[2]
        assert {r["id"]: r["candidate"] for r in tables.best_titles(*frames, percent).collect()} == want and want


def test_titles_that_share_common_words_only_do_not_meet(spark, monkeypatch):
    n = 300
    compared = spark.sparkContext.accumulator(0)

    def told(left, right):
        def alike(a, b):
            compared.add(1)
            return len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))

        return F.udf(alike, "double")(left, right)

    monkeypatch.setattr(tables, "title_similarity", told)
    wanted = spark.range(n).select("id", F.concat(F.lit("red ring k"), "id").alias("title"))
    held = spark.range(n).select(F.col("id").alias("candidate"), F.concat(F.lit("red ring large k"), "id").alias("title"), F.lit(1).alias("cited"))
    assert {r["id"]: r["candidate"] for r in tables.best_titles(wanted, held).collect()} == {i: i for i in range(n)}
    assert compared.value <= 2 * n
