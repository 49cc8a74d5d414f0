import itertools

import numpy as np
from pyspark.sql import functions as F

from bibloom.llm import packing, sharding

from . import cases


def test_optimal_boundaries_against_all_choices():
    rng = np.random.default_rng(0)
    for _ in range(40):
        counts = rng.integers(0, 6, 12)
        lengths = np.nonzero(counts)[0].tolist()
        for buckets in (1, 2, 3, 4):
            got = packing.optimal_boundaries(counts, buckets)
            cost = lambda bounds: sum(counts[x] * (min(b for b in bounds if b >= x) - x) for x in lengths)
            if not lengths:
                assert got == []
                continue
            k = min(buckets, len(lengths))
            best = min(cost(c) for c in itertools.combinations(lengths, k) if c[-1] == lengths[-1])
            assert cost(got) == best and len(got) == k and got[-1] == lengths[-1]


def test_packing_keeps_every_token_and_fills_batches(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(cases.documents(spark, extra=False).withColumn("doc_id", F.col("doc_id") + 10_000))
    rows = packing.pack(docs, max_tokens=300, buckets=5, budget=2000).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    import re

    words = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in texts.items()}
    held = {}
    for r in rows:
        held.setdefault(r["doc_id"], []).append(r)
        assert 0 <= r["n_tokens"] <= r["bucket_tokens"] and r["padding"] == r["bucket_tokens"] - r["n_tokens"]
    assert held.keys() == words.keys()
    for k, parts in held.items():
        parts.sort(key=lambda r: r["seq"])
        assert sum(r["n_tokens"] for r in parts) == words[k] and [r["first_token"] for r in parts] == [300 * i for i in range(len(parts))]
    batches = {}
    for r in rows:
        batches.setdefault((r["bucket_tokens"], r["batch"]), []).append(r["slot"])
    for (bucket, batch), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * bucket <= 2000
        if (bucket, batch + 1) in batches:
            assert len(slots) == 2000 // bucket
    assert len({b for b, _ in batches}) == 5
    again = packing.pack(docs.repartition(9), max_tokens=300, buckets=5, budget=2000).collect()
    assert sorted(rows) == sorted(again)


def test_packing_of_awkward_tables(spark):
    docs = cases.documents(spark)
    assert packing.pack(docs.limit(0)).count() == 0
    assert {r["doc_id"] for r in packing.pack(docs).collect()} == set(range(len(cases.TEXTS)))
    only = packing.pack(cases.documents(spark, [None, "", " "])).collect()
    assert [r["n_tokens"] for r in only] == [0, 0, 0]
    rows = cases.documents(spark, ["a b", "a b", None])
    same = rows.withColumn("doc_id", F.lit(None).cast("long"))
    assert packing.pack(same).count() == 3


def test_packing_spreads_repeated_rows(spark):
    text = F.when(F.col("id") % 3 == 0, F.lit("a b c")).otherwise(F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")))
    docs = spark.range(3000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("doc_id"), text.alias("text"))
    held = packing.counted(packing.sequences(docs))
    copies = [(r["first_copy"], r["copies"]) for r in held.filter("id is null").collect()]
    assert sorted(copies) == [(i, min(packing.COPIES, 1000 - i)) for i in range(0, 1000, packing.COPIES)]
    rows = packing.pack(docs, max_tokens=8, buckets=3, budget=24).collect()
    assert len(rows) == 3000 and sum(r["doc_id"] is None for r in rows) == 1000
    places = {(r["bucket_tokens"], r["batch"], r["slot"]) for r in rows}
    assert len(places) == 3000
    mixed = [r for r in rows if r["bucket_tokens"] == 3 or (r["bucket_tokens"] > 3 and r["n_tokens"] == 3)]
    whose = {}
    for r in mixed:
        whose.setdefault(r["batch"], set()).add(r["doc_id"] is None)
    # copies of one row stand among the others, not in one stretch
    assert sum(kinds == {True, False} for kinds in whose.values()) > len(whose) / 3
    again = packing.pack(docs.repartition(7), max_tokens=8, buckets=3, budget=24).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_fisher_yates_is_a_uniform_permutation():
    counts = {}
    for seed in range(6000):
        p = tuple(sharding.fisher_yates(3, seed).tolist())
        counts[p] = counts.get(p, 0) + 1
    assert len(counts) == 6 and all(850 < c < 1150 for c in counts.values())
    assert sharding.fisher_yates(0, 1).tolist() == [] and sharding.fisher_yates(1, 1).tolist() == [0]


def test_shards_hold_every_record_once(spark, sf_dir, tmp_path):
    docs = cases.documents(spark)
    docs = docs.unionByName(docs)  # repeated rows
    dealt = sharding.deal_shards(sharding.shuffle_records(docs), 5).collect()
    assert sorted(r["position"] for r in dealt) == list(range(2 * len(cases.TEXTS)))
    assert sorted((r["doc_id"], r["text"] or "") for r in dealt) == sorted((i, t or "") for i, t in enumerate(cases.TEXTS) for _ in range(2))
    sizes = [sum(r["shard"] == s for r in dealt) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(5):
        assert sorted(r["slot"] for r in dealt if r["shard"] == s) == list(range(sizes[s]))
    assert sharding.shuffle_records(docs.limit(0)).count() == 0
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = {r["doc_id"]: r["position"] for r in sharding.shuffle_records(real, min_buckets=8).collect()}
    again = {r["doc_id"]: r["position"] for r in sharding.shuffle_records(real.repartition(6), min_buckets=8).collect()}
    other = {r["doc_id"]: r["position"] for r in sharding.shuffle_records(real, seed=18, min_buckets=8).collect()}
    assert first == again and first != other
    ids = sorted(first)
    assert abs(np.corrcoef(ids, [first[i] for i in ids])[0, 1]) < 0.25
    sharding.write_shards(sharding.deal_shards(sharding.shuffle_records(real), 4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == real.count()
