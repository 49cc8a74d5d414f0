import random
import re

import numpy as np
from pyspark.sql import functions as F

from bibloom.llm import exact_dedup, near_dedup, shingles

from . import cases


def decisions(texts):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    return {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}


def test_exact_groups(spark):
    docs = cases.documents(spark)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs.repartition(7)).collect()}
    assert got == decisions(cases.TEXTS)


def test_a_weak_digest_still_compares_content(spark):
    weak = lambda c: F.pmod(F.length(c), F.lit(2)).cast("string")
    docs = cases.documents(spark, ["a", "b", "a", "cc", None, "", "dd", "cc"] * 3)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs.repartition(5), digest=weak).collect()}
    assert got == decisions(["a", "b", "a", "cc", None, "", "dd", "cc"] * 3)


def test_deduplicate_keeps_columns_and_one_row(spark):
    docs = cases.documents(spark)
    docs = docs.unionByName(docs)  # repeated rows
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, d in decisions(cases.TEXTS).items() if d[2])
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


def shingle(text, width):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    k = min(width, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(texts, width, percent=80):
    sets = [shingle(t, width) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def copies(seed=3):
    """Near copies, chains of them, a large group, texts with a common passage, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    out = []
    passage = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 6)):
            out.append(" ".join(base))
            for _ in range(rng.randint(1, 3)):
                base[rng.randrange(len(base))] = word()
    crowd = [word() for _ in range(150)]
    for _ in range(120):
        other = list(crowd)
        other[rng.randrange(150)] = word()
        out.append(" ".join(other))
    for _ in range(60):  # variants about as far from the crowd as a link allows
        other = list(crowd)
        for at in rng.sample(range(150), rng.randint(3, 9)):
            other[at] = word()
        out.append(" ".join(other))
        if rng.random() < 0.3:
            other[rng.randrange(150)] = word()
            out.append(" ".join(other))
    out += [" ".join([word() for _ in range(40)] + passage + [word() for _ in range(30)]) for _ in range(40)]
    out += ["one", "One", "one two", "one\ttwo", "one two three four", "one two three four five", "", None, "  \n"]
    rng.shuffle(out)
    return out


def test_near_components_against_brute_force(spark):
    width, texts = 5, copies()
    docs = cases.documents(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_components(docs.repartition(5), width).collect()}
    assert got == brute(texts, width)


def test_near_components_of_awkward_rows(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_components(cases.documents(spark), 4).collect()}
    assert got == brute(cases.TEXTS, 4)
    docs = cases.documents(spark)
    kept = near_dedup.deduplicate(docs, 4)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, v in got.items() if v[2])
    assert near_dedup.near_components(docs.limit(0)).count() == 0


def test_large_buckets_are_compared_by_rare_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "FAN", 2)
    texts = copies(8)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_components(cases.documents(spark, texts), 4).collect()}
    assert got == brute(texts, 4)


def test_posterior_bounds_rise_and_rarely_lose_a_pair():
    bounds = shingles.least_matches(240, 40, 0.8, 1e-6)
    assert list(bounds) == sorted(bounds) and bounds[-1] < 0.8 * 240
    rng = np.random.default_rng(1)
    matches = np.cumsum(rng.random((20_000, 240)) < 0.8, axis=1)[:, 39::40]
    assert (matches < np.array(bounds)).any(axis=1).mean() < 1e-3


def test_components_of_a_long_chain(spark):
    links = spark.range(60).selectExpr("lpad(id, 3, '0') AS u", "lpad(id + 1, 3, '0') AS v").union(spark.createDataFrame([("x1", "x2")], "u string, v string"))
    got = {r["node"]: r["label"] for r in near_dedup.components(links).collect()}
    assert got == {f"{i:03}": "000" for i in range(61)} | {"x1": "x1", "x2": "x1"}
