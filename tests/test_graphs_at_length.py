"""Graph operators on shapes that break plain loops, and evidence on long texts, against plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from bibloom.functions import spans
from bibloom.operators import evidence, overlap, pagerank, paths, traverse


def components_of(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components_by_contraction(spark, shape, monkeypatch):
    rng = random.Random(4)
    name = lambda i: f"P{i:05d}"
    pairs = {
        "chain": [(name(i), name(i + 1)) for i in range(4095)],
        "star": [(name(999), name(i)) for i in range(500)] + [("lone", "lone")],
        "random": [(name(rng.randrange(900)), name(rng.randrange(900))) for _ in range(500)],
    }[shape]
    rounds = []
    kept = traverse.written
    monkeypatch.setattr(traverse, "written", lambda df: rounds.append(df.columns) or kept(df))
    got = {r["paper_id"]: r["component"] for r in traverse.components(spark.createDataFrame(pairs, "source string, target string")).collect()}
    assert got == components_of(pairs)
    assert sum(c == ["paper_id", "root"] for c in rounds) <= 14  # a round each; a chain of 4,096 papers needs about log3 of them


def test_components_of_seeds(spark):
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("x", "y")], "source string, target string")
    seeds = spark.createDataFrame([("c",), ("y",), ("alone",), ("c",)], "seed_id string")
    assert sorted(map(tuple, traverse.component_summary(seeds, edges).collect())) == [("alone", 1, "alone"), ("c", 3, "a"), ("y", 2, "x")]
    assert sorted(map(tuple, traverse.seed_component(seeds, edges).collect())) == [("alone", "alone"), ("c", "a"), ("c", "b"), ("c", "c"), ("y", "x"), ("y", "y")]


def test_best_paths_are_those_of_the_whole_list_and_few_are_made(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f"n{i}", f"n{j}", None if rng.random() < 0.05 else rng.random(), rng.choice([0.2, 0.5, 0.9, 1.0])) for i in range(40) for j in rng.sample(range(40), 9) if i != j]
    edges = spark.createDataFrame(rows, "source string, target string, weight double, confidence double")
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(6)] + [("nowhere",)], "seed_id string")
    every = paths.simple_paths(seeds, edges, 4)
    want = paths.rank_paths(every)
    made = []
    kept = paths.written

    def counted(df):
        table = kept(df)
        if "prod_c" in df.columns:
            made.append(table.count())
        return table

    monkeypatch.setattr(paths, "written", counted)
    got = paths.best_paths(seeds, edges, 4).select(*want.columns)
    plain = lambda df: sorted((r["seed_id"], r["rank"], r["path"], r["path_length"], round(r["average_confidence"], 9), r["score"]) for r in df.collect())
    assert plain(got) == plain(want)
    assert sum(made) * 10 < every.count()


def test_graphs_leave_the_ranking_loop_as_they_converge(spark):
    chain = [("slow", f"s{i}", f"s{i + 1}", 1.0) for i in range(20)] + [("slow", "s20", "s0", 1.0), ("slow", "s5", "s12", 0.5)]
    rows = chain + [("fast", "a", "b", 1.0), ("fast", "b", "a", 1.0)]
    vertices = sorted({(g, v) for g, s, t, _ in rows for v in (s, t)}) + [("lonely", "only")]
    v, e = spark.createDataFrame(vertices, "graph string, id string"), spark.createDataFrame(rows, "graph string, source string, target string, weight double")
    got = {(r["graph"], r["id"]): r["pagerank"] for r in pagerank.pagerank(v, e).collect()}
    assert set(got) == set(vertices)
    for graph in ("slow", "fast", "lonely"):
        ids = [i for g, i in vertices if g == graph]
        links = [(s, t, w) for g, s, t, w in rows if g == graph]
        out = {s: sum(w for a, _, w in links if a == s) for s in ids}
        r = dict.fromkeys(ids, 1 / len(ids))
        for _ in range(100):
            loose = sum(r[i] for i in ids if not out[i])
            fresh = {i: 0.85 * (sum(r[s] * w / out[s] for s, t, w in links if t == i) + loose / len(ids)) + 0.15 / len(ids) for i in ids}
            change, r = sum(abs(fresh[i] - r[i]) for i in ids), fresh
            if change < len(ids) * 1e-6:
                break
        assert all(math.isclose(got[graph, i], r[i], abs_tol=1e-12) for i in ids)


def test_overlap_of_texts_is_the_overlap_of_grams(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(words[:2]) for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.randrange(3, 60))) for i in range(30)] + [(99, None), (98, "")], "k long, text string")
    marks = spark.createDataFrame([(i, text(12)) for i in range(10)], "m long, text string")
    a = overlap.overlap(overlap.grams(docs, "k", "text"), overlap.grams(marks, "m", "text"), "k")
    b = overlap.text_overlap(docs, marks, "k", "m")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and b.filter("shared > 0").count() > 3


def test_matches_of_a_text_with_thousands_of_them(spark):
    text = " ".join(f"N = {i}," for i in range(3000))
    got = spark.createDataFrame([(text,), (None,), ("none",)], "t string").select(F.expr(spans.matches("t", r"N = (\d+)")).alias("m")).collect()
    ends = list(itertools.accumulate(len(f"N = {i},") + 1 for i in range(3000)))
    starts = [0, *ends[:-1]]
    assert [(m["start"], m["end"], m["number"], m["number_start"]) for m in got[0]["m"]] == [(s, s + len(f"N = {i}"), str(i), s + 4) for i, s in enumerate(starts)]
    assert not got[1]["m"] and got[2]["m"] == []


def test_own_patterns_and_resolution_in_a_row(spark):
    texts = [("a", "methods", "We saw 12 rats. We saw 40 rats in 2019; 5% died."), ("b", "abstract", "A total of 500 patients were randomized. We screened 800 participants."), ("c", "abstract", None), ("d", "x", "nothing")]
    df = spark.createDataFrame(texts, "paper_id string, section string, text string")
    rats = [evidence.Pattern(r"\b(N)\s+rats\b", "RATS", 0.5), evidence.Pattern(r"it's (N)", "QUOTED", 0.5)]
    assert [(r["value"], r["semantic_type"], r["start_char"]) for r in evidence.candidates(df, rats).orderBy("sentence_no").collect()] == [(12, "RATS", 7), (40, "RATS", 7)]
    assert evidence.candidates(spark.createDataFrame([("e", "s", "so it's 7 now")], df.schema), rats).first()["value"] == 7
    want = evidence.resolve(evidence.candidates(df), df.select("paper_id"))
    got = df.select("paper_id", evidence.resolve_in_row().alias("r")).select("paper_id", "r.*")
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
