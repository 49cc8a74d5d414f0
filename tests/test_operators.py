import numpy as np
import pytest
from pyspark.sql import functions as F

from bibloom.functions import ids
from bibloom.operators import evaluate, evidence, overlap, pagerank, paths, ranking, traverse
from bibloom.sources import exports, records


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_query_types(spark):
    values = ["10.4321/Lantern77", "doi:10.4321/y", "https://doi.org/10.4321/y", "www.harbour.example/b", "PMCID: PMC555001", "PMID: 20202020", "W700700", "10.9876", " ", None]
    assert one(spark, ids.query_type, *values) == ["doi", "doi", "url", "url", "pmcid", "pmid", "doi", "title", "title", "title"]


def test_view_suffixes(spark):
    values = ["10.4321/river.77.12/full", "10.4321/12/34", "10.4321/(vol)7-8(2001/02)5:6", "10.1/full", "10.1/x/abs/PDF", None]
    assert one(spark, ids.strip_view, *values) == ["10.4321/river.77.12", *values[1:4], "10.1/x", None]


@pytest.mark.parametrize(
    "text,values",
    [
        ("A total of 6,120 patients were randomized across the sites.", {6120}),
        ("The sample size was N=318 participants.", {318}),
        ("Records of 1407 patients from 61 clinics were read through March 3, 2019.", {1407}),
        ("A total of 730 patients were enrolled; 55.5% were smokers.", {730}),
        ("the first 612 confirmed cases", {612}),
        ("We screened 940 participants that spring.", {940}),
        ("2019 patients and 5 mg doses", set()),
        ("", set()),
    ],
)
def test_population_candidates(spark, text, values):
    df = spark.createDataFrame([("p", "body", text), ("q", "body", None)], "paper_id string, section string, text string")
    found = evidence.candidates(df).collect()
    assert {r["value"] for r in found} == values
    for r in found:
        assert text[r["start_char"] : r["end_char"]] == r["raw_text"]


def test_dataset_counts(spark):
    cases = {
        "a": ("We trained the tagger on 2.5 million sentence pairs. It has 70 million weights.", ("resolved", "training_examples", 2_500_000)),
        "b": ("The tagger has 70 million weights.", ("missing", None, None)),
        "c": ("We trained on 30,000 images. Another training dataset holds 90,000 images.", ("ambiguous", None, 90_000)),
        "d": ("We trained on 70,000 examples and tested on 6,000 examples.", ("resolved", "training_examples", 70_000)),
    }
    df = spark.createDataFrame([(k, "abstract", t) for k, (t, _) in cases.items()], "paper_id string, section string, text string")
    got = {r["paper_id"]: r for r in evidence.resolve_datasets(evidence.dataset_counts(df), df).collect()}
    for k, (_, (status, kind, value)) in cases.items():
        assert (got[k]["status"], got[k]["value"]) == (status, value) and (kind is None or got[k]["kind"] == kind)


def test_pagerank_against_a_loop(spark):
    rng = np.random.default_rng(0)
    n, edges = 30, {(int(a), int(b)) for a, b in rng.integers(0, 28, (120, 2)) if a != b}
    w = {e: float(rng.random() + 0.1) for e in edges}
    v = spark.createDataFrame([("g", str(i)) for i in range(n)], "graph string, id string")
    e = spark.createDataFrame([("g", str(a), str(b), x) for (a, b), x in w.items()], "graph string, source string, target string, weight double")
    got = {r["id"]: r["pagerank"] for r in pagerank.pagerank(v, e, tolerance=1e-9).collect()}
    r = np.full(n, 1 / n)
    m = np.zeros((n, n))
    for (a, b), x in w.items():
        m[b, a] = x
    total = m.sum(axis=0)
    for _ in range(200):
        r = 0.85 * (m / np.where(total, total, 1) @ r + r[total == 0].sum() / n) + 0.15 / n
    assert max(abs(got[str(i)] - r[i]) for i in range(n)) < 1e-6


def test_heavier_edges_rank_higher(spark):
    papers = [f"c{i}" for i in range(20)] + ["heavy", "light", "seed"]
    v = spark.createDataFrame([("seed", p) for p in papers], "graph string, id string")
    e = spark.createDataFrame([("seed", f"c{i}", t, x) for i in range(20) for t, x in (("heavy", 0.9), ("light", 0.1))], "graph string, source string, target string, weight double")
    ranks = pagerank.pagerank(v, e).select(F.col("graph").alias("seed_id"), F.col("id").alias("paper_id"), "pagerank")
    vertices = spark.createDataFrame([("seed", p, p, 2020, None, None) for p in papers], "seed_id string, paper_id string, title string, year int, n_eff int, population_confidence double")
    best = ranking.top_by(ranking.foundational_scores(vertices, ranks, 2026), "seed_id", F.col("score"), "paper_id", 3).orderBy("rank").collect()
    assert best[0]["paper_id"] == "heavy" and best[0]["influence"] == 1.0 and "seed" not in {r["paper_id"] for r in best}


def test_simple_paths(spark):
    edges = spark.createDataFrame([("a", "b", 0.8, 0.9), ("b", "c", 0.7, 0.8), ("c", "a", 1.0, 1.0), ("a", "c", 0.1, 0.5)], "source string, target string, weight double, confidence double")
    found = paths.simple_paths(spark.createDataFrame([("a",)], "seed_id string"), edges, 4)
    got = {r["path"]: r for r in paths.rank_paths(found).collect()}
    assert set(got) == {"a>b", "a>b>c", "a>c"}
    assert abs(got["a>b>c"]["score"] - 0.75 * 0.72 / 3**0.5) < 1e-9 and abs(got["a>b>c"]["average_confidence"] - 0.85) < 1e-9


def walk(seed, edges, backward, forward, most):
    """The traversal rule for one seed, one paper at a time."""
    budget = max(most - 1, 0)
    share = {"backward": budget if forward <= 0 else 0 if backward <= 0 else budget - int(budget * 0.35)}
    share["forward"] = budget - share["backward"]
    depth_of, known, spent, front = {"backward": backward, "forward": forward}, [seed], {"backward": 0, "forward": 0}, {"backward": [seed], "forward": [seed]}
    for depth in range(max(backward, forward)):
        for way, other in (("backward", "forward"), ("forward", "backward")):
            if depth >= depth_of[way] or not front[way]:
                front[way] = []
                continue
            waits = bool(front[other]) and depth < depth_of[other]
            room = min(share[way] - spent[way], most - len(known)) if waits else most - len(known)
            at, to = (0, 1) if way == "backward" else (1, 0)
            near = {}
            for e in edges:
                if e[at] in front[way] and e[to] not in known:
                    near[e[to]] = min(e[2], near.get(e[to], 1 << 60))
            fresh = [p for p, _ in sorted(near.items(), key=lambda x: (x[1], x[0]))][: max(0, room)]
            known += fresh
            spent[way] += len(fresh)
            front[way] = fresh
    return known


@pytest.mark.parametrize("backward,forward,most", [(2, 1, 12), (1, 0, 5), (0, 2, 9), (2, 2, 40), (3, 1, 1)])
def test_traversal_against_one_seed_at_a_time(spark, backward, forward, most):
    rng = np.random.default_rng(backward * 7 + most)
    edges = [(f"p{a:02}", f"p{b:02}", i) for i, (a, b) in enumerate(rng.integers(0, 40, (120, 2))) if a != b]
    seeds = ["p00", "p07", "p33"]
    df = spark.createDataFrame(edges, "source string, target string, seq long")
    got = {}
    for r in traverse.traverse(spark.createDataFrame([(s,) for s in seeds], "seed_id string"), df, backward, forward, most).collect():
        got.setdefault(r["seed_id"], []).append((r["place"], r["paper_id"]))
    for s in seeds:
        assert [p for _, p in sorted(got[s])] == walk(s, edges, backward, forward, most)


def test_shared_passages_against_the_sequential_rule(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abc"), 60)) for _ in range(8)]
    marks = [" ".join(rng.choice(list("abc"), 40)) for _ in range(6)]
    t = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    m = spark.createDataFrame(list(enumerate(marks)), "k int, text string")
    for width in (3, 4):
        held = {tuple(x.split()[i : i + width]) for x in marks for i in range(len(x.split()) - width + 1)}
        want = set()
        for k, x in enumerate(texts):
            words, i = x.split(), 0
            while i <= len(words) - width:
                if tuple(words[i : i + width]) in held:
                    end = i + width
                    while end < len(words) and tuple(words[end - width + 1 : end + 1]) in held:
                        end += 1
                    want.add((k, i, end - i))
                    i = end
                else:
                    i += 1
        got = overlap.passages(overlap.grams(t, "k", "text", width), overlap.grams(m, "k", "text", width), "k", width)
        assert {tuple(r) for r in got.collect()} == want


def test_rates_without_cases_are_null(spark):
    none = evaluate.detection_scores(spark.createDataFrame([], "gold int, predicted int")).first().asDict()
    assert none["tp"] == 0 and all(none[k] is None for k in ("precision", "recall", "specificity", "f1", "accuracy"))
    low, high = evaluate.wilson(F.lit(6), F.lit(10))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert abs(r["l"] - 0.31267) < 1e-5 and abs(r["h"] - 0.831822) < 1e-5
    low, _ = evaluate.wilson(F.lit(0), F.lit(0))
    assert spark.range(1).select(low).first()[0] is None


def test_title_similarity(spark):
    df = spark.createDataFrame([("A b, C", "c B a"), ("a", None), (None, None), ("Maps Of The Old Town", "New Maps Of The Old Town In Ink")], "l string, r string")
    assert [round(r[0], 3) for r in df.select(evaluate.title_similarity(F.col("l"), F.col("r"))).collect()] == [1.0, 0.0, 1.0, 0.625]


def test_inverted_index_and_domains(spark):
    df = spark.createDataFrame([({"Old": [0], "maps": [2], "town": [1]},), ({},), (None,)], "m map<string,array<int>>")
    assert [r[0] for r in df.select(records.abstract_of(F.col("m"))).collect()] == ["Old town maps", None, None]
    d = spark.createDataFrame([("A quantum thing", None, "Computer Science", None), (None, None, "Physics", "Physical Sciences"), (None, None, None, None)], "t string, o string, f string, d string")
    assert [r[0] for r in d.select(records.research_domain(*map(F.col, "tofd"))).collect()] == ["nonclinical", "nonclinical", "unknown"]


def test_csv_survives_quotes_and_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([('Tides, "high" and low\non two lines', 'Acts of "Tides", part 3'), ("x", "")], "title string, journal string")
    exports.write_csv(df.coalesce(1), str(tmp_path / "c"))
    back = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "c"))
    assert {r["title"] for r in back.collect()} == {'Tides, "high" and low\non two lines', "x"}


def test_author_names(spark):
    assert one(spark, exports.split_author, "Ada B. Lovelace", "Lovelace, Ada", "Plato", " ", None) == ["Lovelace, Ada B.", "Lovelace, Ada", "Plato", None, None]
