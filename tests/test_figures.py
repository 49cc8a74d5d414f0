"""Flow figures, readers, documents, walks and streams against plain Python."""

import json
import random

from pyspark.sql import functions as F

from bibloom.operators import evidence, flow, layout, review, traverse
from bibloom.plans import catalog
from bibloom.plans.figures import COUNTED, HEADED, NAMES, RAW_LINKS, _outcomes
from bibloom.sources.recipes import run

BOX = "fig_id string, region_id int, seq int, value long, x0 double, y0 double, x1 double, y1 double, stages array<string>"


def beside(counts):
    """Rows from the top: a count joins the last row if it stands beside that row's first one."""
    out = []
    for c in sorted(counts, key=lambda c: ((c["y0"] + c["y1"]) / 2, c["seq"])):
        middle, high = (c["y0"] + c["y1"]) / 2, c["y1"] - c["y0"]
        if out:
            first = out[-1][0]
            if abs((first["y0"] + first["y1"]) / 2 - middle) < 0.5 * max(first["y1"] - first["y0"], high, 1):
                out[-1].append(c)
                continue
        out.append([c])
    return out


def arms_total(row):
    once = {}
    for c in sorted(row, key=lambda c: c["seq"]):
        once.setdefault(c["region_id"], c["value"])
    numbers = list(once.values())
    return max(numbers) if len(numbers) > 2 and 2 * max(numbers) == sum(numbers) else sum(numbers)


def totals(counts):
    of = lambda stage: [c for c in counts if stage in c["stages"]]
    out = {s: arms_total(beside(of(s))[0]) if of(s) else None for s in ("screened", "enrolled", "randomised")}
    if out["randomised"] is None and of("allocated"):
        out["randomised"] = arms_total(beside(of("allocated"))[0])
    last = of("analysed")
    arms = [r for r in beside(of("allocated")) if len({c["region_id"] for c in r}) > 1]
    if arms:
        left, right = min(c["x0"] for c in arms[0]), max(c["x1"] for c in arms[0])
        last = [c for c in last if min(right, c["x1"]) > max(left, c["x0"])]
    out["analysed"] = arms_total(beside(last)[-1]) if last else None
    return out


def test_totals_of_drawn_figures(spark):
    rng, rows = random.Random(3), []
    for fig in range(60):
        spots = {r: (rng.choice([0, 100, 200, 300]), rng.choice([0, 8, 40, 80, 120])) for r in range(9)}
        for seq in range(rng.randint(0, 12)):
            r = rng.randrange(9)
            x, y = spots[r]
            stages = rng.sample(["screened", "enrolled", "randomised", "allocated", "analysed", "excluded"], rng.choice([0, 1, 1, 1, 2]))
            rows.append((f"f{fig}", r, seq, rng.choice([5, 10, 10, 20]), float(x), float(y), x + 90.0, y + 20.0, stages))
    found = {r["fig_id"]: r.asDict() for r in flow.stage_totals(spark.createDataFrame(rows, BOX)).collect()}
    assert set(found) == {r[0] for r in rows}
    names = [c.strip().split(" ")[0] for c in BOX.split(",")]
    for fig, row in found.items():
        want = totals([dict(zip(names, r)) for r in rows if r[0] == fig])
        assert {k: row[k] for k in want} == want


def test_totals_of_the_registered_query(spark, sf_dir):
    counts = flow.stages_from_layout(run(spark, sf_dir, COUNTED).withColumn("stages", layout.stages_of(F.col("text"))), run(spark, sf_dir, HEADED)).collect()
    found = {r["fig_id"]: r.asDict() for r in catalog.queries()["d20_stage_totals"](spark, sf_dir).collect()}
    groups = {}
    for c in counts:
        groups.setdefault(c["fig_id"], []).append(c)
    assert set(found) == set(groups)
    for fig, held in groups.items():
        want = totals(held)
        assert {k: found[fig][k] for k in want} == want


def test_counts_of_awkward_regions(spark):
    cases = [
        ("a", ["• Randomised (n = 1,200)", "Group A (N: 600) Group B (n=600)"]),
        ("b", ["41", "Women were screened", "7 Lost to follow-up", "in year two"]),
        ("c", ["Excluded (n = 9)", "Moved house before randomisation (n = 4)"]),
        ("d", []), ("e", [None, ""]), ("f", ["no number here", "n = none"]), ("g", ["n = " + "9" * 30 + " kept n = 3"]),
    ]
    df = spark.createDataFrame([("x", r, lines) for r, lines in cases], "fig_id string, region_id string, lines array<string>")
    found = sorted((r["region_id"], r["seq"], r["value"], r["label"], tuple(r["stages"])) for r in flow.region_counts(df).collect())
    assert found == [
        ("a", 0, 1200, "Randomised", ("randomised",)), ("a", 1, 600, "Group A", ("allocated",)), ("a", 2, 600, "Group B", ("allocated",)),
        ("b", 0, 41, " Women were screened", ("screened",)), ("b", 1, 7, "Lost to follow-up in year two", ("excluded",)),
        ("c", 0, 9, "Excluded", ("excluded",)), ("c", 1, 4, "Moved house before randomisation", ("excluded",)), ("g", 0, 3, "kept", ()),
    ]


def test_the_rule_of_readers(spark, sf_dir):
    tally = review.reader_tally(_outcomes(spark, sf_dir))
    row = tally.filter("stage = 'decisive'").first()
    others = spark.createDataFrame([("p", False), ("q", True), ("r", False)], "paper_id string, reported boolean")
    rule = review.reader_rule(tally, others).first()
    assert abs(rule["gap"] - 100 * (row["vision_right"] - row["text_right"]) / row["n"]) < 1e-9
    assert (rule["others"], rule["silent"]) == (3, 2) and rule["passes"] == (rule["gap"] >= 15 and rule["p"] < 0.05)
    assert not review.reader_rule(tally, others.limit(0).unionByName(others.filter("reported"))).first()["passes"]
    assert review.reader_rule(tally.limit(0), others).first()["passes"] is False


def test_a_log_gives_no_values(spark):
    seen = spark.createDataFrame([('{"name": "Ann", "n": [1, 2], "in": {"k": null}}',), ("no json",), (None,)], "body string").select(review.body_shape(F.col("body"))).collect()
    assert "Ann" not in seen[0][0] and "name: STRING" in seen[0][0] and seen[1][0] is None and seen[2][0] is None


def test_documents_read_back(spark, sf_dir):
    edges = run(spark, sf_dir, "SELECT * FROM edges", "edges").collect()
    out = {}
    for e in edges:
        out.setdefault(e["source_paper_id"], set()).add(e["target_paper_id"])
    for r in catalog.queries()["a13_archive_graph"](spark, sf_dir).collect():
        d = json.loads(r["document"])
        assert d["edges"] == d["links"] and d["directed"] is True
        assert {x["target"] for x in d["links"]} == out[r["seed_id"]]
        assert {x["id"] for x in d["nodes"]} == out[r["seed_id"]] | {r["seed_id"]}
    runs = catalog.queries()["a16_run_document"](spark, sf_dir).collect()
    assert len(runs) == len(out)
    for r in runs:
        d = json.loads(r["document"])
        assert "\n" in r["document"] and d["links"] == len(d["edges"]) == len(out[r["run_id"]])
        assert [x["target"] for x in d["edges"]] == sorted(out[r["run_id"]]) and d["note"] == ("many" if d["links"] > 9 else None)


def test_records_of_one_paper_spend_once(spark):
    links = [("W1", "W2", 5), ("W1", "10.1/b", 1), ("W1", "note 3", 0), ("W1", "10.1/two", 2), ("W1", "lost", 0), ("W2", "W1", 3), ("W2", "W4", 4)]
    names = [("W1", "A"), ("W2", "B"), ("10.1/two", "B"), ("10.1/b", "C"), ("note 3", "D"), ("W4", "E")]
    edges, aliases = spark.createDataFrame(links, "source string, target string, seq long"), spark.createDataFrame(names, "alias string, paper_id string")
    walk = lambda most: [r["paper_id"] for r in traverse.traverse(spark.createDataFrame([("A",)], "seed_id string"), edges, 2, 0, most, aliases).orderBy("place").collect()]
    assert walk(4) == ["A", "B", "C", "D"]
    assert walk(9) == ["A", "B", "C", "D", "E"]
    assert walk(2) == ["A", "B"]


def test_arriving_papers_are_those_of_the_table(spark, sf_dir):
    found = catalog.queries()["s1_arriving_papers"](spark, sf_dir)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = F.concat(F.lit("We enrolled "), 20 + F.col("conv_id") % 900, F.lit(" patients. "), F.coalesce("text", F.lit("")))
    want = evidence.candidates(turns.select(F.concat_ws(":", "conv_id", "turn").alias("paper_id"), F.col("role").alias("section"), said.alias("text"))).select(*found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() >= turns.count()


def plain_walk(seed, step, most=100):
    """(paper, direction, depth) in order: two levels back, one forward."""
    depths = {"backward": 2, "forward": 1}
    share = {"forward": int((most - 1) * 0.35)}
    share["backward"] = most - 1 - share["forward"]
    found = [(seed, "seed", 0)]
    level = lambda way, d: [p for p, w, k in found if k == d and (w == way or d == 0)]
    for depth in range(2):
        for way, other in (("backward", "forward"), ("forward", "backward")):
            if depth >= depths[way]:
                continue
            waits = depth < depths[other] and level(other, depth + 1 if other == "backward" else depth)
            room = most - len(found)
            if waits:
                room = min(room, share[way] - sum(w == way for _, w, _ in found))
            best, held = {}, {p for p, _, _ in found}
            for at in level(way, depth):
                for order, near in step[way].get(at, ()):
                    if near not in held:
                        best[near] = min(order, best.get(near, order))
            fresh = sorted((order, p) for p, order in best.items())[: max(room, 0)]
            found += [(p, way, depth + 1) for _, p in fresh]
    return found


def test_the_whole_walk_with_aliases(spark, sf_dir):
    owner = {r["alias"]: r["paper_id"] for r in run(spark, sf_dir, NAMES).collect()}
    kind = lambda raw: 0 if raw.startswith("W") else 1 if raw.startswith("10.") else 2
    step = {"backward": {}, "forward": {}}
    for r in run(spark, sf_dir, RAW_LINKS, "pairs").collect():
        s, t = owner.get(r["source"]), owner.get(r["target"])
        if s and t and s != t:
            step["backward"].setdefault(s, []).append(((kind(r["target"]), r["seq"]), t))
            step["forward"].setdefault(t, []).append(((kind(r["source"]), r["seq"]), s))
    found = {}
    for r in catalog.queries()["f3_resolved_walk_whole"](spark, sf_dir).orderBy("seed_id", "place").collect():
        found.setdefault(r["seed_id"], []).append((r["paper_id"], r["direction"], r["depth"]))
    assert found and all(rows == plain_walk(seed, step) for seed, rows in found.items())
    assert max(map(len, found.values())) > 12


def test_a_pack_is_cut_by_rank(spark):
    papers = spark.createDataFrame(
        [("s", 2, "Two", 1999, "", [], None, "x" * 700), ("s", 1, None, None, "J", ["a", "b", "c", "d"], "10.1/a", None), ("s", 3, "Three", 2000, "J", None, None, None)],
        "seed_id string, rank int, title string, year int, journal string, authors array<string>, doi string, abstract string",
    )
    edges = spark.createDataFrame([("s", 2, "p", "q"), ("s", 1, "q", "r"), ("none", 1, "a", "b")], "seed_id string, seq int, source string, target string")
    rows = review.evidence_pack(papers, edges, 2, 1).collect()
    assert [(r["seed_id"], r["pack"]) for r in rows] == [("s", "Papers:\n1. Untitled - J - a, b, c et al. DOI: 10.1/a\n2. Two (1999) - Abstract: " + "x" * 600 + "\nLinks (2):\nq -> r\n... and 1 more links")]
