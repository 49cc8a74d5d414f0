"""Identifiers, merging, statistics and figure layouts on small cases, against plain Python."""

import math

import numpy as np
from pyspark.sql import functions as F

from bibloom.functions import addresses, ids
from bibloom.operators import evaluate, fulltext, layout, tables
from bibloom.sources import records


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_identifiers_lose_any_white_space_and_no_length(spark):
    long = "10.4321/" + "x" * 9000
    assert one(spark, ids.canonical, "\t10.4321/AbC\n", "doi:" + long, "\u00a0PMC12\u3000", "pmid:\t77 ", None) == ["10.4321/abc", long, "PMC12", "77", ""]
    assert one(spark, ids.query_type, "\n10.4321/a\t", "doi: " + long, "\u2003", "PMID:\t12") == ["doi", "doi", "title", "pmid"]


def test_mcnemar_of_many_pairs(spark):
    cases = [(500, 600), (0, 0), (3, 9), (2000, 2100), (1, 1)]
    df = spark.createDataFrame(cases, "b long, c long")
    got = {(r["b"], r["c"]): r["p"] for r in df.select("b", "c", evaluate.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()}
    for b, c in cases:
        want = min(1.0, 2 * sum(math.comb(b + c, k) for k in range(min(b, c) + 1)) / 2 ** (b + c)) if b + c else 1.0
        assert abs(got[b, c] - want) < 1e-9


def test_merging_does_not_depend_on_the_order_of_rows(spark):
    names = ["title", "year", "authors", "journal", "abstract", "doi", "pmid", "pmcid", "openalex_id", "research_domain"]
    kinds = dict.fromkeys(names, "string") | {"year": "int", "authors": "array<string>"}
    rows = [("q", "crossref", t, 2000, None, None, None, "10.4321/" + t, None, None, None, None) for t in "cab"]
    schema = "query_id string, provider string, " + ", ".join(f"{n} {kinds[n]}" for n in names)
    for order in (rows, rows[::-1]):
        assert records.merge_providers(spark.createDataFrame(order, schema).repartition(3)).first()["title"] == "a"


def test_addresses_and_heads(spark):
    urls = ["https://a.example/10.4321/Q1.?pmid=5", "https://a.example/x?u=10.4321%2FQ2", "https://a.example/pmc77?id=3", "https://pubmed.ncbi.nlm.nih.gov/123/", "https://a.example/x?EXT_ID=9&id=", "not an address", None, "https://a.example/%zz?id=7%"]
    got = one(spark, addresses.from_address, *urls)
    assert [g and tuple(g) for g in got] == [("doi", "10.4321/q1"), ("doi", "10.4321/q2"), ("pmcid", "PMC77"), ("pmid", "123"), ("pmid", "9"), None, None, None]
    heads = ["<meta name=citation_title content='  A  long title'>", "<META PROPERTY=\"og:title\" content=abc>", '<meta name="doi" content="10.4321/Z/pdf">', "", None]
    assert [g and tuple(g) for g in one(spark, addresses.from_head, *heads)] == [("title", "A long title"), None, ("doi", "10.4321/z"), None, None]


def test_section_labels(spark):
    paths = [["Methods", "Discussion"], ["Results", "Participants"], ["Patients"], ["Notes"], ["Notes", "Main findings"], []]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p array<string>")
    assert [r[0] for r in df.orderBy("i").select(fulltext.section_label(F.col("p"))).collect()] == [None, "results", "methods", None, "results", None]


def boxes_kept(boxes):
    def overlap(a, b):
        w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
        both = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
        return w * h / both if both else 0

    kept = []
    for i, b in sorted(boxes, key=lambda x: ((x[1][2] - x[1][0]) * (x[1][3] - x[1][1]), x[0])):
        if not any(overlap(b, k) > 0.8 for _, k in kept):
            kept.append((i, b))
    return {i for i, _ in kept}


def rows_of(cells, least=0.0):
    """Row numbers of (key, cy, h), each beside its row's first cell."""
    out, first, row = {}, None, -1
    for key, cy, h in sorted(cells, key=lambda c: (c[1], c[0])):
        if first is None or not abs(first[1] - cy) < 0.5 * max(first[2], h, least):
            first, row = (key, cy, h), row + 1
        out[key] = row
    return out


def test_layout_against_plain_loops(spark):
    rng = np.random.default_rng(6)
    figs = {f: [(i, tuple(map(float, (x, y, x + w, y + h)))) for i, (x, y, w, h) in enumerate(rng.integers(1, 12, (25, 4)))] for f in ("a", "b", "c")}
    flat = [(f, i, *b) for f, held in figs.items() for i, b in held]
    boxes = spark.createDataFrame(flat, "fig_id string, box_id long, x0 double, y0 double, x1 double, y1 double").repartition(3)
    got = {f: set() for f in figs}
    for r in layout.distinct_boxes(boxes).collect():
        got[r["fig_id"]].add(r["box_id"])
    assert got == {f: boxes_kept(held) for f, held in figs.items()}

    lines = boxes.withColumnRenamed("box_id", "line_id").withColumn("text", F.concat(F.lit("t"), "line_id"))
    order = {r["fig_id"]: r["lines"] for r in layout.reading_order(lines, ["fig_id"]).collect()}
    for f, held in figs.items():
        row = rows_of([(i, (b[1] + b[3]) / 2, b[3] - b[1]) for i, b in held])
        want = [" ".join(f"t{i}" for i, b in sorted(held, key=lambda x: (x[1][0], x[0])) if row[i] == k) for k in range(max(row.values()) + 1)]
        assert order[f] == want

    counts = boxes.select("fig_id", F.col("box_id").alias("seq"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), (F.col("y1") - F.col("y0")).alias("h"), F.col("x0").cast("long").alias("value"))
    placed = layout.side_by_side(counts)
    assert {(r["fig_id"], r["seq"]): r["row"] for r in placed.collect()} == {(f, i): k for f, held in figs.items() for i, k in rows_of([(i, (b[1] + b[3]) / 2, b[3] - b[1]) for i, b in held], 1.0).items()}


def test_row_totals_and_stages(spark):
    df = spark.createDataFrame([("f", 0, v) for v in (7, 3, 4)] + [("f", 1, v) for v in (5, 5)] + [("g", 0, 9)], "fig_id string, row int, value long")
    assert {(r["fig_id"], r["row"]): r["total"] for r in layout.row_totals(df).collect()} == {("f", 0): 7, ("f", 1): 10, ("g", 0): 9}
    assert one(spark, layout.stages_of, "Recruited and randomly assigned", "Dropped before analysis", "Included in the main analysis", "Tea") == [["enrolled", "randomised", "allocated"], ["excluded"], ["analysed"], []]


def test_best_titles_lose_no_match(spark):
    rng = np.random.default_rng(2)
    title = lambda: " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 6)))
    wanted, held = [(i, title()) for i in range(40)], [(i, title(), int(rng.integers(0, 4))) for i in range(80)]
    got = {r["id"]: (r["candidate"], r["score"]) for r in tables.best_titles(spark.createDataFrame(wanted, "id long, title string"), spark.createDataFrame(held, "candidate long, title string, cited long")).collect()}
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    for i, t in wanted:
        found = [(round(s, 3), cited, -c, round(s, 9)) for c, u, cited in held if (s := share(set(t.split()), set(u.split()))) >= 0.6]
        assert got.get(i) == ((-max(found)[2], max(found)[3]) if found else None), t
