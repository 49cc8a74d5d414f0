"""Dumps with broken lines, graph documents as files, reports and messages of odd runs."""

import glob
import json
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from bibloom.operators import report, tables, weights
from bibloom.plans import documents, reports
from bibloom.sources import dumps, exports

from .conftest import SF

NS = "{http://graphml.graphdrawing.org/xmlns}"


def test_dump_lines_of_every_kind(spark, tmp_path):
    lines = [
        json.dumps({"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/A", "display_name": "One", "primary_location": {"source": None}, "unknown": [1]}),
        json.dumps({"id": "https://openalex.org/W2", "primary_location": None, "authorships": None, "abstract_inverted_index": {"b": [1], "a": [0]}}),
        json.dumps({"id": "https://openalex.org/W3", "display_name": "Three", "publication_year": "no year"}),
        '{"id": "https://openalex.org/W4", "display_name": ',
        "nothing like it",
        "",
    ]
    (tmp_path / "part-0.json").write_text("\n".join(lines))
    got = {r["paper_id"]: r for r in dumps.papers(spark, str(tmp_path), "openalex").collect()}
    assert set(got) == {"10.1/a", "W2", "W3"}
    assert got["10.1/a"]["journal"] is None and got["W2"]["abstract"] == "a b" and got["W2"]["authors"] == [] and got["W2"]["title"] == "Unknown Title"
    assert got["W3"]["title"] == "Three" and got["W3"]["year"] is None
    told = dumps.rejected(spark, str(tmp_path), "openalex").first()
    assert (told["lines"], told["broken"], told["partial"]) == (5, 2, 1)
    (tmp_path / "none").mkdir()
    assert dumps.papers(spark, str(tmp_path / "none"), "crossref").count() == 0


def test_references_of_a_crossref_dump(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"DOI": "10.1/S", "reference": [{"DOI": "10.1/T"}, {"key": "no doi"}, {"DOI": ""}, {"DOI": "https://doi.org/10.1/U"}]}) + "\n" + json.dumps({"DOI": "10.1/V"}))
    got = [tuple(r) for r in dumps.references(spark, str(tmp_path), "crossref").orderBy("seq").collect()]
    assert got == [("10.1/S", "10.1/t", 0), ("10.1/S", "10.1/u", 3)]


def test_graphml_files_make_a_document(spark, tmp_path):
    v, inside = documents._journal_graphs(spark, SF)
    some = v.select("journal").distinct().orderBy("journal").limit(3)
    v, inside = v.join(some, "journal"), inside.join(some, "journal")
    exports.write_documents(exports.graphml_lines(v, inside, "journal"), str(tmp_path / "out"), "journal", 5)
    nodes, links = {}, {}
    for r in v.collect():
        nodes.setdefault(r["journal"], {})[r["paper_id"]] = r
    for r in inside.collect():
        links.setdefault(r["journal"], set()).add((r["source"], r["target"], r["weight"], r["confidence"]))
    for journal, own in nodes.items():
        files = sorted(glob.glob(f"{tmp_path}/out/journal={journal.replace('#', '%23')}/part-*"))
        root = ET.fromstring("".join(open(f).read() for f in files).encode())
        assert {k.get("id") for k in root.iter(f"{NS}key")} == {*exports.NODE_KEYS, *exports.EDGE_KEYS}
        found = {n.get("id"): {d.get("key"): d.text for d in n} for n in root.iter(f"{NS}node")}
        assert found == {i: {k: str(r[k]) for k in exports.NODE_KEYS if r[k] is not None} for i, r in own.items()}
        of = lambda e, k: next((float(d.text) for d in e if d.get("key") == k), None)
        assert {(e.get("source"), e.get("target"), of(e, "weight"), of(e, "confidence")) for e in root.iter(f"{NS}edge")} == links.get(journal, set())


def test_a_report_without_rows(spark):
    seeds = spark.createDataFrame([("s|1", "r", "now", None, [], None, None)], "seed_id string, run_id string, generated string, title string, authors array<string>, journal string, year int")
    none = lambda schema: spark.createDataFrame([], "seed_id string, " + schema)
    lines = report.report_lines(
        seeds, none("paper_id string"), none("source string"), none("rank int, title string, year int, score double, n_eff int"),
        none("paper_id string, title string, n_eff int, semantic_type string, status string, confidence double"),
        none("paper_id string, title string, value bigint, unit string, kind string, status string, confidence double"), none("rank int, titles array<string>, score double"),
    )
    text = report.documents(lines).first()["document"]
    assert "## —\n\n- **Run**" in text and "_No candidates were ranked._" in text and "_Study sizes do not apply to these papers._" in text
    assert "## Dataset evidence" not in text and "## Top citation paths" not in text and text.endswith("before citing them._")


def test_messages_keep_their_order(spark):
    schema = "run string, warnings array<string>, dead_doi string, lost_lookups int, abstracts_recovered int, full_text_recovered int, dataset_papers int, without_abstract int, papers int, duplicates_merged int"
    rows = [("all", ["first"], "10.1/x", 2, 3, 4, 5, 6, 7, 8), ("none", None, None, 0, 0, 0, 0, 0, 7, 0)]
    got = tables.walk_warnings(spark.createDataFrame(rows, schema)).orderBy("seq").collect()
    assert [r["run"] for r in got] == ["all"] * 8 and [r["warning"].split()[0] for r in got] == ["first", "The", "2", "3", "4", "Dataset", "6", "8"]


def test_weights_under_the_seed_rule(spark):
    edges = spark.createDataFrame([("a", "x", "y", 1.0), ("b", "x", "y", 1.0), ("c", "x", "y", 1.0)], "seed_id string, source_paper_id string, target_paper_id string, confidence double")
    sizes = spark.createDataFrame([("y", 100_000, 1.0)], "paper_id string, n_eff int, confidence double")
    seeds = spark.createDataFrame([("a", "biomedical"), ("b", "nonclinical"), ("c", None)], "seed_id string, research_domain string")
    got = {r["seed_id"]: round(r["final_weight"], 6) for r in weights.weight_seed_edges(edges, sizes, seeds).collect()}
    assert got == {"a": 0.875, "b": 0.125, "c": 0.875}


def test_edges_of_a_graph(spark):
    rows = [("a", "b", "cites", 0.5, 0.0, ["x", "y"], 1), ("a", "c", "cites", 0.5, None, ["x"], 2), ("a", "b", "cites", 0.7, 0.2, [], 3)]
    raw = spark.createDataFrame(rows, "source_paper_id string, target_paper_id string, relation string, confidence double, final_weight double, providers array<string>, seq int")
    got = {r["target"]: (r["weight"], r["confidence"], r["providers"]) for r in weights.graph_edges(raw.filter("seq < 3")).collect()}
    assert got == {"b": (0.0, 0.5, "x,y"), "c": (1.0, 0.5, "x")}
    assert {r["target"]: r["weight"] for r in weights.graph_edges(raw).collect()} == {"b": 0.2, "c": 1.0}


def test_paper_table_has_every_column(spark):
    assert tuple(reports.a10_whole(spark, SF).columns) == exports.PAPER_COLUMNS and len(exports.PAPER_COLUMNS) == 22
    assert reports.a10_whole(spark, SF).filter(F.col("is_seed") == "yes").count() > 0
