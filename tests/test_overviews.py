"""Overviews and lookups on odd rows."""

from pyspark.sql import functions as F

from bibloom.operators import overviews


def test_first_hits_tell_their_lines(spark):
    text = "one 1\n`2` ```\n3\n``` 4\n\n5 [a](6) 7"
    df = spark.createDataFrame([(2, "9"), (1, text), (3, None), (4, "x" * 90 + " 8")], "k int, text string")
    got = overviews.first_hits(df, "k", {"number": ("struct", "[0-9]"), "long": ("prose", "x+")}, 4).orderBy("pattern", "place").collect()
    # the fence is one blank, so what follows it moves up
    assert [(r["k"], r["line"], r["snippet"]) for r in got if r["pattern"] == "number"] == [(1, 1, "1"), (1, 2, "4"), (1, 4, "5"), (1, 4, "7")]
    assert [r["snippet"] for r in got if r["pattern"] == "long"] == ["x" * 70]


def test_overview_of_runs_without_rows(spark):
    none = lambda schema: spark.createDataFrame([], "run string" + schema)
    runs = spark.createDataFrame([("a", "completed", 2024, 2023, None), ("b", "failed", 2024, None, ["w"])], "run string, status string, created_year int, seed_year int, warnings array<string>")
    papers = spark.createDataFrame([("a",)], "run string")
    status = ", status string, confidence double"
    got = {r["run"]: r for r in overviews.run_overview(runs, papers, none(""), none(status), none(status), none(", score double")).collect()}
    assert got["a"]["no_links"] and got["a"]["recent_seed"] and got["a"]["metadata_done"] and not got["a"]["graph_done"] and got["a"]["mean_confidence"] is None
    assert not got["b"]["no_links"] and not got["b"]["recent_seed"] and got["b"]["warnings"] == 1 and got["b"]["papers"] == 0


def test_catalogue_keeps_first_records(spark):
    cited = spark.createDataFrame([("10.1/A", 2), ("10.1/a", 1), ("10.1/b", 3), ("10.1/c", 4)], "doi string, seq int")
    schema = "doi string, title string, authors array<string>, seq int"
    first = spark.createDataFrame([("10.1/a", "A later", None, 5), ("10.1/A", "Z first", [str(i) for i in range(20)], 1)], schema)
    second = spark.createDataFrame([("10.1/a", "other", [], 0), ("10.1/B", None, ["x"], 0)], schema)
    got = {r["doi"]: r for r in overviews.catalogue(cited, first, second).collect()}
    assert got["10.1/a"]["title"] == "Z first" and len(got["10.1/a"]["authors"]) == 12 and got["10.1/a"]["seq"] == 1
    assert got["10.1/b"]["source"] == "openalex" and got["10.1/b"]["title"] is None and got["10.1/c"]["status"] == "unverified"


def test_rates_without_cases_are_null(spark):
    answers = spark.createDataFrame([], "wanted_doi string, found boolean, doi string, title string, year int, journal string, authors array<string>, abstract string, backfilled boolean")
    row = overviews.completeness_report(answers).first()
    assert row["attempted"] == 0 and row["resolution_rate"] is None and row["title"] is None
    pairs = spark.createDataFrame([], "gold int, predicted int, gold_type string, predicted_type string, confidence double")
    row = overviews.detection_report(pairs).first()
    assert row["tp"] == 0 and row["type_accuracy"] is None and row["confidence_when_right"] is None
    assert overviews.reading_times(spark.createDataFrame([], "seconds double")).first()["median"] is None
    assert [overviews.reading_times(spark.createDataFrame([(float(s),) for s in x], "seconds double")).first()["median"] for x in ([1, 2, 3], [1, 1, 2, 3], [5])] == [2.0, 2.0, 5.0]


def test_graph_page_under_either_seed(spark):
    v = spark.createDataFrame([("a", None, 1, None, 0.9), ("b", 2000, None, 5, 0.8), ("c", 1900, 1, 1, 1.0), ("d", 2001, 2, 2, None)], "paper_id string, year int, n_eff int, technical_value int, metadata_confidence double")
    e = spark.createDataFrame([("a", "d", 1.0, 1.0), ("b", "d", 1.0, 1.0), ("a", "c", 1.0, 1.0), ("d", "a", None, 1.0)], "source_paper_id string, target_paper_id string, confidence double, final_weight double")
    kept = lambda *x: (sorted(r["paper_id"] for r in overviews.graph_page(v, e, (1950, 2010), *x, 0.5, 0.5)[0].collect()), overviews.graph_page(v, e, (1950, 2010), *x, 0.5, 0.5)[1].count())
    assert kept(True, False, False) == (["a", "d"], 1) and kept(True, True, False) == (["b", "d"], 1) and kept(False, False, True) == (["a", "b"], 0)
    assert kept(False, False, False) == (["a", "b", "d"], 2)


def test_pages_put_unknown_numbers_first(spark):
    rows = spark.createDataFrame([("a", "Z", None, 0.5, 3), ("b", None, 2000, None, None), ("c", "m", 1990, 0.9, 9)], "paper_id string, title string, year int, confidence double, citations int")
    ids = lambda *x: [r["paper_id"] for r in overviews.page(rows, *x).orderBy("place").collect()]
    assert ids("year", 9) == ["a", "c", "b"] and ids("citations", 2, True) == ["c", "a"] and ids("title", 9) == ["b", "c", "a"]
    assert rows.select(F.count(F.lit(1))).first()[0] == 3
