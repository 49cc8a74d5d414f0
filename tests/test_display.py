"""Values as text and merged maps, case by case."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from bibloom.functions import display
from bibloom.operators import flow, ledger
from bibloom.plans import display as plans


def test_numbers_and_shares(spark):
    rows = [(1234567.0, 0.125), (0.5, 1.0), (-1234.5678, 0.0), (float("nan"), None), (None, 0.745)]
    found = spark.createDataFrame(rows, "n double, s double").select(display.grouped_number(F.col("n")), display.percent(F.col("s"))).collect()
    assert [tuple(r) for r in found] == [("1,234,567", "13%"), ("0.5", "100%"), ("-1,234.568", "0%"), ("—", "—"), ("—", "75%")]
    assert spark.range(1).select(display.grouped_number(F.lit(12345))).first()[0] == "12,345"


def test_titles_and_authors(spark):
    rows = [("x" * 70, ["A", "B"]), ("é" * 71, ["A", "B", "C", "D", "E"]), ("", []), (None, None), ("t", ["A", None, "C"])]
    found = spark.createDataFrame(rows, "t string, a array<string>").select(display.short_title(F.col("t")), display.author_line(F.col("a"))).collect()
    assert [tuple(r) for r in found] == [("x" * 70, "A, B"), ("é" * 69 + "…", "A, B, C +2"), ("", "Unknown"), ("", "Unknown"), ("t", "A, , C")]


def test_times(spark):
    want = {
        "2024-03-05T11:59:30.5Z": "29s ago", "2024-03-05 11:59:00": "1m ago", "2024-03-05 10:59:59": "1h ago", "2024-03-04 12:00:00": "3/4/2024",
        "2024-03-04 12:00:01": "23h ago", "2024-03-05 12:00:05": "-5s ago", "soon": "Invalid Date", "": "Invalid Date", None: None,
    }
    df = spark.createDataFrame([(k,) for k in want], "raw string")
    assert {r[0]: r[1] for r in df.select("raw", display.time_ago(F.col("raw"), F.lit("2024-03-05 12:00:00").cast("timestamp"))).collect()} == want


def test_times_to_the_nearest_millisecond(spark, tmp_path):
    as_of = datetime.datetime(2024, 1, 30, 23, 26, 30)
    micros = [whole * 1_000_000 + part for whole in (-60, -1, 0, 1, 60, 3600, 86400, 86400 * 20000) for part in (-1001, -1000, -501, -500, -499, -1, 0, 1, 499, 500, 501, 999, 1000)]
    rows = [(50 * i + 1, as_of - datetime.timedelta(microseconds=m)) for i, m in enumerate(micros) if (50 * i + 1) % 51]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    want = {r[0]: r[1] for r in duckdb.connect().execute(plans.H2_SQL.replace("FROM events)", f"FROM '{tmp_path}/events.parquet/*.parquet')")).fetchall()}
    assert {r["event_id"]: r["ago"] for r in plans.h2(spark, str(tmp_path)).collect()} == want and len(want) == len(rows)
    ago = display.time_ago(F.lit("2024-03-05 11:59:30.0005"), F.lit("2024-03-05 12:00:00").cast("timestamp"))
    assert spark.range(1).select(ago).first()[0] == "29s ago"


def test_later_maps_win(spark):
    rows = [({"a": "1", "b": "2"}, {"b": "3"}, {"c": None}), (None, {"a": "1"}, None), ({"a": "1"}, None, {"a": "9"}), (None, None, None)]
    df = spark.createDataFrame(rows, "x map<string,string>, y map<string,string>, z map<string,string>")
    assert [r[0] for r in df.select(display.later_wins(F.col("x"), F.col("y"), F.col("z"))).collect()] == [{"a": "1", "b": "3", "c": None}, {"a": "1"}, {"a": "9"}, None]


def test_helper_columns_keep_clear_of_the_callers_own(spark):
    counts = spark.createDataFrame([("f", 0.0, 30.0, 50.0, 40.0, [], "mine")], "fig_id string, x0 double, y0 double, x1 double, y1 double, stages array<string>, Heads string")
    headings = spark.createDataFrame([("f", 1, 0.0, 0.0, 200.0, 20.0, "Screening", 400.0)], "fig_id string, region_id int, x0 double, y0 double, x1 double, y1 double, text string, width double")
    found = flow.stages_from_layout(counts, headings)
    assert found.columns == counts.columns and found.first()["Heads"] == "mine" and len(found.first()["stages"]) == 1
    rows = spark.createDataFrame([("k", 1, 5, "mine"), ("k", 2, 5, "mine")], "k string, n int, size int, held string")
    with pytest.raises(ValueError):
        ledger.running_budget(rows, "k", ["n"], F.col("size"), 7)
    kept = ledger.running_budget(rows, "k", ["n"], F.col("size"), 7, "total")
    assert [tuple(r) for r in kept.collect()] == [("k", 1, 5, "mine", 5)]
