"""Counts placed in rows with their other columns, and nothing joined back."""

from bibloom.operators import layout


def test_other_columns_ride_along(spark):
    rows = [("f", 1, 10.0, 4.0, 7, "a"), ("f", 2, 11.0, 4.0, 5, "b"), ("f", 3, 30.0, 4.0, None, None), ("g", 1, 0.0, 2.0, 9, "c")]
    df = spark.createDataFrame(rows, "fig_id string, seq long, cy double, h double, value long, note string")
    placed = layout.side_by_side(df)
    got = {(r["fig_id"], r["seq"]): (r["cy"], r["h"], r["value"], r["note"], r["row"]) for r in placed.collect()}
    assert got == {("f", 1): (10.0, 4.0, 7, "a", 0), ("f", 2): (11.0, 4.0, 5, "b", 0), ("f", 3): (30.0, 4.0, None, None, 1), ("g", 1): (0.0, 2.0, 9, "c", 0)}
    assert "Join" not in placed._jdf.queryExecution().executedPlan().toString()
