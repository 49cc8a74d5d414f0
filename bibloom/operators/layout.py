"""Tables of drawn boxes and read lines: regions, reading order, stages and rows of participant flow figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Vocabulary of the stages of a participant flow
EXCLUDED = r"(?i)\b(not|exclud\w*|declin\w*|refus\w*|lost|loss|discontinu\w*|withdr\w*|drop\w*|fail\w*|died|death)\b"
STAGES = (
    ("screened", r"(?i)assess\w*\s+for\s+(pre-?)?eligib|\bscreen\w*|\beligib\w*|\bapplied\b"),
    ("enrolled", r"(?i)\benrol\w*|\bincluded\b(?!\s+in\s+(the\s+)?(\w+\s+)?analy)|\brecruit(ed|ment)\b|\b(met|meet|meeting|fulfill?ing|fulfilled)\s+(the\s+)?(\w+\s+)?inclusion"),
    ("randomised", r"(?i)\brandomi[sz]\w*|\brandomly\b"),
    ("analysed", r"(?i)\banaly\w*"),
    ("allocated", r"(?i)\ballocat\w*|\bassigned\b|\bgroups?\b|\barms?\b"),
)
SURE, UNSURE, REREAD = 0.5, 0.85, 12


def stages_of(label: Column) -> Column:
    """The stages that a label names; an exclusion stands alone."""
    named = F.array_compact(F.array(*[F.when(label.rlike(p), name) for name, p in STAGES]))
    return F.when(label.rlike(EXCLUDED), F.array(F.lit("excluded"))).otherwise(named)


def area(box: Column) -> Column:
    return (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])


def usable_lines(lines: DataFrame) -> DataFrame:
    """Lines with a text that was read well enough; ``reread`` marks a figure's first REREAD unsure ones that hold a digit."""
    kept = lines.filter(F.trim("text") != "").filter(F.col("conf") >= SURE)
    unsure = (F.col("conf") < UNSURE) & F.col("text").rlike("[0-9]")
    so_far = F.sum(F.when(unsure, 1).otherwise(0)).over(Window.partitionBy("fig_id").orderBy("line_id"))
    return kept.withColumn("reread", unsure & (so_far <= REREAD))


def better_reading(lines: DataFrame, again: DataFrame) -> DataFrame:
    """Lines with the text of a second reading (fig_id, line_id, text, conf) where that one is surer."""
    second = again.select("fig_id", "line_id", F.col("text").alias("t2"), F.col("conf").alias("c2"))
    surer = F.coalesce(F.col("c2") > F.col("conf"), F.lit(False))
    joined = lines.join(second, ["fig_id", "line_id"], "left")
    return joined.withColumns({"text": F.when(surer, F.col("t2")).otherwise(F.col("text")), "conf": F.when(surer, F.col("c2")).otherwise(F.col("conf"))}).drop("t2", "c2")


def lines_in_boxes(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Adds box_id: the smallest box around a line's centre, of equal ones the first; null for a free line."""
    size = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    x, y = (F.col("l.x0") + F.col("l.x1")) / 2, (F.col("l.y0") + F.col("l.y1")) / 2
    inside = (F.col("l.fig_id") == F.col("b.fig_id")) & x.between(F.col("b.x0"), F.col("b.x1")) & y.between(F.col("b.y0"), F.col("b.y1"))
    held = lines.alias("l").join(boxes.alias("b"), inside).groupBy("l.fig_id", "l.line_id").agg(F.min_by("b.box_id", F.struct(size, "b.box_id")).alias("box_id"))
    return lines.join(held, ["fig_id", "line_id"], "left")


def distinct_boxes(boxes: DataFrame, most: float = 0.8) -> DataFrame:
    """One of near-identical boxes a figure: by ascending area, each unless its overlap with a kept one is over ``most``."""
    listed = boxes.groupBy("fig_id").agg(F.array_sort(F.collect_list(F.struct(((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("size"), "box_id", "x0", "y0", "x1", "y1"))).alias("all"))

    def overlap(a: Column, b: Column) -> Column:
        wide = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
        high = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
        union = area(a) + area(b) - wide * high
        return F.when(union > 0, wide * high / union).otherwise(0.0)

    none = F.slice("all", 1, 0)
    kept = F.aggregate("all", none, lambda acc, box: F.when(F.exists(acc, lambda k: overlap(box, k) > most), acc).otherwise(F.array_append(acc, box)))
    return listed.select("fig_id", F.explode(kept).alias("k")).select("fig_id", "k.box_id", "k.x0", "k.y0", "k.x1", "k.y1")


def reading_order(lines: DataFrame, key: list[str]) -> DataFrame:
    """(key, lines array<string>): rows from top to bottom, each from left to right; a line joins the row whose first line it stands beside."""
    cells = lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(((F.col("y0") + F.col("y1")) / 2).alias("cy"), "line_id", (F.col("y1") - F.col("y0")).alias("h"), "x0", "text"))).alias("all"))
    start = F.struct(F.lit(-1).alias("row"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("h"), F.array().cast("array<struct<row:int,x0:double,line_id:bigint,text:string>>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        same = (acc["row"] >= 0) & (F.abs(acc["cy"] - c["cy"]) < 0.5 * F.greatest(c["h"], acc["h"]))
        row = F.when(same, acc["row"]).otherwise(acc["row"] + 1)
        first = lambda name: F.when(same, acc[name]).otherwise(c[name]).alias(name)
        cell = F.struct(row.alias("row"), c["x0"].alias("x0"), c["line_id"].cast("long").alias("line_id"), c["text"].alias("text"))
        return F.struct(row.alias("row"), first("cy"), first("h"), F.array_append(acc["out"], cell).alias("out"))

    placed = cells.select(*key, F.aggregate("all", start, step, lambda acc: F.array_sort(acc["out"])).alias("cells"))
    rows = F.transform(F.sequence(F.lit(0), F.element_at("cells", -1)["row"]), lambda r: F.array_join(F.transform(F.filter("cells", lambda c: c["row"] == r), lambda c: c["text"]), " "))
    return placed.select(*key, rows.alias("lines"))


def side_by_side(counts: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Adds row to counts (key, seq, cy, h): from the top, a count beside its row's first one within half of the taller. The key is fig_id by default."""
    key = key or ["fig_id"]
    rest = [c for c in counts.columns if c not in (*key, "seq", "cy", "h")]
    kinds = {f.name: f.dataType.simpleString() for f in counts.schema}
    held = ["seq", "cy", "h", *(["rest"] if rest else [])]
    whole = counts.select(*key, "seq", "cy", "h", *([F.struct(*rest).alias("rest")] if rest else []))
    if rest:
        kinds["rest"] = whole.schema["rest"].dataType.simpleString()
    # the other columns ride along, so nothing is joined back
    listed = whole.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("cy", "seq", "h", *held[3:]))).alias("all"))
    out = ",".join(f"{c}:{kinds[c]}" for c in held)
    start = F.struct(F.lit(-1).alias("row"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("h"), F.array().cast(f"array<struct<{out},row:int>>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        same = (acc["row"] >= 0) & (F.abs(acc["cy"] - c["cy"]) < 0.5 * F.greatest(acc["h"], c["h"], F.lit(1.0)))
        row = F.when(same, acc["row"]).otherwise(acc["row"] + 1)
        first = lambda name: F.when(same, acc[name]).otherwise(c[name]).alias(name)
        cell = F.struct(*[c[k].alias(k) for k in held], row.alias("row"))
        return F.struct(row.alias("row"), first("cy"), first("h"), F.array_append(acc["out"], cell).alias("out"))

    rows = listed.select(*key, F.explode(F.aggregate("all", start, step, lambda acc: acc["out"])).alias("r"))
    return rows.select(*key, *[F.col(f"r.{c}") if c in held else F.col(f"r.rest.{c}") for c in counts.columns if c not in key], "r.row")


def row_totals(counts: DataFrame) -> DataFrame:
    """(fig_id, row, total) of counts (fig_id, row, value): the sum of the arms, unless one of more than two states it already."""
    held = counts.groupBy("fig_id", "row").agg(F.sum("value").alias("s"), F.max("value").alias("m"), F.count(F.lit(1)).alias("n"))
    return held.select("fig_id", "row", F.when((F.col("n") > 2) & (2 * F.col("m") == F.col("s")), F.col("m")).otherwise(F.col("s")).alias("total"))
