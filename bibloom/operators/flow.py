"""Counts of participant flow figures: free regions, labelled counts, stages from headings and the totals of stages.

A figure is one picture, so its regions and headings fit a row; what grows is the number of figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.functions.names import unused
from bibloom.operators.layout import side_by_side, stages_of

# How figures write counts and head their rows
STATED = r"\b[nN]\s*[=:]\s*([0-9][0-9,]*)"
LEADING = r"(?U)^\W*([0-9][0-9,]*)(?:\s+(?=[A-Za-z])|\s*$)"
BULLETS = r"^[\s•◆♦▪►➢➤\-–*·]+"
HEADINGS = (("analysed", r"(?i)\banaly\w*"), ("allocated", r"(?i)\ballocat\w*|\brandomi[sz]\w*"), ("enrolled", r"(?i)\bincluded\b|\benrolled\b"), ("screened", r"(?i)\bscreening\b"))
TOTALS = ("screened", "enrolled", "randomised", "analysed")


def free_regions(lines: DataFrame) -> DataFrame:
    """(fig_id, region_id, x0, y0, x1, y1, members) of lines outside all boxes (fig_id, line_id, x0, y0, x1, y1).

    Lines that overlap sideways with a gap under 0.8 of the taller one are one region, directly or through
    others; region_id is its smallest line_id. Each line in turn merges the regions that it touches.
    """
    line = F.struct(F.col("line_id").cast("long").alias("line_id"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    listed = lines.groupBy("fig_id").agg(F.array_sort(F.collect_list(line)).alias("all"))

    def touch(a: Column, b: Column) -> Column:
        gap = F.greatest(a["y0"], b["y0"]) - F.least(a["y1"], b["y1"])
        wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
        return (gap < 0.8 * F.greatest(a["y1"] - a["y0"], b["y1"] - b["y0"])) & (wide > 0)

    def step(acc: Column, new: Column) -> Column:
        near = lambda region: F.exists(region, lambda held: touch(held, new))
        merged = F.concat(F.flatten(F.filter(acc, near)), F.array(new))
        return F.array_append(F.filter(acc, lambda region: ~near(region)), merged)

    none = F.array().cast("array<array<struct<line_id:bigint,x0:double,y0:double,x1:double,y1:double>>>")
    regions = listed.select("fig_id", F.explode(F.aggregate("all", none, step)).alias("r"))
    side = lambda pick, name: pick(F.col(f"r.{name}")).alias(name)
    return regions.select(
        "fig_id", F.array_min("r.line_id").alias("region_id"), side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1"), F.array_sort("r.line_id").alias("members")
    )


def _number(digits: Column) -> Column:
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("long")


def region_counts(regions: DataFrame) -> DataFrame:
    """(fig_id, region_id, seq, value, label, stages) of regions (fig_id, region_id, lines array<string>).

    A region that states "n = 35" labels each count by the text since the one before; otherwise a line that
    begins with a number opens a count, and its rest and the lines below label it. Numbers beyond 64 bits are
    left out. Where the first count is an exclusion, all of the region are. Null lines count as empty.
    """
    lines = F.transform("lines", lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), BULLETS, ""))
    text = F.array_join(lines, " ")
    found = F.regexp_extract_all(text, F.lit(STATED), F.lit(1))
    before = F.split(text, STATED)
    stated = F.transform(found, lambda n, i: F.struct(_number(n).alias("value"), F.btrim(F.get(before, i), F.lit(" ():;,.-")).alias("label")))
    opened = F.array().cast("array<struct<value:bigint,words:array<string>>>")

    def step(acc: Column, line: Column) -> Column:
        last = F.element_at(acc, -1)
        rest = F.regexp_replace(line, LEADING, "")
        new = F.struct(_number(F.regexp_extract(line, LEADING, 1)).alias("value"), F.array(rest).alias("words"))
        longer = F.struct(last["value"].alias("value"), F.array_append(last["words"], line).alias("words"))
        follows = F.when(F.size(acc) > 0, F.array_append(F.slice(acc, 1, F.size(acc) - 1), longer)).otherwise(acc)
        return F.when(line.rlike(LEADING), F.array_append(acc, new)).otherwise(follows)

    leading = F.transform(F.aggregate(lines, opened, step), lambda c: F.struct(c["value"].alias("value"), F.array_join(c["words"], " ").alias("label")))
    held = F.filter(F.when(F.size(found) > 0, stated).otherwise(leading), lambda c: c["value"].isNotNull())
    listed = regions.select("fig_id", "region_id", held.alias("held"))
    labelled = F.transform("held", lambda c: F.struct(c["value"].alias("value"), c["label"].alias("label"), stages_of(c["label"]).alias("stages")))
    excluded = F.array(F.lit("excluded"))
    rows = listed.select("fig_id", "region_id", labelled.alias("c")).select("fig_id", "region_id", F.coalesce(F.get("c", F.lit(0))["stages"] == excluded, F.lit(False)).alias("out"), F.posexplode("c").alias("seq", "c"))
    return rows.select("fig_id", "region_id", "seq", "c.value", "c.label", F.when(F.col("out"), excluded).otherwise(F.col("c.stages")).alias("stages"))


def heading_stage(text: Column) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), name) for name, p in HEADINGS])


def stages_from_layout(counts: DataFrame, headings: DataFrame) -> DataFrame:
    """Counts (fig_id, x0, y0, x1, y1, stages) where those without a stage take the one of a heading.

    headings: fig_id, region_id, x0, y0, x1, y1, text, width (of the picture). A tall heading, or one in the
    left fifth, stands beside a row: the nearest in height of those to the left, no farther than 1.5 heights.
    Else the lowest heading above, overlapping, with a gap below twice the region's height (20 at least).
    Headings without a stage take no part; ties go to the smaller region_id.
    """
    heads = unused("heads", counts)
    marked = headings.withColumn("stage", heading_stage(F.col("text"))).filter("stage is not null")
    beside = (F.col("y1") - F.col("y0") > 1.5 * (F.col("x1") - F.col("x0"))) | (F.col("x1") < 0.2 * F.col("width"))
    listed = marked.groupBy("fig_id").agg(F.array_sort(F.collect_list(F.struct("region_id", "x0", "y0", "x1", "y1", "stage", beside.alias("side")))).alias(heads))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    left = F.filter(heads, lambda h: h["side"] & (h["x1"] <= x0 + 5))
    off = lambda h: F.abs((h["y0"] + h["y1"]) / 2 - (y0 + y1) / 2)
    near = F.array_min(F.transform(left, lambda h: F.struct(off(h).alias("off"), h["region_id"].alias("region_id"), (h["y1"] - h["y0"]).alias("h"), h["stage"].alias("stage"))))
    banner = F.when(near["off"] <= 1.5 * F.greatest(near["h"], y1 - y0), near["stage"])
    wide = lambda h: F.least(h["x1"], x1) - F.greatest(h["x0"], x0)
    over = F.filter(heads, lambda h: ~h["side"] & (h["y1"] <= y0 + 2) & (y0 - h["y1"] < 2.0 * F.greatest(y1 - y0, F.lit(20.0))) & (wide(h) > 0))
    above = F.array_min(F.transform(over, lambda h: F.struct((-h["y1"]).alias("up"), h["region_id"].alias("region_id"), h["stage"].alias("stage"))))["stage"]
    given = F.coalesce(banner, above)
    joined = counts.join(listed, "fig_id", "left")
    return joined.withColumn("stages", F.when((F.size("stages") == 0) & given.isNotNull(), F.array(given)).otherwise(F.col("stages"))).drop(heads)


def stage_totals(counts: DataFrame) -> DataFrame:
    """(fig_id, screened, enrolled, randomised, analysed) of counts (fig_id, region_id, seq, value, x0, y0, x1, y1, stages).

    A stage's total is that of its first row, one count a region; of the analysed the last row, of those only
    that overlap the arms: the first row of allocations with two regions. Without a randomised count the first
    row of allocations stands for it. seq orders a figure's counts and tells them apart.
    """
    placed = counts.withColumns({"cy": (F.col("y0") + F.col("y1")) / 2, "h": F.col("y1") - F.col("y0")})
    staged = placed.select("*", F.explode("stages").alias("stage")).filter(F.col("stage").isin(*TOTALS, "allocated"))
    rows = side_by_side(staged.filter("stage <> 'analysed'"), ["fig_id", "stage"])
    arms = rows.filter("stage = 'allocated'").groupBy("fig_id", "row").agg(F.count_distinct("region_id").alias("n"), F.min("x0").alias("left"), F.max("x1").alias("right"))
    span = arms.filter("n >= 2").groupBy("fig_id").agg(F.min_by(F.struct("left", "right"), "row").alias("span"))
    inside = F.least(F.col("span.right"), F.col("x1")) - F.greatest(F.col("span.left"), F.col("x0")) > 0
    last = staged.filter("stage = 'analysed'").join(span, "fig_id", "left").filter(F.col("span").isNull() | inside).drop("span")
    every = rows.unionByName(side_by_side(last, ["fig_id", "stage"]))
    arm = every.groupBy("fig_id", "stage", "row", "region_id").agg(F.min_by("value", "seq").alias("value"))
    held = arm.groupBy("fig_id", "stage", "row").agg(F.sum("value").alias("s"), F.max("value").alias("m"), F.count(F.lit(1)).alias("n"))
    total = F.when((F.col("n") > 2) & (2 * F.col("m") == F.col("s")), F.col("m")).otherwise(F.col("s"))
    chosen = held.groupBy("fig_id", "stage").agg(F.min_by(total, "row").alias("first"), F.max_by(total, "row").alias("last"))
    of = lambda name, which="first": F.max(F.when(F.col("stage") == name, F.col(which)))
    wide = chosen.groupBy("fig_id").agg(of("screened").alias("screened"), of("enrolled").alias("enrolled"), F.coalesce(of("randomised"), of("allocated")).alias("randomised"), of("analysed", "last").alias("analysed"))
    return counts.select("fig_id").distinct().join(wide, "fig_id", "left")


def second_opinions(labels: DataFrame, answers: DataFrame, sure: float = 0.7, gap: float = 0.1) -> DataFrame:
    """Labels (label, stages) with ``reason`` and the stages that a second reader's answers (label, selected, probabilities, confidence) leave.

    Asked only where there is not exactly one stage besides the exclusion. An answer counts if it names a
    known stage, its two best options are ``gap`` apart and its confidence is ``sure``. One answer a label.
    """
    known = [name for name, _ in HEADINGS] + ["randomised", "excluded"]
    best = F.reverse(F.array_sort(F.map_values("probabilities")))
    close = F.coalesce(F.get(best, F.lit(0)) - F.get(best, F.lit(1)) < gap, F.lit(False))
    reason = (
        F.when(F.size(F.array_remove("stages", "excluded")) == 1, "rules were sure")
        .when(~F.coalesce(F.col("answered"), F.lit(False)), "no answer")
        .when(~F.coalesce(F.col("selected").isin(known), F.lit(False)), "unknown stage")
        .when(close, "ambiguous")
        .when(~F.coalesce(F.col("confidence") >= sure, F.lit(False)), "not sure")
        .otherwise("decisive")
    )
    joined = labels.join(answers.select("label", "selected", "probabilities", "confidence", F.lit(True).alias("answered")), "label", "left").withColumn("reason", reason)
    revised = F.when(F.col("reason") == "decisive", F.array("selected")).otherwise(F.col("stages"))
    return joined.withColumn("stages", revised).drop("selected", "probabilities", "confidence", "answered")


def flow_figure(figures: DataFrame, files: DataFrame, caption: str) -> DataFrame:
    """(paper_id, name, file, caption): each paper's first figure (paper_id, pos, caption, href) whose caption, tags off, matches.

    Ties of pos go to the smaller href, then caption. A name without an image ending is a .jpg; of its files (paper_id, file) the last in order is current.
    Papers without such a figure or file are left out.
    """
    plain = F.trim(F.regexp_replace(F.regexp_replace("caption", "<[^>]+>", " "), r"\s+", " "))
    first = figures.withColumn("caption", plain).filter(F.col("caption").rlike(caption)).groupBy("paper_id").agg(F.min_by(F.struct("href", "caption"), F.struct("pos", "href", "caption")).alias("f"))
    name = F.when(F.col("f.href").rlike(r"(?i)\.(jpe?g|png|gif|tiff?)$"), F.col("f.href")).otherwise(F.concat(F.col("f.href"), F.lit(".jpg")))
    picked = first.select("paper_id", name.alias("name"), F.left(F.col("f.caption"), F.lit(600)).alias("caption"))
    held = files.select("paper_id", "file", F.substring_index("file", "/", -1).alias("name"))
    return picked.join(held, ["paper_id", "name"]).groupBy("paper_id", "name", "caption").agg(F.max("file").alias("file"))
