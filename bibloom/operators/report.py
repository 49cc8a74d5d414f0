"""A run's report as Markdown: lines by section and number, a document a seed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.functions.storage import written
from bibloom.operators.views import markdown_cell

#: Sections in the order of the document
SECTIONS = ("head", "summary", "foundational", "datasets", "populations", "paths", "end")
TOP_PATHS = 5
NONE = "—"


def _cell(value: Column) -> Column:
    """A table cell; a dash for null."""
    return F.when(value.isNull(), NONE).otherwise(markdown_cell(value.cast("string")))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _lines(df: DataFrame, section: str, parts: list[Column]) -> DataFrame:
    """Each row's lines, null ones left out; rows follow ``seq``."""
    rows = df.select("seed_id", F.col("seq").cast("long").alias("n"), F.posexplode(F.array_compact(F.array(*parts))).alias("k", "line"))
    return rows.select("seed_id", F.lit(SECTIONS.index(section)).alias("part"), F.lit(section).alias("section"), "n", F.col("k").cast("long").alias("k"), "line")


def _fixed(df: DataFrame, section: str, n: int, *lines: str) -> DataFrame:
    return _lines(df.select("seed_id", F.lit(n).alias("seq")), section, [F.lit(x) for x in lines])


def report_lines(seeds: DataFrame, papers: DataFrame, edges: DataFrame, ranked: DataFrame, resolutions: DataFrame, datasets: DataFrame, paths: DataFrame) -> DataFrame:
    """(seed_id, part, section, n, k, line) of every seed's report; its lines stand in the order of part, n and k.

    seeds: seed_id, run_id, generated, title, authors, journal, year. Others by seed_id: papers; edges; ranked (rank,
    title, year, score, n_eff); resolutions (paper_id, title, n_eff, semantic_type, status, confidence); datasets
    (paper_id, title, value, unit, kind, status, confidence); paths (rank, titles, score): tables, as each is read
    two or three times. A section without rows says so or is left out.
    """
    count = lambda df, name, c=F.lit(1): df.groupBy("seed_id").agg(F.count(c).alias(name))
    sized = resolutions.filter("n_eff is not null")
    counts = [count(papers, "papers"), count(edges, "edges"), count(sized, "sized"), count(resolutions.filter("status <> 'not_applicable'"), "applicable"), count(datasets, "data"), count(datasets.filter("value is not null"), "counted"), count(ranked, "ranked"), count(paths, "paths")]
    # a row a seed, read by most of the parts below
    wide = written(reduce(lambda a, b: a.join(b, "seed_id", "left"), counts, seeds).na.fill(0).withColumn("seq", F.lit(0)))
    n = lambda c: F.col(c).cast("string")
    byline = F.concat(F.array_join(F.slice("authors", 1, 4), ", "), F.when(F.size("authors") > 4, " et al.").otherwise(""))
    venue = F.concat_ws(" · ", F.nullif("journal", F.lit("")), F.nullif("year", F.lit(0)).cast("string"))
    head = [F.lit("# Citation analysis"), F.lit(""), F.concat(F.lit("## "), _cell(F.col("title"))), F.when(byline != "", F.concat(F.lit("*"), markdown_cell(byline), F.lit("*"))), F.when(venue != "", markdown_cell(venue)), F.lit("")]
    facts = [F.concat(F.lit(f"- **{name}**: "), value) for name, value in (("Run", F.concat(F.lit("`"), "run_id", F.lit("`"))), ("Seed paper", F.concat(F.lit("`"), "seed_id", F.lit("`"))), ("Generated", F.col("generated")))]
    metrics = (("Papers in graph", n("papers")), ("Citation edges", n("edges")), ("Papers with a study size", F.concat(n("sized"), F.lit(" of "), n("applicable"), F.lit(" applicable"))), ("Papers with dataset counts", F.concat(n("counted"), F.lit(" of "), n("data"))), ("Foundational candidates", n("ranked")), ("Citation paths", n("paths")))
    summary = [F.lit(x) for x in ("## Summary", "", "| Metric | Value |", "| --- | --- |")] + [_row(F.lit(name), value) for name, value in metrics] + [F.lit("")]
    score = lambda c: F.format_string("%.3f", F.coalesce(c, F.lit(0.0)))
    first = lambda df, order: df.withColumn("seq", F.row_number().over(Window.partitionBy("seed_id").orderBy(*order)))
    ranks = ranked.withColumn("seq", F.col("rank"))
    positive = lambda c: F.coalesce(F.nullif(c, F.lit(0)).cast("string"), F.lit(NONE))
    sizes = first(sized, [F.desc("n_eff"), "paper_id"])
    named = F.when(F.coalesce("title", F.lit("")) != "", markdown_cell(F.col("title"))).otherwise(F.concat(F.lit("`"), "paper_id", F.lit("`")))
    empty = wide.select("seed_id", "sized", "applicable", "ranked")
    some = lambda c: wide.filter(F.col(c) > 0)
    step = F.transform("titles", lambda t, i: F.concat(F.when(i == 0, "   - ").otherwise("   - → "), _cell(t)))
    top = paths.filter(F.col("rank") <= TOP_PATHS).withColumn("seq", F.col("rank"))
    hop = F.concat(n("rank"), F.lit(". **score "), score(F.col("score")), F.lit("** ("), (F.size("titles") - 1).cast("string"), F.lit(" hops)"))
    parts = [
        _lines(wide, "head", [*head, *facts, F.lit("")]), _lines(wide, "summary", summary),
        _fixed(wide, "foundational", 0, "## Probable foundational papers", ""), _fixed(some("ranked"), "foundational", 0, "| Rank | Title | Year | Score | Study size |", "| ---: | --- | ---: | ---: | ---: |").withColumn("k", F.col("k") + 2),
        _lines(ranks, "foundational", [_row(n("rank"), _cell(F.col("title")), positive(F.col("year")), score(F.col("score")), positive(F.col("n_eff")))]),
        _fixed(empty.filter("ranked = 0"), "foundational", 1, "_No candidates were ranked._"), _fixed(wide, "foundational", 1 << 40, ""),
        _fixed(some("data"), "datasets", 0, "## Dataset evidence", "", "Dataset counts are no study sizes and weigh no ranking.", "", "| Paper | Count | Unit | Kind | Status | Confidence |", "| --- | ---: | --- | --- | --- | ---: |"),
        _lines(first(datasets, ["paper_id"]), "datasets", [_row(_cell(F.coalesce("title", "paper_id")), _cell(F.col("value")), _cell(F.col("unit")), _cell(F.col("kind")), F.col("status"), F.format_string("%.2f", "confidence"))]),
        _fixed(some("data"), "datasets", 1 << 40, ""),
        _fixed(wide, "populations", 0, "## Population evidence", ""), _fixed(some("sized"), "populations", 0, "| Paper | N | Type | Status | Confidence |", "| --- | ---: | --- | --- | ---: |").withColumn("k", F.col("k") + 2),
        _lines(sizes, "populations", [_row(named, n("n_eff"), F.coalesce(F.nullif("semantic_type", F.lit("")), F.lit(NONE)), F.col("status"), F.format_string("%.2f", "confidence"))]),
        _fixed(empty.filter("sized = 0 and applicable = 0"), "populations", 1, "_Study sizes do not apply to these papers._"),
        _fixed(empty.filter("sized = 0 and applicable > 0"), "populations", 1, "_No study sizes were found; edges have a uniform weight._"), _fixed(wide, "populations", 1 << 40, ""),
        _fixed(some("paths"), "paths", 0, "## Top citation paths", ""),
        _lines(top, "paths", [hop]),
        top.select("seed_id", F.lit(SECTIONS.index("paths")).alias("part"), F.lit("paths").alias("section"), F.col("rank").cast("long").alias("n"), F.posexplode(F.concat(step, F.array(F.lit("")))).alias("k", "line")).withColumn("k", F.col("k").cast("long") + 1),
        _fixed(wide, "end", 0, "---", "", "_Rankings are probable, not certain. Read the papers before citing them._"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def documents(lines: DataFrame) -> DataFrame:
    """(seed_id, document): a report's lines in one text. A report holds a bounded walk's papers; exports.write_documents writes larger ones by line."""
    whole = F.array_sort(F.collect_list(F.struct("part", "n", "k", "line")))
    return lines.groupBy("seed_id").agg(F.array_join(F.transform(whole, lambda x: x["line"]), "\n").alias("document"))
