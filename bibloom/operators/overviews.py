"""A run at a glance: counts, completeness, scores against gold, and lookups by paper."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.functions.spans import PLACES, literal, places
from bibloom.operators.evaluate import detection_scores
from bibloom.operators.tables import plain_prose

STATUSES = ("resolved", "ambiguous", "missing", "low_confidence", "not_applicable")
UNKNOWN_TITLE = "Unknown Title"
MOST_AUTHORS = 12


def _by_run(df: DataFrame, **aggregates: Column) -> DataFrame:
    return df.groupBy("run").agg(*[c.alias(name) for name, c in aggregates.items()])


def run_overview(runs: DataFrame, papers: DataFrame, edges: DataFrame, resolutions: DataFrame, datasets: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row a run: counts, mean confidence, best score, flags, and which steps are done.

    runs: run, status, created_year, seed_year, warnings (array); the others by run: papers; edges; resolutions and
    datasets (status, confidence); ranked (score).
    """
    status = lambda *s: F.count_if(F.col("status").isin(*s))
    told = F.when(F.col("status").isin("resolved", "ambiguous"), F.col("confidence"))
    parts = [
        _by_run(papers, papers=F.count(F.lit(1))), _by_run(edges, edges=F.count(F.lit(1))),
        _by_run(resolutions, resolved=status("resolved"), ambiguous=status("ambiguous", "low_confidence"), missing=status("missing"), not_applicable=status("not_applicable"), mean_confidence=F.avg(told)),
        _by_run(datasets, technical=F.count_if(F.col("status") != "missing")), _by_run(ranked, top_score=F.max("score"), ranked=F.count(F.lit(1))),
    ]
    counts = ["papers", "edges", "resolved", "ambiguous", "missing", "not_applicable", "technical", "ranked"]
    wide = reduce(lambda a, b: a.join(b, "run", "left"), parts, runs).na.fill(0, counts)
    evidence = F.col("resolved") + F.col("ambiguous") + F.col("technical")
    return wide.select(
        "run", *counts[:-1], F.round("mean_confidence", 9).alias("mean_confidence"), F.round("top_score", 9).alias("top_score"), F.size(F.coalesce("warnings", F.array().cast("array<string>"))).alias("warnings"),
        ((F.col("status") == "completed") & (F.col("papers") == 1) & (F.col("edges") == 0)).alias("no_links"),
        F.coalesce(F.col("seed_year").between(F.col("created_year") - 1, F.col("created_year")), F.lit(False)).alias("recent_seed"),
        (F.col("papers") > 0).alias("metadata_done"), (F.col("edges") > 0).alias("citations_done"), (evidence > 0).alias("evidence_done"),
        ((F.col("edges") > 0) & (F.col("papers") > 1)).alias("graph_done"), (F.col("ranked") > 0).alias("ranking_done"),
    )


def population_counts(resolutions: DataFrame, papers: DataFrame, group: str) -> DataFrame:
    """A column for each status, 0 where there is none; missing ones without an abstract, and papers whose size came from the full text.

    resolutions: group, paper_id, status; papers: group, paper_id, abstract, from_full_text.
    """
    known = papers.select(group, "paper_id", (F.coalesce("abstract", F.lit("")) != "").alias("has_abstract"))
    joined = resolutions.join(known, [group, "paper_id"], "left")
    bare = F.count_if((F.col("status") == "missing") & ~F.coalesce("has_abstract", F.lit(False)))
    counts = joined.groupBy(group).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], bare.alias("missing_without_abstract"))
    found = papers.groupBy(group).agg(F.count_if("from_full_text").alias("recovered_from_full_text"))
    return found.join(counts, group, "left").na.fill(0)


def detection_report(pairs: DataFrame) -> DataFrame:
    """``detection_scores`` and more over pairs (gold, predicted, gold_type, predicted_type, confidence): types among exact values, confidence of right and wrong ones."""
    exact = F.coalesce(F.col("gold") == F.col("predicted"), F.lit(False))
    typed = exact & (F.coalesce("gold_type", F.lit("")) != "")
    asked = F.col("gold").isNotNull() & F.col("predicted").isNotNull()
    more = pairs.agg(
        F.count_if(typed).alias("type_total"), F.count_if(typed & (F.col("gold_type") == F.col("predicted_type"))).alias("type_correct"),
        F.round(F.avg(F.when(asked & exact, F.col("confidence"))), 3).alias("confidence_when_right"), F.round(F.avg(F.when(asked & ~exact, F.col("confidence"))), 3).alias("confidence_when_wrong"),
    )
    rate = F.try_divide(F.col("type_correct").cast("double"), F.col("type_total").cast("double"))
    return detection_scores(pairs).join(more.withColumn("type_accuracy", rate))  # one row each


def completeness_report(answers: DataFrame) -> DataFrame:
    """One row over answers (wanted_doi, found, doi, title, year, journal, authors, abstract, backfilled): how many resolve, and fields among those that do."""
    found = F.coalesce("found", F.lit(False))
    has = {
        "title": (F.coalesce("title", F.lit("")) != "") & (F.col("title") != UNKNOWN_TITLE), "year": F.coalesce("year", F.lit(0)) != 0, "journal": F.coalesce("journal", F.lit("")) != "",
        "authors": F.coalesce(F.size("authors"), F.lit(0)) > 0, "abstract": F.coalesce("abstract", F.lit("")) != "",
    }
    match = found & (F.lower(F.coalesce("doi", F.lit(""))) == F.lower("wanted_doi"))
    counts = answers.agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(found).alias("resolved"), F.count_if(match).alias("doi_match"),
        *[F.count_if(found & c).alias(f"n_{name}") for name, c in has.items()], F.count_if("backfilled").alias("backfilled"),
    )
    share = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 9)
    return counts.select("attempted", "resolved", share("resolved", "attempted").alias("resolution_rate"), "doi_match", share("doi_match", "attempted").alias("doi_match_rate"), *[share(f"n_{name}", "resolved").alias(name) for name in has], "backfilled")


def influence_report(edges: DataFrame, scored: DataFrame, n: int = 10) -> DataFrame:
    """One row a seed: its edges' weights, and the part of the influence term (0.5 x influence) in the scores of its first n papers.

    edges: seed_id, weight; scored: seed_id, rank, influence, age, score.
    """
    w = F.coalesce("weight", F.lit(1.0))
    weights = edges.groupBy("seed_id").agg(F.min(w).alias("least_weight"), F.percentile(w, 0.5).alias("median_weight"), F.max(w).alias("greatest_weight"), F.count_distinct(F.round(w, 6)).alias("weights"))
    part = F.when(F.col("rank") <= n, F.try_divide(0.5 * F.col("influence"), F.col("score")))
    shares = scored.groupBy("seed_id").agg(F.percentile(part, 0.5).alias("median_share"), F.max(part).alias("greatest_share"), F.percentile(0.3 * F.col("age"), 0.5).alias("median_age_term"))
    return weights.join(shares, "seed_id", "left")


def catalogue(cited: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct DOIs of cited (doi, seq) with the first record (doi, title, authors, seq) of the first catalogue, else of the second; at most 12 authors."""
    wanted = cited.groupBy(F.lower("doi").alias("doi")).agg(F.min("seq").alias("seq"))
    record = F.struct("title", F.slice(F.coalesce("authors", F.array().cast("array<string>")), 1, MOST_AUTHORS).alias("authors"))
    side = lambda t, name: t.groupBy(F.lower("doi").alias("doi")).agg(F.min_by(record, "seq").alias(name))
    joined = wanted.join(side(first, "c"), "doi", "left").join(side(second, "o"), "doi", "left")
    source = F.when(F.col("c").isNotNull(), "crossref").when(F.col("o").isNotNull(), "openalex")
    best = F.coalesce("c", "o")
    return joined.select("doi", "seq", best["title"].alias("title"), best["authors"].alias("authors"), source.alias("source"), F.when(source.isNotNull(), "verified").otherwise("unverified").alias("status"))


def edges_at(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """(paper_id, direction, and the edge): every edge at either end of the papers given."""
    end = lambda c, way: edges.join(papers.select(F.col("paper_id").alias(c)).distinct(), c, "left_semi").select(F.col(c).alias("paper_id"), F.lit(way).alias("direction"), *edges.columns)
    return end("source_paper_id", "cites").unionByName(end("target_paper_id", "cited_by"))


def page(rows: DataFrame, by: str, n: int, descending: bool = False) -> DataFrame:
    """The first n rows (paper_id, ...) of a table sorted by year, confidence, citations or title, with their place; unknown numbers count as 0."""
    value = F.lower(F.coalesce("title", F.lit(""))) if by == "title" else F.coalesce(F.col(by), F.lit(0))
    order = (value.desc() if descending else value.asc(), F.col("paper_id"))
    return rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # n rows


def graph_page(vertices: DataFrame, edges: DataFrame, years: tuple[int, int], hide_missing: bool, technical_seed: bool, sure: bool, least_confidence: float, least_weight: float) -> tuple[DataFrame, DataFrame]:
    """Papers of a graph page and the edges among them.

    vertices: paper_id, year (an unknown one passes), n_eff, technical_value, metadata_confidence. Under a seed in
    computer science (``technical_seed``) evidence means a dataset count instead of a study size; ``sure`` asks for
    metadata of 0.75 or more.
    """
    value = "technical_value" if technical_seed else "n_eff"
    kept = vertices.filter(F.col("year").isNull() | F.col("year").between(*years))
    kept = kept.filter(F.col(value).isNotNull()) if hide_missing else kept
    kept = kept.filter(F.coalesce("metadata_confidence", F.lit(0.0)) >= 0.75) if sure else kept
    strong = edges.filter((F.coalesce("confidence", F.lit(0.0)) >= least_confidence) & (F.coalesce("final_weight", F.lit(0.0)) >= least_weight))
    for side in ("source_paper_id", "target_paper_id"):
        strong = strong.join(kept.select(F.col("paper_id").alias(side)).distinct(), side, "left_semi")
    return kept, strong


def rescored(outcomes: DataFrame, decisions: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Two rows of right readings (vision, text, n) over the stated values of some stages: by the key as it is, and without those found ambiguous.

    outcomes: paper_id, stage, vision_outcome, text_outcome; decisions: paper_id, stage, decision.
    """
    unclear = decisions.filter("decision = 'ambiguous'").select("paper_id", "stage").distinct().withColumn("unclear", F.lit(True))
    scored = outcomes.filter((F.col("vision_outcome") != "not_stated") & F.col("stage").isin(*stages)).join(unclear, ["paper_id", "stage"], "left")
    keys = F.when(F.col("unclear"), F.array(F.lit("original_key"))).otherwise(F.array(F.lit("original_key"), F.lit("ambiguous_unscored")))
    right = lambda c: F.count_if(F.col(c) == "right")
    return scored.withColumn("scoring", F.explode(keys)).groupBy("scoring").agg(right("vision_outcome").alias("vision"), right("text_outcome").alias("text"), F.count(F.lit(1)).alias("n"))


def reading_times(rows: DataFrame) -> DataFrame:
    """One row over rows (seconds): the upper median, found by its place in an order of distinct values and their counts, and the greatest."""
    counts = rows.filter("seconds is not null").groupBy("seconds").agg(F.count(F.lit(1)).alias("n"))
    both = counts.agg(F.sum("n").alias("all"), F.max("seconds").alias("most"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("seconds")))  # readings have few distinct times, to the hundredth of a second
    middle = upto.join(both).filter(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("seconds").alias("median"))
    return middle.join(both.select("most"))


def first_hits(texts: DataFrame, key: str, patterns: dict[str, tuple[str, str]], n: int = 8) -> DataFrame:
    """(pattern, tag, place, key, line, snippet): of each pattern the first n matches in the order of the texts (key, text), outside code and link targets."""
    plain = texts.select(key, plain_prose(F.col("text")).alias("plain"))
    none = f"cast(array() AS {PLACES})"
    of = lambda name, p: f"struct({literal(name)} AS pattern, {literal(p[0])} AS tag, slice({places('plain', literal(p[1]))}, 1, {n}) AS found)"
    rows = plain.select(key, "plain", F.expr(f"explode(array({', '.join(of(name, p) for name, p in patterns.items())}))").alias("c"))
    hits = rows.select(key, "plain", "c.pattern", "c.tag", F.explode(F.coalesce("c.found", F.expr(none))).alias("m"))
    told = hits.select(
        "pattern", "tag", key, F.col("m.start").alias("start"), F.size(F.split(F.substring("plain", F.lit(1), F.col("m.start")), "\n", -1)).alias("line"),
        F.substring(F.trim(F.regexp_replace("m.value", r"\s+", " ")), 1, 70).alias("snippet"),
    )
    order = Window.partitionBy("pattern").orderBy(key, "start")
    return told.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).drop("start")
