"""Queries of overviews, reports against gold, and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.operators import overviews, review
from bibloom.plans import figures
from bibloom.plans import tables as table_queries
from bibloom.plans.reports import WALK
from bibloom.sources.recipes import run, table, with_recipes

_NAMES = ("edges", "seeds", "papers", "resolutions")
RUNS = "SELECT paper_id AS run, CASE WHEN seq % 5 > 0 THEN 'completed' ELSE 'failed' END AS status, CAST(2010 AS INTEGER) AS created_year, year AS seed_year, CAST(seq % 3 AS INTEGER) AS n_warnings FROM papers WHERE seq % 2 = 0"
RUN_EDGES = "SELECT source_paper_id AS run, target_paper_id AS paper_id, confidence FROM edges WHERE seq % 4 > 0"
RUN_PAPERS = f"SELECT paper_id AS run, paper_id FROM papers WHERE seq % 6 > 0 UNION ALL SELECT run, paper_id FROM ({RUN_EDGES}) e"
RUN_SIZES = f"SELECT run, r.paper_id, CASE WHEN r.status = 'ambiguous' AND confidence < 0.3 THEN 'low_confidence' ELSE r.status END AS status, confidence FROM ({RUN_PAPERS}) p JOIN resolutions r ON r.paper_id = p.paper_id"
RUN_SETS = f"SELECT run, CASE WHEN r.n_eff % 2 = 0 THEN 'missing' ELSE 'resolved' END AS status FROM ({RUN_PAPERS}) p JOIN resolutions r ON r.paper_id = p.paper_id WHERE n_eff % 3 = 0"


def d5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview of every second paper's run."""
    t = lambda q: run(spark, sf_dir, q, *_NAMES)
    runs = t(RUNS).withColumn("warnings", F.when(F.col("n_warnings") > 0, F.array_repeat(F.lit("said"), F.col("n_warnings"))))
    return overviews.run_overview(runs, t(RUN_PAPERS), t(RUN_EDGES), t(RUN_SIZES), t(RUN_SETS), t(RUN_EDGES).withColumnRenamed("confidence", "score"))


D5_RUNS_SQL = with_recipes(f"""WITH r AS ({RUNS}), p AS (SELECT run, count(*) AS papers FROM ({RUN_PAPERS}) a GROUP BY 1), e AS (SELECT run, count(*) AS edges, max(confidence) AS top FROM ({RUN_EDGES}) a GROUP BY 1), d AS (SELECT run, count(*) FILTER (status <> 'missing') AS technical FROM ({RUN_SETS}) a GROUP BY 1),
z AS (SELECT run, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status IN ('ambiguous', 'low_confidence')) AS ambiguous, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'not_applicable') AS na, avg(confidence) FILTER (status IN ('resolved', 'ambiguous')) AS mc FROM ({RUN_SIZES}) a GROUP BY 1),
j AS (SELECT r.*, coalesce(papers, 0) AS papers, coalesce(edges, 0) AS edges, coalesce(resolved, 0) AS resolved, coalesce(ambiguous, 0) AS ambiguous, coalesce(missing, 0) AS missing, coalesce(na, 0) AS not_applicable, coalesce(technical, 0) AS technical, mc, top FROM r LEFT JOIN p USING (run) LEFT JOIN e USING (run) LEFT JOIN z USING (run) LEFT JOIN d USING (run))
SELECT run, papers, edges, resolved, ambiguous, missing, not_applicable, technical, round(mc, 9) AS mean_confidence, round(top, 9) AS top_score, n_warnings AS warnings, status = 'completed' AND papers = 1 AND edges = 0 AS no_links, coalesce(seed_year BETWEEN 2009 AND 2010, false) AS recent_seed,
 papers > 0 AS metadata_done, edges > 0 AS citations_done, resolved + ambiguous + technical > 0 AS evidence_done, edges > 0 AND papers > 1 AS graph_done, edges > 0 AS ranking_done FROM j""", *_NAMES)  # fmt: skip
HELD = "SELECT journal, paper_id, CASE WHEN seq % 3 = 0 THEN title WHEN seq % 3 = 1 THEN '' END AS abstract, seq % 4 = 0 AS from_full_text FROM papers"


def d6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = run(spark, sf_dir, "SELECT p.journal, r.paper_id, r.status FROM resolutions r JOIN papers p ON p.paper_id = r.paper_id", "papers", "resolutions")
    return overviews.population_counts(sizes, run(spark, sf_dir, HELD, "papers"), "journal")


D6_COUNTS_SQL = with_recipes(f"""WITH h AS ({HELD}), n AS (SELECT journal, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in overviews.STATUSES)}, count(*) FILTER (status = 'missing' AND coalesce(abstract, '') = '') AS missing_without_abstract FROM resolutions r JOIN h USING (paper_id) GROUP BY journal),
f AS (SELECT journal, count(*) FILTER (from_full_text) AS recovered_from_full_text FROM h GROUP BY 1) SELECT f.*, {', '.join(f'coalesce({s}, 0) AS {s}' for s in (*overviews.STATUSES, 'missing_without_abstract'))} FROM f LEFT JOIN n USING (journal)""", "papers", "resolutions")  # fmt: skip
PAIRS = "SELECT r.paper_id, n_eff AS gold, CASE WHEN seq % 3 = 0 THEN n_eff WHEN seq % 3 = 1 THEN n_eff + 1 END AS predicted, CASE WHEN seq % 4 > 0 THEN 'TOTAL_ENROLLED' END AS gold_type, CASE WHEN seq % 9 > 0 THEN 'TOTAL_ENROLLED' ELSE 'ARM_SIZE' END AS predicted_type, r.confidence FROM resolutions r JOIN papers p ON p.paper_id = r.paper_id"


def d9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overviews.detection_report(run(spark, sf_dir, PAIRS, "papers", "resolutions"))
    return found.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


D9_REPORT_SQL = with_recipes(f"""WITH q AS ({PAIRS}), n AS (SELECT count(*) FILTER (gold IS NOT NULL AND predicted IS NOT NULL) AS tp, count(*) FILTER (gold IS NULL AND predicted IS NOT NULL) AS fp, count(*) FILTER (gold IS NULL AND predicted IS NULL) AS tn, count(*) FILTER (gold IS NOT NULL AND predicted IS NULL) AS fn, count(*) FILTER (gold = predicted) AS exact,
 count(*) FILTER (gold = predicted AND gold_type IS NOT NULL) AS type_total, count(*) FILTER (gold = predicted AND gold_type = predicted_type) AS type_correct, round(avg(confidence) FILTER (gold = predicted), 3) AS confidence_when_right, round(avg(confidence) FILTER (gold <> predicted), 3) AS confidence_when_wrong FROM q),
r AS (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall FROM n)
SELECT tp, fp, tn, fn, exact, round(precision, 9) AS precision, round(recall, 9) AS recall, round(tn / nullif(tn + fp, 0)::DOUBLE, 9) AS specificity, round((tp + tn) / nullif(tp + fp + tn + fn, 0)::DOUBLE, 9) AS accuracy, round(exact / nullif(tp, 0)::DOUBLE, 9) AS value_accuracy, round(2 * precision * recall / nullif(precision + recall, 0), 9) AS f1,
 type_total, type_correct, confidence_when_right, confidence_when_wrong, round(type_correct / nullif(type_total, 0)::DOUBLE, 9) AS type_accuracy FROM r""", "papers", "resolutions")  # fmt: skip
ANSWERS = "SELECT concat('10.1/A', seq) AS wanted_doi, seq % 7 > 0 AS found, CASE WHEN seq % 5 > 0 THEN concat('10.1/a', seq) END AS doi, CASE seq % 11 WHEN 0 THEN 'Unknown Title' WHEN 1 THEN NULL ELSE title END AS title, year, CASE WHEN seq % 3 > 0 THEN journal END AS journal, CAST(seq % 4 AS INTEGER) AS n_people, CASE WHEN seq % 6 > 1 THEN title WHEN seq % 6 = 1 THEN '' END AS abstract, seq % 8 = 0 AS backfilled FROM papers"


def d12_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = run(spark, sf_dir, ANSWERS, "papers").withColumn("authors", F.when(F.col("n_people") > 0, F.array_repeat(F.lit("A B"), F.col("n_people"))))
    return overviews.completeness_report(answers)


D12_REPORT_SQL = with_recipes(f"""WITH a AS ({ANSWERS}), n AS (SELECT count(*) AS attempted, count(*) FILTER (found) AS resolved, count(*) FILTER (found AND lower(doi) = lower(wanted_doi)) AS doi_match, count(*) FILTER (found AND title <> 'Unknown Title') AS t, count(*) FILTER (found AND year IS NOT NULL) AS y, count(*) FILTER (found AND journal IS NOT NULL) AS j, count(*) FILTER (found AND n_people > 0) AS p, count(*) FILTER (found AND abstract <> '') AS b, count(*) FILTER (backfilled) AS backfilled FROM a)
SELECT attempted, resolved, round(resolved / attempted::DOUBLE, 9) AS resolution_rate, doi_match, round(doi_match / attempted::DOUBLE, 9) AS doi_match_rate, round(t / resolved::DOUBLE, 9) AS title, round(y / resolved::DOUBLE, 9) AS year, round(j / resolved::DOUBLE, 9) AS journal, round(p / resolved::DOUBLE, 9) AS authors, round(b / resolved::DOUBLE, 9) AS abstract, backfilled FROM n""", "papers")  # fmt: skip
CITED = "SELECT concat(CASE WHEN l_linenumber % 2 = 0 THEN '10.1/A' ELSE '10.1/a' END, l_partkey) AS doi, l_orderkey * 10 + l_linenumber AS seq FROM lineitem"
RECORDS = "SELECT concat('10.1/A', p_partkey) AS doi, p_name AS title, CAST(p_size AS INTEGER) AS n_people, CAST(2 AS INTEGER) AS seq, p_partkey AS k FROM part UNION ALL SELECT concat('10.1/a', p_partkey), concat('earlier ', p_name), CAST(3 AS INTEGER), CAST(1 AS INTEGER), p_partkey FROM part WHERE p_partkey % 4 = 0"


def c13_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, RECORDS).withColumn("authors", F.transform(F.sequence(F.lit(1), F.col("n_people")), lambda i: F.concat(F.lit("Author "), i)))
    return overviews.catalogue(run(spark, sf_dir, CITED), rows.filter("k % 3 = 0"), rows.filter("k % 5 > 0"))


C13_CATALOGUE_SQL = f"""WITH c AS (SELECT lower(doi) AS doi, min(seq) AS seq FROM ({CITED}) x GROUP BY 1), r AS ({RECORDS}), a AS (SELECT lower(doi) AS doi, arg_min(title, seq) AS title, arg_min(n_people, seq) AS n FROM r WHERE k % 3 = 0 GROUP BY 1), b AS (SELECT lower(doi) AS doi, arg_min(title, seq) AS title, arg_min(n_people, seq) AS n FROM r WHERE k % 5 > 0 GROUP BY 1),
j AS (SELECT c.doi, c.seq, coalesce(a.title, b.title) AS title, coalesce(a.n, b.n) AS n, CASE WHEN a.doi IS NOT NULL THEN 'crossref' WHEN b.doi IS NOT NULL THEN 'openalex' END AS source FROM c LEFT JOIN a ON a.doi = c.doi LEFT JOIN b ON b.doi = c.doi)
SELECT doi, seq, title, CASE WHEN source IS NOT NULL THEN list_transform(range(1, least(12, n) + 1), lambda i: concat('Author ', i)) END AS authors, source, CASE WHEN source IS NULL THEN 'unverified' ELSE 'verified' END AS status FROM j"""


def c18_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge at either end of the seeds."""
    edges = table(spark, sf_dir, "edges").select("source_paper_id", "target_paper_id", "confidence")
    return overviews.edges_at(table(spark, sf_dir, "seeds").select(F.col("seed_id").alias("paper_id")), edges)


C18_EDGES_SQL = with_recipes("SELECT seed_id AS paper_id, 'cites' AS direction, source_paper_id, target_paper_id, confidence FROM seeds JOIN edges ON source_paper_id = seed_id UNION ALL SELECT seed_id, 'cited_by', source_paper_id, target_paper_id, confidence FROM seeds JOIN edges ON target_paper_id = seed_id", "edges", "seeds")


def d16_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge weights of each seed's citations, and how much of the first ten scores is influence (scores of a fixed recipe)."""
    walk = run(spark, sf_dir, WALK, *_NAMES)
    edges = walk.select("seed_id", F.when(F.col("rank") % 3 > 0, F.col("link")).alias("weight"))
    age, score = (F.col("seq") % 20) / 20.0, 0.5 * F.col("link") + 0.3 * (F.col("seq") % 20) / 20.0
    found = overviews.influence_report(edges, walk.select("seed_id", "rank", F.col("link").alias("influence"), age.alias("age"), score.alias("score")))
    return found.select("seed_id", "weights", *[F.round(c, 9).alias(c) for c, t in found.dtypes if t == "double"])


D16_INFLUENCE_SQL = with_recipes(f"""WITH w AS (SELECT *, CASE WHEN rank % 3 > 0 THEN link ELSE 1::DOUBLE END AS weight, (seq % 20) / 20.0::DOUBLE AS age, 0.5::DOUBLE * link + 0.3::DOUBLE * (seq % 20) / 20.0::DOUBLE AS score FROM ({WALK}) x)
SELECT seed_id, count(DISTINCT round(weight, 6)) AS weights, round(min(weight), 9) AS least_weight, round(median(weight), 9) AS median_weight, round(max(weight), 9) AS greatest_weight, round(median(0.5::DOUBLE * link / score) FILTER (rank <= 10), 9) AS median_share, round(max(0.5::DOUBLE * link / score) FILTER (rank <= 10), 9) AS greatest_share, round(median(0.3::DOUBLE * age), 9) AS median_age_term FROM w GROUP BY seed_id""", *_NAMES)  # fmt: skip


SORTS = {"year": False, "confidence": True, "citations": True, "title": False}
SORTED = "SELECT p.paper_id, title, year, r.confidence, CASE WHEN p.seq % 3 > 0 THEN n END AS citations FROM papers p LEFT JOIN resolutions r ON r.paper_id = p.paper_id LEFT JOIN (SELECT target_paper_id AS id, count(*) AS n FROM edges GROUP BY 1) c ON id = p.paper_id"


def b16_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of 50 papers in each order of the metadata table."""
    rows = run(spark, sf_dir, SORTED, *_NAMES)
    pages = [overviews.page(rows, by, 50, down).select(F.lit(by).alias("sorted_by"), "place", "paper_id") for by, down in SORTS.items()]
    return pages[0].union(pages[1]).union(pages[2]).union(pages[3])


B16_PAGES_SQL = with_recipes(f"WITH r AS ({SORTED}) " + " UNION ALL ".join(
    f"SELECT '{by}' AS sorted_by, place, paper_id FROM (SELECT paper_id, CAST(row_number() OVER (ORDER BY {'lower(title)' if by == 'title' else f'coalesce({by}, 0)'} {'DESC' if down else 'ASC'}, paper_id) AS INTEGER) AS place FROM r) x WHERE place <= 50" for by, down in SORTS.items()
), *_NAMES)


PAGE = "SELECT p.paper_id, year, n_eff, CASE WHEN p.seq % 3 > 0 THEN p.seq END AS technical_value, CASE WHEN p.seq % 5 > 0 THEN CAST(p.seq % 10 AS DOUBLE) / CAST(10 AS DOUBLE) END AS metadata_confidence FROM papers p LEFT JOIN resolutions r ON r.paper_id = p.paper_id"
PAGE_EDGES = "SELECT source_paper_id, target_paper_id, confidence, CASE WHEN seq % 4 > 0 THEN confidence / 2 END AS final_weight FROM edges"


def b14_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a graph page under a seed in computer science, with sure metadata."""
    _, strong = overviews.graph_page(run(spark, sf_dir, PAGE, "papers", "resolutions"), run(spark, sf_dir, PAGE_EDGES, "edges"), (1975, 2012), True, True, True, 0.92, 0.4)
    return strong


B14_PAGE_SQL = with_recipes(f"""WITH v AS (SELECT paper_id FROM ({PAGE}) x WHERE (year IS NULL OR year BETWEEN 1975 AND 2012) AND technical_value IS NOT NULL AND metadata_confidence >= 0.75)
SELECT * FROM ({PAGE_EDGES}) e WHERE confidence >= 0.92 AND final_weight >= 0.4 AND source_paper_id IN (SELECT paper_id FROM v) AND target_paper_id IN (SELECT paper_id FROM v)""", "papers", "resolutions", "edges")


def d15_rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right readings by the answer key, and without the values that the decisions call ambiguous."""
    decided = run(spark, sf_dir, figures.DECIDED).withColumnRenamed("figure", "paper_id")
    return overviews.rescored(figures._outcomes(spark, sf_dir), decided, review.DECISIVE)


D15_RESCORED_SQL = f"""{figures.D13_SQL[: figures.D13_SQL.index('SELECT stage, count(gold) AS n')].replace('SELECT g.stage,', 'SELECT g.paper_id, g.stage,', 1)},
u AS (SELECT DISTINCT figure, stage FROM ({figures.DECIDED}) x WHERE decision = 'ambiguous'), s AS (SELECT o.*, u.figure IS NOT NULL AS unclear FROM o LEFT JOIN u ON u.figure = o.paper_id AND u.stage = o.stage WHERE gold IS NOT NULL AND o.stage <> 'screened')
SELECT 'original_key' AS scoring, count(*) FILTER (vr) AS vision, count(*) FILTER (tr) AS text, count(*) AS n FROM s UNION ALL SELECT 'ambiguous_unscored', count(*) FILTER (vr), count(*) FILTER (tr), count(*) FROM s WHERE NOT unclear"""


def d13_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overviews.reading_times(run(spark, sf_dir, "SELECT round(CAST(l_quantity AS DOUBLE) / 7, 2) AS seconds FROM lineitem"))


def d18_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight matches of each pattern; line numbers are tested apart from the SQL."""
    return overviews.first_hits(table(spark, sf_dir, "documents"), "doc_id", table_queries.PATTERNS).drop("line")


D18_HITS_SQL = f"WITH p AS (SELECT doc_id, {table_queries._PLAIN} AS plain FROM documents), " + "h AS (" + " UNION ALL ".join(f"SELECT '{n}' AS pattern, '{t}' AS tag, doc_id, unnest(regexp_extract_all(plain, '{x}')) AS v, generate_subscripts(regexp_extract_all(plain, '{x}'), 1) AS k FROM p" for n, (t, x) in table_queries.PATTERNS.items()) + r"""), r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY doc_id, k) AS place FROM h)
SELECT pattern, tag, place::INTEGER AS place, doc_id, left(trim(regexp_replace(v, '\s+', ' ', 'g')), 70) AS snippet FROM r WHERE place <= 8"""


def queries() -> dict:
    return {"d5_run_overview": d5_runs, "d6_population_counts": d6_counts, "d9_detection_report": d9_report, "d12_completeness_report": d12_report, "d16_influence_report": d16_influence, "c13_catalogue": c13_catalogue, "c18_edges_at": c18_edges, "b16_sorted_pages": b16_pages, "b14_graph_page": b14_page, "d13_reading_times": d13_times, "d15_rescored": d15_rescored, "d18_first_hits": d18_hits}


def oracle_sql() -> dict:
    return {"d5_run_overview": D5_RUNS_SQL, "d6_population_counts": D6_COUNTS_SQL, "d9_detection_report": D9_REPORT_SQL, "d12_completeness_report": D12_REPORT_SQL, "d16_influence_report": D16_INFLUENCE_SQL, "c13_catalogue": C13_CATALOGUE_SQL, "c18_edges_at": C18_EDGES_SQL, "b16_sorted_pages": B16_PAGES_SQL, "b14_graph_page": B14_PAGE_SQL, "d13_reading_times": "WITH q AS (SELECT round(CAST(l_quantity AS DOUBLE) / 7, 2) AS s FROM lineitem), o AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM q) SELECT max(s) FILTER (i = n // 2) AS median, max(s) AS most FROM o", "d15_rescored": D15_RESCORED_SQL, "d18_first_hits": D18_HITS_SQL}
