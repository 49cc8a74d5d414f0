"""Queries of lookups, table views, summaries and figure layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.operators import evidence, layout, tables
from bibloom.plans.graph import F8_SQL, F9_SQL, f8, variant_ranks, weighted, WEIGHTED
from bibloom.sources.recipes import run, table, with_recipes

# --- aliases

KNOWN = """SELECT concat('P', p_partkey) AS paper_id, concat('10.1/A', p_partkey) AS doi, CASE WHEN p_partkey % 3 = 0 THEN concat('', p_partkey % 1500) END AS pmid,
    CASE WHEN p_partkey % 4 = 0 THEN concat('PMC', p_partkey) END AS pmcid, CASE WHEN p_partkey % 2 = 0 THEN concat('W', p_partkey) END AS openalex_id, p_partkey AS seq FROM part WHERE p_partkey % 5 > 0"""
WANTED = """SELECT l_orderkey AS ord, l_linenumber AS line, CASE l_linenumber % 5 WHEN 0 THEN concat('https://doi.org/10.1/a', l_partkey) WHEN 1 THEN concat('w', l_partkey)
    WHEN 2 THEN concat('pmc', l_partkey) WHEN 3 THEN concat('PMID:', l_partkey % 1500) ELSE ' ' END AS raw FROM lineitem"""
_ALIASES = f"""k AS ({KNOWN}), every AS (SELECT paper_id, seq, unnest([paper_id, lower(doi), pmid, pmcid, openalex_id]) AS alias FROM k),
aliases AS (SELECT alias, arg_min(paper_id, seq) AS paper_id FROM every WHERE alias IS NOT NULL GROUP BY alias),
w AS (SELECT ord, line, CASE line % 5 WHEN 0 THEN lower(substr(raw, 17)) WHEN 3 THEN substr(raw, 6) WHEN 4 THEN '' ELSE upper(raw) END AS alias FROM ({WANTED}) x)"""


def c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.resolved(run(spark, sf_dir, WANTED), tables.alias_table(run(spark, sf_dir, KNOWN))).select("ord", "line", "alias", "paper_id")


def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.unresolved(run(spark, sf_dir, WANTED), tables.alias_table(run(spark, sf_dir, KNOWN)))


C9_SQL = f"WITH {_ALIASES} SELECT ord, line, w.alias, a.paper_id FROM w LEFT JOIN aliases a ON a.alias = w.alias"
C12_SQL = f"WITH {_ALIASES} SELECT DISTINCT w.alias FROM w ANTI JOIN aliases a ON a.alias = w.alias WHERE w.alias <> ''"

CITED = "SELECT concat('10.1/', CASE WHEN l_linenumber % 2 = 0 THEN 'X' ELSE 'x' END, l_partkey) AS doi, l_orderkey * 10 + l_linenumber AS seq FROM lineitem"
CROSS = "SELECT concat('10.1/x', p_partkey) AS doi, p_name AS title FROM part WHERE p_partkey % 3 > 0"
OPEN = "SELECT concat('10.1/X', p_partkey) AS doi, p_type AS title FROM part WHERE p_partkey % 4 > 0"


def c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.verified_references(*[run(spark, sf_dir, q) for q in (CITED, CROSS, OPEN)])


C13_SQL = f"""WITH f AS (SELECT lower(doi) AS doi, min(seq) AS seq FROM ({CITED}) x GROUP BY 1), c AS ({CROSS}), o AS (SELECT lower(doi) AS doi, title FROM ({OPEN}) y)
SELECT f.doi, f.seq, coalesce(c.title, o.title) AS title, CASE WHEN c.title IS NOT NULL THEN 'crossref' WHEN o.title IS NOT NULL THEN 'openalex' END AS source, coalesce(c.title, o.title) IS NOT NULL AS verified
FROM f LEFT JOIN c ON c.doi = f.doi LEFT JOIN o ON o.doi = f.doi"""


def c18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.edges_of(table(spark, sf_dir, "seeds").select(F.col("seed_id").alias("paper_id")), table(spark, sf_dir, "edges"))


C18_SQL = with_recipes("SELECT seed_id AS paper_id, (SELECT count(*) FROM edges WHERE source_paper_id = seed_id) AS n_out, (SELECT count(*) FROM edges WHERE target_paper_id = seed_id) AS n_in FROM seeds", "edges", "seeds")


def c8_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar of all titles for each part's name."""
    p = table(spark, sf_dir, "part")
    held = p.select(F.col("p_partkey").alias("candidate"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.floor("p_retailprice").alias("cited"))
    return tables.best_titles(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), held)


_TITLE = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: w <> ''))"
C8_WHOLE_SQL = f"""WITH x AS (SELECT DISTINCT p_name AS name, {_TITLE.format('p_name')} AS a FROM part),
y AS (SELECT p_name || ' ' || p_type AS title, any_value({_TITLE.format("p_name || ' ' || p_type")}) AS b, max(floor(p_retailprice)) AS cited, arg_min(p_partkey, (-floor(p_retailprice), p_partkey)) AS candidate FROM part GROUP BY 1),
m AS (SELECT name, candidate, cited, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS s FROM x, y),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(s, 3) DESC, cited DESC, candidate) AS r FROM m WHERE s >= 0.6)
SELECT p_partkey AS id, candidate, round(s, 9) AS score FROM part JOIN r ON r.name = p_name AND r = 1"""


# --- table views

_SAID = "SELECT p_partkey AS path_id, p_size % 6 AS path_length, p_retailprice / CAST(1500 AS DOUBLE) AS score, CAST(p_size AS DOUBLE) / CAST(50 AS DOUBLE) AS average_confidence, concat('P', p_partkey) AS a, concat('P', p_partkey + 1) AS b FROM part"


def b16(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = run(spark, sf_dir, "SELECT concat('P', p_partkey) AS paper_id, p_name AS title, p_type AS author, p_brand AS journal, concat('10.1/', p_partkey) AS doi FROM part").withColumn("authors", F.array("author"))
    ranked = table(spark, sf_dir, "edges").filter("confidence >= 0.99").select(F.col("target_paper_id").alias("paper_id"))
    return tables.metadata_rows(papers, " Red ", table(spark, sf_dir, "seeds").select(F.col("seed_id").alias("paper_id")), ranked).select("paper_id", "title", "role")


B16_SQL = with_recipes("""SELECT concat('P', p_partkey) AS paper_id, p_name AS title, CASE WHEN concat('P', p_partkey) IN (SELECT seed_id FROM seeds) THEN 'seed' WHEN concat('P', p_partkey) IN (SELECT target_paper_id FROM edges WHERE confidence >= 0.99) THEN 'foundational' ELSE 'cited' END AS role
FROM part WHERE lower(p_name) LIKE '%red%' OR lower(p_type) LIKE '%red%' OR lower(p_brand) LIKE '%red%'""", "edges", "seeds")


def b17(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = table(spark, sf_dir, "resolutions").select("paper_id", F.col("n_eff").alias("value"), "confidence")
    return tables.ranking_view(f8(spark, sf_dir), shown, 0.4, True, True).select("seed_id", "rank", "paper_id", "score", "value")


B17_SQL = f"SELECT r.seed_id, r.rank, r.paper_id, r.score, v.n_eff AS value FROM ({F8_SQL}) r JOIN ({with_recipes('SELECT * FROM resolutions', 'resolutions')}) v ON v.paper_id = r.paper_id WHERE score >= 0.4 AND v.confidence >= 0.75 AND v.n_eff IS NOT NULL"


def b18(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = run(spark, sf_dir, _SAID).withColumn("paper_ids", F.array("a", "b"))
    sized = table(spark, sf_dir, "resolutions").filter("n_eff is not null")
    return tables.path_view(paths, sized, 0.5, 3, True, True).select("path_id", "path_length", F.round("score", 6).alias("score"))


B18_SQL = with_recipes(f"SELECT path_id, path_length, round(score, 6) AS score FROM ({_SAID}) x WHERE score >= 0.5 AND path_length <= 3 AND average_confidence >= 0.75 AND (a IN (SELECT paper_id FROM resolutions WHERE n_eff IS NOT NULL) OR b IN (SELECT paper_id FROM resolutions WHERE n_eff IS NOT NULL))", "resolutions")

_OLD = """SELECT p_brand AS seed_id, p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN 'a>b>c' END AS ids, CASE WHEN p_partkey % 3 = 1 THEN 'x>y' END AS old,
    CASE WHEN p_partkey % 4 = 0 THEN 7 WHEN p_partkey % 4 = 1 THEN 0 END AS rank, CASE WHEN p_partkey % 5 = 0 THEN 9 END AS path_length, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS score FROM part"""


def b19(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = run(spark, sf_dir, _OLD).withColumns({"paper_ids": F.split("ids", ">"), "path": F.split("old", ">")})
    return tables.filled_paths(old).withColumn("paper_ids", F.array_join("paper_ids", ">"))


B19_SQL = f"""SELECT seed_id, seq, coalesce(ids, old, '') AS paper_ids, CASE WHEN rank > 0 THEN rank ELSE CAST(row_number() OVER (PARTITION BY seed_id ORDER BY seq) AS INTEGER) END AS rank,
 coalesce(path_length, CASE WHEN ids IS NOT NULL THEN 2 WHEN old IS NOT NULL THEN 1 ELSE 0 END) AS path_length, coalesce(score, 0.0::DOUBLE) AS score FROM ({_OLD}) o"""

_CHECKS = "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 200 WHEN 1 THEN 204 WHEN 2 THEN 301 WHEN 3 THEN 401 WHEN 4 THEN 403 WHEN 5 THEN 429 WHEN 6 THEN 404 END AS status FROM events"


def b23(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = run(spark, sf_dir, _CHECKS)
    return checks.groupBy(tables.link_class(F.col("status")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(tables.doi_is_dead(F.col("status"))).alias("dead"))


B23_SQL = f"SELECT CASE WHEN status BETWEEN 200 AND 299 THEN 'live' WHEN status IN (401, 403, 429) THEN 'walled' ELSE 'broken' END AS class, count(*) AS n, count(*) FILTER (status = 404) AS dead FROM ({_CHECKS}) c GROUP BY 1"

# --- summaries

_RUNS = "SELECT p_brand AS run, count(*) AS papers, sum(CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END) AS edges, sum(CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END) AS missing, sum(CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END) AS ambiguous, sum(CASE WHEN p_size > 49 THEN 1 ELSE 0 END) AS no_abstract FROM part GROUP BY p_brand"
_WALKS = """SELECT seed_id, (SELECT count(*) FROM edges) * 0 + count(DISTINCT target_paper_id) AS papers, count(target_paper_id) AS edges, count(target_paper_id) AS backward, max(coalesce(f, 0)) AS forward
    FROM seeds LEFT JOIN edges ON source_paper_id = seed_id LEFT JOIN (SELECT target_paper_id AS t, count(*) AS f FROM edges GROUP BY target_paper_id) i ON t = seed_id GROUP BY seed_id"""


def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.traversal_summary(run(spark, sf_dir, _WALKS, "edges", "seeds"))


D4_SQL = with_recipes(f"SELECT count(*) AS seeds, CAST(sum(papers) AS BIGINT) AS papers, CAST(sum(edges) AS BIGINT) AS edges, round(avg(papers), 2) AS mean_papers, round(avg(edges), 2) AS mean_edges, CAST(sum(backward) AS BIGINT) AS backward, CAST(sum(forward) AS BIGINT) AS forward, count(*) FILTER (edges = 0) AS without_edges FROM ({_WALKS}) w", "edges", "seeds")


def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.run_warnings(run(spark, sf_dir, _RUNS)).select("run", F.array_join("warnings", "; ").alias("warnings"))


D7_SQL = f"SELECT run, concat_ws('; ', CASE WHEN edges = 0 THEN 'no citation links' END, CASE WHEN missing > 0 THEN concat(missing, ' papers without a study size') END, CASE WHEN ambiguous > 0 THEN concat(ambiguous, ' papers with rival sizes') END, CASE WHEN no_abstract > 0 THEN concat(no_abstract, ' papers without a text') END) AS warnings FROM ({_RUNS}) r"

_META = """SELECT CASE WHEN p_partkey % 9 > 0 THEN concat('10.1/A', p_partkey) END AS doi, concat('10.1/a', p_partkey + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END) AS wanted_doi, CASE p_partkey % 6 WHEN 0 THEN 'Unknown Title' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE p_name END AS title,
    CASE WHEN p_partkey % 4 > 0 THEN p_size END AS year, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS author, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE p_brand END AS journal FROM part"""


def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.completeness(run(spark, sf_dir, _META).withColumn("authors", F.array_compact(F.array("author"))))


D12_SQL = f"""SELECT count(*) AS resolved, round(avg(CASE WHEN lower(doi) = lower(wanted_doi) THEN 1.0::DOUBLE ELSE 0 END), 6) AS doi_match, round(avg(CASE WHEN title NOT IN ('', 'Unknown Title') THEN 1.0::DOUBLE ELSE 0 END), 6) AS title,
 round(avg(CASE WHEN year IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS year, round(avg(CASE WHEN author IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS authors, round(avg(CASE WHEN journal <> '' THEN 1.0::DOUBLE ELSE 0 END), 6) AS journal FROM ({_META}) m"""


def d16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.weight_summary(weighted(spark, sf_dir))


D16_SQL = with_recipes(f"WITH {WEIGHTED} SELECT round(min(final_weight), 9) AS least, round(quantile_cont(final_weight, 0.5), 9) AS median, round(max(final_weight), 9) AS most, count(DISTINCT round(final_weight, 4)) AS different FROM final", "edges", "resolutions")


def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.variant_summary(variant_ranks(spark, sf_dir), "combined")


G8_SQL = f"""WITH r AS ({F9_SQL}), t AS (SELECT seed_id, variant, list(paper_id ORDER BY rank) AS ids FROM r WHERE rank <= 10 GROUP BY ALL)
SELECT a.seed_id, a.variant, CAST(len(list_intersect(a.ids, b.ids)) AS INTEGER) AS shared, a.ids = b.ids AS identical FROM t a JOIN t b ON b.seed_id = a.seed_id AND b.variant = 'combined' WHERE a.variant <> 'combined'"""

PATTERNS = {"capital": ("prose", r"\b[A-Z][a-z]+"), "long_word": ("prose", r"[a-z]{12,}"), "number": ("struct", r"[0-9]+"), "colon": ("struct", ":"), "dash": ("struct", " - ")}


def d18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pattern_census(table(spark, sf_dir, "documents"), PATTERNS)


_PLAIN = "regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g'), '\\]\\([^)]*\\)', ']', 'g')"
D18_SQL = f"WITH p AS (SELECT {_PLAIN} AS plain FROM documents) " + " UNION ALL ".join(f"SELECT '{n}' AS pattern, '{t}' AS tag, CAST(sum(k) AS BIGINT) AS hits, count(*) FILTER (k > 0) AS texts FROM (SELECT len(regexp_extract_all(plain, '{x}')) AS k FROM p) q" for n, (t, x) in PATTERNS.items())


def d21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.split_summary(run(spark, sf_dir, "SELECT concat('PMC', page_id) AS pmcid, concat('cc-', page_id % 3) AS licence FROM pages"))


D21_SQL = "SELECT CASE WHEN page_id % 4 = 0 THEN 'held_out' ELSE 'development' END AS split, concat('cc-', page_id % 3) AS licence, count(*) AS n FROM pages GROUP BY 1, 2"


def e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers whose extraction changes where sections don't count: confident values as multisets."""
    texts = table(spark, sf_dir, "texts")
    pick = lambda t: evidence.candidates(t).filter("confidence >= 0.9").select("paper_id", "value", "semantic_type")
    return tables.changed_sets(pick(texts), pick(texts.withColumn("section", F.lit("full_text"))), "paper_id", ["value", "semantic_type"])


def e7_sql() -> str:
    from bibloom.plans.text import _CANDIDATES

    return with_recipes(f"""WITH {_CANDIDATES}, a AS (SELECT paper_id, value, semantic_type, count(*) FILTER (confidence >= 0.9) AS x, count(*) FILTER (round(least(1.0::DOUBLE, weight), 6) >= 0.9) AS y FROM c WHERE value BETWEEN 1 AND 10000000 GROUP BY ALL)
SELECT paper_id, CAST(sum(greatest(x - y, 0)) AS BIGINT) AS lost, CAST(sum(greatest(y - x, 0)) AS BIGINT) AS gained FROM a WHERE x <> y GROUP BY paper_id""", "texts")


def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that only cite or only are cited by the surest edges."""
    edges = table(spark, sf_dir, "edges").filter("confidence >= 0.99")
    a, b = edges.select(F.col("source_paper_id").alias("paper_id")).distinct(), edges.select(F.col("target_paper_id").alias("paper_id")).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("cites")).unionByName(b.exceptAll(a).withColumn("side", F.lit("cited")))


G9_SQL = with_recipes("SELECT * FROM (SELECT source_paper_id AS paper_id, 'cites' AS side FROM edges WHERE confidence >= 0.99 EXCEPT SELECT target_paper_id, 'cites' FROM edges WHERE confidence >= 0.99) x UNION ALL SELECT * FROM (SELECT target_paper_id AS paper_id, 'cited' AS side FROM edges WHERE confidence >= 0.99 EXCEPT SELECT source_paper_id, 'cited' FROM edges WHERE confidence >= 0.99) y", "edges")

# --- layout: an order is a figure, its lines are read lines, their quantities places

LINES = """SELECT concat('F', l_orderkey) AS fig_id, n AS line_id, CASE WHEN n % 6 = 5 THEN ' ' ELSE concat(CASE l_partkey % 9 WHEN 0 THEN 'Assessed for eligibility' WHEN 1 THEN 'Excluded from analysis' WHEN 2 THEN 'Enrolled and randomised' WHEN 3 THEN 'Included in the final analysis'
    WHEN 4 THEN 'Allocated to arm' WHEN 5 THEN 'Lost to follow-up' WHEN 6 THEN 'met the inclusion criteria' WHEN 7 THEN 'Patients' ELSE 'Screening' END, ' (n = ', l_suppkey, ')') END AS text,
    CAST(CASE WHEN l_quantity > 5 THEN 40 + l_quantity ELSE l_quantity END AS DOUBLE) / CAST(100 AS DOUBLE) AS conf, CAST(l_quantity * 4 AS DOUBLE) AS x0, CAST(l_partkey % 90 AS DOUBLE) AS y0, CAST(l_quantity * 4 + 30 AS DOUBLE) AS x1, CAST(l_partkey % 90 + 12 AS DOUBLE) AS y1 FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS INTEGER) AS n FROM lineitem) li"""
BOXES = """SELECT concat('F', l_orderkey) AS fig_id, n AS box_id, CAST(l_quantity * 3 AS DOUBLE) AS x0, CAST(l_suppkey % 50 AS DOUBLE) AS y0, CAST(l_quantity * 3 + 60 + 20 * n AS DOUBLE) AS x1, CAST(l_suppkey % 50 + 40 AS DOUBLE) AS y1 FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS INTEGER) AS n FROM lineitem) li"""


def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines_in_boxes(run(spark, sf_dir, LINES), run(spark, sf_dir, BOXES)).select("fig_id", "line_id", "box_id")


C14_SQL = f"""WITH l AS ({LINES}), b AS ({BOXES}), h AS (SELECT l.fig_id, l.line_id, arg_min(b.box_id, ((b.x1 - b.x0) * (b.y1 - b.y0), b.box_id)) AS box_id FROM l JOIN b ON b.fig_id = l.fig_id AND (l.x0 + l.x1) / 2 BETWEEN b.x0 AND b.x1 AND (l.y0 + l.y1) / 2 BETWEEN b.y0 AND b.y1 GROUP BY ALL)
SELECT l.fig_id, l.line_id, h.box_id FROM l LEFT JOIN h ON h.fig_id = l.fig_id AND h.line_id = l.line_id"""


def e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = run(spark, sf_dir, LINES)
    again = run(spark, sf_dir, f"SELECT fig_id, line_id, concat(text, ' again') AS text, conf + CASE WHEN line_id % 2 = 0 THEN CAST(0.1 AS DOUBLE) ELSE CAST(-0.1 AS DOUBLE) END AS conf FROM ({LINES}) x")
    usable = layout.usable_lines(lines)
    return layout.better_reading(usable, again.join(usable.filter("reread").select("fig_id", "line_id"), ["fig_id", "line_id"], "left_semi")).select("fig_id", "line_id", "text", F.round("conf", 6).alias("conf"), "reread")


E8_SQL = f"""WITH k AS (SELECT *, conf < 0.85 AND regexp_matches(text, '[0-9]') AS unsure FROM ({LINES}) x WHERE trim(text) <> '' AND conf >= 0.5),
r AS (SELECT *, unsure AND sum(CASE WHEN unsure THEN 1 ELSE 0 END) OVER (PARTITION BY fig_id ORDER BY line_id) <= 12 AS reread FROM k)
SELECT fig_id, line_id, CASE WHEN reread AND line_id % 2 = 0 THEN concat(text, ' again') ELSE text END AS text, round(CASE WHEN reread AND line_id % 2 = 0 THEN conf + 0.1 ELSE conf END, 6) AS conf, reread FROM r"""


def e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.distinct_boxes(run(spark, sf_dir, BOXES))


def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(run(spark, sf_dir, LINES), ["fig_id"])


def e13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, LINES).select("fig_id", "line_id", F.array_join(layout.stages_of(F.col("text")), ",").alias("stages"))


# RE2 has no look-ahead: in these texts the excepted phrase is one of two
_STAGE = {n: p for n, p in layout.STAGES if n != "enrolled"}
E13_SQL = f"""SELECT fig_id, line_id, CASE WHEN regexp_matches(text, '{layout.EXCLUDED}') THEN 'excluded' ELSE concat_ws(',', CASE WHEN regexp_matches(text, '{_STAGE['screened']}') THEN 'screened' END,
 CASE WHEN regexp_matches(text, '(?i)\\benrol\\w*|\\b(met|meet|meeting)\\s+(the\\s+)?inclusion') THEN 'enrolled' END, CASE WHEN regexp_matches(text, '{_STAGE['randomised']}') THEN 'randomised' END,
 CASE WHEN regexp_matches(text, '{_STAGE['analysed']}') THEN 'analysed' END, CASE WHEN regexp_matches(text, '{_STAGE['allocated']}') THEN 'allocated' END) END AS stages FROM ({LINES}) x"""


def e14(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = run(spark, sf_dir, LINES).select("fig_id", F.col("line_id").cast("long").alias("seq"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), (F.col("y1") - F.col("y0")).alias("h"), F.col("x0").cast("long").alias("value"))
    return layout.row_totals(layout.side_by_side(counts))


def queries() -> dict:
    return {
        "b16_metadata_rows": b16, "b17_ranking_view": b17, "b18_path_view": b18, "b19_filled_paths": b19, "b23_link_classes": b23, "c8_title_match": c8_whole, "c8_title_match_whole": c8_whole, "c9_aliases": c9, "c12_unresolved": c12,
        "c13_verified_references": c13, "c14_lines_in_boxes": c14, "c18_edges_of": c18, "d4_traversal_summary": d4, "d7_run_warnings": d7, "d12_completeness": d12, "d16_weight_summary": d16, "d18_pattern_census": d18,
        "d21_split_summary": d21, "e7_changed_sets": e7, "e8_usable_lines": e8, "e9_distinct_boxes": e9, "e11_reading_order": e11, "e13_stages": e13, "e14_row_totals": e14, "g8_variant_summary": g8, "g9_one_sided": g9,
    }


def oracle_sql() -> dict:
    return {
        "b16_metadata_rows": B16_SQL, "b17_ranking_view": B17_SQL, "b18_path_view": B18_SQL, "b19_filled_paths": B19_SQL, "b23_link_classes": B23_SQL, "c8_title_match": C8_WHOLE_SQL, "c8_title_match_whole": C8_WHOLE_SQL, "c9_aliases": C9_SQL, "c12_unresolved": C12_SQL,
        "c13_verified_references": C13_SQL, "c14_lines_in_boxes": C14_SQL, "c18_edges_of": C18_SQL, "d4_traversal_summary": D4_SQL, "d7_run_warnings": D7_SQL, "d12_completeness": D12_SQL, "d16_weight_summary": D16_SQL, "d18_pattern_census": D18_SQL,
        "d21_split_summary": D21_SQL, "e7_changed_sets": e7_sql(), "e8_usable_lines": E8_SQL, "e13_stages": E13_SQL, "g8_variant_summary": G8_SQL, "g9_one_sided": G9_SQL,
    }
