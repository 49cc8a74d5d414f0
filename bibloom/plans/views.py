"""Queries of views, filters and the remaining mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.functions import ids
from bibloom.operators import views, weights
from bibloom.sources import exports, records
from bibloom.sources.recipes import run, table, with_recipes


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.build_vertices(table(spark, sf_dir, "papers"), table(spark, sf_dir, "resolutions"))


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.weight_edges(table(spark, sf_dir, "edges"), table(spark, sf_dir, "resolutions"))


_WEIGHT = "CASE WHEN r.paper_id IS NULL THEN 0.5::DOUBLE ELSE r.confidence END * 0.75::DOUBLE * least(1.0::DOUBLE, ln(1.0::DOUBLE + coalesce(r.n_eff, 0)) / ln(100001.0::DOUBLE))"


def b14(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = views.graph_view(_vertices(spark, sf_dir), _weighted(spark, sf_dir), (1980, 2010), True, 0.95, 0.2)
    return edges.select("source_paper_id", "target_paper_id", F.round("final_weight", 9).alias("final_weight"))


B14_SQL = with_recipes(f"""WITH v AS (SELECT p.paper_id FROM papers p JOIN resolutions r ON r.paper_id = p.paper_id WHERE (year IS NULL OR year BETWEEN 1980 AND 2010) AND n_eff IS NOT NULL),
w AS (SELECT source_paper_id, target_paper_id, e.confidence, ({_WEIGHT} + 0.125::DOUBLE) * e.confidence AS fw FROM edges e LEFT JOIN resolutions r ON r.paper_id = target_paper_id)
SELECT source_paper_id, target_paper_id, round(fw, 9) AS final_weight FROM w WHERE confidence >= 0.95 AND fw >= 0.2 AND source_paper_id IN (SELECT paper_id FROM v) AND target_paper_id IN (SELECT paper_id FROM v)""", "papers", "resolutions", "edges")  # fmt: skip


def b12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", views.strip_markup(F.col("html")).alias("plain"))


def b15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.search(_vertices(spark, sf_dir), " ReD ", ["title", "journal"], "resolved").select("paper_id", "title")


def b20(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = run(spark, sf_dir, _ERRORS)
    return raw.groupBy(views.error_class(F.col("error")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


_ERRORS = "SELECT CASE event_id % 7 WHEN 0 THEN 'Request TIMED out' WHEN 1 THEN 'no papers found to merge' WHEN 2 THEN 'Aborted due to server shutdown' WHEN 3 THEN 'hit Rate Limit' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE event_type END AS error FROM events"
B20_SQL = f"SELECT CASE WHEN coalesce(error, '') = '' THEN 'none' WHEN lower(error) LIKE '%no papers found to merge%' THEN 'unresolved' WHEN regexp_matches(lower(error), 'timeout|timed out') THEN 'timeout' WHEN lower(error) LIKE '%aborted due to server shutdown%' THEN 'restart' WHEN lower(error) LIKE '%rate limit%' THEN 'rate_limit' ELSE 'other' END AS class, count(*) AS n FROM ({_ERRORS}) e GROUP BY 1"


def b21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vertices(spark, sf_dir).select("paper_id", views.confidence_level(F.col("population_confidence")).alias("level"))


def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.overview(_vertices(spark, sf_dir), "journal")


D5_SQL = with_recipes("SELECT journal, count(*) AS papers, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status IN ('ambiguous', 'low_confidence')) AS ambiguous, count(*) FILTER (status = 'missing') AS missing, round(avg(CASE WHEN status IN ('resolved', 'ambiguous') THEN confidence END), 9) AS mean_confidence FROM papers p LEFT JOIN resolutions r ON r.paper_id = p.paper_id GROUP BY journal", "papers", "resolutions")


def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.status_counts(_vertices(spark, sf_dir).filter("status is not null"), "journal")


D6_SQL = with_recipes("SELECT journal, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in views.STATUSES) + " FROM papers p JOIN resolutions r ON r.paper_id = p.paper_id GROUP BY journal", "papers", "resolutions")


def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.link_confidence(table(spark, sf_dir, "papers"), table(spark, sf_dir, "edges"))


def crossref_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the second provider's nested shape."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    raw = p.select(
        F.when(k % 4 > 0, F.concat(F.lit("10.1/AbC"), k)).alias("DOI"), F.when(k % 5 > 0, F.array("p_name", "p_type")).alias("title"),
        F.array(F.struct(F.col("p_brand").alias("given"), F.when(k % 2 > 0, F.col("p_type")).alias("family"))).alias("author"),
        F.when(k % 3 > 0, F.struct(F.array(F.array((F.lit(1970) + k % 50).cast("int"), F.lit(1))).alias("date-parts"))).alias("issued"), F.when(k % 6 > 0, F.array("p_brand")).alias("container-title"),
    )
    return raw


def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.crossref_papers(crossref_works(spark, sf_dir))


A2_SQL = "SELECT CASE WHEN p_partkey % 4 > 0 THEN concat('10.1/AbC', p_partkey) ELSE 'unknown' END AS paper_id, CASE WHEN p_partkey % 4 > 0 THEN concat('10.1/AbC', p_partkey) END AS doi, CASE WHEN p_partkey % 5 > 0 THEN p_name ELSE 'Unknown Title' END AS title, [CASE WHEN p_partkey % 2 > 0 THEN p_brand || ' ' || p_type ELSE p_brand END] AS authors, CASE WHEN p_partkey % 3 > 0 THEN CAST(1970 + p_partkey % 50 AS INTEGER) END AS year, CASE WHEN p_partkey % 6 > 0 THEN p_brand END AS journal, 0.9::DOUBLE AS metadata_confidence FROM part"


def europe_pmc_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the third provider's nested shape."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    raw = p.select(
        F.when(k % 3 == 0, F.concat(F.lit("pmc"), k)).alias("id"), F.when(k % 2 == 0, F.concat(F.lit("10.1/X"), k)).alias("doi"), F.when(k % 3 < 2, F.concat(F.lit("PMID:"), k)).alias("pmid"), none.alias("pmcid"),
        F.col("p_name").alias("title"), F.struct(F.array(F.struct(F.col("p_brand").alias("fullName")), F.struct(F.lit("").alias("fullName"))).alias("author")).alias("authorList"),
        F.when(k % 4 > 0, (F.lit(1970) + k % 50).cast("string")).alias("pubYear"), F.struct(F.struct(F.col("p_type").alias("title")).alias("journal")).alias("journalInfo"), F.col("p_type").alias("abstractText"),
    )
    return raw


def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.europe_pmc_papers(europe_pmc_hits(spark, sf_dir)).drop("pmcid")


A3_SQL = "SELECT CASE WHEN p_partkey % 3 = 0 THEN concat('PMC', p_partkey) WHEN p_partkey % 3 = 1 THEN concat('', p_partkey) WHEN p_partkey % 2 = 0 THEN concat('10.1/x', p_partkey) ELSE '' END AS paper_id, CASE WHEN p_partkey % 2 = 0 THEN concat('10.1/x', p_partkey) END AS doi, CASE WHEN p_partkey % 3 < 2 THEN concat('', p_partkey) END AS pmid, p_name AS title, [p_brand] AS authors, CASE WHEN p_partkey % 4 > 0 THEN CAST(1970 + p_partkey % 50 AS INTEGER) END AS year, p_type AS journal, p_type AS abstract, 0.85::DOUBLE AS metadata_confidence FROM part"


def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each pair of journals that cite each other: here each journal's own papers and the edges among them."""
    v = _vertices(spark, sf_dir)
    home = lambda side: v.select(F.col("paper_id").alias(side), F.col("journal").alias(f"j_{side}"))
    edges = table(spark, sf_dir, "edges").select(F.col("source_paper_id").alias("source"), F.col("target_paper_id").alias("target"), F.col("confidence").alias("weight"))
    inside = edges.join(home("source"), "source").join(home("target"), "target").filter("j_source = j_target").select(F.col("j_source").alias("journal"), "source", "target", "weight")
    found = exports.node_link(v, inside, "journal")
    back = F.from_json("document", "nodes array<struct<id:string,label:string,year:int,n_eff:int>>, links array<struct<source:string,target:string,weight:double>>")
    return found.select("journal", back.alias("d")).select("journal", F.size("d.nodes").alias("nodes"), F.size("d.links").alias("links"), F.get("d.nodes", 0)["label"].alias("first_label"))


A12_SQL = with_recipes("""WITH l AS (SELECT a.journal, count(*) AS n FROM edges JOIN papers a ON a.paper_id = source_paper_id JOIN papers b ON b.paper_id = target_paper_id AND b.journal = a.journal GROUP BY 1)
SELECT p.journal, CAST(count(*) AS INTEGER) AS nodes, CAST(coalesce(any_value(l.n), 0) AS INTEGER) AS links, arg_min(title, p.paper_id) AS first_label FROM papers p LEFT JOIN l ON l.journal = p.journal GROUP BY p.journal""", "papers", "edges")


def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.report_lines(_vertices(spark, sf_dir).withColumn("title", F.concat("title", F.lit(" |  x"))))


A15_SQL = with_recipes("""WITH v AS (SELECT p.paper_id, title, year, n_eff FROM papers p LEFT JOIN resolutions r ON r.paper_id = p.paper_id)
SELECT 'summary' AS section, 0::BIGINT AS seq, concat('Papers: ', count(*), ', with a study size: ', count(n_eff)) AS line FROM v
UNION ALL SELECT 'largest', seq, line FROM (SELECT row_number() OVER (ORDER BY n_eff DESC, paper_id) AS seq, concat('| ', title, ' \\| x | ', coalesce(CAST(year AS VARCHAR), ''), ' | ', n_eff, ' |') AS line FROM v WHERE n_eff IS NOT NULL) x WHERE seq <= 20""", "papers", "resolutions")


def b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries in their normal form: identifiers canonical, titles trimmed."""
    q = table(spark, sf_dir, "raw_ids").withColumn("query_type", ids.query_type(F.col("raw")))
    value = F.when(F.col("query_type").isin("title", "url"), F.trim(F.coalesce("raw", F.lit("")))).otherwise(ids.canonical(F.col("raw")))
    return q.select("id", "query_type", value.alias("value"))


def b6_sql() -> str:
    from bibloom.plans.text import B1_SQL, B3_SQL

    return f"SELECT t.id, query_type, CASE WHEN query_type IN ('title', 'url') THEN trim(coalesce(raw, '')) ELSE canonical END AS value FROM ({B3_SQL}) t JOIN ({B1_SQL}) c ON c.id = t.id JOIN ({with_recipes('SELECT * FROM raw_ids', 'raw_ids')}) r ON r.id = t.id"


def queries() -> dict:
    return {
        "a2_crossref_papers": a2, "a3_europe_pmc_papers": a3, "a12_node_link": a12, "a15_report": a15, "b6_normalise": b6, "b12_strip_markup": b12, "b14_graph_view": b14, "b15_search": b15,
        "b20_error_classes": b20, "b21_confidence_levels": b21, "d5_overview": d5, "d6_status_counts": d6, "d8_link_confidence": d8,
    }


def oracle_sql() -> dict:
    return {
        "a2_crossref_papers": A2_SQL, "a3_europe_pmc_papers": A3_SQL, "a12_node_link": A12_SQL, "a15_report": A15_SQL, "b6_normalise": b6_sql(),
        "b12_strip_markup": r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages",
        "b14_graph_view": B14_SQL,
        "b15_search": with_recipes("SELECT p.paper_id, title FROM papers p JOIN resolutions r ON r.paper_id = p.paper_id WHERE status = 'resolved' AND (lower(title) LIKE '%red%' OR lower(journal) LIKE '%red%')", "papers", "resolutions"),
        "b20_error_classes": B20_SQL,
        "b21_confidence_levels": with_recipes("SELECT p.paper_id, CASE WHEN confidence IS NULL THEN 'missing' WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.45 THEN 'medium' ELSE 'low' END AS level FROM papers p LEFT JOIN resolutions r ON r.paper_id = p.paper_id", "papers", "resolutions"),
        "d5_overview": D5_SQL, "d6_status_counts": D6_SQL,
        "d8_link_confidence": with_recipes("SELECT p.paper_id, c AS confidence, coalesce(c < 0.5, false) AS low FROM papers p LEFT JOIN (SELECT source_paper_id AS id, max(confidence) AS c FROM edges GROUP BY 1) e ON e.id = p.paper_id", "papers", "edges"),
    }
