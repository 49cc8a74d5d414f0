"""Queries of sources, merging, exports, logs and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibloom.operators import ledger, weights
from bibloom.sources import exports, records
from bibloom.sources.recipes import run, table, with_recipes
from bibloom.streaming import ledger as streams

_WORKS = """SELECT p_partkey AS k, concat('https://openalex.org/w', p_partkey) AS id,
CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 6 = 1 THEN concat('https://doi.org/10.48550/arXiv.2101.', 10000 + p_partkey % 80000) ELSE concat('https://doi.org/10.1/AbC.', p_partkey) END AS doi,
CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('https://pubmed.ncbi.nlm.nih.gov/', 1000 + p_partkey) END AS pmid,
CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 13 = 1 THEN concat('Quantum ', p_name) ELSE p_name END AS name, 1970 + p_partkey % 50 AS year, p_brand AS journal, p_type AS kind,
CASE p_size % 4 WHEN 0 THEN 'Computer Science' WHEN 1 THEN 'Medicine' WHEN 2 THEN 'Physics' ELSE NULL END AS field FROM part"""


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the first provider's nested shape."""
    w = run(spark, sf_dir, _WORKS)
    none = F.lit(None)
    return w.select(
        "k", "id", "doi", F.struct(F.col("pmid"), none.cast("string").alias("pmcid")).alias("ids"), F.col("name").alias("display_name"), F.col("year").cast("int").alias("publication_year"),
        F.when(F.col("k") % 5 > 0, F.struct(F.when(F.col("k") % 5 > 1, F.struct(F.col("journal").alias("display_name"))).alias("source"))).alias("primary_location"),
        F.array(F.struct(F.struct(F.col("journal").alias("display_name")).alias("author")), F.struct(F.struct(F.lit("").alias("display_name")).alias("author")), F.struct(F.struct(F.col("kind").alias("display_name")).alias("author"))).alias("authorships"),
        F.when(F.col("k") % 2 > 0, F.create_map(F.lit("the"), F.array(F.lit(0), F.lit(2)), F.lit("zeta"), F.array(F.lit(3)), F.col("kind"), F.array(F.lit(1)))).alias("abstract_inverted_index"),
        F.struct(F.lit("topic").alias("display_name"), F.struct(F.col("field").alias("display_name")).alias("field"), F.struct(F.when(F.col("field") == "Physics", "Physical Sciences").alias("display_name")).alias("domain")).alias("primary_topic"),
        F.array(F.struct(none.cast("string").alias("landing_page_url"), F.when(F.col("k") % 7 == 0, F.concat(F.lit("http://arXiv.org/pdf/1234."), F.lpad(F.col("k") % 10000, 4, "0"), F.lit("v2"))).alias("pdf_url"))).alias("locations"),
        F.transform(F.sequence(F.lit(1), F.col("k") % 3 + 1), lambda i: F.concat(F.lit("https://openalex.org/W"), F.col("k") + i)).alias("referenced_works"),
    )


def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.openalex_papers(works(spark, sf_dir)).drop("pmcid", "metadata_confidence")


A1_SQL = f"""WITH w AS ({_WORKS}), i AS (SELECT *, lower(split_part(doi, 'doi.org/', 2)) AS d, CAST(CASE WHEN pmid IS NULL THEN NULL ELSE 1000 + k END AS VARCHAR) AS p FROM w)
SELECT coalesce(d, p, concat('W', k)) AS paper_id, d AS doi, p AS pmid, concat('W', k) AS openalex_id,
 CASE WHEN doi LIKE '%arXiv%' THEN regexp_extract(doi, 'arXiv\\.([0-9]+\\.[0-9]+)', 1) WHEN k % 7 = 0 THEN concat('1234.', lpad(CAST(k % 10000 AS VARCHAR), 4, '0')) END AS arxiv_id,
 CASE WHEN name = '' THEN 'Unknown Title' ELSE name END AS title, [journal, kind] AS authors, CAST(year AS INTEGER) AS year, CASE WHEN k % 5 > 1 THEN journal END AS journal,
 CASE WHEN k % 2 > 0 THEN concat('the ', kind, ' the zeta') END AS abstract,
 CASE WHEN field = 'Computer Science' AND name LIKE 'Quantum%' THEN 'nonclinical' WHEN field = 'Computer Science' THEN 'computer_science' WHEN field = 'Medicine' THEN 'biomedical' WHEN field = 'Physics' THEN 'nonclinical' ELSE 'unknown' END AS research_domain, field AS research_field FROM i"""


def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.openalex_references(works(spark, sf_dir))


def a5(spark: SparkSession, sf_dir: str, limit: int = 5) -> DataFrame:
    edges = table(spark, sf_dir, "edges").select("source_paper_id", "target_paper_id")
    counts = edges.groupBy(F.col("target_paper_id").alias("paper_id")).agg(F.count(F.lit(1)).alias("cited_by_count"))
    return records.most_cited_citing(edges, counts, limit)


def a5_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's 200 citing papers a paper; a5's SQL stops at 5."""
    return a5(spark, sf_dir, 200)


A5_SQL = with_recipes("""WITH c AS (SELECT target_paper_id AS id, count(*) AS n FROM edges GROUP BY 1)
SELECT * FROM (SELECT e.source_paper_id, e.target_paper_id, coalesce(n, 0) AS cited_by_count, CAST(row_number() OVER (PARTITION BY e.target_paper_id ORDER BY coalesce(n, 0) DESC, e.source_paper_id) AS INTEGER) AS rank
FROM edges e LEFT JOIN c ON c.id = e.source_paper_id) x WHERE rank <= 5""", "edges")

# three answers to each query, with gaps and empty strings that rotate
_ANSWERS = """SELECT p_partkey AS query_id, 'crossref' AS provider, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END AS title, CAST(NULL AS INTEGER) AS year, p_brand AS journal, CAST(NULL AS VARCHAR(9)) AS abstract,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('10.1/A', p_partkey) END AS doi, CAST(NULL AS VARCHAR(9)) AS pmid, CAST(NULL AS VARCHAR(9)) AS openalex_id, CAST(NULL AS VARCHAR(9)) AS research_domain, CAST(0.9 AS DOUBLE) AS match_score FROM part WHERE p_partkey % 5 > 0
UNION ALL SELECT p_partkey, 'openalex', concat(p_name, ' b'), CAST(1970 + p_partkey % 50 AS INTEGER), NULL, CASE WHEN p_partkey % 2 = 0 THEN p_type END, concat('10.1/a', p_partkey + p_partkey % 7 / 6), '', concat('W', p_partkey), 'biomedical', CAST(0.8 AS DOUBLE) + CAST(p_partkey % 3 AS DOUBLE) / 10 FROM part WHERE p_partkey % 6 > 0
UNION ALL SELECT p_partkey, 'europe_pmc', concat(p_name, ' c'), CAST(1 AS INTEGER), 'J', 'text', NULL, concat('', 5000 + p_partkey), NULL, NULL, CAST(1 AS DOUBLE) FROM part WHERE p_partkey % 7 > 0"""
_ANSWERS = _ANSWERS.replace("p_partkey + p_partkey % 7 / 6", "p_partkey + CAST(floor(p_partkey % 7 / 6.0) AS INTEGER)")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _ANSWERS).withColumns({"authors": F.when(F.col("provider") == "openalex", F.array("title")), "pmcid": F.lit(None).cast("string")})


def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.merge_providers(answers(spark, sf_dir)).drop("pmcid", "authors")


C6_SQL = f"""WITH a AS ({_ANSWERS}), q AS (SELECT query_id, count(*) AS n FROM a GROUP BY query_id), c AS (SELECT * FROM a WHERE provider = 'crossref'), o AS (SELECT * FROM a WHERE provider = 'openalex'), e AS (SELECT * FROM a WHERE provider = 'europe_pmc'),
m AS (SELECT q.query_id, q.n, coalesce(nullif(c.doi, ''), nullif(o.doi, ''), nullif(e.doi, '')) AS doi, coalesce(nullif(c.pmid, ''), nullif(o.pmid, ''), nullif(e.pmid, '')) AS pmid, o.openalex_id, coalesce(nullif(coalesce(c.title, o.title), ''), 'Unknown Title') AS title, coalesce(c.year, o.year) AS year,
 coalesce(c.journal, o.journal) AS journal, coalesce(o.abstract, c.abstract) AS abstract, coalesce(o.research_domain, 'unknown') AS research_domain FROM q LEFT JOIN c USING (query_id) LEFT JOIN o USING (query_id) LEFT JOIN e USING (query_id))
SELECT query_id, coalesce(doi, pmid, openalex_id) AS paper_id, doi, pmid, openalex_id, title, year, journal, abstract, research_domain, CASE WHEN n > 1 THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END AS metadata_confidence FROM m"""


def c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.provider_conflicts(answers(spark, sf_dir))


C7_SQL = f"SELECT * FROM (SELECT query_id, count(DISTINCT nullif(lower(doi), '')) > 1 AS conflict, coalesce(min(match_score) < 0.85::DOUBLE, false) AS weak FROM ({_ANSWERS}) a GROUP BY query_id) x WHERE conflict OR weak"


def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = records.merge_providers(answers(spark, sf_dir)).select("query_id", "doi", "abstract")
    other = run(spark, sf_dir, "SELECT concat('10.1/A', p_partkey) AS doi, CASE WHEN p_partkey % 9 > 0 THEN concat('found ', p_partkey) ELSE '' END AS abstract FROM part")
    return records.backfill_abstracts(merged, other)


C3_SQL = f"WITH m AS ({C6_SQL}), t AS (SELECT concat('10.1/A', p_partkey) AS doi, concat('found ', p_partkey) AS spare FROM part WHERE p_partkey % 9 > 0) SELECT m.query_id, m.doi, coalesce(nullif(m.abstract, ''), spare) AS abstract, nullif(m.abstract, '') IS NULL AND spare IS NOT NULL AS recovered FROM m LEFT JOIN t ON t.doi = m.doi"


def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = run(spark, sf_dir, _PROVIDED, "pairs")
    return records.union_edges(raw).withColumn("providers", F.array_join("providers", ";"))


_PROVIDED = "SELECT concat('P', s) AS source_paper_id, concat('P', t) AS target_paper_id, flag AS provider, CAST(1 AS DOUBLE) - disc AS confidence, ord * 100 + line AS seq FROM pairs WHERE t IS NOT NULL AND s <> t"
D2_SQL = with_recipes(f"""WITH r AS ({_PROVIDED}), f AS (SELECT source_paper_id, target_paper_id, provider, min(seq) AS seq, arg_min(confidence, seq) AS confidence FROM r GROUP BY ALL)
SELECT source_paper_id, target_paper_id, string_agg(provider, ';' ORDER BY seq, provider) AS providers, arg_min(confidence, seq) AS confidence FROM f GROUP BY 1, 2""".replace("GROUP BY ALL", "GROUP BY source_paper_id, target_paper_id, provider"), "pairs")


# --- exports

_PEOPLE = "SELECT p.paper_id, title, year, journal, seq FROM papers p"


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.transform(F.sequence(F.lit(1), F.col("seq") % 7 + 1), lambda i: F.concat(F.lit("Given"), i, F.lit(" Van "), F.col("journal")))
    doi = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("10.1/a-"), F.col("seq")))
    return table(spark, sf_dir, "papers").withColumns({"authors": names, "doi": doi})


def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "edges")
    cited = edges.groupBy(F.col("target_paper_id").alias("paper_id")).agg(F.count(F.lit(1)).alias("n"))
    order = (F.col("n").desc(), F.col("paper_id"))
    ranks = cited.orderBy(*order).limit(10).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return exports.paper_rows(_papers(spark, sf_dir), table(spark, sf_dir, "resolutions"), edges, ranks)


A10_SQL = with_recipes("""WITH c AS (SELECT target_paper_id AS id, count(*) AS n FROM edges GROUP BY 1), o AS (SELECT source_paper_id AS id, count(*) AS n FROM edges GROUP BY 1), k AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS rank FROM c)
SELECT p.paper_id, title, array_to_string(list_transform(range(1, least(5, seq % 7 + 1) + 1), lambda i: concat('Given', i, ' Van ', journal)), '; ') || CASE WHEN seq % 7 + 1 > 5 THEN '; et al.' ELSE '' END AS authors,
 coalesce(CAST(year AS VARCHAR), '') AS year, journal, coalesce(CAST(r.n_eff AS VARCHAR), '') AS n_eff, coalesce(r.status, '') AS population_status, CASE WHEN r.confidence IS NULL THEN '' ELSE printf('%.2f', r.confidence) END AS population_confidence,
 CAST(coalesce(c.n, 0) AS VARCHAR) AS cited_by_in_graph, CAST(coalesce(o.n, 0) AS VARCHAR) AS references_in_graph, coalesce(CAST(k.rank AS VARCHAR), '') AS foundational_rank
FROM papers p LEFT JOIN resolutions r ON r.paper_id = p.paper_id LEFT JOIN c ON c.id = p.paper_id LEFT JOIN o ON o.id = p.paper_id LEFT JOIN k ON k.id = p.paper_id AND k.rank <= 10""", "papers", "edges", "resolutions")  # fmt: skip


def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = weights.weight_edges(table(spark, sf_dir, "edges"), table(spark, sf_dir, "resolutions"))
    return exports.edge_rows(weighted, table(spark, sf_dir, "papers")).select("source_paper_id", "source_title", "target_paper_id", "target_title", "journal_score", "edge_confidence")


A11_SQL = with_recipes("SELECT source_paper_id, a.title AS source_title, target_paper_id, b.title AS target_title, '0.5000' AS journal_score, printf('%.2f', confidence) AS edge_confidence FROM edges LEFT JOIN papers a ON a.paper_id = source_paper_id LEFT JOIN papers b ON b.paper_id = target_paper_id", "edges", "papers")


def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "papers").withColumn("title", F.concat("title", F.lit(' <"&>')))
    return exports.graphml_nodes(weights.build_vertices(papers, table(spark, sf_dir, "resolutions")))


A14_SQL = with_recipes("""SELECT p.paper_id, concat('<node id="', p.paper_id, '"><data key="title">', title, ' &lt;&quot;&amp;&gt;</data>', CASE WHEN year IS NOT NULL THEN concat('<data key="year">', year, '</data>') END,
 CASE WHEN n_eff IS NOT NULL THEN concat('<data key="n_eff">', n_eff, '</data>') END, CASE WHEN status IS NOT NULL THEN concat('<data key="status">', status, '</data>') END, '</node>') AS line FROM papers p LEFT JOIN resolutions r ON r.paper_id = p.paper_id""", "papers", "resolutions")


def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = table(spark, sf_dir, "resolutions").select("paper_id", "confidence")
    return exports.ris(_papers(spark, sf_dir).join(linked, "paper_id", "left"))


A17_SQL = with_recipes("""SELECT p.paper_id, concat_ws(chr(10), 'TY  - JOUR', array_to_string(list_transform(range(1, seq % 7 + 2), lambda i: concat('AU  - ', journal, ', Given', i, ' Van')), chr(10)), 'TI  - ' || title, 'JO  - ' || journal, 'PY  - ' || year,
 CASE WHEN seq % 2 = 0 THEN concat('DO  - 10.1/a-', seq) END, CASE WHEN seq % 2 = 0 THEN concat('UR  - https://doi.org/10.1/a-', seq) END,
 CASE WHEN r.confidence < 0.5 THEN concat('N1  - Weak link to the seed (confidence ', printf('%.2f', r.confidence), '): read it before citing.') END, 'ER  - ') AS block
FROM papers p LEFT JOIN resolutions r ON r.paper_id = p.paper_id""", "papers", "resolutions")


def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.bibtex(_papers(spark, sf_dir))


A18_SQL = with_recipes("""SELECT paper_id, concat('@article{', regexp_replace(CASE WHEN seq % 2 = 0 THEN concat('10.1/a-', seq) ELSE paper_id END, '[^A-Za-z0-9]', '_', 'g'), ',', chr(10), concat_ws(',' || chr(10), concat('  title = {', title, '}'),
 concat('  author = {', array_to_string(list_transform(range(1, seq % 7 + 2), lambda i: concat(journal, ', Given', i, ' Van')), ' and '), '}'), concat('  journal = {', journal, '}'), CASE WHEN year IS NOT NULL THEN concat('  year = {', year, '}') END,
 CASE WHEN seq % 2 = 0 THEN concat('  doi = {10.1/a-', seq, '}') END, CASE WHEN seq % 2 = 0 THEN concat('  url = {https://doi.org/10.1/a-', seq, '}') END), chr(10), '}') AS entry FROM papers""", "papers")


# --- logs

_COSTS = "SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 3 > 0 THEN value END AS cost_usd, CASE WHEN event_id % 4 > 0 THEN event_id % 1000 END AS input_tokens, CASE WHEN event_id % 4 > 0 THEN event_id % 77 END AS output_tokens, value FROM events"


def d17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.daily_spend(run(spark, sf_dir, _COSTS), 15000.0)


D17_SQL = f"""SELECT day, spent, calls, estimated, greatest(0.0::DOUBLE, round(15000.0::DOUBLE - spent, 6)) AS remaining, spent >= 15000.0::DOUBLE AS exhausted FROM (
 SELECT CAST(ts AS DATE) AS day, round(sum(cost), 6) AS spent, count(*) AS calls, count(*) FILTER (cost_usd IS NULL) AS estimated FROM (SELECT *, coalesce(cost_usd, (input_tokens + output_tokens) * 1e-6::DOUBLE) AS cost FROM ({_COSTS}) c) x WHERE cost IS NOT NULL GROUP BY 1) y"""


def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = run(spark, sf_dir, "SELECT user_id AS run_id, event_type AS status, CASE WHEN event_type = 'error' THEN props END AS error, ts, event_id FROM events")
    return ledger.latest(log, "run_id", ["ts", "event_id"], ["status", "error"])


A9_SQL = "SELECT run_id, status, error FROM (SELECT user_id AS run_id, event_type AS status, CASE WHEN event_type = 'error' THEN props END AS error, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) x WHERE r = 1"


def c17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type and property text is a request; the log before has the answers."""
    e = run(spark, sf_dir, "SELECT event_id, user_id, event_type, props, value FROM events")
    asked = e.select(ledger.request_key({"model": F.col("event_type"), "body": F.col("props")}).alias("key"), "event_id")
    stored = e.select(ledger.request_key({"body": F.col("props"), "model": F.col("event_type")}).alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 2).cast("int").alias("version"), F.col("value").alias("body"), F.when(F.col("event_id") % 5 > 0, F.col("event_id").cast("double")).alias("stored_at"))
    return ledger.cached_answers(asked, stored, 1, 8000.0, 5000.0).select("event_id", "body", "hit")


C17_SQL = "WITH f AS (SELECT event_type, props, arg_min(value, event_id) AS body FROM events WHERE event_id % 2 = 1 AND event_id % 5 > 0 AND 8000 - event_id <= 5000 GROUP BY 1, 2) SELECT e.event_id, f.body, f.body IS NOT NULL AS hit FROM events e LEFT JOIN f ON f.event_type = e.event_type AND f.props = e.props"


def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return ledger.running_budget(turns, "conv_id", ["turn"], F.length("text"), 1500).select("conv_id", "turn", "held")


def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.drained(streams.daily(streams.event_stream(spark, sf_dir)), f"daily_{uuid.uuid4().hex}")
    return found.select(F.to_date("window.start").alias("day"), F.round("spent", 4).alias("spent"), "calls")


def queries() -> dict:
    return {
        "a1_openalex_papers": a1, "a4_reference_edges": a4, "a5_most_cited_citing": a5, "a5_most_cited_citing_whole": a5_whole, "c3_abstract_backfill": c3, "c6_merge_providers": c6, "c7_provider_conflicts": c7, "d2_union_edges": d2,
        "a9_latest_state": a9, "a10_paper_csv": a10, "a11_edge_csv": a11, "a14_graphml": a14, "a17_ris": a17, "a18_bibtex": a18, "c17_answer_cache": c17, "d17_daily_spend": d17, "g3_running_budget": g3, "s2_daily_stream": s2,
    }


def oracle_sql() -> dict:
    return {
        "a1_openalex_papers": A1_SQL,
        "a4_reference_edges": "SELECT concat('W', p_partkey) AS source_paper_id, concat('W', p_partkey + i) AS target_paper_id, CAST(i - 1 AS INTEGER) AS seq FROM (SELECT p_partkey, unnest(range(1, p_partkey % 3 + 2)) AS i FROM part) x",
        "a5_most_cited_citing": A5_SQL, "c3_abstract_backfill": C3_SQL, "c6_merge_providers": C6_SQL, "c7_provider_conflicts": C7_SQL, "d2_union_edges": D2_SQL,
        "a9_latest_state": A9_SQL, "a10_paper_csv": A10_SQL, "a11_edge_csv": A11_SQL, "a14_graphml": A14_SQL, "a17_ris": A17_SQL, "a18_bibtex": A18_SQL, "c17_answer_cache": C17_SQL, "d17_daily_spend": D17_SQL,
        "g3_running_budget": "SELECT * FROM (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS held FROM conversations) x WHERE held <= 1500",
        "s2_daily_stream": "SELECT CAST(ts AS DATE) AS day, round(sum(value), 4) AS spent, count(*) AS calls FROM events GROUP BY 1",
    }
