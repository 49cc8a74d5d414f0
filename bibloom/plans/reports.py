"""Queries of whole reports, tables and messages, and of graphs as their seeds see them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibloom.functions.storage import written
from bibloom.operators import report, tables, weights
from bibloom.plans.figures import CITED
from bibloom.sources import exports
from bibloom.sources.recipes import run, table, with_recipes

_NAMES = ("edges", "seeds", "papers", "resolutions")
#: What each seed cites, twelve papers at most: a small walk
WALK = f"SELECT s.seed_id, c.paper_id, c.rank, c.confidence AS link, p.title, p.year, p.seq, p.domain, q.seq AS seed_seq, q.title AS seed_title FROM seeds s JOIN ({CITED}) c ON c.seed_id = s.seed_id JOIN papers p ON p.paper_id = c.paper_id JOIN papers q ON q.paper_id = s.seed_id WHERE c.rank <= 12"
HEADS = "SELECT seed_id, concat('run-', seed_id) AS run_id, '2026-01-01 00:00:00 UTC' AS generated, concat(title, ' |  x') AS title, CAST(seq % 7 AS INTEGER) AS n_people, CASE WHEN seq % 4 > 0 THEN journal END AS journal, year FROM seeds JOIN papers ON paper_id = seed_id"
RANKED = f"SELECT w.seed_id, w.rank, title, year, link AS score, n_eff FROM ({WALK}) w LEFT JOIN resolutions r ON r.paper_id = w.paper_id WHERE w.rank <= 10 AND seed_seq % 5 > 0"
SIZES = f"SELECT w.seed_id, w.paper_id, CASE WHEN w.seq % 9 = 0 THEN '' ELSE title END AS title, CASE WHEN seed_seq % 3 > 0 THEN n_eff END AS n_eff, CASE WHEN w.seq % 2 = 0 THEN 'TOTAL_ENROLLED' END AS semantic_type, CASE WHEN seed_seq % 6 = 0 THEN 'not_applicable' ELSE status END AS status, confidence FROM ({WALK}) w JOIN resolutions r ON r.paper_id = w.paper_id"
DATASETS = f"SELECT seed_id, paper_id, title, CASE WHEN seq % 3 > 0 THEN CAST(seq * 10 AS BIGINT) END AS value, CASE WHEN seq % 3 > 0 THEN 'images' END AS unit, CASE WHEN seq % 3 > 0 THEN 'training_examples' END AS kind, CASE WHEN seq % 3 > 0 THEN 'resolved' ELSE 'missing' END AS status, CASE WHEN seq % 3 > 0 THEN CAST(0.85 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS confidence FROM ({WALK}) w WHERE domain = 'computer_science' AND seed_seq % 2 = 0"
PATHS = f"SELECT seed_id, rank, seed_title, title, link AS score FROM ({WALK}) w WHERE rank <= 7 AND seed_seq % 11 > 0"


def a15_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    walk, view = written(run(spark, sf_dir, WALK, *_NAMES)), f"walk_{uuid.uuid4().hex}"
    walk.createOrReplaceTempView(view)
    t = lambda q: written(run(spark, sf_dir, q.replace(f"({WALK})", view), *(_NAMES if q == HEADS else ("resolutions",))))
    names = F.when(F.col("n_people") > 0, F.transform(F.sequence(F.lit(1), F.greatest("n_people", F.lit(1))), lambda i: F.concat(F.lit("Author "), i))).otherwise(F.array().cast("array<string>"))
    heads = t(HEADS).withColumn("authors", names)
    paths = t(PATHS).withColumn("titles", F.array("seed_title", "title"))
    return report.report_lines(heads, walk, walk.filter("rank % 2 = 0"), t(RANKED), t(SIZES), t(DATASETS), paths)


def a15_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of every seed."""
    return report.documents(a15_lines(spark, sf_dir))


def _md(c: str) -> str:
    return rf"trim(regexp_replace(replace({c}, '|', '\|'), '\s+', ' ', 'g'))"


A15_WHOLE_SQL = with_recipes(rf"""WITH w AS ({WALK}), h AS ({HEADS}), k AS ({RANKED}), z AS ({SIZES}), d AS ({DATASETS}), t AS ({PATHS}),
a AS (SELECT h.*, (SELECT count(*) FROM w WHERE w.seed_id = h.seed_id) AS papers, (SELECT count(*) FROM w WHERE w.seed_id = h.seed_id AND rank % 2 = 0) AS edges, (SELECT count(n_eff) FROM z WHERE z.seed_id = h.seed_id) AS sized,
    (SELECT count(*) FROM z WHERE z.seed_id = h.seed_id AND status <> 'not_applicable') AS applicable, (SELECT count(*) FROM d WHERE d.seed_id = h.seed_id) AS n_data, (SELECT count(value) FROM d WHERE d.seed_id = h.seed_id) AS counted,
    (SELECT count(*) FROM k WHERE k.seed_id = h.seed_id) AS ranked, (SELECT count(*) FROM t WHERE t.seed_id = h.seed_id) AS paths FROM h),
x AS (SELECT a.*, (SELECT string_agg(concat('| ', rank, ' | ', {_md('title')}, ' | ', coalesce(year::VARCHAR, '—'), ' | ', printf('%.3f', score), ' | ', coalesce(nullif(n_eff, 0)::VARCHAR, '—'), ' |'), chr(10) ORDER BY rank) FROM k WHERE k.seed_id = a.seed_id) AS ranks,
    (SELECT string_agg(concat('| ', {_md('title')}, ' | ', coalesce(value::VARCHAR, '—'), ' | ', coalesce(unit, '—'), ' | ', coalesce(kind, '—'), ' | ', status, ' | ', printf('%.2f', confidence), ' |'), chr(10) ORDER BY paper_id) FROM d WHERE d.seed_id = a.seed_id) AS data,
    (SELECT string_agg(concat('| ', CASE WHEN title = '' THEN concat('`', paper_id, '`') ELSE {_md('title')} END, ' | ', n_eff, ' | ', coalesce(semantic_type, '—'), ' | ', status, ' | ', printf('%.2f', confidence), ' |'), chr(10) ORDER BY n_eff DESC, paper_id) FROM z WHERE z.seed_id = a.seed_id AND n_eff IS NOT NULL) AS sizes,
    (SELECT string_agg(concat_ws(chr(10), concat(rank, '. **score ', printf('%.3f', score), '** (1 hops)'), concat('   - ', {_md('seed_title')}), concat('   - → ', {_md('title')}), ''), chr(10) ORDER BY rank) FROM t WHERE t.seed_id = a.seed_id AND rank <= 5) AS hops FROM a)
SELECT seed_id, concat_ws(chr(10), '# Citation analysis', '', concat('## ', {_md('title')}), CASE WHEN n_people > 0 THEN concat('*', array_to_string(list_transform(range(1, least(4, n_people) + 1), lambda i: concat('Author ', i)), ', '), CASE WHEN n_people > 4 THEN ' et al.' ELSE '' END, '*') END,
    nullif(concat_ws(' · ', journal, year), ''), '', concat('- **Run**: `', run_id, '`'), concat('- **Seed paper**: `', seed_id, '`'), concat('- **Generated**: ', generated), '', '## Summary', '', '| Metric | Value |', '| --- | --- |', concat('| Papers in graph | ', papers, ' |'), concat('| Citation edges | ', edges, ' |'),
    concat('| Papers with a study size | ', sized, ' of ', applicable, ' applicable |'), concat('| Papers with dataset counts | ', counted, ' of ', n_data, ' |'), concat('| Foundational candidates | ', ranked, ' |'), concat('| Citation paths | ', paths, ' |'), '',
    '## Probable foundational papers', '', CASE WHEN ranked > 0 THEN '| Rank | Title | Year | Score | Study size |' || chr(10) || '| ---: | --- | ---: | ---: | ---: |' END, ranks, CASE WHEN ranked = 0 THEN '_No candidates were ranked._' END, '',
    CASE WHEN n_data > 0 THEN concat_ws(chr(10), '## Dataset evidence', '', 'Dataset counts are no study sizes and weigh no ranking.', '', '| Paper | Count | Unit | Kind | Status | Confidence |', '| --- | ---: | --- | --- | --- | ---: |', data, '') END,
    '## Population evidence', '', CASE WHEN sized > 0 THEN '| Paper | N | Type | Status | Confidence |' || chr(10) || '| --- | ---: | --- | --- | ---: |' END, sizes, CASE WHEN sized = 0 AND applicable = 0 THEN '_Study sizes do not apply to these papers._' WHEN sized = 0 THEN '_No study sizes were found; edges have a uniform weight._' END, '',
    CASE WHEN paths > 0 THEN concat_ws(chr(10), '## Top citation paths', '', hops) END, '---', '', '_Rankings are probable, not certain. Read the papers before citing them._') AS document FROM x""", *_NAMES)  # fmt: skip


RUNS = """SELECT source_paper_id AS run, CASE WHEN min(seq) % 5 = 0 THEN concat('10.1/', source_paper_id) END AS dead_doi, CAST(min(seq) % 4 AS INTEGER) AS lost_lookups, CAST(min(seq) % 3 AS INTEGER) AS abstracts_recovered, CAST(min(seq) % 2 AS INTEGER) AS full_text_recovered,
    CAST(min(seq) % 6 AS INTEGER) AS dataset_papers, CAST(count(*) % 7 AS INTEGER) AS without_abstract, CAST(count(*) AS INTEGER) AS papers, CAST(min(seq) % 8 AS INTEGER) AS duplicates_merged, CASE WHEN min(seq) % 9 = 0 THEN 'the title matched weakly' END AS told FROM edges GROUP BY source_paper_id"""


def d7_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of messages of every run, in order."""
    runs = run(spark, sf_dir, RUNS, "edges").withColumn("warnings", F.when(F.col("told").isNotNull(), F.array("told")))
    return tables.walk_warnings(runs)


D7_WHOLE_SQL = with_recipes(f"""WITH r AS ({RUNS}), m AS (SELECT run, list_filter([told, CASE WHEN dead_doi IS NOT NULL THEN concat('The page of the seed''s DOI ', dead_doi, ' is gone; its metadata stand.') END,
    CASE WHEN lost_lookups > 0 THEN concat(lost_lookups, ' lookups stayed without an answer; abstracts or full texts may be missing.') END, CASE WHEN abstracts_recovered > 0 THEN concat(abstracts_recovered, ' abstracts came from another provider.') END,
    CASE WHEN full_text_recovered > 0 THEN concat(full_text_recovered, ' papers got their study size from the full text.') END, CASE WHEN dataset_papers > 0 THEN 'Dataset counts come from abstracts and weigh no ranking.' END,
    CASE WHEN without_abstract > 0 THEN concat(without_abstract, ' of ', papers, ' papers have no abstract.') END, CASE WHEN duplicates_merged > 0 THEN concat(duplicates_merged, ' duplicate records were merged before the paper limit.') END], lambda x: x IS NOT NULL) AS l FROM r)
SELECT run, (generate_subscripts(l, 1) - 1)::INTEGER AS seq, unnest(l) AS warning FROM m""", "edges")  # fmt: skip


def _people(df: DataFrame) -> DataFrame:
    return df.withColumn("authors", F.transform(F.sequence(F.lit(1), F.col("seq") % 7 + 1), lambda i: F.concat(F.lit("Given"), i, F.lit(" Van "), F.col("journal"))))


_AUTHORS = "list_transform(range(1, least({0}, seq % 7 + 1) + 1), lambda i: concat('Given', i, ' Van ', journal))"
_DATA = "SELECT paper_id, CASE WHEN seq % 3 > 0 THEN CAST(seq * 10 AS BIGINT) END AS value, CASE WHEN seq % 3 > 0 THEN 'images' END AS unit, 'training_examples' AS kind, CASE WHEN seq % 3 > 0 THEN 'resolved' ELSE 'missing' END AS status, CAST(seq % 4 AS DOUBLE) / CAST(4 AS DOUBLE) AS confidence, CASE WHEN seq % 6 > 0 THEN 'We trained on \"many\", and more' END AS evidence FROM papers WHERE domain = 'computer_science'"


def a10_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paper table with every column."""
    n = F.col("seq")
    papers = _people(table(spark, sf_dir, "papers")).withColumns({"doi": F.when(n % 2 == 0, F.concat(F.lit("10.1/a-"), n)), "pmid": F.when(n % 3 == 0, n.cast("string")), "research_domain": F.col("domain"), "research_field": F.when(n % 5 > 0, F.col("journal"))})
    edges = table(spark, sf_dir, "edges")
    cited = edges.groupBy(F.col("target_paper_id").alias("paper_id")).agg(F.count(F.lit(1)).alias("n"))
    order = (F.col("n").desc(), F.col("paper_id"))
    ranks = cited.orderBy(*order).limit(10).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    seeds = table(spark, sf_dir, "seeds").select(F.col("seed_id").alias("paper_id"))
    return exports.paper_table(papers, table(spark, sf_dir, "resolutions"), run(spark, sf_dir, _DATA, "papers"), edges, ranks, seeds)


A10_WHOLE_SQL = with_recipes(f"""WITH c AS (SELECT target_paper_id AS id, count(*) AS n FROM edges GROUP BY 1), o AS (SELECT source_paper_id AS id, count(*) AS n FROM edges GROUP BY 1), k AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS rank FROM c), d AS ({_DATA})
SELECT p.paper_id, title, array_to_string({_AUTHORS.format(5)}, '; ') || CASE WHEN seq % 7 + 1 > 5 THEN '; et al.' ELSE '' END AS authors, coalesce(CAST(year AS VARCHAR), '') AS year, journal, CASE WHEN seq % 2 = 0 THEN concat('10.1/a-', seq) ELSE '' END AS doi, CASE WHEN seq % 3 = 0 THEN seq::VARCHAR ELSE '' END AS pmid,
 coalesce(CAST(r.n_eff AS VARCHAR), '') AS n_eff, coalesce(r.status, '') AS population_status, CASE WHEN r.confidence IS NULL THEN '' ELSE printf('%.2f', r.confidence) END AS population_confidence, domain AS research_domain, CASE WHEN seq % 5 > 0 THEN journal ELSE '' END AS research_field,
 coalesce(d.value::VARCHAR, '') AS dataset_examples, coalesce(d.unit, '') AS dataset_unit, coalesce(d.kind, '') AS dataset_kind, coalesce(d.status, '') AS dataset_status, CASE WHEN d.confidence IS NULL THEN '' ELSE printf('%.2f', d.confidence) END AS dataset_confidence, coalesce(d.evidence, '') AS dataset_evidence,
 CAST(coalesce(c.n, 0) AS VARCHAR) AS cited_by_in_graph, CAST(coalesce(o.n, 0) AS VARCHAR) AS references_in_graph, coalesce(CAST(k.rank AS VARCHAR), '') AS foundational_rank, CASE WHEN p.paper_id IN (SELECT seed_id FROM seeds) THEN 'yes' ELSE 'no' END AS is_seed
FROM papers p LEFT JOIN resolutions r ON r.paper_id = p.paper_id LEFT JOIN c ON c.id = p.paper_id LEFT JOIN o ON o.id = p.paper_id LEFT JOIN k ON k.id = p.paper_id AND k.rank <= 10 LEFT JOIN d ON d.paper_id = p.paper_id""", *_NAMES)  # fmt: skip

SEED_EDGES = f"SELECT w.seed_id, w.seed_id AS source_paper_id, w.paper_id AS target_paper_id, w.link AS confidence FROM ({WALK}) w"
SEED_DOMAINS = "SELECT seed_id, CASE WHEN seq % 7 > 0 THEN domain END AS research_domain FROM seeds JOIN papers ON paper_id = seed_id"


def e4_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of each seed's edges: a seed outside medicine lets no study size into its ranking."""
    found = weights.weight_seed_edges(run(spark, sf_dir, SEED_EDGES, *_NAMES), table(spark, sf_dir, "resolutions"), run(spark, sf_dir, SEED_DOMAINS, *_NAMES))
    return found.select("seed_id", "target_paper_id", "sized", F.round("n_score", 9).alias("n_score"), F.round("final_weight", 9).alias("final_weight"))


E4_SEEDS_SQL = with_recipes(f"""WITH e AS ({SEED_EDGES}), s AS (SELECT seed_id, NOT coalesce(research_domain IN ('computer_science', 'nonclinical'), false) AS sized FROM ({SEED_DOMAINS}) y),
j AS (SELECT e.*, sized, r.paper_id IS NOT NULL AS known, n_eff, r.confidence AS trust FROM e JOIN s ON s.seed_id = e.seed_id LEFT JOIN resolutions r ON r.paper_id = target_paper_id AND sized),
n AS (SELECT *, least(1.0::DOUBLE, ln(1.0::DOUBLE + coalesce(n_eff, 0)) / ln(100001.0::DOUBLE)) AS ns FROM j)
SELECT seed_id, target_paper_id, sized, round(ns, 9) AS n_score, round((0.75::DOUBLE * ns * CASE WHEN known THEN trust ELSE 0.5::DOUBLE END + 0.125::DOUBLE) * confidence, 9) AS final_weight FROM n""", *_NAMES)  # fmt: skip


def f5_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = _people(table(spark, sf_dir, "papers")).withColumn("research_domain", F.col("domain"))
    return weights.graph_vertices(papers, table(spark, sf_dir, "resolutions"))


F5_VERTICES_SQL = with_recipes(f"SELECT p.paper_id, title, year, array_to_string({_AUTHORS.format(3)}, ', ') || CASE WHEN seq % 7 + 1 > 3 THEN '...' ELSE '' END AS authors, journal, n_eff, coalesce(confidence, 0::DOUBLE) AS population_confidence, domain AS research_domain, 'paper' AS type FROM papers p LEFT JOIN resolutions r ON r.paper_id = p.paper_id", "papers", "resolutions")
# every seventh pair comes twice, the second time without a provider
RAW_EDGES = """SELECT source_paper_id, target_paper_id, 'cites' AS relation, confidence, CASE WHEN seq % 3 = 0 THEN CAST(0 AS DOUBLE) WHEN seq % 3 = 1 THEN confidence END AS final_weight, seq, CAST(2 AS INTEGER) AS n FROM edges
    UNION ALL SELECT source_paper_id, target_paper_id, 'mentions', confidence / 2, CAST(NULL AS DOUBLE), seq + 1, CAST(0 AS INTEGER) FROM edges WHERE seq % 7 = 0"""


def f5_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = run(spark, sf_dir, RAW_EDGES, "edges").withColumn("providers", F.when(F.col("n") > 0, F.array(F.lit("openalex"), F.lit("crossref"))).otherwise(F.array().cast("array<string>")))
    return weights.graph_edges(raw)


F5_EDGES_SQL = with_recipes(f"""WITH r AS ({RAW_EDGES}) SELECT source_paper_id AS source, target_paper_id AS target, relation, confidence, coalesce(final_weight, 1::DOUBLE) AS weight, CASE WHEN n > 0 THEN 'openalex,crossref' ELSE '' END AS providers
FROM r QUALIFY row_number() OVER (PARTITION BY source_paper_id, target_paper_id ORDER BY seq DESC) = 1""", "edges")


def queries() -> dict:
    return {"a10_paper_table": a10_whole, "a15_whole_report": a15_whole, "d7_walk_warnings": d7_whole, "e4_seed_rule": e4_seeds, "f5_graph_vertices": f5_vertices, "f5_graph_edges": f5_edges}


def oracle_sql() -> dict:
    return {"a10_paper_table": A10_WHOLE_SQL, "a15_whole_report": A15_WHOLE_SQL, "d7_walk_warnings": D7_WHOLE_SQL, "e4_seed_rule": E4_SEEDS_SQL, "f5_graph_vertices": F5_VERTICES_SQL, "f5_graph_edges": F5_EDGES_SQL}
