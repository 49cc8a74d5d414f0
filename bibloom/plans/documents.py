"""Queries of files: provider dumps read back, and graph documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.functions.storage import shared_folder
from bibloom.operators import fulltext, traverse, weights
from bibloom.plans import fulltext as fulltext_queries
from bibloom.plans import records as record_queries
from bibloom.plans import text as text_queries
from bibloom.plans import views as view_queries
from bibloom.plans.graph import F1_SQL, seeds_and_edges
from bibloom.sources import dumps, exports
from bibloom.sources.recipes import run, table, with_recipes
from bibloom.streaming import papers


def _dump(spark: SparkSession, sf_dir: str, provider: str) -> str:
    """A folder of the given parts as a provider's JSON lines, with broken lines among them."""
    made = {"openalex": lambda: record_queries.works(spark, sf_dir).drop("k"), "crossref": lambda: crossref_with_references(spark, sf_dir), "europe_pmc": lambda: view_queries.europe_pmc_hits(spark, sf_dir)}
    path = f"{shared_folder(spark)}/dump-{provider}-{uuid.uuid4().hex}"
    dumps.write_works(made[provider](), f"{path}/good")
    k = F.col("p_partkey")
    torn = F.when(k % 3 == 0, F.concat(F.lit('{"id": "w'), k)).when(k % 3 == 1, F.lit("not json at all")).otherwise(F.lit('{"id": "x", "title": ['))
    table(spark, sf_dir, "part").filter(k % 20 == 0).select(torn.alias("value")).write.text(f"{path}/torn")
    # a field of another type: the rest of such a line stays
    odd = F.concat(F.lit('{"DOI": "10.9/odd'), k, F.lit('", "title": {"not": "a list"}}')) if provider == "crossref" else None
    if odd is not None:
        table(spark, sf_dir, "part").filter(k % 50 == 1).select(odd.alias("value")).write.text(f"{path}/odd")
    return f"{path}/*"


def crossref_with_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view_queries.crossref_works(spark, sf_dir)
    n = F.coalesce(F.regexp_extract("DOI", "([0-9]+)$", 1).try_cast("long"), F.lit(0))
    cited = F.transform(F.sequence(F.lit(1), n % 3 + 1), lambda i: F.struct(F.when(i != 2, F.concat(F.lit("10.1/ABC"), n + i)).alias("DOI")))
    return raw.select(*[F.col(f"`{c}`") for c in raw.columns if c != "reference"], F.when(n % 7 > 0, cited).alias("reference"))


def a1_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dumps.papers(spark, _dump(spark, sf_dir, "openalex"), "openalex").drop("pmcid", "metadata_confidence")


def a2_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dumps.papers(spark, _dump(spark, sf_dir, "crossref"), "crossref")


A2_DUMP_SQL = f"{view_queries.A2_SQL} UNION ALL SELECT concat('10.9/odd', p_partkey), concat('10.9/odd', p_partkey), 'Unknown Title', [], NULL, NULL, 0.9::DOUBLE FROM part WHERE p_partkey % 50 = 1"


def a3_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dumps.papers(spark, _dump(spark, sf_dir, "europe_pmc"), "europe_pmc").drop("pmcid")


def a4_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of both providers that list them, each with its own ids."""
    one = dumps.references(spark, _dump(spark, sf_dir, "openalex"), "openalex").withColumn("provider", F.lit("openalex"))
    two = dumps.references(spark, _dump(spark, sf_dir, "crossref"), "crossref").withColumn("provider", F.lit("crossref"))
    return one.unionByName(two)


A4_DUMP_SQL = """SELECT concat('W', p_partkey) AS source_paper_id, concat('W', p_partkey + i) AS target_paper_id, CAST(i - 1 AS INTEGER) AS seq, 'openalex' AS provider FROM part, unnest(range(1, p_partkey % 3 + 2)) AS t(i) UNION ALL
SELECT concat('10.1/AbC', p_partkey), concat('10.1/abc', p_partkey + i), CAST(i - 1 AS INTEGER), 'crossref' FROM part, unnest(range(1, p_partkey % 3 + 2)) AS t(i) WHERE p_partkey % 4 > 0 AND p_partkey % 7 > 0 AND i <> 2"""


def a_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, broken lines and lines that lost a field of each provider's dump."""
    found = [dumps.rejected(spark, _dump(spark, sf_dir, p), p) for p in dumps.PROVIDERS]
    return found[0].union(found[1]).union(found[2])


REJECTED_SQL = """WITH n AS (SELECT count(*) AS n, count(*) FILTER (p_partkey % 20 = 0) AS torn, count(*) FILTER (p_partkey % 50 = 1) AS odd FROM part)
SELECT 'openalex' AS provider, n + torn AS lines, torn AS broken, 0::BIGINT AS partial FROM n UNION ALL SELECT 'crossref', n + torn + odd, torn, odd FROM n UNION ALL SELECT 'europe_pmc', n + torn, torn, 0 FROM n"""

# --- graph documents


def _journal_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each journal's papers, titles with signs that XML escapes, and the edges among them."""
    titled = table(spark, sf_dir, "papers").withColumn("title", F.concat("title", F.lit(' <"&>')))
    v = weights.build_vertices(titled, table(spark, sf_dir, "resolutions"))
    inside = run(spark, sf_dir, "SELECT a.journal, source_paper_id AS source, target_paper_id AS target, CASE WHEN e.seq % 3 > 0 THEN round(e.confidence, 2) END AS weight, round(e.confidence, 2) AS confidence FROM edges e JOIN papers a ON a.paper_id = source_paper_id JOIN papers b ON b.paper_id = target_paper_id AND b.journal = a.journal", "edges", "papers")
    return v, inside


def a14_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of a GraphML document a journal, written to files and read back from them."""
    lines = exports.graphml_lines(*_journal_graphs(spark, sf_dir), "journal")
    path = f"{shared_folder(spark)}/graphml-{uuid.uuid4().hex}"
    exports.write_documents(lines, path, "journal", 8)
    return spark.read.schema("value STRING, journal STRING").text(path).groupBy("journal", "value").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("value", "line")


_HEAD = ('<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="title" for="node" attr.name="title" attr.type="string"/>', '<key id="year" for="node" attr.name="year" attr.type="int"/>', '<key id="n_eff" for="node" attr.name="n_eff" attr.type="int"/>', '<key id="status" for="node" attr.name="status" attr.type="string"/>', '<key id="weight" for="edge" attr.name="weight" attr.type="double"/>', '<key id="confidence" for="edge" attr.name="confidence" attr.type="double"/>', '<graph edgedefault="directed">', "</graph>", "</graphml>")
A14_DOCUMENT_SQL = with_recipes(f"""WITH lines AS (
SELECT p.journal, concat('<node id="', p.paper_id, '"><data key="title">', title, ' &lt;&quot;&amp;&gt;</data>', CASE WHEN year IS NOT NULL THEN concat('<data key="year">', year, '</data>') END, CASE WHEN n_eff IS NOT NULL THEN concat('<data key="n_eff">', n_eff, '</data>') END, CASE WHEN status IS NOT NULL THEN concat('<data key="status">', status, '</data>') END, '</node>') AS line FROM papers p LEFT JOIN resolutions r ON r.paper_id = p.paper_id
UNION ALL SELECT a.journal, concat('<edge source="', source_paper_id, '" target="', target_paper_id, '">', CASE WHEN e.seq % 3 > 0 THEN concat('<data key="weight">', round(e.confidence, 2), '</data>') END, '<data key="confidence">', round(e.confidence, 2), '</data></edge>') FROM edges e JOIN papers a ON a.paper_id = source_paper_id JOIN papers b ON b.paper_id = target_paper_id AND b.journal = a.journal
UNION ALL SELECT DISTINCT journal, unnest([{', '.join("'" + x + "'" for x in _HEAD)}]) FROM papers) SELECT journal, line, count(*) AS n FROM lines GROUP BY 1, 2""", "papers", "edges", "resolutions")  # fmt: skip


def a12_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole node/link document of every seed's walk, at most 100 papers each."""
    seeds, edges = seeds_and_edges(spark, sf_dir)
    edges = edges.select(F.col("source_paper_id").alias("source"), F.col("target_paper_id").alias("target"), "confidence", "seq")
    walk = traverse.traverse(seeds, edges, 2, 1, 100).select("seed_id", "paper_id")
    v = weights.build_vertices(table(spark, sf_dir, "papers").join(walk, "paper_id"), table(spark, sf_dir, "resolutions").join(walk.select("paper_id").distinct(), "paper_id", "left_semi"))
    end = lambda c: walk.select("seed_id", F.col("paper_id").alias(c))
    inside = edges.join(end("source"), "source").join(end("target"), ["seed_id", "target"]).select("seed_id", "source", "target", F.round("confidence", 2).alias("weight"))
    back = F.from_json("document", "nodes array<struct<id:string,label:string,year:int,n_eff:int>>, links array<struct<source:string,target:string,weight:double>>")
    read = exports.node_link(v, inside, "seed_id").select("seed_id", back.alias("d"))
    said = lambda c, fields: F.transform(f"d.{c}", lambda x: F.concat_ws("|", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields]))
    return read.select("seed_id", said("nodes", ("id", "label", "year", "n_eff")).alias("nodes"), said("links", ("source", "target", "weight")).alias("links"))


A12_DOCUMENTS_SQL = (
    F1_SQL.replace(" SELECT * FROM k3", """, n AS (SELECT seed_id, list(concat_ws('|', p.paper_id, title, coalesce(year::VARCHAR, '-'), coalesce(n_eff::VARCHAR, '-')) ORDER BY p.paper_id) AS nodes FROM k3 JOIN papers p ON p.paper_id = k3.paper_id LEFT JOIN resolutions r ON r.paper_id = p.paper_id GROUP BY 1),
l AS (SELECT a.seed_id, list(concat_ws('|', source_paper_id, target_paper_id, round(e.confidence, 2)) ORDER BY source_paper_id, target_paper_id) AS links FROM edges e JOIN k3 a ON a.paper_id = source_paper_id JOIN k3 b ON b.paper_id = target_paper_id AND b.seed_id = a.seed_id GROUP BY 1)
SELECT n.seed_id, nodes, coalesce(links, []) AS links FROM n LEFT JOIN l ON l.seed_id = n.seed_id""")
    .replace("WITH pairs", with_recipes("", "papers", "resolutions").strip() + ", pairs", 1)
)


# --- texts: ids with any sign, and texts as they arrive


def c5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text recovery of papers whose ids hold the signs that keys are often glued with."""
    named = lambda df: df.withColumn("paper_id", F.concat(F.lit("10.1/a#b|"), "paper_id", F.lit(":c")))
    had = named(table(spark, sf_dir, "resolutions").withColumn("semantic_type", F.lit(None).cast("string")))
    found = fulltext.recovered(had, named(fulltext_queries._sections(spark, sf_dir)))
    return found.select("paper_id", "n_eff", "semantic_type", F.round("confidence", 6).alias("confidence"), "status", "from_full_text")


ARRIVING = """SELECT concat('P', p_partkey) AS paper_id, CASE WHEN p_partkey % 2 = 0 THEN 'methods' ELSE 'full_text' END AS section,
    CASE p_partkey % 5 WHEN 0 THEN concat('A total of ', 30 + p_partkey % 900, ' patients were randomized. Then ', p_size, ' women were followed for a year!')
    WHEN 1 THEN concat('We screened ', 50 + p_size, ' participants. The sample size was N=', 50 + p_size, ' in 2019.') WHEN 2 THEN 'No size is told here.' WHEN 3 THEN ''
    ELSE concat('A cohort of ', 40 + p_partkey % 777, ' adult subjects; ', p_size, ' patients completed treatment.') END AS text FROM part"""


def s1_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study sizes of texts that arrive as files, each resolved inside its row."""
    parts = papers.arriving(spark, sf_dir, "part.parquet")
    view = f"arriving_{uuid.uuid4().hex}"
    parts.createOrReplaceTempView(view)
    texts = spark.sql(ARRIVING.replace("FROM part", f"FROM {view}"))
    found = papers.resolve(texts, f"resolved-{uuid.uuid4().hex}")
    return found.select("paper_id", "n_eff", "semantic_type", "confidence", "status", "selected_candidate_id")


S1_SQL = f"""WITH texts AS ({ARRIVING}), papers AS (SELECT paper_id FROM texts), {text_queries._RESOLVED.replace("FROM m\n", "FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, section, sentence_no ORDER BY pattern_no, k) - 1 AS match_no FROM m) n\n")}
SELECT p.paper_id, b.value AS n_eff, b.semantic_type, coalesce(b.confidence, 0.0::DOUBLE) AS confidence, CASE WHEN b.value IS NULL THEN 'missing' WHEN v.paper_id IS NOT NULL THEN 'ambiguous' ELSE 'resolved' END AS status,
    CASE WHEN b.value IS NOT NULL THEN sha256(concat_ws('|', b.paper_id, b.section, b.sentence_no, b.match_no)) END AS selected_candidate_id FROM papers p LEFT JOIN b ON b.paper_id = p.paper_id LEFT JOIN v ON v.paper_id = p.paper_id"""


def queries() -> dict:
    return {
        "a1_openalex_dump": a1_dump, "a2_crossref_dump": a2_dump, "a3_europe_pmc_dump": a3_dump, "a4_dump_references": a4_dump, "a_rejected_lines": a_rejected,
        "a12_walk_documents": a12_documents, "a14_graphml_document": a14_document,
        "c5_recovery_of_any_id": c5_ids, "s1_arriving_resolutions": s1_resolutions,
    }


def oracle_sql() -> dict:
    return {
        "a1_openalex_dump": record_queries.A1_SQL, "a2_crossref_dump": A2_DUMP_SQL, "a3_europe_pmc_dump": view_queries.A3_SQL, "a4_dump_references": A4_DUMP_SQL, "a_rejected_lines": REJECTED_SQL,
        "a12_walk_documents": A12_DOCUMENTS_SQL, "a14_graphml_document": A14_DOCUMENT_SQL,
        "c5_recovery_of_any_id": f"SELECT concat('10.1/a#b|', paper_id, ':c') AS paper_id, * EXCLUDE (paper_id) FROM ({fulltext_queries.C5_SQL}) x", "s1_arriving_resolutions": S1_SQL,
    }
