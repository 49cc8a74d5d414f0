"""Queries of the graph operators."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.functions import ids
from bibloom.functions.storage import forget, written
from bibloom.operators import pagerank as pr
from bibloom.operators import paths, ranking, traverse, weights
from bibloom.sources.recipes import over, run, table, with_recipes

YEAR = 2026
ITERATIONS = 10
#: PageRank to convergence, as its operator does by default; the unrolled SQL has ITERATIONS steps
CONVERGED = (100, 1e-6)

WEIGHTED = """
weighted AS (SELECT e.source_paper_id, e.target_paper_id, e.confidence, e.seq,
    least(1.0::DOUBLE, greatest(0.0::DOUBLE, ln(1.0::DOUBLE + coalesce(r.n_eff, 0)) / ln(100001.0::DOUBLE))) AS n_score,
    CASE WHEN r.paper_id IS NULL THEN 0.5::DOUBLE ELSE r.confidence END AS trust
    FROM edges e LEFT JOIN resolutions r ON r.paper_id = e.target_paper_id),
final AS (SELECT *, 0.75::DOUBLE * n_score + 0.125::DOUBLE AS base_weight, (0.75::DOUBLE * n_score * trust + 0.125::DOUBLE) * confidence AS final_weight FROM weighted)
"""
LOCAL = """
local AS (SELECT DISTINCT seed_id, id FROM (
    SELECT seed_id, seed_id AS id FROM seeds
    UNION ALL SELECT seed_id, target_paper_id FROM seeds JOIN edges ON source_paper_id = seed_id
    UNION ALL SELECT seed_id, b.target_paper_id FROM seeds JOIN edges a ON a.source_paper_id = seed_id JOIN edges b ON b.source_paper_id = a.target_paper_id) z)
"""


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.weight_edges(table(spark, sf_dir, "edges"), table(spark, sf_dir, "resolutions"))


def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 9).alias(c)
    return weighted(spark, sf_dir).select("source_paper_id", "target_paper_id", r("n_score"), r("base_weight"), r("final_weight"))


def plain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(weighted(spark, sf_dir))


def _plain(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_paper_id").alias("source"), F.col("target_paper_id").alias("target"), F.col("final_weight").alias("weight"), "confidence", "seq")


def seeds_and_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Seeds and unweighted edges as tables: edges are derived once, and joins know how few seeds there are."""
    edges = written(table(spark, sf_dir, "edges"))
    return written(over(spark, sf_dir, "seeds", edges=edges).select("seed_id")), edges


def f7(spark: SparkSession, sf_dir: str, limits: tuple = (ITERATIONS, None)) -> DataFrame:
    edges = plain_edges(spark, sf_dir).withColumn("graph", F.lit("all"))
    vertices = table(spark, sf_dir, "papers").select(F.lit("all").alias("graph"), F.col("paper_id").alias("id"))
    return pr.pagerank(vertices, edges, *limits).select(F.col("id").alias("paper_id"), F.round("pagerank", 10).alias("pagerank"))


def _rank_sql(nodes: str, links: str, iterations: int) -> str:
    """Unrolled iterations over nodes (graph, id) and links (graph, s, t, w)."""
    out = [
        f"nodes AS ({nodes})", f"links AS ({links})", "sizes AS (SELECT graph, count(*)::DOUBLE AS n FROM nodes GROUP BY graph)",
        "totals AS (SELECT graph, s, sum(w) AS total FROM links GROUP BY graph, s)",
        "parts AS (SELECT l.graph, l.s, l.t, w / total AS p FROM links l JOIN totals x ON x.graph = l.graph AND x.s = l.s)",
        "r0 AS (SELECT v.graph, v.id, 1 / n AS pr FROM nodes v JOIN sizes z ON z.graph = v.graph)",
    ]
    for i in range(iterations):
        out.append(f"""g{i} AS (SELECT p.graph, p.t AS id, sum(p.p * r.pr) AS gain FROM parts p JOIN r{i} r ON r.graph = p.graph AND r.id = p.s GROUP BY p.graph, p.t),
        d{i} AS (SELECT r.graph, sum(r.pr) AS loose FROM r{i} r LEFT JOIN totals x ON x.graph = r.graph AND x.s = r.id WHERE x.s IS NULL GROUP BY r.graph),
        r{i + 1} AS MATERIALIZED (SELECT r.graph, r.id, 0.85::DOUBLE * (coalesce(gain, 0) + coalesce(loose, 0) / n) + 0.15::DOUBLE / n AS pr
            FROM r{i} r JOIN sizes z ON z.graph = r.graph LEFT JOIN g{i} g ON g.graph = r.graph AND g.id = r.id LEFT JOIN d{i} d ON d.graph = r.graph)""")
    return ", ".join(out)


def _converged_sql(nodes: str, links: str) -> str:
    """The same by recursion, each graph until its summed change is below n * 1e-6 or for 100 steps; rlast has the ranks."""
    return f"""nodes AS ({nodes}), links AS ({links}), sizes AS (SELECT graph, count(*)::DOUBLE AS n FROM nodes GROUP BY graph),
totals AS (SELECT graph, s, sum(w) AS total FROM links GROUP BY graph, s),
parts AS MATERIALIZED (SELECT l.graph, l.s, l.t, w / total AS p FROM links l JOIN totals x ON x.graph = l.graph AND x.s = l.s),
start AS MATERIALIZED (SELECT v.graph, v.id, n, x.s IS NULL AS loose FROM nodes v JOIN sizes z ON z.graph = v.graph LEFT JOIN totals x ON x.graph = v.graph AND x.s = v.id),
steps(step, graph, id, n, loose, pr, change) AS (SELECT 0, graph, id, n, loose, 1 / n, 1e300::DOUBLE FROM start UNION ALL
    SELECT step, graph, id, n, loose, fresh, sum(abs(fresh - pr)) OVER (PARTITION BY graph) FROM (
        SELECT k.step + 1 AS step, k.graph, k.id, k.n, k.loose, k.pr, 0.85::DOUBLE * (coalesce(g.gain, 0) + (sum(CASE WHEN k.loose THEN k.pr ELSE 0 END) OVER (PARTITION BY k.graph)) / k.n) + 0.15::DOUBLE / k.n AS fresh
        FROM steps k LEFT JOIN (SELECT p.graph, p.t AS id, sum(p.p * r.pr) AS gain FROM parts p JOIN steps r ON r.graph = p.graph AND r.id = p.s GROUP BY p.graph, p.t) g ON g.graph = k.graph AND g.id = k.id
        WHERE k.step < 100 AND k.change >= k.n * 1e-6::DOUBLE) y),
rlast AS (SELECT graph, id, pr FROM steps QUALIFY row_number() OVER (PARTITION BY graph, id ORDER BY step DESC) = 1)"""


def _local(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each seed's papers within two references, the edges among them, and the resolutions of such papers; edges of no seed's graph are never weighted."""
    seeds, edges = seeds_and_edges(spark, sf_dir)
    step = edges.select(F.col("source_paper_id").alias("id"), F.col("target_paper_id").alias("target"))
    one = written(seeds.withColumn("id", F.col("seed_id")).join(step, "id").select("seed_id", F.col("target").alias("id")))
    two = one.distinct().join(step, "id").select("seed_id", F.col("target").alias("id"))
    nodes = written(seeds.withColumn("id", F.col("seed_id")).unionByName(one).unionByName(two).distinct().withColumnRenamed("seed_id", "graph"))
    end = lambda c: nodes.select("graph", F.col("id").alias(c))
    inside = written(edges.join(end("source_paper_id"), "source_paper_id").join(end("target_paper_id"), ["graph", "target_paper_id"]))
    papers = nodes.select(F.col("id").alias("paper_id")).distinct()
    resolutions = written(table(spark, sf_dir, "resolutions").join(papers, "paper_id", "left_semi"))
    forget(seeds, edges, one)
    links = weights.weight_edges(inside, resolutions)
    return nodes, links.select("graph", F.col("source_paper_id").alias("source"), F.col("target_paper_id").alias("target"), F.col("final_weight").alias("weight")), resolutions


def scored(spark: SparkSession, sf_dir: str, limits: tuple = (ITERATIONS, None)) -> DataFrame:
    nodes, inside, resolutions = _local(spark, sf_dir)
    ranks = pr.pagerank(nodes, inside, *limits).select(F.col("graph").alias("seed_id"), F.col("id").alias("paper_id"), "pagerank")
    papers = table(spark, sf_dir, "papers").join(nodes.select(F.col("graph").alias("seed_id"), F.col("id").alias("paper_id")), "paper_id")
    return ranking.foundational_scores(weights.build_vertices(papers, resolutions), ranks, YEAR)


def f8(spark: SparkSession, sf_dir: str, limits: tuple = (ITERATIONS, None)) -> DataFrame:
    rounded = scored(spark, sf_dir, limits).withColumn("score", F.round("score", 9))
    best = ranking.top_by(rounded, "seed_id", F.col("score"), "paper_id", 10)
    return best.select("seed_id", "rank", "paper_id", "title", "year", "score", F.round("influence", 9).alias("influence"), F.coalesce("n_eff", F.lit(0)).alias("n_eff"))


LOCAL_NODES = "SELECT seed_id AS graph, id FROM local"
LOCAL_LINKS = "SELECT a.seed_id AS graph, source_paper_id AS s, target_paper_id AS t, final_weight AS w FROM final JOIN local a ON a.id = source_paper_id JOIN local b ON b.id = target_paper_id AND b.seed_id = a.seed_id"
SCORED = f"""
scored AS (SELECT r.graph AS seed_id, p.paper_id, p.title, p.year, coalesce(n_eff, 0) AS n_eff, r.pr AS pagerank, r.pr / max(r.pr) OVER (PARTITION BY r.graph) AS influence,
    CASE WHEN coalesce(p.year, 0) = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, ({YEAR} - p.year) / 20.0::DOUBLE) END AS age,
    ln(1.0::DOUBLE + coalesce(n_eff, 0)) / ln(100001.0::DOUBLE) * coalesce(nullif(v.confidence, 0), 0.5::DOUBLE) AS evidence
    FROM r{ITERATIONS} r JOIN papers p ON p.paper_id = r.id LEFT JOIN resolutions v ON v.paper_id = r.id WHERE r.id <> r.graph)
"""
ALL_SCORES = f"WITH {WEIGHTED}, {LOCAL}, {_rank_sql(LOCAL_NODES, LOCAL_LINKS, ITERATIONS)}, {SCORED}"
F8_SQL = with_recipes(f"""{ALL_SCORES}
SELECT seed_id, CAST(rank AS INTEGER) AS rank, paper_id, title, year, score, round(influence, 9) AS influence, n_eff FROM (
    SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, paper_id) AS rank FROM (
        SELECT *, round(0.5::DOUBLE * influence + 0.3::DOUBLE * age + 0.2::DOUBLE * evidence, 9) AS score FROM scored) x) y WHERE rank <= 10""", "edges", "resolutions", "papers", "seeds")  # fmt: skip

VARIANTS = {"combined": "0.5::DOUBLE*influence+0.3::DOUBLE*age+0.2::DOUBLE*evidence", "influence_only": "influence", "age_only": "age", "evidence_only": "evidence", "no_influence": "0.3::DOUBLE*age+0.2::DOUBLE*evidence", "raw_pagerank": "0.5::DOUBLE*pagerank+0.3::DOUBLE*age+0.2::DOUBLE*evidence"}


def variant_ranks(spark: SparkSession, sf_dir: str, limits: tuple = (ITERATIONS, None)) -> DataFrame:
    rounded = ranking.variants(scored(spark, sf_dir, limits)).withColumn("score", F.round("score", 9)).withColumn("g", F.concat_ws("|", "seed_id", "variant"))
    return ranking.top_by(rounded, "g", F.col("score"), "paper_id", 1 << 30)


def f9(spark: SparkSession, sf_dir: str, limits: tuple = (ITERATIONS, None)) -> DataFrame:
    return variant_ranks(spark, sf_dir, limits).select("seed_id", "variant", "paper_id", "rank", "score")


_RANKED = "ranked AS (SELECT seed_id, variant, paper_id, score, CAST(row_number() OVER (PARTITION BY seed_id, variant ORDER BY score DESC, paper_id) AS INTEGER) AS rank FROM (" + " UNION ALL ".join(f"SELECT seed_id, '{k}' AS variant, paper_id, round({v}, 9) AS score FROM scored" for k, v in VARIANTS.items()) + ") u)"
F9_SQL = with_recipes(f"{ALL_SCORES}, {_RANKED} SELECT * FROM ranked", "edges", "resolutions", "papers", "seeds")


def f10(spark: SparkSession, sf_dir: str, limits: tuple = (ITERATIONS, None)) -> DataFrame:
    ranked = variant_ranks(spark, sf_dir, limits).select("seed_id", "variant", "paper_id", "rank")
    base = ranked.filter("variant = 'combined'").select("seed_id", "paper_id", F.col("rank").alias("base_rank"))
    found = ranking.rank_correlation(ranked.filter("variant <> 'combined'").join(base, ["seed_id", "paper_id"]), ["seed_id", "variant"], "base_rank", "rank")
    return found.select("seed_id", "variant", F.round("rho", 9).alias("rho"), "n")


F10_SQL = with_recipes(f"""{ALL_SCORES}, {_RANKED}
SELECT a.seed_id, a.variant, round(1 - 6.0::DOUBLE * sum((a.rank - b.rank) * (a.rank - b.rank))::DOUBLE / (count(*) * (count(*) * count(*) - 1))::DOUBLE, 9) AS rho, count(*) AS n
FROM ranked a JOIN ranked b ON b.seed_id = a.seed_id AND b.paper_id = a.paper_id AND b.variant = 'combined' WHERE a.variant <> 'combined' GROUP BY a.seed_id, a.variant""", "edges", "resolutions", "papers", "seeds")  # fmt: skip


def f12(spark: SparkSession, sf_dir: str, hops: int = 3) -> DataFrame:
    edges = plain_edges(spark, sf_dir)
    best = paths.best_paths(table(spark, sf_dir, "seeds").select("seed_id"), edges, hops)
    return best.select("seed_id", "rank", "path", "path_length", F.round("average_confidence", 9).alias("average_confidence"), "score")


F12_SQL = with_recipes(f"""WITH {WEIGHTED},
p1 AS (SELECT seed_id, [seed_id, target_paper_id] AS path, final_weight AS sw, confidence AS pc, confidence AS sc FROM seeds JOIN final ON source_paper_id = seed_id),
p2 AS (SELECT seed_id, list_append(path, target_paper_id) AS path, sw + final_weight AS sw, pc * confidence AS pc, sc + confidence AS sc FROM p1 JOIN final ON source_paper_id = path[-1] WHERE NOT list_contains(path, target_paper_id)),
p3 AS (SELECT seed_id, list_append(path, target_paper_id) AS path, sw + final_weight AS sw, pc * confidence AS pc, sc + confidence AS sc FROM p2 JOIN final ON source_paper_id = path[-1] WHERE NOT list_contains(path, target_paper_id)),
every AS (SELECT seed_id, array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS path_length, sw, pc, sc FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) u)
SELECT seed_id, rank, path, path_length, average_confidence, score FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, path) AS INTEGER) AS rank FROM (
        SELECT *, round(sc / path_length, 9) AS average_confidence, round(sw / path_length * pc / sqrt(path_length + 1.0::DOUBLE), 9) AS score FROM every) a) b WHERE rank <= 10""", "edges", "resolutions", "seeds")  # fmt: skip


def f11(spark: SparkSession, sf_dir: str, hops: int = 3) -> DataFrame:
    found = paths.simple_paths(table(spark, sf_dir, "seeds").select("seed_id"), plain_edges(spark, sf_dir), hops)
    return found.groupBy("seed_id", (F.size("path") - 1).alias("path_length")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.element_at("path", -1)).alias("ends"))


F11_SQL = F12_SQL[: F12_SQL.index("SELECT seed_id, rank, path")].replace("array_to_string(path, '>') AS path", "path") + "SELECT seed_id, path_length, count(*) AS n, count(DISTINCT path[-1]) AS ends FROM every GROUP BY seed_id, path_length"


# the same with paths of four edges
_P4 = "p4 AS (SELECT seed_id, list_append(path, target_paper_id) AS path, sw + final_weight AS sw, pc * confidence AS pc, sc + confidence AS sc FROM p3 JOIN final ON source_paper_id = path[-1] WHERE NOT list_contains(path, target_paper_id)),\nevery AS ("
F11_WHOLE_SQL, F12_WHOLE_SQL = (q.replace("every AS (", _P4, 1).replace("SELECT * FROM p3)", "SELECT * FROM p3 UNION ALL SELECT * FROM p4)", 1) for q in (F11_SQL, F12_SQL))


def f11_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of 1 to 4 edges."""
    return f11(spark, sf_dir, 4)


def f12_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the paths of 1 to 4 edges."""
    return f12(spark, sf_dir, 4)


def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, edges = seeds_and_edges(spark, sf_dir)
    walk = edges.select(F.col("source_paper_id").alias("source"), F.col("target_paper_id").alias("target"), "seq")
    return traverse.traverse(seeds, walk, 2, 1, 100).select("seed_id", "paper_id", "direction", "depth", "place")


def _level(name: str, way: str, depth: int, share: int | None) -> str:
    at, to = ("source_paper_id", "target_paper_id") if way == "backward" else ("target_paper_id", "source_paper_id")
    frontier = f"(k.direction = '{way}' AND k.depth = {depth})" if depth else "k.depth = 0"
    room = "100 - held" if share is None else f"least({share} - own, 100 - held)"
    # the share binds where the other direction has a frontier left; here the seed itself
    return f"""{name}_c AS (SELECT seed_id, count(*) AS held, count(*) FILTER (direction = '{way}') AS own FROM {{k}} GROUP BY seed_id),
{name}_n AS (SELECT k.seed_id, e.{to} AS paper_id, min(e.seq) AS seq FROM {{k}} k JOIN edges e ON e.{at} = k.paper_id WHERE {frontier} GROUP BY k.seed_id, e.{to}),
{name} AS (SELECT * FROM {{k}} UNION ALL SELECT seed_id, paper_id, '{way}', {depth + 1}, held + r - 1 FROM (
    SELECT n.seed_id, n.paper_id, c.held, {room} AS room, row_number() OVER (PARTITION BY n.seed_id ORDER BY n.seq, n.paper_id) AS r
    FROM {name}_n n JOIN {name}_c c ON c.seed_id = n.seed_id LEFT JOIN {{k}} o ON o.seed_id = n.seed_id AND o.paper_id = n.paper_id WHERE o.paper_id IS NULL) x WHERE r <= room)"""


F1_SQL = with_recipes(
    "WITH k0 AS (SELECT seed_id, seed_id AS paper_id, 'seed' AS direction, 0 AS depth, 0::BIGINT AS place FROM seeds), "
    + ", ".join([_level("k1", "backward", 0, 65).replace("{k}", "k0"), _level("k2", "forward", 0, None).replace("{k}", "k1").replace("100 - held AS room", "CASE WHEN own_b > 0 THEN least(34 - own, 100 - held) ELSE 100 - held END AS room").replace("AS own FROM", "AS own, count(*) FILTER (direction = 'backward') AS own_b FROM"), _level("k3", "backward", 1, None).replace("{k}", "k2")])
    + " SELECT * FROM k3",
    "edges", "seeds",
)


def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, edges = seeds_and_edges(spark, sf_dir)
    return traverse.component_summary(seeds, edges.select(F.col("source_paper_id").alias("source"), F.col("target_paper_id").alias("target")))


F4_SQL = with_recipes("""WITH RECURSIVE around AS (SELECT source_paper_id AS a, target_paper_id AS b FROM edges UNION SELECT target_paper_id, source_paper_id FROM edges),
reached(seed_id, id) AS (SELECT seed_id, seed_id FROM seeds UNION SELECT seed_id, b FROM reached JOIN around ON a = id)
SELECT seed_id, count(*) AS n, min(id) AS smallest FROM reached GROUP BY seed_id""", "edges", "seeds").replace("WITH pairs", "WITH RECURSIVE pairs", 1).replace(", RECURSIVE around", ", around")  # fmt: skip


def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = weights.build_vertices(table(spark, sf_dir, "papers"), table(spark, sf_dir, "resolutions"))
    return v.select("paper_id", "title", "year", "n_eff", "population_confidence", "status")


def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, papers = table(spark, sf_dir, "edges"), table(spark, sf_dir, "papers").select("paper_id")
    out = edges.groupBy(F.col("source_paper_id").alias("paper_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("target_paper_id").alias("paper_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return papers.join(out, "paper_id", "left").join(into, "paper_id", "left").na.fill(0, ["in_degree", "out_degree"])


def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph health, with biomedical papers as the graph: edges that leave it dangle."""
    nodes = table(spark, sf_dir, "papers").filter("domain = 'biomedical'").select("paper_id").distinct()
    edges = table(spark, sf_dir, "edges").select("source_paper_id", "target_paper_id")
    known = lambda c: nodes.select(F.col("paper_id").alias(c), F.lit(1).alias(f"has_{c}"))
    told = edges.join(known("source_paper_id"), "source_paper_id", "left").join(known("target_paper_id"), "target_paper_id", "left")
    whole = F.col("has_source_paper_id").isNotNull() & F.col("has_target_paper_id").isNotNull()
    counts = told.agg(F.count(F.lit(1)).alias("edges"), F.count_if(~whole).alias("dangling"))
    ends = told.filter(whole).select(F.explode(F.array("source_paper_id", "target_paper_id")).alias("paper_id"))
    degree = nodes.join(ends.groupBy("paper_id").agg(F.count(F.lit(1)).alias("d")), "paper_id", "left")
    shape = degree.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("d").isNull()).alias("isolated"), F.round(F.avg(F.coalesce("d", F.lit(0))), 6).alias("mean_degree"))
    return shape.join(counts)  # one row each


D3_SQL = with_recipes("""WITH n AS (SELECT DISTINCT paper_id FROM papers WHERE domain = 'biomedical'),
t AS (SELECT e.*, a.paper_id IS NOT NULL AND b.paper_id IS NOT NULL AS whole FROM edges e LEFT JOIN n a ON a.paper_id = source_paper_id LEFT JOIN n b ON b.paper_id = target_paper_id),
d AS (SELECT n.paper_id, count(x.id) AS d FROM n LEFT JOIN (SELECT source_paper_id AS id FROM t WHERE whole UNION ALL SELECT target_paper_id FROM t WHERE whole) x ON x.id = n.paper_id GROUP BY n.paper_id)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM d WHERE d = 0) AS isolated, (SELECT round(avg(d), 6) FROM d) AS mean_degree,
 (SELECT count(*) FROM t) AS edges, (SELECT count(*) FROM t WHERE NOT whole) AS dangling""", "edges", "papers")


def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "papers").withColumn("title_key", ids.title_key(F.regexp_replace("title", "[0-9]+$", "of the catalogue")))
    return traverse.duplicate_works(papers)


C10_SQL = with_recipes("""WITH k AS (SELECT paper_id, year, seq, trim(regexp_replace(lower(regexp_replace(title, '[0-9]+$', 'of the catalogue')), '[^a-z0-9]+', ' ', 'g')) AS t FROM papers),
h AS (SELECT paper_id, year, seq, left(t, 80) AS key FROM k WHERE length(t) >= 25),
f AS (SELECT key, arg_min({'p': paper_id, 'y': year}, seq) AS first FROM h GROUP BY key)
SELECT paper_id, first.p AS duplicate_of FROM h JOIN f USING (key) WHERE paper_id <> first.p AND coalesce(year = first.y, true)""", "papers")


def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of one title count as the first of them, and their edges move there."""
    papers = table(spark, sf_dir, "papers").withColumn("title_key", ids.title_key(F.regexp_replace("title", "[0-9]+$", "of the catalogue")))
    same = traverse.duplicate_works(papers)
    aliases = papers.join(same, "paper_id", "left").select(F.col("paper_id").alias("alias"), F.coalesce("duplicate_of", "paper_id").alias("paper_id"))
    raw = table(spark, sf_dir, "edges").select(F.col("source_paper_id").alias("source"), F.col("target_paper_id").alias("target"), "seq")
    return traverse.commit_edges(raw, aliases)


C11_SQL = C10_SQL.replace("SELECT paper_id, first.p AS duplicate_of", ", dup AS (SELECT paper_id, first.p AS duplicate_of", 1) + """),
al AS (SELECT p.paper_id AS alias, coalesce(duplicate_of, p.paper_id) AS id FROM papers p LEFT JOIN dup USING (paper_id))
SELECT a.id AS source_paper_id, b.id AS target_paper_id, min(e.seq) AS seq, a.id || '_cites_' || b.id AS edge_id
FROM edges e JOIN al a ON a.alias = source_paper_id JOIN al b ON b.alias = target_paper_id WHERE a.id <> b.id GROUP BY a.id, b.id"""
C11_SQL = C11_SQL.replace("WITH papers", with_recipes("", "edges").strip() + ", papers", 1)


_CONVERGED = _converged_sql(LOCAL_NODES, LOCAL_LINKS)
_F8_F9_F10 = {k: q.replace(_rank_sql(LOCAL_NODES, LOCAL_LINKS, ITERATIONS), _CONVERGED).replace(f"FROM r{ITERATIONS} r", "FROM rlast r").replace("WITH pairs", "WITH RECURSIVE pairs", 1) for k, q in (("f8_foundational", F8_SQL), ("f9_variants", F9_SQL), ("f10_rank_correlation", F10_SQL))}
F7_WHOLE_SQL = with_recipes(
    f"WITH {WEIGHTED}, " + _converged_sql("SELECT 'all' AS graph, paper_id AS id FROM papers", "SELECT 'all' AS graph, source_paper_id AS s, target_paper_id AS t, final_weight AS w FROM final") + " SELECT id AS paper_id, round(pr, 10) AS pagerank FROM rlast",
    "edges", "resolutions", "papers",
).replace("WITH pairs", "WITH RECURSIVE pairs", 1)


def queries() -> dict:
    return {
        "f1_traverse": f1, "f4_seed_component": f4, "f5_vertices": f5, "f6_weight_edges": f6, "f7_pagerank": f7, "f8_foundational": f8,
        "f9_variants": f9, "f10_rank_correlation": f10, "f11_simple_paths": f11, "f12_rank_paths": f12, "d1_degrees": d1,
        "f11_simple_paths_whole": f11_whole, "f12_rank_paths_whole": f12_whole,
        **{f"{k}_whole": functools.partial(f, limits=CONVERGED) for k, f in (("f7_pagerank", f7), ("f8_foundational", f8), ("f9_variants", f9), ("f10_rank_correlation", f10))},
        "d3_graph_health": d3,
        "c10_duplicate_works": c10, "c11_commit_edges": c11,
    }


def oracle_sql() -> dict:
    rank_all = _rank_sql("SELECT 'all' AS graph, paper_id AS id FROM papers", "SELECT 'all' AS graph, source_paper_id AS s, target_paper_id AS t, final_weight AS w FROM final", ITERATIONS)
    return {
        "f1_traverse": F1_SQL,
        "f4_seed_component": F4_SQL,
        "f5_vertices": with_recipes("SELECT p.paper_id, title, year, n_eff, r.confidence AS population_confidence, status FROM papers p LEFT JOIN resolutions r ON r.paper_id = p.paper_id", "papers", "resolutions"),
        "f6_weight_edges": with_recipes(f"WITH {WEIGHTED} SELECT source_paper_id, target_paper_id, round(n_score, 9) AS n_score, round(base_weight, 9) AS base_weight, round(final_weight, 9) AS final_weight FROM final", "edges", "resolutions"),
        "f7_pagerank": with_recipes(f"WITH {WEIGHTED}, {rank_all} SELECT id AS paper_id, round(pr, 10) AS pagerank FROM r{ITERATIONS}", "edges", "resolutions", "papers"),
        "f8_foundational": F8_SQL, "f9_variants": F9_SQL, "f10_rank_correlation": F10_SQL, "f11_simple_paths": F11_SQL, "f12_rank_paths": F12_SQL,
        "f7_pagerank_whole": F7_WHOLE_SQL, **{f"{k}_whole": q for k, q in _F8_F9_F10.items()},
        "f11_simple_paths_whole": F11_WHOLE_SQL, "f12_rank_paths_whole": F12_WHOLE_SQL,
        "d1_degrees": with_recipes("SELECT p.paper_id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree FROM papers p LEFT JOIN (SELECT source_paper_id AS a, count(*) AS o FROM edges GROUP BY 1) ON a = p.paper_id LEFT JOIN (SELECT target_paper_id AS b, count(*) AS i FROM edges GROUP BY 1) ON b = p.paper_id", "papers", "edges"),
        "d3_graph_health": D3_SQL, "c10_duplicate_works": C10_SQL, "c11_commit_edges": C11_SQL,
    }
