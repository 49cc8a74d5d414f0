"""Citation tables derived from the given star schema, in SQL that Spark and DuckDB both run.

Orders' consecutive parts cite each other, parts are papers, their sold quantities the
study sizes. The text is shared with the oracles, so both sides start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("part", "lineitem", "orders", "customer", "supplier", "nation", "region", "events", "documents", "pages", "benchmark", "labels", "conversations")

RECIPES = {
    "pairs": """
        SELECT l_partkey AS s, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS t,
               l_discount AS disc, l_returnflag AS flag, l_orderkey AS ord, l_linenumber AS line FROM lineitem""",
    "edges": """
        SELECT concat('P', s) AS source_paper_id, concat('P', t) AS target_paper_id,
               CAST(1 AS DOUBLE) - max(disc) AS confidence, min(ord) AS seq
        FROM pairs WHERE t IS NOT NULL AND s <> t GROUP BY s, t""",
    "papers": """
        SELECT concat('P', p_partkey) AS paper_id, concat_ws(' ', p_name, lower(p_type), p_partkey) AS title,
               CAST(CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 1970 + p_partkey % 50 END AS INTEGER) AS year,
               p_brand AS journal, p_partkey AS seq,
               CASE WHEN p_size % 4 = 0 THEN 'biomedical' WHEN p_size % 4 = 1 THEN 'computer_science'
                    WHEN p_size % 4 = 2 THEN 'nonclinical' ELSE 'unknown' END AS domain
        FROM part""",
    "resolutions": """
        SELECT concat('P', p_partkey) AS paper_id,
               CAST(CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE q END AS INTEGER) AS n_eff,
               CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END AS DOUBLE) / CAST(50 AS DOUBLE) AS confidence,
               CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 THEN 'ambiguous' ELSE 'resolved' END AS status
        FROM part JOIN (SELECT l_partkey AS k, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY l_partkey) x ON k = p_partkey
        WHERE p_partkey % 11 <> 3""",
    "seeds": """
        SELECT p_brand AS brand, paper_id AS seed_id FROM (
            SELECT p_brand, source_paper_id AS paper_id, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, source_paper_id) AS r
            FROM edges JOIN part ON source_paper_id = concat('P', p_partkey) GROUP BY p_brand, source_paper_id) y WHERE r = 1""",
    "texts": """
        SELECT concat('P', p_partkey) AS paper_id, CASE WHEN p_partkey % 3 = 0 THEN 'abstract' WHEN p_partkey % 3 = 1 THEN 'methods' ELSE 'full_text' END AS section,
            CASE p_partkey % 10
            WHEN 0 THEN concat('A total of ', q, ' patients were randomized in 2019. Then 0.5% of ', r, ' women were followed for a year!')
            WHEN 1 THEN concat('We screened ', q, ' participants. The sample size was N=', r, '; dose of 0.5 mg daily.')
            WHEN 2 THEN concat('We report data from the first ', q, ' laboratory-confirmed cases through January 29, 2020.')
            WHEN 3 THEN concat('The study included ', q, ' consecutive patients (n = ', r, '). Enrolled ', r, ' by 2021?')
            WHEN 4 THEN concat('A cohort of ', q, ' adult subjects; ', r, ' patients completed treatment, p < 0.05.')
            WHEN 5 THEN concat('We trained the model on ', q, ' thousand images and tested on ', r, ' images.')
            WHEN 6 THEN concat('The dataset has ', q, ' documents. A benchmark of ', r, ' million sentence pairs was collected. It has ', q, ' records.')
            WHEN 7 THEN concat('Group (n = ', q, ') analyzed ', r, ' and 2,', 100 + r % 800, ' volunteers, 95% CI.')
            WHEN 8 THEN '' ELSE NULL END AS text
        FROM (SELECT p_partkey, CAST(coalesce(sum(l_quantity), 7) AS BIGINT) AS q, CAST(coalesce(count(l_orderkey), 0) AS BIGINT) + 2 AS r
              FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey) x""",
    "raw_ids": """
        SELECT p_partkey AS id, CASE p_partkey % 16
            WHEN 0 THEN concat('https://doi.org/10.1234/ABC.', p_partkey) WHEN 1 THEN concat('10.3389/Fcomp.', p_partkey, '/full')
            WHEN 2 THEN concat('doi:10.5555/X', p_partkey) WHEN 3 THEN concat('https://pubmed.ncbi.nlm.nih.gov/', 1000 + p_partkey, '/')
            WHEN 4 THEN concat('https://www.ncbi.nlm.nih.gov/pmc/articles/PMC', p_partkey, '/') WHEN 5 THEN concat('pmc', p_partkey)
            WHEN 6 THEN concat('PMID: ', p_partkey) WHEN 7 THEN concat('', p_partkey) WHEN 8 THEN concat('w', p_partkey)
            WHEN 9 THEN concat(' ', p_name, ' of the ', lower(p_type), ' ') WHEN 10 THEN concat('10.1000/', p_partkey, '/456') WHEN 11 THEN concat('9', p_partkey, '/AbC')
            WHEN 12 THEN concat('10.1002/s', p_partkey, '/Abstract/pdf') WHEN 13 THEN '   ' WHEN 14 THEN NULL ELSE concat('PMCID: PMC', p_partkey) END AS raw
        FROM part""",
}
NEEDS = {"edges": ("pairs",), "seeds": ("edges",)}


def _closed(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in (*_closed(NEEDS.get(n, ())), n):
            if x not in out:
                out.append(x)
    return out


def with_recipes(body: str, *names: str) -> str:
    """The recipes as common table expressions before a query's text, which may begin with more of them."""
    parts = ", ".join(f"{n} AS ({RECIPES[n]})" for n in _closed(names))
    body = body.strip()
    return f"WITH {parts}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {parts} {body}"


def register(spark: SparkSession, sf_dir: str, body: str | None = None) -> None:
    """Views of the given tables, of those only that the text of a query names: each costs a job that reads its schema."""
    for name in TABLES:
        if body is None or re.search(rf"\b{name}\b", body):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run(spark, sf_dir, f"SELECT * FROM {name}", *([name] if name in RECIPES else []))


def run(spark: SparkSession, sf_dir: str, body: str, *names: str) -> DataFrame:
    body = with_recipes(body, *names) if names else body
    register(spark, sf_dir, body)
    return spark.sql(body)


def over(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A recipe over frames that hold what it needs of other recipes (NEEDS), so that these are worked out once."""
    for need, frame in given.items():
        frame.createOrReplaceTempView(need)
    try:
        return run(spark, sf_dir, RECIPES[name])
    finally:
        for need in given:
            spark.catalog.dropTempView(need)
