"""Queries of addresses, page heads and full texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.functions import addresses, ids
from bibloom.operators import fulltext
from bibloom.plans.text import _FINAL, _RESOLVED, _SENTENCES, E5_SQL
from bibloom.sources.recipes import run, table, with_recipes

URLS = """SELECT p_partkey AS id, CASE p_partkey % 12
    WHEN 0 THEN concat('https://journal.example/doi/10.1234/AbC.', p_partkey, '/full') WHEN 1 THEN concat('https://x.example/articles/pmc', p_partkey, '/')
    WHEN 2 THEN concat('https://ncbi.example/pubmed/', p_partkey, '?x=1') WHEN 3 THEN concat('https://x.example/view?b=2&pmid=', p_partkey)
    WHEN 4 THEN concat('https://pubmed.ncbi.nlm.nih.gov/', p_partkey, '/') WHEN 5 THEN concat('https://x.example/a?doi=10.5555/Z', p_partkey, '.')
    WHEN 6 THEN concat('https://x.example/a?q=1#10.77777/q', p_partkey) WHEN 7 THEN concat('https://x.example/nothing/', p_partkey)
    WHEN 8 THEN NULL WHEN 9 THEN concat('https://x.example/view?ID=', p_partkey, '&id=x') WHEN 10 THEN concat('https://x.example/PMC1?u=10.1234%2Fq', p_partkey) ELSE '' END AS url
    FROM part"""
_URL_PARTS = f"""u AS ({URLS}), p AS (SELECT id, coalesce(regexp_extract(url, '^https?://([^/?#]*)', 1), '') AS host, coalesce(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '\\?([^#]*)', 1), '') AS query, coalesce(regexp_extract(url, '#(.*)$', 1), '') AS frag FROM u),
f AS (SELECT *, string_split(url_decode(query), '&') AS pairs, list_filter(list_transform([path, query, frag, url_decode(query)], lambda t: regexp_replace(regexp_extract(t, '{addresses.DOI_INSIDE}'), '\\.+$', '')), lambda d: d <> '') AS dois FROM p),
g AS (SELECT *, list_filter(list_transform([path, query, frag], lambda t: regexp_extract(t, '(?i)PMC\\d+')), lambda d: d <> '') AS pmcs, list_filter(pairs, lambda x: regexp_full_match(x, '(?i)(pmid|id|ext_id)=\\d{{1,9}}')) AS own FROM f)"""
B7_SQL = f"""WITH {_URL_PARTS}
SELECT id, CASE WHEN len(dois) > 0 THEN 'doi' WHEN len(pmcs) > 0 THEN 'pmcid' WHEN contains(path, '/pubmed/') OR len(own) > 0 OR (contains(host, 'pubmed.ncbi') AND regexp_matches(path, '/\\d+/?$')) THEN 'pmid' END AS query_type,
 CASE WHEN len(dois) > 0 THEN regexp_replace(lower(dois[1]), '(?i)^([^/]*/[^/]*(?:/.*?)??)(?:/(?:{'|'.join(ids.VIEW_SEGMENTS)}))+$', '\\1') WHEN len(pmcs) > 0 THEN upper(pmcs[1])
  WHEN contains(path, '/pubmed/') THEN regexp_extract(path, '/pubmed/(\\d+)', 1) WHEN len(own) > 0 THEN regexp_extract(own[1], '=(.*)$', 1) WHEN contains(host, 'pubmed.ncbi') THEN nullif(regexp_extract(path, '/(\\d+)/?$', 1), '') END AS value FROM g"""


def b7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, URLS).select("id", addresses.from_address(F.col("url")).alias("q")).select("id", "q.query_type", "q.value")


HEADS = """SELECT p_partkey AS id, CASE p_partkey % 5
    WHEN 0 THEN concat('<head><meta name="citation_title" content="T ', p_name, '"><META content="10.1234/A', p_partkey, '/abstract" name="Citation_DOI"></head>')
    WHEN 1 THEN concat('<meta property=''og:title'' content='' ', p_name, '  x ''>') WHEN 2 THEN concat('<meta content="10.5/short" name="DC.Identifier"><meta name=dc.title content=abc><meta name="dc.title" content="', p_name, '">')
    WHEN 3 THEN '<meta name="viewport" content="10.1234/no">' ELSE NULL END AS html FROM part
    UNION ALL SELECT 1000000000 + page_id, html FROM pages"""
_ATTRIBUTE = """coalesce(regexp_extract(e, '(?is)\\s{0}\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))', 1), '') || coalesce(regexp_extract(e, '(?is)\\s{0}\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))', 2), '') || coalesce(regexp_extract(e, '(?is)\\s{0}\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))', 3), '')"""
_listed = lambda names: ", ".join(f"'{n}'" for n in names)
B8_SQL = f"""WITH h AS ({HEADS}), m AS (SELECT id, unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*>')) AS e, generate_subscripts(regexp_extract_all(html, '(?is)<meta\\b[^>]*>'), 1) AS k FROM h),
a AS (SELECT id, k, lower(coalesce(nullif({_ATTRIBUTE.format('name')}, ''), {_ATTRIBUTE.format('property')})) AS n, {_ATTRIBUTE.format('content')} AS c FROM m),
d AS (SELECT id, arg_min(v, k) AS doi FROM (SELECT id, k, regexp_replace(lower(regexp_replace(regexp_extract(c, '{addresses.DOI_INSIDE}'), '\\.+$', '')), '(?i)^([^/]*/[^/]*(?:/.*?)??)(?:/(?:{'|'.join(ids.VIEW_SEGMENTS)}))+$', '\\1') AS v FROM a WHERE n IN ({_listed(addresses.DOI_NAMES)})) x WHERE v <> '' GROUP BY id),
t AS (SELECT id, arg_min(v, k) AS title FROM (SELECT id, k, trim(regexp_replace(c, '\\s+', ' ', 'g')) AS v FROM a WHERE n IN ({_listed(addresses.TITLE_NAMES)})) x WHERE length(v) >= 5 GROUP BY id)
SELECT h.id, CASE WHEN doi IS NOT NULL THEN 'doi' WHEN title IS NOT NULL THEN 'title' END AS query_type, coalesce(doi, title) AS value FROM h LEFT JOIN d ON d.id = h.id LEFT JOIN t ON t.id = h.id"""


def b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, HEADS).select("id", addresses.from_head(F.col("html")).alias("q")).select("id", "q.query_type", "q.value")


# a paper's paragraphs, with their headings from the outside in
PARAGRAPHS = """SELECT concat('P', p_partkey) AS paper_id, i AS pos, CASE (p_partkey + i) % 7
    WHEN 0 THEN 'Methods>Study population' WHEN 1 THEN 'Introduction>Participants' WHEN 2 THEN 'Results>Patients>Follow up' WHEN 3 THEN 'Discussion'
    WHEN 4 THEN 'Materials  and METHODS>References' WHEN 5 THEN 'Appendix' ELSE 'Overview>Main outcome' END AS headings,
    CASE i WHEN 0 THEN concat('A total of ', 100 + p_partkey % 900, ' patients were randomized. ', p_name) WHEN 1 THEN concat('We screened ', 50 + p_partkey % 300, '  participants for a year.') ELSE concat('Set (n = ', p_partkey % 70, ') of ', p_type) END AS paragraph
    FROM part CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) n"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = run(spark, sf_dir, PARAGRAPHS).withColumn("heading_path", F.split("headings", ">"))
    return fulltext.study_sections(raw)


def _label(level: int) -> str:
    h, before = f"h[{level}]", f"l{level - 1}" if level > 1 else "NULL::VARCHAR"
    return f"CASE WHEN {h} IS NULL THEN {before} WHEN regexp_matches({h}, '{fulltext.RESULTS}') THEN 'results' WHEN coalesce({before}, '') <> 'results' AND regexp_matches({h}, '{fulltext.METHODS}') THEN 'methods' ELSE {before} END AS l{level}"


_SECTIONS = f"""raw AS ({PARAGRAPHS}), h0 AS (SELECT *, list_transform(string_split(headings, '>'), lambda x: trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))) AS h FROM raw),
h1 AS (SELECT *, {_label(1)} FROM h0), h2 AS (SELECT *, {_label(2)} FROM h1), h3 AS (SELECT *, {_label(3)} FROM h2),
sections AS (SELECT paper_id, pos, l3 AS section, trim(regexp_replace(paragraph, '\\s+', ' ', 'g')) AS paragraph FROM h3 WHERE l3 IS NOT NULL AND len(list_filter(h, lambda x: regexp_matches(x, '{fulltext.PRUNED}'))) = 0)"""
A6_SQL = f"WITH {_SECTIONS} SELECT * FROM sections"

BODIES = """SELECT concat('P', p_partkey) AS paper_id, concat_ws(chr(10), 'Abstract', p_name, CASE p_partkey % 4 WHEN 0 THEN '3.1 Training data' WHEN 1 THEN '  Datasets and more' WHEN 2 THEN 'Experimental setup' ELSE 'Nothing' END,
    concat('We trained the mo-'), concat('del on ', p_size, ' thousand images.'), CASE WHEN p_partkey % 3 = 0 THEN '7 References' ELSE 'More' END, p_type) AS text,
    CASE WHEN p_partkey % 5 > 0 THEN concat('2001.', 10000 + p_partkey) END AS arxiv_id, p_partkey % 7 = 0 AS checked FROM part"""
_DATA = f"""bodies AS ({BODIES}), found AS (SELECT *, regexp_extract(text, '(?ims)({fulltext.DATA_HEADING}.*)', 1) AS f FROM bodies),
data AS (SELECT paper_id, arxiv_id, checked, CASE WHEN f <> '' THEN trim(regexp_replace(regexp_replace(left(string_split_regex(f, '{fulltext.REFERENCES}')[1], 100000), '-\\s*\\n', '', 'g'), '\\s+', ' ', 'g')) END AS section FROM found)"""
A7_SQL = f"WITH {_DATA} SELECT paper_id, section FROM data"


def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir)


def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, BODIES).select("paper_id", fulltext.data_section(F.col("text")).alias("section"))


def b22(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bibloom.functions.spans import sentences

    told = table(spark, sf_dir, "texts").filter("text <> ''").select("paper_id", F.posexplode(sentences(F.col("text"))).alias("sentence_no", "sentence"))
    return told.select("paper_id", "sentence_no", fulltext.about_people(F.col("sentence")).alias("relevant"))


B22_SQL = with_recipes(f"WITH {_SENTENCES} SELECT paper_id, CAST(sentence_no AS INTEGER) AS sentence_no, regexp_matches(sentence, '{fulltext.PEOPLE}') AS relevant FROM s", "texts")

OPEN = "SELECT l_orderkey AS seq0, l_linenumber AS line, concat(CASE l_linenumber % 3 WHEN 0 THEN 'https://doi.org/10.1/A' WHEN 1 THEN '10.1/a' ELSE ' doi:10.1/A' END, l_partkey) AS doi, CASE WHEN l_suppkey % 4 > 0 THEN concat('pmc', l_orderkey) WHEN l_suppkey % 8 = 0 THEN 'none' END AS pmcid FROM lineitem"


def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = run(spark, sf_dir, "SELECT concat('P', p_partkey) AS paper_id, concat('10.1/A', p_partkey) AS doi FROM part")
    records = run(spark, sf_dir, OPEN).select("doi", "pmcid", (F.col("seq0") * 10 + F.col("line")).alias("seq"))
    return fulltext.open_access(papers, records).select("paper_id", "pmcid")


C4_SQL = f"""WITH r AS ({OPEN}), v AS (SELECT lower(concat('10.1/a', regexp_extract(doi, '(\\d+)$', 1))) AS d, upper(pmcid) AS pmcid, seq0 * 10 + line AS seq FROM r WHERE regexp_full_match(upper(pmcid), 'PMC\\d+')),
b AS (SELECT d, arg_max(pmcid, seq) AS pmcid FROM v GROUP BY d) SELECT concat('P', p_partkey) AS paper_id, b.pmcid FROM part LEFT JOIN b ON d = concat('10.1/a', p_partkey)"""


def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    had = table(spark, sf_dir, "resolutions").withColumn("semantic_type", F.lit(None).cast("string"))
    return fulltext.recovered(had, _sections(spark, sf_dir)).select("paper_id", "n_eff", "semantic_type", F.round("confidence", 6).alias("confidence"), "status", "from_full_text")


# a sentence's place runs over a paper's paragraphs, as in the operator
_C5 = _RESOLVED.replace("FROM c WHERE value BETWEEN", f"FROM c WHERE regexp_matches(sentence, '{fulltext.PEOPLE}') AND value BETWEEN").replace(
    "SELECT paper_id, section, generate_subscripts(p, 1) - 1 AS sentence_no", "SELECT paper_id, section, pos * 100000 + generate_subscripts(p, 1) - 1 AS sentence_no"
).replace("SELECT paper_id, section, string_split(", "SELECT paper_id, section, pos, string_split(")
C5_SQL = with_recipes(f"""WITH {_SECTIONS}, texts AS (SELECT paper_id, section, pos, paragraph AS text FROM sections SEMI JOIN (SELECT paper_id FROM resolutions WHERE status = 'missing') q USING (paper_id)), {_C5}, f AS ({_FINAL})
SELECT r.paper_id, coalesce(f.n_eff, r.n_eff) AS n_eff, f.semantic_type, round(CASE WHEN f.n_eff IS NULL THEN r.confidence ELSE f.confidence END, 6) AS confidence, CASE WHEN f.n_eff IS NULL THEN r.status ELSE f.status END AS status, f.n_eff IS NOT NULL AS from_full_text
FROM resolutions r LEFT JOIN f ON f.paper_id = r.paper_id AND r.status = 'missing'""", "papers", "resolutions")  # fmt: skip


def e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = run(spark, sf_dir, BODIES)
    none = F.lit(None)
    before = bodies.select("paper_id", "arxiv_id", F.lit("missing").alias("status"), none.cast("string").alias("kind"), none.cast("long").alias("value"), "checked")
    return fulltext.technical_upgrade(before, bodies.select("paper_id", "text"))


_E5_BODY = E5_SQL[E5_SQL.index("s AS (SELECT paper_id, section, generate_subscripts") :]
E6_SQL = f"""WITH {_DATA}, texts AS (SELECT paper_id, 'full_text' AS section, section AS text FROM data WHERE arxiv_id IS NOT NULL AND NOT checked AND section IS NOT NULL), papers AS (SELECT paper_id FROM data),
{_E5_BODY[: _E5_BODY.index('SELECT p.paper_id, CASE WHEN b.value IS NULL')]}, g AS ({_E5_BODY[_E5_BODY.index('SELECT p.paper_id, CASE WHEN b.value IS NULL'):]})
SELECT d.paper_id, d.arxiv_id, g.status, g.kind, g.value, d.checked OR d.arxiv_id IS NOT NULL AS checked FROM data d JOIN g ON g.paper_id = d.paper_id"""


def queries() -> dict:
    return {
        "a6_study_sections": a6, "a7_data_section": a7, "b7_address_identifier": b7, "b8_head_identifier": b8, "b22_people_sentences": b22,
        "c4_open_access": c4, "c5_full_text_recovery": c5, "e6_technical_upgrade": e6,
    }


def oracle_sql() -> dict:
    return {
        "a6_study_sections": A6_SQL, "a7_data_section": A7_SQL, "b7_address_identifier": B7_SQL, "b8_head_identifier": B8_SQL, "b22_people_sentences": B22_SQL,
        "c4_open_access": C4_SQL, "c5_full_text_recovery": C5_SQL, "e6_technical_upgrade": E6_SQL,
    }
