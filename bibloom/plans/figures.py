"""Queries of flow figures, readers, evidence packs, request logs, whole documents and arriving papers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.operators import flow, layout, review, traverse
from bibloom.plans.tables import LINES
from bibloom.sources import exports
from bibloom.sources.recipes import run, table, with_recipes
from bibloom.streaming import ledger as days
from bibloom.streaming import papers as streams


def _stages_sql(label: str) -> str:
    """The stages of a label; RE2 has no look-ahead, and these labels say 'included' only where it is no enrolment."""
    p = dict(layout.STAGES)
    one = lambda name, pattern: f"CASE WHEN regexp_matches({label}, '{pattern}') THEN '{name}' END"
    named = ", ".join((one("screened", p["screened"]), one("enrolled", r"(?i)\benrol\w*|\b(met|meet|meeting)\s+(the\s+)?inclusion"), *[one(n, p[n]) for n in ("randomised", "analysed", "allocated")]))
    return f"CASE WHEN regexp_matches({label}, '{layout.EXCLUDED}') THEN 'excluded' ELSE concat_ws(',', {named}) END"


# --- regions and counts: an order is a figure; its even lines state counts, the odd ones open with them


def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.free_regions(run(spark, sf_dir, LINES)).withColumn("members", F.array_join("members", ","))


E10_SQL = f"""WITH RECURSIVE l AS MATERIALIZED (SELECT * FROM ({LINES}) x), near AS MATERIALIZED (SELECT a.fig_id, a.line_id AS p, b.line_id AS q FROM l a JOIN l b ON a.fig_id = b.fig_id
    WHERE greatest(a.y0, b.y0) - least(a.y1, b.y1) < 0.8 * greatest(a.y1 - a.y0, b.y1 - b.y0) AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0),
reach AS (SELECT fig_id, line_id AS p, line_id AS q FROM l UNION SELECT r.fig_id, r.p, n.q FROM reach r JOIN near n ON n.fig_id = r.fig_id AND n.p = r.q),
root AS (SELECT fig_id, q AS line_id, CAST(min(p) AS BIGINT) AS region_id FROM reach GROUP BY 1, 2)
SELECT fig_id, region_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(line_id::VARCHAR, ',' ORDER BY line_id) AS members FROM root JOIN l USING (fig_id, line_id) GROUP BY 1, 2"""

READ = """SELECT concat('F', l_orderkey) AS fig_id, n % 2 AS region_id, n AS pos, CASE WHEN n % 2 = 0 THEN concat(CASE l_partkey % 7 WHEN 0 THEN '• Assessed for eligibility' WHEN 1 THEN 'Excluded from analysis' WHEN 2 THEN ' - Enrolled and randomised'
    WHEN 3 THEN 'Included in the final analysis' WHEN 4 THEN 'Allocated to arm' WHEN 5 THEN 'met the inclusion criteria' ELSE 'Patients' END, CASE WHEN l_suppkey % 3 = 0 THEN ' (n = 1,' ELSE ' (N: ' END, 100 + l_suppkey % 800, ')')
    WHEN l_partkey % 4 = 0 THEN 'were screened' WHEN l_partkey % 4 = 1 THEN concat('', l_suppkey) WHEN l_partkey % 4 = 2 THEN concat(l_suppkey, ' Patients allocated') ELSE concat('(', l_suppkey, '  Lost to follow-up') END AS text
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS n FROM lineitem) y"""


def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = run(spark, sf_dir, READ).groupBy("fig_id", "region_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("l"))
    found = flow.region_counts(lines.select("fig_id", "region_id", F.col("l.text").alias("lines")))
    return found.select("fig_id", "region_id", "seq", "value", "label", F.array_join("stages", ",").alias("stages"))


E12_SQL = rf"""WITH l AS (SELECT fig_id, region_id, pos, regexp_replace(text, '^[\s•◆♦▪►➢➤\-–*·]+', '') AS line FROM ({READ}) x),
t AS (SELECT fig_id, region_id, string_agg(line, ' ' ORDER BY pos) AS text FROM l GROUP BY 1, 2),
s AS (SELECT fig_id, region_id, regexp_extract_all(text, '\b[nN]\s*[=:]\s*([0-9][0-9,]*)', 1) AS ns, string_split_regex(text, '\b[nN]\s*[=:]\s*[0-9][0-9,]*') AS labels FROM t),
stated AS (SELECT fig_id, region_id, i AS k, CAST(replace(ns[i], ',', '') AS BIGINT) AS value, trim(labels[i], ' ():;,.-') AS label FROM (SELECT *, unnest(range(1, len(ns) + 1)) AS i FROM s) q),
o AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY fig_id, region_id ORDER BY pos) AS k FROM (SELECT *, regexp_matches(line, '^\W*[0-9][0-9,]*(\s+[A-Za-z]|\s*$)') AS opens FROM l JOIN s USING (fig_id, region_id) WHERE len(ns) = 0) q),
led AS (SELECT fig_id, region_id, k, max(CASE WHEN opens THEN CAST(replace(regexp_extract(line, '^\W*([0-9][0-9,]*)', 1), ',', '') AS BIGINT) END) AS value, string_agg(CASE WHEN opens THEN regexp_replace(line, '^\W*[0-9][0-9,]*\s*', '') ELSE line END, ' ' ORDER BY pos) AS label FROM o WHERE k > 0 GROUP BY 1, 2, 3),
c AS (SELECT fig_id, region_id, CAST(row_number() OVER w - 1 AS INTEGER) AS seq, value, label, {_stages_sql('label')} AS stages FROM (FROM stated UNION ALL FROM led) q WINDOW w AS (PARTITION BY fig_id, region_id ORDER BY k))
SELECT fig_id, region_id, seq, value, label, CASE WHEN first_value(stages) OVER (PARTITION BY fig_id, region_id ORDER BY seq) = 'excluded' THEN 'excluded' ELSE stages END AS stages FROM c"""

PLACED = """SELECT concat('F', l_orderkey) AS fig_id, n AS region_id, l_suppkey AS value, CAST(l_quantity * 4 AS DOUBLE) AS x0, CAST(l_partkey % 90 AS DOUBLE) AS y0, CAST(l_quantity * 4 + CASE WHEN n % 3 = 1 THEN 8 ELSE 60 END AS DOUBLE) AS x1, CAST(l_partkey % 90 + 15 AS DOUBLE) AS y1,
    CASE l_suppkey % 6 WHEN 0 THEN 'Analysis' WHEN 1 THEN 'Allocated to arm' WHEN 2 THEN 'Enrolled' WHEN 3 THEN 'Screening' WHEN 4 THEN 'Randomised' ELSE 'Patients' END AS text
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS n FROM lineitem) y"""
COUNTED = f"SELECT *, region_id AS seq FROM ({PLACED}) x WHERE region_id % 2 = 0"
HEADED = f"SELECT fig_id, region_id, x0, y0, x1, y1, text, CAST(220 AS DOUBLE) AS width FROM ({PLACED}) x WHERE region_id % 2 = 1"


def _placed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.stages_from_layout(run(spark, sf_dir, COUNTED).withColumn("stages", layout.stages_of(F.col("text"))), run(spark, sf_dir, HEADED))


def c15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed_counts(spark, sf_dir).select("fig_id", "region_id", F.array_join("stages", ",").alias("stages"))


C15_SQL = rf"""WITH c AS (SELECT *, {_stages_sql('text')} AS stages FROM ({COUNTED}) a), h AS (SELECT *, (y1 - y0 > 1.5 * (x1 - x0) OR x1 < 0.2 * width) AS side, CASE {' '.join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in flow.HEADINGS)} END AS stage FROM ({HEADED}) b),
near AS (SELECT c.fig_id, c.region_id, arg_min({{'off': abs((h.y0 + h.y1) / 2 - (c.y0 + c.y1) / 2), 'most': 1.5 * greatest(h.y1 - h.y0, c.y1 - c.y0), 'stage': h.stage}}, (abs((h.y0 + h.y1) / 2 - (c.y0 + c.y1) / 2), h.region_id)) AS n FROM c JOIN h ON h.fig_id = c.fig_id AND h.side AND h.stage IS NOT NULL AND h.x1 <= c.x0 + 5 GROUP BY ALL),
above AS (SELECT c.fig_id, c.region_id, arg_min(h.stage, (-h.y1, h.region_id)) AS stage FROM c JOIN h ON h.fig_id = c.fig_id AND NOT h.side AND h.stage IS NOT NULL AND h.y1 <= c.y0 + 2 AND c.y0 - h.y1 < 2 * greatest(c.y1 - c.y0, 20) AND least(h.x1, c.x1) - greatest(h.x0, c.x0) > 0 GROUP BY ALL)
SELECT c.fig_id, c.region_id, CASE WHEN c.stages <> '' THEN c.stages ELSE coalesce(CASE WHEN n.off <= n.most THEN n.stage END, above.stage, '') END AS stages FROM c LEFT JOIN near ON near.fig_id = c.fig_id AND near.region_id = c.region_id LEFT JOIN above ON above.fig_id = c.fig_id AND above.region_id = c.region_id"""


def d20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.stage_totals(_placed_counts(spark, sf_dir))


ANSWERS = """SELECT label, selected, CAST(hi AS DOUBLE) AS hi, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS confidence FROM (SELECT DISTINCT concat('Patients ', l_suppkey) AS label, CASE l_suppkey % 5 WHEN 0 THEN 'analysed' WHEN 1 THEN 'excluded' WHEN 2 THEN 'screened' WHEN 3 THEN 'followed' END AS selected,
    (50 + l_suppkey % 50) / 100.0 AS hi, (50 - l_suppkey % 41) / 100.0 AS lo FROM lineitem WHERE l_suppkey % 11 > 0) x"""
ASKED = "SELECT l_orderkey AS ord, l_linenumber AS line, concat(CASE l_partkey % 5 WHEN 0 THEN 'Randomised ' WHEN 1 THEN 'Lost ' WHEN 2 THEN 'Screened and randomised ' ELSE 'Patients ' END, l_suppkey) AS label FROM lineitem"


def c16(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = run(spark, sf_dir, ANSWERS).withColumn("probabilities", F.create_map(F.lit("a"), F.col("hi"), F.lit("b"), F.col("lo")))
    found = flow.second_opinions(run(spark, sf_dir, ASKED).withColumn("stages", layout.stages_of(F.col("label"))), answers)
    return found.select("ord", "line", "label", F.array_join("stages", ",").alias("stages"), "reason")


C16_SQL = f"""WITH l AS (SELECT *, {_stages_sql('label')} AS s FROM ({ASKED}) x), r AS (SELECT l.*, a.selected, CASE WHEN s <> '' AND s <> 'excluded' AND NOT contains(s, ',') THEN 'rules were sure' WHEN a.label IS NULL THEN 'no answer'
    WHEN selected IS NULL OR selected = 'followed' THEN 'unknown stage' WHEN greatest(hi, lo) - least(hi, lo) < 0.1::DOUBLE THEN 'ambiguous' WHEN confidence < 0.7::DOUBLE THEN 'not sure' ELSE 'decisive' END AS reason FROM l LEFT JOIN ({ANSWERS}) a ON a.label = l.label)
SELECT ord, line, label, CASE WHEN reason = 'decisive' THEN selected ELSE s END AS stages, reason FROM r"""

CAPTION = "(?i)consort|flow ?(chart|diagram)|participant flow|trial profile|enrol?lment|study flow|patient flow|screening,? (and )?randomi"
FIGURES = """SELECT concat('PMC', l_orderkey) AS paper_id, l_linenumber AS pos, concat('<p>', CASE l_partkey % 4 WHEN 0 THEN 'Participant <i>flow</i>' WHEN 1 THEN 'Trial profile of' WHEN 2 THEN 'Survival by arm' ELSE 'Study  flow</b>chart' END, ' ', l_partkey, '</p>') AS caption,
    concat('fig', l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN '.PNG' ELSE '' END) AS href FROM lineitem"""
FILES = "SELECT concat('PMC', l_orderkey) AS paper_id, concat('PMC', l_orderkey, '.', 1 + l_suppkey % 3, '/fig', l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN '.PNG' WHEN l_suppkey % 7 = 0 THEN '.gif' ELSE '.jpg' END) AS file FROM lineitem"


def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.flow_figure(run(spark, sf_dir, FIGURES), run(spark, sf_dir, FILES), CAPTION)


A8_SQL = rf"""WITH f AS (SELECT paper_id, pos, href, trim(regexp_replace(regexp_replace(caption, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS caption FROM ({FIGURES}) x), p AS (SELECT paper_id, arg_min((href, caption), (pos, href, caption)) AS f FROM f WHERE regexp_matches(caption, '{CAPTION}') GROUP BY 1),
n AS (SELECT paper_id, CASE WHEN regexp_matches(f[1], '(?i)\.(jpe?g|png|gif|tiff?)$') THEN f[1] ELSE concat(f[1], '.jpg') END AS name, left(f[2], 600) AS caption FROM p)
SELECT n.paper_id, name, caption, max(file) AS file FROM n JOIN ({FILES}) g ON g.paper_id = n.paper_id AND split_part(file, '/', 2) = name GROUP BY 1, 2, 3"""

# --- readers and annotators: an order is a paper, a line number a stage

_STAGE = "CASE l_linenumber % 4 WHEN 0 THEN 'screened' WHEN 1 THEN 'enrolled' WHEN 2 THEN 'randomised' ELSE 'analysed' END"
GOLD = f"SELECT l_orderkey AS paper_id, {_STAGE} AS stage, max(CASE WHEN l_partkey % 6 > 0 THEN l_suppkey END) AS value FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2"
VISION = f"SELECT l_orderkey AS paper_id, {_STAGE} AS stage, l_linenumber AS seq, l_suppkey + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS value FROM lineitem WHERE l_partkey % 7 > 0"
SAID = f"SELECT l_orderkey AS paper_id, {_STAGE} AS stage, l_linenumber AS seq, l_suppkey + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS value FROM lineitem WHERE l_partkey % 4 > 0"


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.reader_outcomes(run(spark, sf_dir, GOLD), run(spark, sf_dir, VISION), run(spark, sf_dir, SAID))


def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right readings of each stage and pooled; p is checked in d14_mcnemar."""
    return review.reader_tally(_outcomes(spark, sf_dir)).drop("p")


def _said(which: str) -> str:
    return f"(SELECT paper_id, stage, arg_min(value, (seq, value)) AS value FROM ({which}) x GROUP BY 1, 2)"


D13_SQL = f"""WITH o AS (SELECT g.stage, g.value AS gold, v.value AS vision, coalesce(v.value = g.value, false) AS vr, coalesce(t.value = g.value, false) AS tr, EXISTS (SELECT 1 FROM ({SAID}) a WHERE a.paper_id = g.paper_id AND a.value = g.value) AS present
    FROM ({GOLD}) g LEFT JOIN {_said(VISION)} v ON v.paper_id = g.paper_id AND v.stage = g.stage LEFT JOIN {_said(SAID)} t ON t.paper_id = g.paper_id AND t.stage = g.stage)
SELECT stage, count(gold) AS n, count(*) FILTER (vr) AS vision_right, count(*) FILTER (tr) AS text_right, count(*) FILTER (present) AS text_present, count(*) FILTER (vr AND NOT tr) AS only_vision, count(*) FILTER (tr AND NOT vr) AS only_text, count(*) FILTER (gold IS NULL AND vision IS NOT NULL) AS unscored
FROM (FROM o UNION ALL SELECT 'decisive', * EXCLUDE stage FROM o WHERE stage <> 'screened') x GROUP BY stage"""

SECOND = f"SELECT l_orderkey AS figure, {_STAGE} AS stage, concat('reader', l_orderkey % 3) AS provider, max(CASE WHEN l_partkey % 6 > 0 THEN l_suppkey + CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END END) AS value FROM lineitem WHERE l_linenumber <= 4 AND l_orderkey % 5 > 0 GROUP BY 1, 2, 3"
DECIDED = f"SELECT l_orderkey AS figure, {_STAGE} AS stage, CASE l_orderkey % 3 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'key_error' ELSE 'second_annotator_error' END AS decision FROM lineitem WHERE l_linenumber <= 4 AND l_orderkey % 7 > 0"


def d15(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = review.compared(run(spark, sf_dir, GOLD).withColumnRenamed("paper_id", "figure"), run(spark, sf_dir, SECOND))
    return review.agreement(pairs, run(spark, sf_dir, DECIDED))


D15_SQL = f"""WITH c AS (SELECT s.provider, s.figure, g.value IS NOT DISTINCT FROM s.value AS same, d.decision FROM ({SECOND}) s JOIN ({GOLD}) g ON g.paper_id = s.figure AND g.stage = s.stage LEFT JOIN ({DECIDED}) d ON d.figure = s.figure AND d.stage = s.stage)
SELECT provider, count(DISTINCT figure) AS figures, count(*) AS n_values, count(*) FILTER (same) AS agreed, count(*) FILTER (NOT same) AS disagreements, count(*) FILTER (NOT same AND decision = 'second_annotator_error') AS second_annotator_errors,
    count(*) FILTER (NOT same AND decision = 'ambiguous') AS ambiguous, count(*) FILTER (NOT same AND decision = 'key_error') AS key_errors, count(*) FILTER (NOT same AND decision IS NULL) AS undecided FROM c GROUP BY provider"""

# --- documents of a seed: its own references

CITED = """SELECT source_paper_id AS seed_id, CAST(row_number() OVER (PARTITION BY source_paper_id ORDER BY confidence DESC, seq, target_paper_id) AS INTEGER) AS rank, target_paper_id AS paper_id, confidence FROM edges"""
PACKED = f"""SELECT c.seed_id, c.rank, p.title, p.year, p.journal, CAST(p.seq % 6 AS INTEGER) AS n_people, CASE WHEN p.seq % 3 > 0 THEN concat('10.1/', p.seq) END AS doi, CASE WHEN p.seq % 4 = 0 THEN repeat(p.title, 30) WHEN p.seq % 4 = 1 THEN '' END AS abstract FROM ({CITED}) c JOIN papers p ON p.paper_id = c.paper_id"""
LINKED = "SELECT source_paper_id AS seed_id, seq, source_paper_id AS source, target_paper_id AS target FROM edges"


def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = F.expr("transform(sequence(0, n_people), i -> concat('Author ', i))")
    papers = run(spark, sf_dir, PACKED, "edges", "papers").withColumn("authors", F.slice(people, 1, F.col("n_people")))
    return review.evidence_pack(papers, run(spark, sf_dir, LINKED, "edges"))


A19_SQL = with_recipes(f"""WITH p AS (SELECT seed_id, rank, concat_ws(' ', concat(rank, '. ', title), '(' || year || ')', '- ' || nullif(journal, ''), CASE WHEN n_people > 0 THEN concat('- ', array_to_string(list_transform(range(0, least(3, n_people)), lambda i: concat('Author ', i)), ', '), CASE WHEN n_people > 3 THEN ' et al.' ELSE '' END) END,
    'DOI: ' || doi, '- Abstract: ' || nullif(left(abstract, 600), '')) AS line FROM ({PACKED}) x WHERE rank <= 40),
e AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY seq, source, target) AS place, count(*) OVER (PARTITION BY seed_id) AS n FROM ({LINKED}) x),
links AS (SELECT seed_id, concat_ws(chr(10), concat('Links (', max(n), '):'), string_agg(concat(source, ' -> ', target), chr(10) ORDER BY place) FILTER (place <= 500), CASE WHEN max(n) > 500 THEN concat('... and ', max(n) - 500, ' more links') END) AS t FROM e GROUP BY 1)
SELECT p.seed_id, concat_ws(chr(10), 'Papers:', string_agg(line, chr(10) ORDER BY rank), any_value(links.t)) AS pack FROM p LEFT JOIN links ON links.seed_id = p.seed_id GROUP BY 1""", "edges", "papers")  # fmt: skip


def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed and what it cites, a document a seed."""
    nodes = run(spark, sf_dir, f"SELECT c.seed_id, p.paper_id, p.title, p.year FROM ({CITED}) c JOIN papers p ON p.paper_id = c.paper_id WHERE rank <= 99 UNION ALL SELECT DISTINCT source_paper_id, paper_id, title, year FROM edges JOIN papers ON paper_id = source_paper_id", "edges", "papers")
    links = run(spark, sf_dir, f"SELECT seed_id, seed_id AS source, paper_id AS target, round(confidence, 6) AS confidence FROM ({CITED}) c WHERE rank <= 99", "edges")
    return exports.archive_graph(nodes, links, "seed_id")


def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = run(spark, sf_dir, "SELECT source_paper_id AS run_id, count(*) AS links, max(confidence) AS best, CASE WHEN count(*) > 9 THEN 'many' END AS note, sort_array(collect_list(struct(target_paper_id AS target, confidence))) AS edges FROM edges GROUP BY source_paper_id", "edges")
    return exports.run_document(runs, "run_id")


# --- a request log: a page is a request, a host's first page label a log

REQUESTS = """SELECT page_id AS seq, 'log' AS log_id, split_part(url, '/', 3) AS host, CASE page_id % 7 WHEN 0 THEN concat('https://a.example/app.', page_id % 20, '.JS?v=2') WHEN 1 THEN concat('https://a.example/assets/', page_id % 20) WHEN 2 THEN concat('https://a.example/data/', page_id % 30, '?page=', page_id) ELSE url END AS url,
    CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, CAST(200 + page_id % 5 AS INTEGER) AS status, 'text/html; charset=utf-8' AS mime, length(html) AS size, CASE page_id % 4 WHEN 0 THEN 'Cookie' WHEN 1 THEN 'x-api-key' ELSE 'Accept' END AS header, html AS secret FROM pages"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, REQUESTS).withColumn("headers", F.array(F.struct(F.col("header").alias("name"), F.col("secret").alias("value")))).drop("header", "secret")


def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, first requests of paths and secret header names in one table of lines."""
    log = _requests(spark, sf_dir)
    hosts = review.log_hosts(log).select(F.lit("host").alias("part"), F.col("host").alias("name"), F.col("requests").cast("string").alias("detail"))
    paths = review.log_paths(log).select(F.lit("path"), "path", F.concat_ws(" ", "method", "status", "mime", "size"))
    secrets = review.log_secrets(log).select(F.lit("header"), "header", F.col("requests").cast("string"))
    return hosts.union(paths).union(secrets)


A20_SQL = rf"""WITH r AS ({REQUESTS}), p AS (SELECT *, split_part(url, '?', 1) AS path FROM r)
SELECT 'host' AS part, host AS name, count(*)::VARCHAR AS detail FROM r GROUP BY host UNION ALL
SELECT 'path', path, arg_min(concat_ws(' ', method, status, 'text/html', size), seq) FROM p WHERE NOT regexp_matches(path, '{review.STATIC}') AND NOT regexp_matches(path, '{review.STATIC_FOLDERS}') GROUP BY path UNION ALL
SELECT 'header', header, count(*)::VARCHAR FROM r WHERE header <> 'Accept' GROUP BY header"""


def a20_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each shape of an event's properties occurs."""
    return table(spark, sf_dir, "events").groupBy("event_type", review.body_shape(F.col("props")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


A20_BODIES_SQL = "SELECT event_type, 'OBJECT<k: BIGINT>' AS shape, count(*) AS n FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') GROUP BY 1"

# --- streams and walks


def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study sizes in the turns of conversations, each turn a text that arrives."""
    turns = streams.arriving(spark, sf_dir, "conversations.parquet")
    said = F.concat(F.lit("We enrolled "), 20 + F.col("conv_id") % 900, F.lit(" patients. "), F.coalesce("text", F.lit("")))
    texts = turns.select(F.concat_ws(":", "conv_id", "turn").alias("paper_id"), F.col("role").alias("section"), said.alias("text"))
    return streams.extract(texts, f"sizes-{uuid.uuid4().hex}").select("paper_id", "section", "sentence_no", "value", "semantic_type", "confidence")


def s2_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = days.drained(days.daily(days.event_stream(spark, sf_dir)), f"budget-{uuid.uuid4().hex}")
    kept = days.budgeted(found, 9000.0)
    return kept.select(F.to_date("window.start").alias("day"), F.round("spent", 4).alias("spent"), "calls", F.round("remaining", 4).alias("remaining"), "exhausted")


S2_BUDGET_SQL = "SELECT day, round(s, 4) AS spent, calls, round(greatest(0, 9000::DOUBLE - s), 4) AS remaining, s >= 9000 AS exhausted FROM (SELECT CAST(ts AS DATE) AS day, sum(value) AS s, count(*) AS calls FROM events GROUP BY 1) x"

RAW_LINKS = """SELECT concat(CASE WHEN s % 2 = 0 THEN 'W' WHEN s % 3 = 0 THEN '10.1/a' ELSE 'x' END, s) AS source, concat(CASE WHEN (t + ord) % 3 = 0 THEN 'W' WHEN (t + ord) % 3 = 1 THEN '10.1/a' ELSE 'x' END, t) AS target, min(ord) AS seq FROM pairs WHERE t IS NOT NULL AND s <> t GROUP BY 1, 2"""
NAMES = """SELECT concat(kind, p_partkey) AS alias, concat('P', p_partkey) AS paper_id FROM part CROSS JOIN (VALUES ('W'), ('10.1/a')) k(kind) UNION ALL SELECT concat('x', p_partkey), concat('P', p_partkey) FROM part WHERE p_partkey % 5 > 0"""


def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each seed's walk resolves among its references, 12 papers a seed."""
    seeds = table(spark, sf_dir, "seeds").select("seed_id")
    return traverse.traverse(seeds, run(spark, sf_dir, RAW_LINKS, "pairs"), 1, 0, 12, run(spark, sf_dir, NAMES))


def f3_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk whole: two levels back, one forward, 100 papers a seed."""
    seeds = table(spark, sf_dir, "seeds").select("seed_id")
    return traverse.traverse(seeds, run(spark, sf_dir, RAW_LINKS, "pairs"), aliases=run(spark, sf_dir, NAMES))


F3_SQL = with_recipes(f"""WITH r AS ({RAW_LINKS}), n AS ({NAMES}), e AS (SELECT s.paper_id AS source, t.paper_id AS target, CASE WHEN r.target LIKE 'W%' THEN 0 WHEN r.target LIKE '10.%' THEN 1 ELSE 2 END AS class, seq FROM r JOIN n s ON s.alias = r.source JOIN n t ON t.alias = r.target WHERE s.paper_id <> t.paper_id),
near AS (SELECT seed_id, target AS paper_id, min((class, seq)) AS o FROM seeds JOIN e ON source = seed_id GROUP BY 1, 2)
SELECT seed_id, seed_id AS paper_id, 'seed' AS direction, 0 AS depth, CAST(0 AS BIGINT) AS place FROM (SELECT DISTINCT seed_id FROM seeds) x UNION ALL
SELECT seed_id, paper_id, 'backward', 1, r FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY o, paper_id) AS r FROM near) y WHERE r <= 11""", "pairs", "edges", "seeds")  # fmt: skip


def queries() -> dict:
    return {
        "a8_flow_figure": a8, "a13_archive_graph": a13, "a16_run_document": a16, "a19_evidence_pack": a19, "a20_request_log": a20, "a20_body_shapes": a20_bodies, "c15_stages_from_layout": c15, "c16_second_opinions": c16,
        "d13_reader_tally": d13, "d15_agreement": d15, "d20_stage_totals": d20, "e10_free_regions": e10, "e12_region_counts": e12, "f3_resolved_walk": f3, "f3_resolved_walk_whole": f3_whole, "s1_arriving_papers": s1, "s2_daily_budget": s2_budget,
    }


def oracle_sql() -> dict:
    return {
        "a8_flow_figure": A8_SQL, "a19_evidence_pack": A19_SQL, "a20_request_log": A20_SQL, "a20_body_shapes": A20_BODIES_SQL, "c15_stages_from_layout": C15_SQL, "c16_second_opinions": C16_SQL, "d13_reader_tally": D13_SQL, "d15_agreement": D15_SQL,
        "e10_free_regions": E10_SQL, "e12_region_counts": E12_SQL, "f3_resolved_walk": F3_SQL, "s2_daily_budget": S2_BUDGET_SQL,
    }
