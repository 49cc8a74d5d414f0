"""Queries of the text, identifier and evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.functions import ids
from bibloom.operators import evaluate, evidence, overlap, tables
from bibloom.sources.recipes import run, table, with_recipes


# --- identifiers


def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_ids").select("id", ids.canonical(F.col("raw")).alias("canonical"))


_TRIMMED = "t AS (SELECT id, raw, trim(coalesce(raw, '')) AS t0 FROM raw_ids), u AS (SELECT *, CASE WHEN contains(t0, 'pubmed.ncbi.nlm.nih.gov/') THEN trim(split_part(t0, 'pubmed.ncbi.nlm.nih.gov/', 2), '/') WHEN contains(t0, '/pmc/articles/') THEN trim(split_part(t0, '/pmc/articles/', 2), '/') ELSE t0 END AS t FROM t)"
_CANONICAL = """CASE WHEN contains(t, 'doi.org/') THEN lower(split_part(t, 'doi.org/', 2)) WHEN t LIKE '10.%' THEN lower(t) WHEN lower(t) LIKE 'doi:%' THEN lower(substr(t, 5))
WHEN upper(t) LIKE 'PMC%' THEN upper(t) WHEN lower(t) LIKE 'pmid:%' THEN trim(substr(lower(t), 6)) WHEN regexp_full_match(t, '[0-9]{1,9}') THEN t
WHEN regexp_full_match(t, '[Ww][0-9]+') THEN upper(t) WHEN contains(t, '/') AND regexp_matches(t, '^[0-9]') THEN lower(t) ELSE t END"""
_KEY = """CASE WHEN regexp_full_match(c, 'W[0-9]+') THEN c WHEN regexp_full_match(c, 'PMC[0-9]+') THEN 'pmcid:' || c WHEN regexp_full_match(c, '[0-9]+') THEN 'pmid:' || c
WHEN regexp_full_match(c, '10\\.[0-9]{4,9}/\\S+') THEN 'doi:' || c ELSE '' END"""
B1_SQL = with_recipes(f"WITH {_TRIMMED} SELECT id, {_CANONICAL} AS canonical FROM u", "raw_ids")
B4_SQL = with_recipes(f"WITH {_TRIMMED}, k AS (SELECT id, {_CANONICAL} AS c FROM u) SELECT id, {_KEY} AS lookup_key FROM k", "raw_ids")


def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_ids").select("id", ids.strip_view(F.col("raw")).alias("doi"))


B2_SQL = with_recipes(f"SELECT id, regexp_replace(raw, '(?i)^([^/]*/[^/]*(?:/.*?)??)(?:/(?:{'|'.join(ids.VIEW_SEGMENTS)}))+$', '\\1') AS doi FROM raw_ids", "raw_ids")


def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_ids").select("id", ids.query_type(F.col("raw")).alias("query_type"))


B3_SQL = with_recipes("""WITH t AS (SELECT id, trim(coalesce(raw, '')) AS t FROM raw_ids)
SELECT id, CASE WHEN t = '' THEN 'title' WHEN regexp_matches(lower(t), '^(http://|https://|www\\.)') THEN 'url'
 WHEN regexp_full_match(trim(replace(upper(t), 'PMCID:', '')), 'PMC[0-9]+') THEN 'pmcid'
 WHEN regexp_full_match(CASE WHEN lower(t) LIKE 'doi:%' OR lower(t) LIKE 'doi %' THEN trim(substr(t, 5)) ELSE t END, '10\\.[0-9]{4,9}/\\S+') THEN 'doi'
 WHEN regexp_full_match(trim(replace(upper(t), 'PMID:', '')), '[0-9]{1,9}') THEN 'pmid' WHEN regexp_full_match(upper(t), 'W[0-9]+') THEN 'doi' ELSE 'title' END AS query_type FROM t""", "raw_ids")  # fmt: skip


def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_ids").select("id", ids.lookup_key(F.col("raw")).alias("lookup_key"))


def b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries checked by their type, with the reason of a rejection."""
    q = table(spark, sf_dir, "raw_ids").select("id", F.trim(F.coalesce("raw", F.lit(""))).alias("value")).withColumn("query_type", ids.query_type(F.col("value")))
    reason = (
        F.when(F.col("value") == "", "empty")
        .when((F.col("query_type") == "title") & (F.length("value") < 5), "title too short")
        .when((F.col("query_type") == "url") & ~F.col("value").rlike(r"^https?://[^/\s]+"), "address without scheme or host")
    )
    return q.select("id", "query_type", reason.alias("rejected"))


B5_SQL = B3_SQL.replace("SELECT id, CASE WHEN t = ''", ", q AS (SELECT id, t, CASE WHEN t = ''", 1).replace(" AS query_type FROM t", " AS query_type FROM t) SELECT id, query_type, CASE WHEN t = '' THEN 'empty' WHEN query_type = 'title' AND length(t) < 5 THEN 'title too short' WHEN query_type = 'url' AND NOT regexp_matches(t, '^https?://[^/\\s]+') THEN 'address without scheme or host' END AS rejected FROM q")


def b13(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", ids.clamp(F.col("p_size") - 5, 0, 3).alias("backward"), ids.clamp(F.col("p_size") - 5, 0, 2).alias("forward"), ids.clamp(F.col("p_partkey"), 1, 200).alias("papers"))


# --- evidence


def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.candidates(table(spark, sf_dir, "texts")).select("paper_id", "sentence_no", "raw_text", "value", "semantic_type", "confidence", (F.col("end_char") - F.col("start_char")).alias("length"))


def e2_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their ids and offsets."""
    return evidence.candidates(table(spark, sf_dir, "texts")).select("candidate_id", "paper_id", "sentence_no", "match_no", "sentence", "start_char", "end_char", "value")


def e2_own_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a caller's own patterns: numbers of images and of documents."""
    found = evidence.candidates(table(spark, sf_dir, "texts"), OWN_PATTERNS, ())
    return found.select("paper_id", "sentence_no", "raw_text", "start_char", "value", "semantic_type", "confidence")


OWN_PATTERNS = (evidence.Pattern(r"\b(N)\s+(?:thousand\s+)?images\b", "IMAGES", 0.5), evidence.Pattern(r"\bhas\s+(N)\s+documents\b", "DOCUMENTS", 0.9))


def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.candidates(table(spark, sf_dir, "texts"))
    return evidence.resolve(found, table(spark, sf_dir, "papers")).drop("selected_candidate_id")


def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolutions behind the domain gate: no study size is sought in computer science or nonclinical papers."""
    papers = table(spark, sf_dir, "papers")
    gated = papers.filter(~F.col("domain").isin("computer_science", "nonclinical")).select("paper_id")
    found = evidence.candidates(table(spark, sf_dir, "texts").join(gated, "paper_id", "left_semi"))
    return papers.select("paper_id", "domain").join(evidence.resolve(found, gated), "paper_id", "left").withColumn("status", F.coalesce("status", F.lit("not_applicable"))).select("paper_id", "domain", "n_eff", "status")


_SENTENCES = r"""s AS (SELECT paper_id, section, generate_subscripts(p, 1) - 1 AS sentence_no, unnest(p) AS sentence FROM (
    SELECT paper_id, section, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)) AS p FROM texts WHERE text <> '') x)"""


def _matched(i: int) -> str:
    pattern, kind, weight = evidence.POPULATION[i]
    p = ("(?i)" + pattern.replace("(N)", f"({evidence.NUMBER})")).replace("'", "''")
    return f"SELECT paper_id, section, sentence_no, sentence, {i} AS pattern_no, unnest(regexp_extract_all(sentence, '{p}', 0)) AS raw_text, unnest(regexp_extract_all(sentence, '{p}', 1)) AS number, generate_subscripts(regexp_extract_all(sentence, '{p}', 0), 1) AS k, '{kind}' AS semantic_type, {weight}::DOUBLE AS weight FROM s"


# in these texts a number is ignored where it is a year, or a percentage or dose follows it
_CANDIDATES = f"""{_SENTENCES}, m AS ({' UNION ALL '.join(_matched(i) for i in range(len(evidence.POPULATION)))}),
c AS (SELECT *, CAST(floor(CAST(replace(number, ',', '') AS DOUBLE)) AS INTEGER) AS value, round(least(1.0::DOUBLE, weight + CASE WHEN section IN ('abstract', 'methods') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END), 6) AS confidence FROM m
    WHERE NOT regexp_full_match(number, '20[0-9][0-9]') AND NOT regexp_matches(sentence, '(^|[^0-9,.])' || number || '\\s*(%|mg)'))"""
E2_SQL = with_recipes(f"WITH {_CANDIDATES} SELECT paper_id, CAST(sentence_no AS INTEGER) AS sentence_no, raw_text, value, semantic_type, confidence, CAST(length(raw_text) AS INTEGER) AS length FROM c WHERE value BETWEEN 1 AND 10000000", "texts")
# no text here repeats a match, so a match stands where its words first do
_NUMBERED = _CANDIDATES.replace("FROM m\n", "FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, section, sentence_no ORDER BY pattern_no, k) - 1 AS match_no FROM m) n\n")
E2_PLACES_SQL = with_recipes(f"""WITH {_NUMBERED}
SELECT sha256(concat_ws('|', paper_id, section, sentence_no, match_no)) AS candidate_id, paper_id, sentence_no::INTEGER AS sentence_no, match_no::INTEGER AS match_no, trim(sentence) AS sentence,
    (strpos(sentence, raw_text) - 1)::INTEGER AS start_char, (strpos(sentence, raw_text) - 1 + length(raw_text))::INTEGER AS end_char, value
FROM c WHERE value BETWEEN 1 AND 10000000""", "texts")
E2_OWN_SQL = with_recipes(rf"""WITH {_SENTENCES}, m AS (
    SELECT paper_id, section, sentence_no, sentence, regexp_extract(sentence, '([0-9]+) (thousand )?images', 0) AS raw_text, 'IMAGES' AS semantic_type, 0.5::DOUBLE AS weight FROM s UNION ALL
    SELECT paper_id, section, sentence_no, sentence, substr(regexp_extract(sentence, 'tested on [0-9]+ images', 0), 11), 'IMAGES', 0.5::DOUBLE FROM s WHERE regexp_matches(sentence, 'images.*images') UNION ALL
    SELECT paper_id, section, sentence_no, sentence, regexp_extract(sentence, 'has ([0-9]+) documents', 0), 'DOCUMENTS', 0.9::DOUBLE FROM s)
SELECT paper_id, sentence_no::INTEGER AS sentence_no, raw_text, (strpos(sentence, raw_text) - 1)::INTEGER AS start_char, regexp_extract(raw_text, '[0-9]+')::INTEGER AS value, semantic_type,
    round(least(1.0::DOUBLE, weight + CASE WHEN section IN ('abstract', 'methods') THEN 0.1::DOUBLE ELSE 0::DOUBLE END), 6) AS confidence FROM m WHERE raw_text <> ''""", "texts")
_PRIORITY = "CASE semantic_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in evidence.PRIORITY.items()) + " ELSE 0 END"
_RESOLVED = f"""{_CANDIDATES}, h AS (SELECT *, confidence * (1 + {_PRIORITY} / 10.0::DOUBLE) AS score FROM c WHERE value BETWEEN 1 AND 10000000 AND confidence > 0.4),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, confidence DESC, sentence_no, pattern_no, k) AS r FROM h) x WHERE r = 1),
v AS (SELECT DISTINCT h.paper_id FROM h JOIN b USING (paper_id) WHERE h.score > b.score * 0.9::DOUBLE AND abs(h.value - b.value) > b.value * 0.1::DOUBLE)"""
_FINAL = "SELECT p.paper_id, b.value AS n_eff, b.semantic_type, coalesce(b.confidence, 0.0::DOUBLE) AS confidence, CASE WHEN b.value IS NULL THEN 'missing' WHEN v.paper_id IS NOT NULL THEN 'ambiguous' ELSE 'resolved' END AS status FROM papers p LEFT JOIN b ON b.paper_id = p.paper_id LEFT JOIN v ON v.paper_id = p.paper_id"
E3_SQL = with_recipes(f"WITH {_RESOLVED} {_FINAL}", "texts", "papers")
E4_SQL = with_recipes(f"WITH {_RESOLVED}, f AS ({_FINAL}) SELECT p.paper_id, p.domain, CASE WHEN p.domain IN ('computer_science', 'nonclinical') THEN NULL ELSE n_eff END AS n_eff, CASE WHEN p.domain IN ('computer_science', 'nonclinical') THEN 'not_applicable' ELSE status END AS status FROM papers p JOIN f ON f.paper_id = p.paper_id", "texts", "papers")


def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.dataset_counts(table(spark, sf_dir, "texts"))
    return evidence.resolve_datasets(found, table(spark, sf_dir, "papers")).drop("evidence")


_COUNT = evidence.COUNTED.replace("'", "''")
_CONTEXT = evidence.CONTEXT.replace("'", "''")
E5_SQL = with_recipes(f"""WITH {_SENTENCES}, m AS (SELECT paper_id, section, sentence_no, sentence, unnest(regexp_extract_all(sentence, '{_COUNT}', 0)) AS v, generate_subscripts(regexp_extract_all(sentence, '{_COUNT}', 0), 1) AS k FROM s WHERE regexp_matches(sentence, '{_CONTEXT}')),
n AS (SELECT *, string_split(v, ' ') AS w, lower(substr(sentence, greatest(1, strpos(sentence, v) - 100), least(100, strpos(sentence, v) - 1))) AS before FROM m),
o AS (SELECT *, CAST(round_even(CAST(replace(w[1], ',', '') AS DOUBLE) * CASE lower(w[2]) WHEN 'million' THEN 1000000 WHEN 'thousand' THEN 1000 WHEN 'billion' THEN 1000000000 ELSE 1 END, 0) AS BIGINT) AS value,
  lower(CASE WHEN lower(w[2]) IN ('million', 'thousand', 'billion') THEN array_to_string(w[3:], ' ') ELSE array_to_string(w[2:], ' ') END) AS unit,
  length(before) - strpos(reverse(before), 'niart') AS train, greatest(CASE WHEN contains(before, 'test') THEN length(before) - strpos(reverse(before), 'tset') ELSE -1 END, CASE WHEN contains(before, 'benchmark') THEN length(before) - strpos(reverse(before), 'kramhcneb') ELSE -1 END) AS test, contains(before, 'train') AS trains FROM n),
q AS (SELECT *, CASE WHEN NOT trains AND test < 0 THEN 'dataset_examples' WHEN trains AND train > test THEN 'training_examples' ELSE 'evaluation_examples' END AS kind FROM o),
c AS (SELECT *, round(CASE WHEN kind = 'training_examples' THEN 0.85::DOUBLE ELSE 0.75::DOUBLE END - CASE WHEN section = 'full_text' THEN 0.05::DOUBLE ELSE 0::DOUBLE END, 6) AS confidence, CASE kind WHEN 'training_examples' THEN 3 WHEN 'dataset_examples' THEN 2 ELSE 1 END AS priority FROM q),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY priority DESC, confidence DESC, value DESC, sentence_no, k) AS r FROM c) x WHERE r = 1),
a AS (SELECT DISTINCT c.paper_id FROM c JOIN b ON b.paper_id = c.paper_id AND b.kind = c.kind WHERE abs(c.value - b.value) > b.value * 0.1::DOUBLE)
SELECT p.paper_id, CASE WHEN b.value IS NULL THEN 'missing' WHEN a.paper_id IS NOT NULL THEN 'ambiguous' ELSE 'resolved' END AS status, b.kind, b.value, b.unit, coalesce(round(b.confidence * CASE WHEN a.paper_id IS NOT NULL THEN 0.7::DOUBLE ELSE 1::DOUBLE END, 6), 0::DOUBLE) AS confidence
FROM papers p LEFT JOIN b ON b.paper_id = p.paper_id LEFT JOIN a ON a.paper_id = p.paper_id""", "texts", "papers")  # fmt: skip


# --- overlap


def d19(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return overlap.text_overlap(docs, marks, "doc_id", "item_id")


_WORDS = r"""list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '(?m)^\s*\|.*$', ' ', 'g'), '`[^`]*`', ' ', 'g'), 'https?://\S+', ' ', 'g'), '[^A-Za-z0-9 ]', ' ', 'g')), ' +'), lambda w: w <> '')"""


def _grams(name: str, key: str) -> str:
    return f"w_{name} AS (SELECT {key}, {_WORDS} AS w FROM {name}), g_{name} AS (SELECT {key}, pos, array_to_string(w[pos + 1:pos + 8], ' ') AS gram FROM (SELECT {key}, w, unnest(range(len(w) - 7)) AS pos FROM w_{name} WHERE len(w) >= 8) x)"


_GRAMS = f"WITH {_grams('documents', 'doc_id')}, {_grams('benchmark', 'item_id')}"
D19_SQL = f"""{_GRAMS} SELECT doc_id, grams, shared, percent, CASE WHEN percent < 1 THEN 'low' WHEN percent < 5 THEN 'medium' ELSE 'high' END AS band FROM (
    SELECT doc_id, count(*) AS grams, count(*) FILTER (gram IN (SELECT gram FROM g_benchmark)) AS shared, round(100.0::DOUBLE * count(*) FILTER (gram IN (SELECT gram FROM g_benchmark)) / count(*), 6) AS percent FROM g_documents GROUP BY doc_id) x"""


def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return overlap.passages(overlap.grams(docs, "doc_id", "text"), overlap.grams(marks, "item_id", "text"), "doc_id")


# --- evaluation


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold sizes are the sold quantities of a paper, predictions what its text says."""
    predicted = evidence.resolve(evidence.candidates(table(spark, sf_dir, "texts")), table(spark, sf_dir, "papers")).select("paper_id", F.col("n_eff").alias("predicted"))
    gold = table(spark, sf_dir, "resolutions").select("paper_id", F.col("n_eff").alias("gold"))
    return table(spark, sf_dir, "papers").select("paper_id", "journal").join(gold, "paper_id", "left").join(predicted, "paper_id", "left")


def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.detection_scores(_gold(spark, sf_dir))
    return found.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


_PAIRS = f"{_RESOLVED}, f AS ({_FINAL}), pairs_ AS (SELECT p.paper_id, p.journal, g.n_eff AS gold, f.n_eff AS predicted FROM papers p LEFT JOIN resolutions g ON g.paper_id = p.paper_id JOIN f ON f.paper_id = p.paper_id)"
D9_SQL = with_recipes(f"""WITH {_PAIRS}, n AS (SELECT count(*) FILTER (gold IS NOT NULL AND predicted IS NOT NULL) AS tp, count(*) FILTER (gold IS NULL AND predicted IS NOT NULL) AS fp, count(*) FILTER (gold IS NULL AND predicted IS NULL) AS tn, count(*) FILTER (gold IS NOT NULL AND predicted IS NULL) AS fn, count(*) FILTER (gold = predicted) AS exact FROM pairs_),
r AS (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall FROM n)
SELECT tp, fp, tn, fn, exact, round(precision, 9) AS precision, round(recall, 9) AS recall, round(tn / nullif(tn + fp, 0)::DOUBLE, 9) AS specificity, round((tp + tn) / nullif(tp + fp + tn + fn, 0)::DOUBLE, 9) AS accuracy,
 round(exact / nullif(tp, 0)::DOUBLE, 9) AS value_accuracy, round(2 * precision * recall / nullif(precision + recall, 0), 9) AS f1 FROM r""", "texts", "papers", "resolutions")  # fmt: skip


def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _gold(spark, sf_dir).groupBy("journal").agg(F.count_if(F.col("gold").eqNullSafe(F.col("predicted"))).alias("right"), F.count(F.lit(1)).alias("n"))
    low, high = evaluate.wilson(F.col("right"), F.col("n"))
    return counts.select("journal", "right", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


D10_SQL = with_recipes(f"""WITH {_PAIRS}, cn AS (SELECT journal, count(*) FILTER (gold IS NOT DISTINCT FROM predicted) AS "right", count(*) AS n FROM pairs_ GROUP BY journal), pp AS (SELECT *, "right" / n::DOUBLE AS p FROM cn)
SELECT journal, "right", n, round(greatest(0::DOUBLE, least(1::DOUBLE, (p + 3.8416::DOUBLE / (2 * n)) / (1 + 3.8416::DOUBLE / n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n)) / (1 + 3.8416::DOUBLE / n))), 9) AS low,
 round(greatest(0::DOUBLE, least(1::DOUBLE, (p + 3.8416::DOUBLE / (2 * n)) / (1 + 3.8416::DOUBLE / n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n)) / (1 + 3.8416::DOUBLE / n))), 9) AS high FROM pp""", "texts", "papers", "resolutions")  # fmt: skip


def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.exact_match_rate(_gold(spark, sf_dir), "journal", "gold", "predicted")
    return found.select("journal", F.round("rate", 9).alias("rate"), "n")


D11_SQL = with_recipes(f"WITH {_PAIRS} SELECT journal, round(avg(CASE WHEN gold IS NOT DISTINCT FROM predicted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS rate, count(*) AS n FROM pairs_ GROUP BY journal", "texts", "papers", "resolutions")


def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readers of documents per source: which of length and language agrees with the label where only one does."""
    both = run(spark, sf_dir, _READERS)
    return both.select("source", "b", "c", F.round(evaluate.mcnemar(F.col("b"), F.col("c")), 9).alias("p"))


_READERS = """SELECT source, sum(CASE WHEN x = quality AND y <> quality THEN 1 ELSE 0 END) AS b, sum(CASE WHEN x <> quality AND y = quality THEN 1 ELSE 0 END) AS c FROM (
    SELECT d.source, l.quality, CASE WHEN d.n_chars > 900 THEN 1 ELSE 0 END AS x, CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END AS y FROM documents d JOIN labels l ON l.doc_id = d.doc_id) z GROUP BY source"""
D14_SQL = f"""WITH r AS (SELECT source, b::BIGINT AS b, c::BIGINT AS c FROM ({_READERS}) q)
SELECT source, b, c, round(CASE WHEN b + c = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(least(b, c) + 1), lambda k: exp(lgamma(b + c + 1.0::DOUBLE) - lgamma(k + 1.0::DOUBLE) - lgamma(b + c - k + 1.0::DOUBLE) - (b + c) * ln(2.0::DOUBLE))))) END, 9) AS p FROM r"""


def c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No query (c8_title_match is plans/tables.py's): parts of size 1 in their brand and type, on which tests try the operator's blocks."""
    p = table(spark, sf_dir, "part")
    wanted = p.filter(F.col("p_size") == 1).select("p_brand", "p_type", F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    held = p.select("p_brand", "p_type", F.col("p_partkey").alias("candidate"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.floor(F.col("p_retailprice")).alias("cited"))
    return tables.best_titles(wanted, held, block=("p_brand", "p_type"))


def queries() -> dict:
    return {
        "b1_canonical_id": b1, "b2_strip_view": b2, "b3_query_type": b3, "b4_lookup_key": b4, "b5_validate": b5, "b13_clamp": b13,
        "e2_population_candidates": e2, "e2_candidate_places": e2_places, "e2_own_patterns": e2_own_patterns, "e3_resolve_population": e3, "e4_domain_gate": e4, "e5_dataset_counts": e5,
        "d19_ngram_overlap": d19, "f13_shared_passages": f13, "d9_detection": d9, "d10_wilson": d10, "d11_exact_match": d11, "d14_mcnemar": d14,
    }


def oracle_sql() -> dict:
    return {
        "b1_canonical_id": B1_SQL, "b2_strip_view": B2_SQL, "b3_query_type": B3_SQL, "b4_lookup_key": B4_SQL, "b5_validate": B5_SQL,
        "b13_clamp": "SELECT p_partkey, least(greatest(p_size - 5, 0), 3) AS backward, least(greatest(p_size - 5, 0), 2) AS forward, least(greatest(p_partkey, 1), 200) AS papers FROM part",
        "e2_population_candidates": E2_SQL, "e2_candidate_places": E2_PLACES_SQL, "e2_own_patterns": E2_OWN_SQL, "e3_resolve_population": E3_SQL, "e4_domain_gate": E4_SQL, "e5_dataset_counts": E5_SQL,
        "d19_ngram_overlap": D19_SQL, "d9_detection": D9_SQL, "d10_wilson": D10_SQL, "d11_exact_match": D11_SQL, "d14_mcnemar": D14_SQL,
    }
