"""Study sizes and dataset counts read from text, and their resolution per paper."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.functions.spans import SENTENCE_END, bound, literal, matches, places, sentences


class Pattern(NamedTuple):
    """What a study size looks like: an expression without back-references whose group (N) is the number, in either case."""

    pattern: str
    kind: str
    weight: float


# A number; patterns of study sizes; what is no study size
NUMBER = r"\d+(?:,\d{3})*(?:\.\d+)?"
POPULATION = (
    Pattern(r"\b[Nn]\s*=\s*(N)\b", "SAMPLE_SIZE_GENERIC", 0.8),
    Pattern(r"\b(N)\s*(?:eligible\s+)?patients\b", "TOTAL_ENROLLED", 0.7),
    Pattern(r"\b(N)\s*participants\b", "TOTAL_ENROLLED", 0.7),
    Pattern(r"\b(?:randomized|assigned)\s+(N)\b", "TOTAL_RANDOMIZED", 0.9),
    Pattern(r"\b(N)\s+(?:patients|participants|individuals|subjects)\s+(?:were\s+)?(?:randomized|assigned|enrolled)\b", "TOTAL_RANDOMIZED", 0.95),
    Pattern(r"\benrolled\s+(N)\b", "TOTAL_ENROLLED", 0.85),
    Pattern(r"\banalyzed\s+(N)\b", "TOTAL_ANALYZED", 0.85),
    Pattern(r"\bcohort\s+of\s+(N)\b", "SAMPLE_SIZE_GENERIC", 0.75),
    Pattern(r"\bsample\s+size\s+of\s+(N)\b", "SAMPLE_SIZE_GENERIC", 0.9),
    Pattern(r"\ba\s+total\s+of\s+(N)\b", "SAMPLE_SIZE_GENERIC", 0.85),
    Pattern(r"\b(N)\s+(?:laboratory-|lab-|virologically\s+)?(?:confirmed\s+|reported\s+|suspected\s+|index\s+)?cases\b", "SAMPLE_SIZE_GENERIC", 0.7),
    Pattern(r"\b(N)\s+(?:healthy\s+|consecutive\s+|adult\s+)?(?:subjects|individuals|volunteers|adults|children|infants|women|men)\b", "TOTAL_ENROLLED", 0.7),
    Pattern(r"\b(N)\s+consecutive\s+(?:patients|cases|subjects)\b", "TOTAL_ENROLLED", 0.8),
    Pattern(r"\b(?:included|recruited|studied|evaluated|assessed)\s+(N)\b", "TOTAL_ANALYZED", 0.8),
    Pattern(r"\bdata\s+(?:on|from|regarding)\s+(?:the\s+first\s+)?(N)\b", "TOTAL_ANALYZED", 0.75),
    Pattern(r"\bscreened\s+(N)\b", "SCREENED", 0.8),
    Pattern(r"\b(N)\s+(?:patients\s+|participants\s+|subjects\s+)?(?:were\s+)?screened\b", "SCREENED", 0.8),
    Pattern(r"\b(N)\s+(?:patients\s+|participants\s+|subjects\s+)?completed\b", "COMPLETERS", 0.75),
    Pattern(r"\b(?:group|arm)\s+\(\s*[Nn]\s*=\s*(N)\s*\)", "ARM_SIZE", 0.7),
    Pattern(r"\b(N)\s+(?:patients\s+|participants\s+)?(?:were\s+)?followed\s+(?:up|for)\b", "FOLLOWUP_COUNT", 0.7),
)
IGNORED = (r"\b20\d{2}\b", r"\d+\s*%", r"[Pp]\s*<\s*0?\.\d+", r"95%\s*CI", r"\d+\s*mg", r"p\s*=\s*\d+\.\d+")
PRIORITY = {"TOTAL_RANDOMIZED": 10, "TOTAL_ANALYZED": 9, "TOTAL_ENROLLED": 8, "SAMPLE_SIZE_GENERIC": 7, "ARM_SIZE": 5, "SCREENED": 4, "COMPLETERS": 3, "FOLLOWUP_COUNT": 2, "EVENT_COUNT": 1}
MOST = 10_000_000
# Dataset counts
COUNTED = r"(?i)\b(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)\s*(?:billion|million|thousand|[bmk])?\s+(?:sentence pairs?|images?|examples?|samples?|documents?|instances?|records?|data points?)\b"
COUNT_PARTS = r"(?i)^([\d,.]+)\s*(billion|million|thousand|[bmk])?\s+(.+)$"
CONTEXT = r"(?i)\b(dataset|data set|corpus|benchmark|train\w*|test\w*|validat\w*|evaluat\w*|collect\w*|used?|using)\b"
SCALE = {"billion": 10**9, "b": 10**9, "million": 10**6, "m": 10**6, "thousand": 10**3, "k": 10**3}
KINDS = {"training_examples": 3, "dataset_examples": 2, "evaluation_examples": 1}


FOUND = "array<struct<match_no:int,m:struct<value:string,number:string,start:int,end:int,number_start:int,type:string,weight:double>>>"


def _lookup(values: dict, key: Column, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def sentence_candidates(sentence: str, patterns: Sequence[Pattern] = POPULATION, ignored: Sequence[str] = IGNORED) -> str:
    """SQL for an array of (match_no, m): what the patterns find in a sentence, in their order, without numbers inside an ignored span.

    One alternation of all patterns proposes sentences; each pattern is tried only in those.
    """
    fields = ", ".join(f"m.{k} AS {k}" for k in ("value", "number", "start", "end", "number_start"))
    typed = [f"transform({matches(sentence, '(?i)' + p.pattern.replace('(N)', f'({NUMBER})'))}, m -> struct({fields}, {literal(p.kind)} AS type, {float(p.weight)}D AS weight))" for p in patterns]
    spans = f"concat({', '.join(places(sentence, literal(p)) for p in ignored)})" if ignored else "cast(array() AS array<struct<start:int,end:int>>)"
    none = f"cast(array() AS {FOUND})"
    inside = "g.start < c.m.number_start + length(c.m.number) AND c.m.number_start < g.end"
    clear = bound(spans, "h", f"filter(transform(t, (m, i) -> struct(i AS match_no, m AS m)), c -> NOT exists(h, g -> {inside}))")
    all_ = bound(f"concat({', '.join(typed)})", "t", f"CASE WHEN size(t) > 0 THEN {clear} ELSE {none} END")
    anything = literal("(?i)" + "|".join(f"(?:{p.pattern.replace('(N)', f'(?:{NUMBER})')})" for p in patterns))
    return f"CASE WHEN {sentence} RLIKE {anything} THEN {all_} ELSE {none} END"


def _value(number: Column) -> Column:
    return F.floor(F.replace(number, F.lit(","), F.lit("")).try_cast("double"))


def _id(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def candidates(texts: DataFrame, patterns: Sequence[Pattern] = POPULATION, ignored: Sequence[str] = IGNORED, places: Sequence[str] = ()) -> DataFrame:
    """Every study-size candidate of texts (paper_id, section, text): one row each, in extraction order.

    A number inside an ignored span (a year, a percentage, ...) is none; the same number may
    give candidates of several types. ``patterns`` and ``ignored`` are tables of the caller's
    own, a few dozen rows that become part of the plan. ``places`` are columns that tell where in
    a paper a text stands; they are kept and take part in the candidate's id.
    """
    parts = texts.filter("text is not null and text <> ''").select("paper_id", "section", *places, F.posexplode(sentences(F.col("text"))).alias("sentence_no", "sentence"))
    numbered = parts.filter(F.col("sentence").rlike("[0-9]"))
    rows = numbered.select("paper_id", "section", *places, "sentence_no", "sentence", F.expr(f"inline({sentence_candidates('sentence', patterns, ignored)})"))
    kept = rows.withColumn("value", _value(F.col("m.number"))).filter((F.col("value") > 0) & (F.col("value") <= MOST))
    return kept.select(
        _id("paper_id", "section", *places, "sentence_no", "match_no").alias("candidate_id"),
        "paper_id", "section", *places, "sentence_no", "match_no", F.trim("sentence").alias("sentence"), F.col("m.value").alias("raw_text"),
        F.col("m.start").alias("start_char"), F.col("m.end").alias("end_char"), F.col("value").cast("int").alias("value"),
        F.col("m.type").alias("semantic_type"), F.round(F.least(F.lit(1.0), F.col("m.weight") + F.when(F.lower("section").isin("abstract", "methods"), 0.1).otherwise(0.0)), 6).alias("confidence"),
    )


def _score(confidence: Column, kind: Column) -> Column:
    return confidence * (1 + _lookup(PRIORITY, kind, 0) / 10.0)


def resolve_in_row(patterns: Sequence[Pattern] = POPULATION, ignored: Sequence[str] = IGNORED) -> Column:
    """(n_eff, semantic_type, confidence, status, selected_candidate_id) of a row (paper_id, section, text), as ``resolve`` gives for a paper of that text alone.

    No row meets another, so it suits a stream that keeps no state.
    """
    number = "floor(try_cast(replace(c.m.number, ',', '') AS double))"
    confidence = "round(least(1.0D, c.m.weight + CASE WHEN lower(section) IN ('abstract', 'methods') THEN 0.1D ELSE 0.0D END), 6)"
    priority = f"(CASE k.kind {' '.join(f'WHEN {literal(n)} THEN {v}' for n, v in PRIORITY.items())} ELSE 0 END)"
    plain = f"transform({sentence_candidates('q', patterns, ignored)}, c -> struct({number} AS value, {confidence} AS confidence, c.m.type AS kind, p AS sentence_no, c.match_no AS match_no))"
    read = f"flatten(transform(split(coalesce(text, ''), {literal(SENTENCE_END)}), (q, p) -> {plain}))"
    kept = f"filter({read}, k -> k.value > 0 AND k.value <= {MOST} AND k.confidence > 0.4D)"
    # the least of these is the best candidate
    ranked = f"transform({kept}, k -> struct(-(k.confidence * (1 + {priority} / 10.0D)) AS s, -k.confidence AS c, k.sentence_no AS sentence_no, k.match_no AS match_no, k.value AS value, k.kind AS kind))"
    rival = "exists(r, o -> -o.s > -b.s * 0.9D AND abs(o.value - b.value) > b.value * 0.1D)"
    name = "CASE WHEN b IS NOT NULL THEN sha2(concat_ws('|', paper_id, section, b.sentence_no, b.match_no), 256) END"
    status = f"CASE WHEN b IS NULL THEN 'missing' WHEN {rival} THEN 'ambiguous' ELSE 'resolved' END"
    answer = f"struct(cast(b.value AS int) AS n_eff, b.kind AS semantic_type, coalesce(-b.c, 0.0D) AS confidence, {status} AS status, {name} AS selected_candidate_id)"
    return F.expr(bound(ranked, "r", bound("array_min(r)", "b", answer)))


def resolve(found: DataFrame, papers: DataFrame, places: Sequence[str] = ()) -> DataFrame:
    """One row per paper: the best candidate, and whether a rival of nearly its score differs by over a tenth.

    Equals go by extraction order: ``places``, then sentence and match.
    """
    score = _score(F.col("confidence"), F.col("semantic_type"))
    # the least of these is the best candidate; one shuffle by paper serves both the best and its rivals
    ranked = F.struct((-score).alias("s"), (-F.col("confidence")).alias("c"), *places, "sentence_no", "match_no", "value", "semantic_type", "candidate_id")
    held = found.filter("confidence > 0.4").select("paper_id", ranked.alias("own"))
    met = held.select("paper_id", "own", F.min("own").over(Window.partitionBy("paper_id")).alias("best"))
    value, rival = F.col("best.value"), F.col("own.value")
    unclear = (-F.col("own.s") > -F.col("best.s") * 0.9) & (F.abs(rival - value) > value * 0.1)
    best = met.groupBy("paper_id").agg(F.min("best").alias("best"), F.bool_or(unclear).alias("unclear"))
    joined = papers.select("paper_id").join(best, "paper_id", "left")
    status = F.when(value.isNull(), "missing").when(F.col("unclear"), "ambiguous").otherwise("resolved")
    return joined.select(
        "paper_id", value.alias("n_eff"), F.col("best.semantic_type").alias("semantic_type"), F.coalesce(-F.col("best.c"), F.lit(0.0)).alias("confidence"),
        status.alias("status"), F.col("best.candidate_id").alias("selected_candidate_id"),
    )


def _last(text: Column, word: str) -> Column:
    """Where the last occurrence of a word begins; -1 where there is none."""
    return F.length(F.regexp_extract(text, rf"(?is)^(.*)\b{word}\b", 1)) - F.when(text.rlike(rf"(?i)\b{word}\b"), 0).otherwise(1)


def dataset_counts(texts: DataFrame) -> DataFrame:
    """Dataset-count candidates of texts (paper_id, section, text) in sentences that speak of data."""
    parts = texts.filter("text is not null and text <> ''").select("paper_id", "section", F.posexplode(sentences(F.col("text"))).alias("sentence_no", "sentence"))
    rows = parts.filter(F.col("sentence").rlike(CONTEXT)).select("*", F.posexplode(F.expr(matches("sentence", COUNTED))).alias("match_no", "m"))
    number, scale, unit = (F.regexp_extract("m.value", COUNT_PARTS, k) for k in (1, 2, 3))
    value = F.bround(F.replace(number, F.lit(","), F.lit("")).cast("double") * _lookup(SCALE, F.lower(scale), 1)).cast("long")
    before = F.substring(F.col("sentence"), F.greatest(F.col("m.start") - 99, F.lit(1)), F.least(F.col("m.start"), F.lit(100)))
    train, test = _last(before, r"train\w*"), _last(before, r"(?:test\w*|evaluat\w*|benchmark)")
    kind = F.when((train < 0) & (test < 0), "dataset_examples").when(train > test, "training_examples").otherwise("evaluation_examples")
    out = rows.withColumns({"value": value, "unit": F.lower(unit), "kind": kind}).filter("value > 0 and value <= 10000000000")
    confidence = F.when(F.col("kind") == "training_examples", 0.85).otherwise(0.75) - F.when(F.col("section") == "full_text", 0.05).otherwise(0.0)
    return out.select("paper_id", "section", "sentence_no", "match_no", "kind", "value", "unit", F.round(confidence, 6).alias("confidence"), F.trim("sentence").alias("evidence"))


def resolve_datasets(found: DataFrame, papers: DataFrame) -> DataFrame:
    """One row per paper: the count of the best kind, then confidence, then value; ambiguous if one of its kind differs by over a tenth."""
    ranked = found.withColumn("priority", _lookup(KINDS, F.col("kind"), 0))
    order = Window.partitionBy("paper_id").orderBy(F.col("priority").desc(), F.col("confidence").desc(), F.col("value").desc(), "sentence_no", "match_no")
    best = ranked.withColumn("r", F.row_number().over(order)).filter("r = 1")
    other = found.select("paper_id", "kind", F.col("value").alias("v")).join(best.select("paper_id", "kind", "value"), ["paper_id", "kind"])
    unclear = other.filter("abs(v - value) > value * 0.1D").select("paper_id").distinct().withColumn("unclear", F.lit(True))
    joined = papers.select("paper_id").join(best.drop("r", "priority"), "paper_id", "left").join(unclear, "paper_id", "left")
    status = F.when(F.col("value").isNull(), "missing").when(F.col("unclear"), "ambiguous").otherwise("resolved")
    confidence = F.coalesce(F.round(F.col("confidence") * F.when(F.col("unclear"), 0.7).otherwise(1.0), 6), F.lit(0.0))
    return joined.select("paper_id", status.alias("status"), "kind", "value", "unit", confidence.alias("confidence"), "evidence")
