"""Study sections of full texts, and what they recover for papers whose abstracts tell nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.functions import ids
from bibloom.operators import evidence, ledger

# Words of headings, of sentences about people, of data sections
PRUNED = r"\b(introduction|discussion|conclusions?|references?)\b"
RESULTS = r"\b(results?|findings?|outcomes?)\b"
METHODS = r"\b(methods?|methodology|materials?|patients?|participants?|subjects?|study design|recruitment|cohort|population)\b"
PEOPLE = (
    r"(?i)\b(patients?|participants?|subjects?|individuals?|volunteers?|cases?|cohort|population|sample size|randomiz\w*|enroll\w*|screen\w*"
    r"|recruit\w*|followed|adults?|children|infants?|women|men)\b"
)
DATA_HEADING = r"^\s*(?:\d+(?:\.\d+)*\s+)?(?:training(?: data)?|datasets?|data(?:sets?)?|experiments?|evaluation|experimental setup)\b"
REFERENCES = r"(?im)^\s*(?:\d+\s+)?references\s*$"
DATA_MOST = 100_000
PAPER_MOST = 250_000


def section_label(path: Column) -> Column:
    """The label of a paragraph by its headings from the outside in: methods, results or null.

    A heading of PRUNED takes everything below it away; results once met stay results.
    """
    start = F.struct(F.lit(None).cast("string").alias("label"), F.lit(False).alias("gone"))

    def step(acc: Column, heading: Column) -> Column:
        h = F.trim(F.regexp_replace(F.lower(F.coalesce(heading, F.lit(""))), r"\s+", " "))
        inherited = F.coalesce(acc["label"], F.lit(""))
        label = F.when(h.rlike(RESULTS), "results").when((inherited != "results") & h.rlike(METHODS), "methods").otherwise(acc["label"])
        return F.struct(label.alias("label"), (acc["gone"] | h.rlike(PRUNED)).alias("gone"))

    return F.aggregate(path, start, step, lambda acc: F.when(~acc["gone"], acc["label"]))


def study_sections(fulltext: DataFrame) -> DataFrame:
    """(paper_id, pos, section, paragraph) of fulltext (paper_id, pos, heading_path, paragraph): labelled paragraphs with a text."""
    plain = F.trim(F.regexp_replace(F.coalesce("paragraph", F.lit("")), r"\s+", " "))
    told = fulltext.select("paper_id", "pos", section_label(F.col("heading_path")).alias("section"), plain.alias("paragraph"))
    return told.filter("section is not null and paragraph <> ''")


def data_section(body: Column) -> Column:
    """A plain text from its first heading about data up to its references, on one line; null without such a heading."""
    found = F.regexp_extract(body, rf"(?ims)({DATA_HEADING}.*)", 1)
    kept = F.left(F.get(F.split(found, REFERENCES, 2), 0), F.lit(DATA_MOST))
    return F.when(found != "", F.trim(F.regexp_replace(F.regexp_replace(kept, r"-\s*\n", ""), r"\s+", " ")))


def about_people(sentence: Column) -> Column:
    return sentence.rlike(PEOPLE)


def open_access(papers: DataFrame, records: DataFrame) -> DataFrame:
    """Adds pmcid to papers (doi): the last valid one of records (doi, pmcid, seq) with the same canonical DOI."""
    valid = records.select(ids.canonical(F.col("doi")).alias("d"), F.upper(ids.stripped(F.col("pmcid"))).alias("pmcid"), "seq").filter("d <> ''")
    last = valid.filter(F.col("pmcid").rlike(r"^PMC\d+$")).groupBy("d").agg(F.max_by("pmcid", "seq").alias("pmcid"))
    return papers.join(last, ids.canonical(F.col("doi")) == F.col("d"), "left").drop("d")


def recovered(resolutions: DataFrame, sections: DataFrame, most: int = PAPER_MOST) -> DataFrame:
    """Resolutions (paper_id, n_eff, semantic_type, confidence, status, ...) with missing ones replaced by what the full text tells.

    The leading paragraphs of a paper that hold ``most`` characters together are read (the
    provider's own budget a paper), and only sentences about people count. What is still
    missing stays as it was.
    """
    wanted = sections.join(resolutions.filter("status = 'missing'").select("paper_id"), "paper_id", "left_semi")
    read = ledger.running_budget(wanted, "paper_id", ["pos"], F.length("paragraph"), most)
    # extraction order runs over a paper's paragraphs
    found = evidence.candidates(read.select("paper_id", "section", "pos", F.col("paragraph").alias("text")), places=["pos"])
    fresh = evidence.resolve(found.filter(about_people(F.col("sentence"))), wanted.select("paper_id").distinct(), ["pos"]).filter("status <> 'missing'")
    fields = ("n_eff", "semantic_type", "confidence", "status")
    renamed = fresh.select("paper_id", *[F.col(c).alias(f"{c}_fresh") for c in fields])
    joined = resolutions.join(renamed, "paper_id", "left").withColumn("from_full_text", F.col("status_fresh").isNotNull())
    return joined.select(*[F.coalesce(f"{c}_fresh", c).alias(c) if c in fields else F.col(c) for c in resolutions.columns], "from_full_text")


def technical_upgrade(technical: DataFrame, texts: DataFrame) -> DataFrame:
    """technical (paper_id, arxiv_id, status, kind, value, checked) after one look at the texts (paper_id, text) of papers that need it.

    Only missing papers with an arXiv id that were not checked before are looked at; they are
    checked afterwards, and replaced only where something is found.
    """
    due = technical.filter("status = 'missing' and arxiv_id is not null and not checked").select("paper_id")
    read = texts.join(due, "paper_id", "left_semi").select("paper_id", F.lit("full_text").alias("section"), data_section(F.col("text")).alias("text"))
    fresh = evidence.resolve_datasets(evidence.dataset_counts(read), due).filter("status <> 'missing'")
    renamed = fresh.select("paper_id", *[F.col(c).alias(f"{c}_fresh") for c in ("status", "kind", "value")])
    joined = technical.join(renamed, "paper_id", "left").join(due.withColumn("looked", F.lit(True)), "paper_id", "left")
    fields = [F.coalesce(f"{c}_fresh", c).alias(c) for c in ("status", "kind", "value")]
    return joined.select("paper_id", "arxiv_id", *fields, (F.col("checked") | F.coalesce("looked", F.lit(False))).alias("checked"))
