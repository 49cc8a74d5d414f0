"""Column functions for scholarly identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path segments that publishers append to a DOI in a page address
VIEW_SEGMENTS = (
    "abs", "abstract", "citation", "citations", "download", "epub", "figure", "figures", "full", "full-text",
    "fulltext", "html", "meta", "pdf", "print", "references", "summary", "supplementary", "text",
)
DOI = r"10\.\d{4,9}/\S+"
TITLE_KEY_LEAST, TITLE_KEY_MOST = 25, 80


# White space of any script, as a character class
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def stripped(text: Column) -> Column:
    """The text without white space at its ends; a null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")


def strip_view(doi: Column) -> Column:
    """Drops view segments from the end, never from a DOI's first two parts."""
    return F.regexp_replace(doi, rf"(?i)^([^/]*/[^/]*(?:/.*?)??)(?:/(?:{'|'.join(VIEW_SEGMENTS)}))+$", "$1")


def _after(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, -1)


def canonical(raw: Column) -> Column:
    """One spelling of a DOI, PMID, PMCID or OpenAlex id; anything else as it is, nulls and blanks empty."""
    t = stripped(raw)
    pubmed, pmc = "pubmed.ncbi.nlm.nih.gov/", "/pmc/articles/"
    bare = lambda c: F.regexp_replace(c, "^/+|/+$", "")
    t = F.when(F.contains(t, F.lit(pubmed)), bare(_after(t, pubmed))).when(F.contains(t, F.lit(pmc)), bare(_after(t, pmc))).otherwise(t)
    low, up = F.lower(t), F.upper(t)
    return (
        F.when(F.contains(t, F.lit("doi.org/")), F.lower(_after(t, "doi.org/")))
        .when(t.startswith("10."), low)
        .when(low.startswith("doi:"), F.substr(low, F.lit(5)))
        .when(up.startswith("PMC"), up)
        .when(low.startswith("pmid:"), stripped(F.substr(low, F.lit(6))))
        .when(t.rlike("^[0-9]{1,9}$"), t)
        .when(t.rlike("^[Ww][0-9]+$"), up)
        .when(F.contains(t, F.lit("/")) & t.rlike("^[0-9]"), low)
        .otherwise(t)
    )


def query_type(value: Column) -> Column:
    """url, pmcid, doi, pmid or title, by shape; the order matters."""
    t = stripped(value)
    low, up = F.lower(t), F.upper(t)
    doi = F.when(low.startswith("doi:") | low.startswith("doi "), stripped(F.substr(t, F.lit(5)))).otherwise(t)
    return (
        F.when(t == "", "title")
        .when(low.rlike(r"^(http://|https://|www\.)"), "url")
        .when(stripped(F.replace(up, F.lit("PMCID:"), F.lit(""))).rlike(r"^PMC\d+$"), "pmcid")
        .when(doi.rlike(rf"^{DOI}$"), "doi")
        .when(stripped(F.replace(up, F.lit("PMID:"), F.lit(""))).rlike(r"^\d{1,9}$"), "pmid")
        .when(up.rlike(r"^W\d+$"), "doi")
        .otherwise("title")
    )


def lookup_key(raw: Column) -> Column:
    """The key of a works endpoint; empty where nothing is recognised."""
    c = canonical(raw)
    return (
        F.when(c.rlike(r"^W\d+$"), c)
        .when(c.rlike(r"^PMC\d+$"), F.concat(F.lit("pmcid:"), c))
        .when(c.rlike(r"^\d+$"), F.concat(F.lit("pmid:"), c))
        .when(c.rlike(rf"^{DOI}$"), F.concat(F.lit("doi:"), c))
        .otherwise("")
    )


def title_key(title: Column) -> Column:
    """Lower-case letters and digits with single spaces, cut short; null where the title is too short to tell works apart."""
    t = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))
    return F.when(F.length(t) >= TITLE_KEY_LEAST, F.left(t, F.lit(TITLE_KEY_MOST)))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
