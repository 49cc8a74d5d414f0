"""Identifiers in page addresses and in the head of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bibloom.functions import ids

# A DOI inside a longer text; names of meta elements and of address parameters
DOI_INSIDE = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"
DOI_NAMES = ("citation_doi", "dc.identifier", "dc.identifier.doi", "doi", "prism.doi")
TITLE_NAMES = ("citation_title", "dc.title", "og:title", "twitter:title")
PMID_PARAMETERS = ("pmid", "id", "ext_id")
HEAD = 500_000  # characters of a page in which its head is sought
LEAST_TITLE = 5


def doi_in(text: Column) -> Column:
    """The first DOI in a text, without final dots and view segments; empty where there is none."""
    found = F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), DOI_INSIDE, 0), r"\.+$", "")
    return F.when(found == "", "").otherwise(ids.strip_view(ids.canonical(found)))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v != ""), 0)


def _found(kind: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.struct(F.lit(kind).alias("query_type"), value.alias("value")))


def from_address(url: Column) -> Column:
    """(query_type, value) of the identifier that an address names; null where it names none.

    A DOI anywhere comes before a PMCID anywhere, both sought in path, query, fragment, then
    the parameters' values; then a PMID after /pubmed/, in a parameter, or at the end of a
    path of the PubMed host.
    """
    part = lambda name: F.coalesce(F.try_parse_url(url, F.lit(name)), F.lit(""))
    path, query = part("PATH"), part("QUERY")
    pairs = F.filter(F.split(query, "&"), lambda p: F.contains(p, F.lit("=")))
    decoded = lambda text: F.coalesce(F.try_url_decode(text), text)
    value = lambda p: decoded(F.regexp_replace(p, "^[^=]*=", ""))
    targets = F.concat(F.array(path, query, part("REF")), F.transform(pairs, value))
    pmc = F.upper(_first(F.transform(targets, lambda t: F.regexp_extract(t, r"(?i)PMC\d+", 0))))
    own = F.filter(pairs, lambda p: F.lower(decoded(F.substring_index(p, "=", 1))).isin(*PMID_PARAMETERS) & value(p).rlike(r"^\d{1,9}$"))
    return F.coalesce(
        _found("doi", _first(F.transform(targets, doi_in))),
        _found("pmcid", pmc),
        _found("pmid", F.when(F.contains(path, F.lit("/pubmed/")), F.regexp_extract(path, r"(?i)/pubmed/(\d+)", 1))),
        _found("pmid", F.get(F.transform(own, value), 0)),
        _found("pmid", F.when(F.contains(part("HOST"), F.lit("pubmed.ncbi.nlm.nih.gov")), F.regexp_extract(path, r"/(\d+)/?$", 1))),
    )


def _attribute(element: Column, name: str) -> Column:
    """An attribute's value, in either quotes or in none; character references stay as they are."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(element, pattern, k) for k in (1, 2, 3)])


def from_head(html: Column) -> Column:
    """(query_type, value): a page's DOI by its meta elements, else its title of LEAST_TITLE characters or more; null without."""
    elements = F.regexp_extract_all(F.left(html, F.lit(HEAD)), F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    name = lambda e: F.lower(F.coalesce(F.nullif(_attribute(e, "name"), F.lit("")), _attribute(e, "property")))
    of = lambda names: F.transform(F.filter(elements, lambda e: name(e).isin(*names)), lambda e: _attribute(e, "content"))
    titles = F.transform(of(TITLE_NAMES), lambda t: ids.stripped(F.regexp_replace(t, f"{ids.SPACE}+", " ")))
    title = F.get(F.filter(titles, lambda t: F.length(t) >= LEAST_TITLE), 0)
    return F.coalesce(_found("doi", _first(F.transform(of(DOI_NAMES), doi_in))), _found("title", title))
