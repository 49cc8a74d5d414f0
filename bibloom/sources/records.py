"""Bulk bibliographic records of three providers as papers and edges.

Each mapping takes a table with the provider's own nested columns (read JSON dumps with an
explicit schema, so that a missing object is null) and returns flat papers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.functions import ids

# Words of hardware topics; identifiers in arXiv addresses
HARDWARE = r"(?i)\b(quantum|photonic|photonics|qubits?|superconducting|silicon chip|integrated circuit)\b"
ARXIV = r"(?i)(?:arxiv\.org/(?:abs|pdf)/|arxiv\.)(\d{4}\.\d{4,5})(?:v\d+)?"
UNKNOWN_TITLE = "Unknown Title"
OPENALEX = """id STRING, doi STRING, ids STRUCT<pmid:STRING,pmcid:STRING>, display_name STRING, publication_year INT,
primary_location STRUCT<source:STRUCT<display_name:STRING>>, authorships ARRAY<STRUCT<author:STRUCT<display_name:STRING>>>,
abstract_inverted_index MAP<STRING,ARRAY<INT>>, referenced_works ARRAY<STRING>,
primary_topic STRUCT<display_name:STRING,field:STRUCT<display_name:STRING>,domain:STRUCT<display_name:STRING>>,
locations ARRAY<STRUCT<landing_page_url:STRING,pdf_url:STRING>>, cited_by_count BIGINT"""
CROSSREF = """DOI STRING, title ARRAY<STRING>, author ARRAY<STRUCT<given:STRING,family:STRING>>, issued STRUCT<`date-parts`:ARRAY<ARRAY<INT>>>,
`container-title` ARRAY<STRING>, reference ARRAY<STRUCT<DOI:STRING>>, `is-referenced-by-count` BIGINT"""
EUROPE_PMC = """id STRING, doi STRING, pmid STRING, pmcid STRING, title STRING, authorList STRUCT<author:ARRAY<STRUCT<fullName:STRING>>>,
pubYear STRING, journalInfo STRUCT<journal:STRUCT<title:STRING>>, abstractText STRING"""


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def abstract_of(index: Column) -> Column:
    """The text of an inverted index: words by (position, word); null where there is none."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return filled(F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " "))


def research_domain(title: Column, topic: Column, field: Column, domain: Column) -> Column:
    hardware = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(topic, F.lit(""))).rlike(HARDWARE)
    return (
        F.when((field == "Computer Science") & hardware, "nonclinical")
        .when(field == "Computer Science", "computer_science")
        .when((domain == "Health Sciences") | (field == "Medicine"), "biomedical")
        .when(domain == "Physical Sciences", "nonclinical")
        .otherwise("unknown")
    )


def arxiv_id(doi: Column, locations: Column) -> Column:
    """The first identifier in the DOI, then in each location's page and file address."""
    places = F.flatten(F.transform(F.coalesce(locations, F.array().cast("array<struct<landing_page_url:string,pdf_url:string>>")), lambda x: F.array(x["landing_page_url"], x["pdf_url"])))
    found = F.filter(F.concat(F.array(doi), places), lambda u: F.coalesce(u.rlike(ARXIV), F.lit(False)))
    return F.when(F.size(found) > 0, F.regexp_extract(F.get(found, 0), ARXIV, 1))


def openalex_papers(works: DataFrame) -> DataFrame:
    doi, work = filled(ids.canonical(F.col("doi"))), ids.canonical(F.substring_index("id", "/", -1))
    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: n.isNotNull() & (n != ""))
    topic = F.col("primary_topic")
    return works.select(
        F.coalesce(doi, filled(ids.canonical(F.col("ids.pmid"))), work).alias("paper_id"),
        doi.alias("doi"), filled(ids.canonical(F.col("ids.pmid"))).alias("pmid"), filled(ids.canonical(F.col("ids.pmcid"))).alias("pmcid"), work.alias("openalex_id"),
        arxiv_id(doi, F.col("locations")).alias("arxiv_id"),
        F.coalesce(filled(F.col("display_name")), F.lit(UNKNOWN_TITLE)).alias("title"),
        F.coalesce(names, F.array().cast("array<string>")).alias("authors"),
        F.col("publication_year").alias("year"), F.col("primary_location.source.display_name").alias("journal"),
        abstract_of(F.col("abstract_inverted_index")).alias("abstract"),
        research_domain(F.col("display_name"), topic["display_name"], topic["field"]["display_name"], topic["domain"]["display_name"]).alias("research_domain"),
        topic["field"]["display_name"].alias("research_field"), F.lit(0.9).alias("metadata_confidence"),
    )


def crossref_papers(works: DataFrame) -> DataFrame:
    """DOIs keep their case; no abstract."""
    names = F.transform("author", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    return works.select(
        F.coalesce(filled(F.col("DOI")), F.lit("unknown")).alias("paper_id"), F.col("DOI").alias("doi"),
        F.coalesce(F.get("title", 0), F.lit(UNKNOWN_TITLE)).alias("title"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"),
        F.get(F.get(F.col("issued").getField("date-parts"), 0), 0).alias("year"), F.get(F.col("container-title"), 0).alias("journal"), F.lit(0.9).alias("metadata_confidence"),
    )


def europe_pmc_papers(hits: DataFrame) -> DataFrame:
    names = F.filter(F.transform("authorList.author", lambda a: a["fullName"]), lambda n: n.isNotNull() & (n != ""))
    return hits.select(
        ids.canonical(F.coalesce("id", "pmid", "doi")).alias("paper_id"), filled(ids.canonical(F.col("doi"))).alias("doi"),
        filled(ids.canonical(F.col("pmid"))).alias("pmid"), filled(ids.canonical(F.col("pmcid"))).alias("pmcid"), F.coalesce("title", F.lit(UNKNOWN_TITLE)).alias("title"),
        F.coalesce(names, F.array().cast("array<string>")).alias("authors"), F.col("pubYear").try_cast("int").alias("year"),
        F.col("journalInfo.journal.title").alias("journal"), F.col("abstractText").alias("abstract"), F.lit(0.85).alias("metadata_confidence"),
    )


def reference_edges(works: DataFrame, source: Column, references: Column) -> DataFrame:
    """(source_paper_id, target_paper_id, seq) of each listed reference; blanks dropped."""
    rows = works.select(source.alias("source_paper_id"), F.posexplode(references).alias("seq", "raw"))
    target = ids.canonical(F.col("raw"))
    return rows.select("source_paper_id", target.alias("target_paper_id"), "seq").filter("target_paper_id <> ''")


def openalex_references(works: DataFrame) -> DataFrame:
    last = F.transform("referenced_works", lambda u: F.element_at(F.split(u, "/"), -1))
    return reference_edges(works, ids.canonical(F.substring_index("id", "/", -1)), last)


def crossref_references(works: DataFrame) -> DataFrame:
    return reference_edges(works, F.col("DOI"), F.transform("reference", lambda r: F.coalesce(r["DOI"], F.lit(""))))


def most_cited_citing(edges: DataFrame, counts: DataFrame, limit: int = 200) -> DataFrame:
    """Citing papers of each paper, the most cited first, at most ``limit`` (a feature: the provider's own page size)."""
    order = Window.partitionBy("target_paper_id").orderBy(F.col("cited_by_count").desc(), "source_paper_id")
    ranked = edges.join(counts.withColumnRenamed("paper_id", "source_paper_id"), "source_paper_id", "left").na.fill(0, ["cited_by_count"])
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def merge_providers(records: DataFrame) -> DataFrame:
    """One paper a query from records (query_id, provider, paper fields): precedence by field.

    Title, year, authors and journal come from crossref before openalex, the abstract the
    other way round; a present value wins even if it is empty. Ids come from the first
    provider that has one, in the order crossref, openalex, europe_pmc.
    """
    fields = ("title", "year", "authors", "journal", "abstract", "doi", "pmid", "pmcid", "openalex_id", "research_domain")
    order = F.struct(*(["seq"] if "seq" in records.columns else []), *fields)
    of = lambda p: F.min_by(F.struct(*fields), F.when(F.col("provider") == p, order))
    wide = records.groupBy("query_id").agg(of("crossref").alias("c"), of("openalex").alias("o"), of("europe_pmc").alias("e"), F.count_distinct("provider").alias("n"))
    any_id = lambda f: F.coalesce(*[filled(F.col(f"{p}.{f}")) for p in "coe"])
    return wide.select(
        "query_id", F.coalesce(any_id("doi"), any_id("pmid"), any_id("openalex_id")).alias("paper_id"),
        any_id("doi").alias("doi"), any_id("pmid").alias("pmid"), any_id("pmcid").alias("pmcid"), any_id("openalex_id").alias("openalex_id"),
        F.coalesce(filled(F.coalesce("c.title", "o.title")), F.lit(UNKNOWN_TITLE)).alias("title"), F.coalesce("c.year", "o.year").alias("year"),
        F.coalesce(F.coalesce("c.authors", "o.authors"), F.array().cast("array<string>")).alias("authors"), F.coalesce("c.journal", "o.journal").alias("journal"),
        F.coalesce("o.abstract", "c.abstract").alias("abstract"), F.coalesce("o.research_domain", F.lit("unknown")).alias("research_domain"),
        F.when(F.col("n") > 1, 0.95).otherwise(0.8).alias("metadata_confidence"),
    )


def provider_conflicts(records: DataFrame) -> DataFrame:
    """Queries whose providers name different DOIs, or whose weakest title match is below 0.85."""
    held = records.groupBy("query_id").agg(F.count_distinct(filled(F.lower("doi"))).alias("dois"), F.min("match_score").alias("weakest"))
    return held.select("query_id", (F.col("dois") > 1).alias("conflict"), F.coalesce(F.col("weakest") < 0.85, F.lit(False)).alias("weak")).filter("conflict or weak")


def backfill_abstracts(papers: DataFrame, other: DataFrame) -> DataFrame:
    """Empty abstracts filled by DOI from other (doi, abstract); ``recovered`` tells where."""
    spare = other.filter("abstract is not null and abstract <> ''").groupBy("doi").agg(F.min("abstract").alias("spare"))
    joined = papers.join(spare, "doi", "left")
    own = filled(F.col("abstract"))
    return joined.withColumn("recovered", own.isNull() & F.col("spare").isNotNull()).withColumn("abstract", F.coalesce(own, F.col("spare"))).drop("spare")


def union_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target) over providers: the first edge's confidence, providers in first-seen order."""
    seen = edges.groupBy("source_paper_id", "target_paper_id", "provider").agg(F.min("seq").alias("seq"), F.min_by("confidence", "seq").alias("confidence"))
    return seen.groupBy("source_paper_id", "target_paper_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "provider"))), lambda x: x["provider"]).alias("providers"),
        F.min_by("confidence", F.struct("seq", "provider")).alias("confidence"),
    )
