"""Views, lookups and summaries over the tables of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.functions import ids
from bibloom.operators.evaluate import title_similarity, title_words

HIGH = 0.75
IDENTIFIERS = ("paper_id", "doi", "pmid", "pmcid", "openalex_id")


# --- aliases


def alias_table(papers: DataFrame) -> DataFrame:
    """(alias, paper_id): every identifier of papers (IDENTIFIERS, seq) in its canonical form, with the first paper that has it."""
    every = papers.select(F.col("paper_id").alias("owner"), "seq", F.explode(F.array(*[ids.canonical(F.col(c)) for c in IDENTIFIERS])).alias("alias"))
    return every.filter("alias <> ''").groupBy("alias").agg(F.min_by("owner", F.struct("seq", "owner")).alias("paper_id"))


def resolved(wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds paper_id to wanted (raw); null where no paper has the identifier."""
    return wanted.withColumn("alias", ids.canonical(F.col("raw"))).join(aliases, "alias", "left")


def unresolved(wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """The distinct canonical identifiers of wanted (raw) that no paper has."""
    return wanted.select(ids.canonical(F.col("raw")).alias("alias")).filter("alias <> ''").distinct().join(aliases, "alias", "left_anti")


def verified_references(cited: DataFrame, crossref: DataFrame, openalex: DataFrame) -> DataFrame:
    """Distinct DOIs of cited (doi, seq), first come first, with the title and source that a catalogue gives; verified tells whether one does."""
    first = cited.withColumn("doi", F.lower("doi")).groupBy("doi").agg(F.min("seq").alias("seq"))
    side = lambda t, name: t.groupBy(F.lower("doi").alias("doi")).agg(F.min("title").alias(name))
    joined = first.join(side(crossref, "c"), "doi", "left").join(side(openalex, "o"), "doi", "left")
    source = F.when(F.col("c").isNotNull(), "crossref").when(F.col("o").isNotNull(), "openalex")
    return joined.select("doi", "seq", F.coalesce("c", "o").alias("title"), source.alias("source"), source.isNotNull().alias("verified"))


def edges_of(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """(paper_id, n_out, n_in) of the papers given: their edges at either end."""
    out = edges.join(papers.select(F.col("paper_id").alias("source_paper_id")), "source_paper_id", "left_semi").groupBy(F.col("source_paper_id").alias("paper_id")).agg(F.count(F.lit(1)).alias("n_out"))
    into = edges.join(papers.select(F.col("paper_id").alias("target_paper_id")), "target_paper_id", "left_semi").groupBy(F.col("target_paper_id").alias("paper_id")).agg(F.count(F.lit(1)).alias("n_in"))
    return papers.select("paper_id").join(out, "paper_id", "left").join(into, "paper_id", "left").na.fill(0, ["n_out", "n_in"])


def _size_step(n: Column) -> Column:
    """How many sizes count as one class at n: 1 below 32, then a sixteenth of the power of two at or below."""
    return F.pow(F.lit(2), F.greatest(F.length(F.bin(n)) - 5, F.lit(0))).cast("long")


def _size_class(n: Column) -> Column:
    """The least size of n's class."""
    return n - n % _size_step(n)


def best_titles(wanted: DataFrame, held: DataFrame, percent: int = 60, block: Sequence[str] = ()) -> DataFrame:
    """(id, candidate, score) of wanted (id, title): the candidate of held (candidate, title, cited) with the most similar title.

    Similarity is the Jaccard share of words, at least ``percent``; of equal ones (to three
    digits) the most cited candidate counts, then the first. Equal titles are compared once.
    Titles of m and n words so similar share at least s = share / (1 + share) * (m + n) of them, so
    also one of the m - s + 1 and n - s + 1 first in any common order, here the rarest first. They
    meet by such a word and the classes of both sizes, so no match is lost and common words meet little;
    titles without words meet nothing. With ``block``, columns of both, titles meet only where these are equal.
    """
    block = list(block)
    whole = F.coalesce("title", F.lit("")).alias("title")
    best = held.select(*block, "candidate", "cited", whole).groupBy(*block, "title").agg(F.max_by("candidate", F.struct("cited", -F.col("candidate"))).alias("candidate"), F.max("cited").alias("cited"))
    texts = wanted.select(*block, whole).distinct()
    split = lambda titles: titles.select(*block, "title", F.explode(title_words(F.col("title"))).alias("word"))
    count = split(best).groupBy(*block, "word").agg(F.count(F.lit(1)).alias("n"))

    def keys(titles: DataFrame, name: str, own: str, other: str) -> DataFrame:
        words = split(titles).join(count, [*block, "word"], "left").na.fill(0, ["n"])
        order = words.groupBy(*block, F.col("title").alias(name)).agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))
        n = F.size("w").cast("long")
        least, most = F.ceil(n * percent / 100), F.floor(n * 100 / percent)
        classes = F.array_distinct(F.transform(F.sequence(_size_class(least), most, _size_step(least)), _size_class))
        sized = order.select(*block, name, "w", _size_class(n).alias(own), F.explode(classes).alias(other))
        shared = F.ceil((n + F.greatest(least, F.col(other))) * percent / (100 + percent))
        return sized.select(*block, name, own, other, F.explode(F.slice("w", F.lit(1), (n - shared + 1).cast("int"))).alias("k")).select(*block, name, own, other, "k.word")

    met = keys(texts, "a", "size_a", "size_b").join(keys(best, "b", "size_b", "size_a"), [*block, "word", "size_a", "size_b"]).select(*block, "a", "b").distinct()
    alike = met.withColumn("s", title_similarity(F.col("a"), F.col("b"))).filter(100 * F.col("s") >= percent)
    told = alike.join(best.withColumnRenamed("title", "b"), [*block, "b"])
    first = told.groupBy(*block, "a").agg(F.max_by(F.struct("candidate", "s"), F.struct(F.round("s", 3), "cited", -F.col("candidate"))).alias("m"))
    return wanted.select(*block, "id", whole.alias("a")).join(first, [*block, "a"]).select("id", "m.candidate", F.round("m.s", 9).alias("score"))


# --- table views


def metadata_rows(papers: DataFrame, wanted: str, seeds: DataFrame, ranked: DataFrame) -> DataFrame:
    """Papers (paper_id, title, authors, journal, doi) with ``wanted`` in a title, author, journal or doi, and their role."""
    w = F.lit(wanted.strip().lower())
    has = lambda c: F.coalesce(F.contains(F.lower(c), w), F.lit(False))
    hit = has(F.col("title")) | has(F.col("journal")) | has(F.col("doi")) | F.coalesce(F.exists("authors", has), F.lit(False))
    mark = lambda t, name: t.select("paper_id").distinct().withColumn(name, F.lit(True))
    joined = papers.filter(hit).join(mark(seeds, "is_seed"), "paper_id", "left").join(mark(ranked, "is_ranked"), "paper_id", "left")
    return joined.withColumn("role", F.when(F.col("is_seed"), "seed").when(F.col("is_ranked"), "foundational").otherwise("cited")).drop("is_seed", "is_ranked")


def ranking_view(ranked: DataFrame, evidence: DataFrame, least: float, sure: bool, told: bool) -> DataFrame:
    """Ranked rows with at least a score; ``sure`` asks for confident evidence (paper_id, value, confidence), ``told`` for a value."""
    joined = ranked.join(evidence.select("paper_id", "value", "confidence"), "paper_id", "left").filter(F.col("score") >= least)
    joined = joined.filter(F.coalesce("confidence", F.lit(0.0)) >= HIGH) if sure else joined
    return joined.filter("value is not null") if told else joined


def path_view(paths: DataFrame, sized: DataFrame, least: float, longest: int, sure: bool, any_sized: bool) -> DataFrame:
    """Paths (path_id, paper_ids, score, path_length, average_confidence) that pass; ``any_sized``: a paper on it is among sized (paper_id)."""
    kept = paths.filter((F.col("score") >= least) & (F.col("path_length") <= longest))
    kept = kept.filter(F.col("average_confidence") >= HIGH) if sure else kept
    if not any_sized:
        return kept
    held = kept.select("path_id", F.explode("paper_ids").alias("paper_id")).join(sized.select("paper_id"), "paper_id", "left_semi").select("path_id").distinct()
    return kept.join(held, "path_id", "left_semi")


def filled_paths(paths: DataFrame) -> DataFrame:
    """Paths (seed_id, seq, paper_ids, path, rank, path_length, score) of older runs with their defaults: ids, rank, length, score."""
    nodes = F.coalesce("paper_ids", "path", F.array().cast("array<string>"))
    place = F.row_number().over(Window.partitionBy("seed_id").orderBy("seq"))
    return paths.withColumns({"paper_ids": nodes, "place": place}).select(
        "seed_id", "seq", "paper_ids", F.when(F.col("rank") > 0, F.col("rank")).otherwise(F.col("place")).alias("rank"),
        F.coalesce("path_length", F.greatest(F.size("paper_ids") - 1, F.lit(0))).alias("path_length"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def link_class(status: Column) -> Column:
    """live, walled (the host turns programs away) or broken, by an HTTP status."""
    return F.when(status.between(200, 299), "live").when(status.isin(401, 403, 429), "walled").otherwise("broken")


def doi_is_dead(status: Column) -> Column:
    """Only an answer of 404 tells that a DOI is dead."""
    return F.coalesce(status == 404, F.lit(False))


# --- summaries


def traversal_summary(runs: DataFrame) -> DataFrame:
    """One row over runs (seed_id, papers, edges, backward, forward, seconds)."""
    return runs.agg(
        F.count(F.lit(1)).alias("seeds"), F.sum("papers").alias("papers"), F.sum("edges").alias("edges"), F.round(F.avg("papers"), 2).alias("mean_papers"),
        F.round(F.avg("edges"), 2).alias("mean_edges"), F.sum("backward").alias("backward"), F.sum("forward").alias("forward"), F.count_if(F.col("edges") == 0).alias("without_edges"),
    )


def run_warnings(runs: DataFrame) -> DataFrame:
    """(run, warnings) of runs with counts papers, edges, missing, ambiguous, no_abstract: messages in a fixed order."""
    say = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    parts = [F.when(F.col("edges") == 0, "no citation links"), say("missing", " papers without a study size"), say("ambiguous", " papers with rival sizes"), say("no_abstract", " papers without a text")]
    return runs.select("run", F.array_compact(F.array(*parts)).alias("warnings"))


def walk_warnings(runs: DataFrame) -> DataFrame:
    """(run, seq, warning): what each run had to work around, in a fixed order.

    runs: run, warnings (what the walk and the seed's lookup said), dead_doi (the seed's, where its page is gone),
    lost_lookups, abstracts_recovered, full_text_recovered, dataset_papers, without_abstract, papers, duplicates_merged.
    """
    n = lambda c: F.col(c).cast("string")
    say = lambda c, *parts: F.when(F.col(c) > 0, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    later = F.array_compact(F.array(
        F.when(F.col("dead_doi").isNotNull(), F.concat(F.lit("The page of the seed's DOI "), "dead_doi", F.lit(" is gone; its metadata stand."))),
        say("lost_lookups", n("lost_lookups"), " lookups stayed without an answer; abstracts or full texts may be missing."),
        say("abstracts_recovered", n("abstracts_recovered"), " abstracts came from another provider."),
        say("full_text_recovered", n("full_text_recovered"), " papers got their study size from the full text."),
        say("dataset_papers", F.lit("Dataset counts come from abstracts and weigh no ranking.")),
        say("without_abstract", n("without_abstract"), " of ", n("papers"), " papers have no abstract."),
        say("duplicates_merged", n("duplicates_merged"), " duplicate records were merged before the paper limit."),
    ))
    return runs.select("run", F.posexplode(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), later)).alias("seq", "warning"))


def completeness(papers: DataFrame) -> DataFrame:
    """One row: shares of resolved papers (wanted_doi, doi, title, year, authors, journal) with each field; a placeholder title is none."""
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return papers.agg(
        F.count(F.lit(1)).alias("resolved"), rate(F.lower("doi") == F.lower("wanted_doi")).alias("doi_match"), rate(F.col("title").isNotNull() & ~F.col("title").isin("", "Unknown Title")).alias("title"),
        rate(F.col("year").isNotNull()).alias("year"), rate(F.size("authors") > 0).alias("authors"), rate(F.coalesce("journal", F.lit("")) != "").alias("journal"),
    )


def variant_summary(ranked: DataFrame, base: str, n: int = 10) -> DataFrame:
    """(seed_id, variant, shared, identical): how the first n of each variant meet those of the base variant."""
    first = ranked.filter(F.col("rank") <= n).groupBy("seed_id", "variant").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "paper_id"))), lambda x: x["paper_id"]).alias("ids"))
    own = first.filter(F.col("variant") == base).select("seed_id", F.col("ids").alias("base_ids"))
    return first.filter(F.col("variant") != base).join(own, "seed_id").select("seed_id", "variant", F.size(F.array_intersect("ids", "base_ids")).alias("shared"), (F.col("ids") == F.col("base_ids")).alias("identical"))


def weight_summary(edges: DataFrame) -> DataFrame:
    """One row: least, median and greatest final weight, and how many different ones to four digits."""
    return edges.agg(
        F.round(F.min("final_weight"), 9).alias("least"), F.round(F.percentile("final_weight", 0.5), 9).alias("median"), F.round(F.max("final_weight"), 9).alias("most"),
        F.count_distinct(F.round("final_weight", 4)).alias("different"),
    )


def split_summary(figures: DataFrame) -> DataFrame:
    """(split, licence, n) of figures (pmcid, licence): every fourth number is held out."""
    number = F.regexp_extract("pmcid", r"(\d+)$", 1).cast("long")
    split = F.when(number % 4 == 0, "held_out").otherwise("development")
    return figures.groupBy(split.alias("split"), "licence").agg(F.count(F.lit(1)).alias("n"))


def changed_sets(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, lost, gained) where two extractions differ as multisets of ``columns``."""
    names = [key, *columns]
    count = lambda a, b, name: a.select(*names).exceptAll(b.select(*names)).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return count(before, after, "lost").join(count(after, before, "gained"), key, "full").na.fill(0, ["lost", "gained"])


def plain_prose(text: Column) -> Column:
    """A text without code fences, inline code and link targets; null counts as empty."""
    plain = F.coalesce(text, F.lit(""))
    for p, to in ((r"(?s)```.*?```", " "), ("`[^`]*`", " "), (r"\]\([^)]*\)", "]")):
        plain = F.regexp_replace(plain, p, to)
    return plain


def pattern_census(texts: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """(pattern, tag, hits, texts) of texts (text): matches outside code fences, inline code and link targets."""
    counted = texts.select(plain_prose(F.col("text")).alias("plain")).select(*[F.regexp_count("plain", F.lit(p)).alias(name) for name, (_, p) in patterns.items()])
    long = counted.select(F.explode(F.array(*[F.struct(F.lit(name).alias("pattern"), F.lit(tag).alias("tag"), F.col(name).cast("long").alias("k")) for name, (tag, _) in patterns.items()])).alias("c"))
    return long.groupBy("c.pattern", "c.tag").agg(F.sum("c.k").alias("hits"), F.count_if(F.col("c.k") > 0).alias("texts"))
