"""Export tables: one row for each line or record, ready for a text or CSV writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CSV = {"quoteAll": True, "lineSep": "\r\n", "header": True, "escape": '"'}
LOW_CONFIDENCE = 0.5


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals; null becomes empty."""
    return F.when(value.isNull(), "").otherwise(F.format_string(f"%.{digits}f", value))


def text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def author_line(authors: Column) -> Column:
    return F.concat(F.array_join(F.slice(authors, 1, 5), "; "), F.when(F.size(authors) > 5, "; et al.").otherwise(""))


def paper_rows(papers: DataFrame, resolutions: DataFrame, edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Papers with study size, degrees in the graph and rank, all as text."""
    cited = edges.groupBy(F.col("target_paper_id").alias("paper_id")).agg(F.count(F.lit(1)).alias("cited_by_in_graph"))
    refs = edges.groupBy(F.col("source_paper_id").alias("paper_id")).agg(F.count(F.lit(1)).alias("references_in_graph"))
    res = resolutions.select("paper_id", "n_eff", F.col("status").alias("population_status"), F.col("confidence").alias("population_confidence"))
    wide = papers
    for other in (res, cited, refs, ranks.select("paper_id", F.col("rank").alias("foundational_rank"))):
        wide = wide.join(other, "paper_id", "left")
    return wide.select(
        "paper_id", text(F.col("title")).alias("title"), author_line(F.col("authors")).alias("authors"), text(F.nullif("year", F.lit(0))).alias("year"), text(F.col("journal")).alias("journal"),
        text(F.col("n_eff")).alias("n_eff"), text(F.col("population_status")).alias("population_status"), fixed(F.col("population_confidence"), 2).alias("population_confidence"),
        text(F.coalesce("cited_by_in_graph", F.lit(0))).alias("cited_by_in_graph"), text(F.coalesce("references_in_graph", F.lit(0))).alias("references_in_graph"), text(F.col("foundational_rank")).alias("foundational_rank"),
    )


PAPER_COLUMNS = (
    "paper_id", "title", "authors", "year", "journal", "doi", "pmid", "n_eff", "population_status", "population_confidence", "research_domain", "research_field",
    "dataset_examples", "dataset_unit", "dataset_kind", "dataset_status", "dataset_confidence", "dataset_evidence", "cited_by_in_graph", "references_in_graph", "foundational_rank", "is_seed",
)


def paper_table(papers: DataFrame, resolutions: DataFrame, datasets: DataFrame, edges: DataFrame, ranks: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every column of the paper table, as text. datasets: paper_id, value, unit, kind, status, confidence, evidence; seeds: paper_id."""
    said = datasets.select(
        "paper_id", text(F.col("value")).alias("dataset_examples"), text(F.col("unit")).alias("dataset_unit"), text(F.col("kind")).alias("dataset_kind"),
        text(F.col("status")).alias("dataset_status"), fixed(F.col("confidence"), 2).alias("dataset_confidence"), text(F.col("evidence")).alias("dataset_evidence"),
    )
    own = papers.select("paper_id", *[text(F.col(c)).alias(c) for c in ("doi", "pmid", "research_domain", "research_field")])
    wide = paper_rows(papers, resolutions, edges, ranks).join(own, "paper_id").join(said, "paper_id", "left")
    wide = wide.join(seeds.select("paper_id", F.lit("yes").alias("is_seed")).distinct(), "paper_id", "left")
    fill = {c: F.coalesce(c, F.lit("no" if c == "is_seed" else "")) for c in PAPER_COLUMNS if c == "is_seed" or c.startswith("dataset_")}
    return wide.withColumns(fill).select(*PAPER_COLUMNS)


def edge_rows(edges: DataFrame, papers: DataFrame) -> DataFrame:
    title = lambda side: papers.select(F.col("paper_id").alias(f"{side}_paper_id"), F.col("title").alias(f"{side}_title"))
    wide = edges.join(title("source"), "source_paper_id", "left").join(title("target"), "target_paper_id", "left")
    return wide.select(
        "source_paper_id", text(F.col("source_title")).alias("source_title"), "target_paper_id", text(F.col("target_title")).alias("target_title"),
        *[fixed(F.col(c), 4).alias(c) for c in ("final_weight", "base_weight", "n_score", "journal_score")], fixed(F.col("confidence"), 2).alias("edge_confidence"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(**CSV).csv(path)


def xml_text(value: Column) -> Column:
    out = F.replace(value, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


NODE_KEYS = {"title": "string", "year": "int", "n_eff": "int", "status": "string"}
EDGE_KEYS = {"weight": "double", "confidence": "double"}
GRAPHML_HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'
GRAPH_HEAD, GRAPHML_END = '<graph edgedefault="directed">', "</graph>\n</graphml>"


def _data(key: str, name: str | None = None) -> Column:
    """A data element; null for a null attribute, which has no place in the format."""
    value = F.col(name or key).cast("string")
    return F.concat(F.lit(f'<data key="{key}">'), xml_text(value), F.lit("</data>"))


def graphml_nodes(vertices: DataFrame) -> DataFrame:
    """(id, line): a node element; null attributes are left out."""
    return vertices.select("paper_id", F.concat(F.lit('<node id="'), xml_text(F.col("paper_id")), F.lit('">'), F.concat_ws("", *map(_data, NODE_KEYS)), F.lit("</node>")).alias("line"))


def graphml_lines(vertices: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """(group, part, k1, k2, line): the lines of a GraphML document a group, in the order of part, k1 and k2.

    Parts: 0 head and keys, 1 nodes, 2 edges, 3 end. A line is a row, so a graph of any size needs no row of its
    own. vertices: group, paper_id, attributes of NODE_KEYS; edges: group, source, target, attributes of EDGE_KEYS.
    """
    keys = "\n".join([GRAPHML_HEAD, *[f'<key id="{k}" for="{kind}" attr.name="{k}" attr.type="{t}"/>' for kind, found in (("node", NODE_KEYS), ("edge", EDGE_KEYS)) for k, t in found.items()], GRAPH_HEAD])
    graphs = vertices.select(group).distinct()
    frame = lambda part, line: graphs.select(group, F.lit(part).alias("part"), F.lit("").alias("k1"), F.lit("").alias("k2"), F.lit(line).alias("line"))
    nodes = vertices.select(group, F.lit(1), "paper_id", F.lit(""), F.concat(F.lit('<node id="'), xml_text(F.col("paper_id")), F.lit('">'), F.concat_ws("", *map(_data, NODE_KEYS)), F.lit("</node>")))
    ends = F.concat(F.lit('<edge source="'), xml_text(F.col("source")), F.lit('" target="'), xml_text(F.col("target")), F.lit('">'))
    links = edges.select(group, F.lit(2), "source", "target", F.concat(ends, F.concat_ws("", *map(_data, EDGE_KEYS)), F.lit("</edge>")))
    return frame(0, keys).union(nodes).union(links).union(frame(3, GRAPHML_END))


def write_documents(lines: DataFrame, path: str, group: str, parts: int | None = None) -> None:
    """Each group's lines (part, k1, k2, line) as text files in a folder of its own.

    The rows are dealt out by ranges of their order, so file names in ascending order give the document, and a
    large one is written by many tasks at once.
    """
    order = [group, "part", "k1", "k2"]
    ranged = lines.repartitionByRange(parts, *order) if parts else lines.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select(group, F.col("line").alias("value")).write.partitionBy(group).text(path)


def node_link(vertices: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """One JSON document a graph: nodes and links in id order. A graph is a seed's bounded walk, so it fits a row."""
    nodes = vertices.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col("paper_id").alias("id"), F.col("title").alias("label"), "year", "n_eff"))).alias("nodes"))
    links = edges.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("source", "target", "weight"))).alias("links"))
    joined = nodes.join(links, group, "left")
    return joined.select(group, F.to_json(F.struct("nodes", F.coalesce("links", F.array().cast("array<struct<source:string,target:string,weight:double>>")).alias("links"))).alias("document"))


def archive_graph(vertices: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """One JSON document a graph for archives: directed, with the links under both names that readers know. A graph is a seed's bounded walk."""
    nodes = vertices.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col("paper_id").alias("id"), "title", "year"))).alias("nodes"))
    links = edges.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("source", "target", "confidence"))).alias("l"))
    joined = nodes.join(links, group, "left").withColumn("l", F.coalesce("l", F.array().cast("array<struct<source:string,target:string,confidence:double>>")))
    whole = F.struct(F.lit(True).alias("directed"), F.lit(False).alias("multigraph"), "nodes", F.col("l").alias("edges"), F.col("l").alias("links"))
    return joined.select(group, F.to_json(whole).alias("document"))


def run_document(runs: DataFrame, key: str) -> DataFrame:
    """(key, document): each row whole as an indented JSON document."""
    return runs.select(key, F.to_json(F.struct(*[F.col(c) for c in runs.columns]), {"pretty": "true", "ignoreNullFields": "false"}).alias("document"))


def split_author(name: Column) -> Column:
    """Family and given name as 'Family, Given'; null where there is none."""
    t = F.trim(F.regexp_replace(name, r"\s+", " "))
    last = F.substring_index(t, " ", -1)
    given = F.trim(F.substring(t, F.lit(1), F.length(t) - F.length(last)))
    parts = F.concat_ws(", ", F.trim(F.substring_index(t, ",", 1)), F.nullif(F.trim(F.substring(t, F.locate(",", t) + 1, F.length(t))), F.lit("")))
    return F.when(t.isNull() | (t == ""), None).when(F.contains(t, F.lit(",")), parts).when(given == "", last).otherwise(F.concat_ws(", ", last, given))


def ris(papers: DataFrame) -> DataFrame:
    """(paper_id, block) of papers with authors, title, journal, year, doi and link confidence."""
    tag = lambda name, value: F.concat(F.lit(f"{name}  - "), value.cast("string"))
    people = F.array_join(F.transform(F.filter(F.transform("authors", split_author), lambda a: a.isNotNull()), lambda a: tag("AU", a)), "\n")
    note = F.when(F.col("confidence") < LOW_CONFIDENCE, F.format_string("N1  - Weak link to the seed (confidence %.2f): read it before citing.", F.col("confidence")))
    block = F.concat_ws("\n", F.lit("TY  - JOUR"), F.nullif(people, F.lit("")), tag("TI", F.col("title")), tag("JO", F.col("journal")), tag("PY", F.col("year")), tag("DO", F.col("doi")), F.concat(F.lit("UR  - https://doi.org/"), F.col("doi")), note, F.lit("ER  - "))
    return papers.select("paper_id", block.alias("block"))


def bibtex(papers: DataFrame) -> DataFrame:
    """(paper_id, entry) with the DOI, or else the id, as the key."""
    field = lambda name, value: F.when(value.cast("string") != "", F.concat(F.lit(f"  {name} = {{"), value.cast("string"), F.lit("}")))
    people = F.array_join(F.filter(F.transform("authors", split_author), lambda a: a.isNotNull()), " and ")
    key = F.regexp_replace(F.coalesce(F.nullif("doi", F.lit("")), F.col("paper_id")), "[^A-Za-z0-9]", "_")
    body = F.concat_ws(",\n", field("title", F.col("title")), field("author", people), field("journal", F.col("journal")), field("year", F.col("year")), field("doi", F.col("doi")), field("url", F.concat(F.lit("https://doi.org/"), F.nullif("doi", F.lit("")))))
    return papers.select("paper_id", F.concat(F.lit("@article{"), key, F.lit(",\n"), body, F.lit("\n}")).alias("entry"))
