"""Readers and annotators against an answer key, evidence packs for a writer, and what a request log reveals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.operators.evaluate import mcnemar

DECISIVE = ("enrolled", "randomised", "analysed")
# Headers whose values are secrets, and endings of static files
SECRET_HEADERS = ("authorization", "cookie", "set-cookie", "proxy-authorization", "x-api-key", "x-auth-token", "x-csrf-token", "x-xsrf-token", "x-session", "x-amz-security-token", "x-goog-api-key")
STATIC = r"(?i)\.(js|css|png|jpg|jpeg|svg|woff|woff2|ico|map|webp|gif|mp4|json)$"
STATIC_FOLDERS = r"/_next/|/assets/"


def _outcome(gold: Column, said: Column) -> Column:
    return F.when(gold.isNull(), "not_stated").when(said.isNull(), "missed").when(said == gold, "right").otherwise("wrong")


def reader_outcomes(gold: DataFrame, vision: DataFrame, text: DataFrame) -> DataFrame:
    """Each scored (paper_id, stage) of gold (with value, null: not stated) with both readers' first values and outcomes.

    vision and text: paper_id, stage, seq, value; ties of seq go to the smaller value. ``text_present``: the right value is among the text's values of any stage.
    """
    first = lambda found, name: found.groupBy("paper_id", "stage").agg(F.min_by("value", F.struct("seq", "value")).alias(name))
    any_stage = text.select("paper_id", "value").distinct().withColumn("present", F.lit(True))
    joined = gold.join(first(vision, "vision"), ["paper_id", "stage"], "left").join(first(text, "text"), ["paper_id", "stage"], "left").join(any_stage, ["paper_id", "value"], "left")
    return joined.select(
        "paper_id", "stage", F.col("value").alias("gold"), "vision", "text", _outcome(F.col("value"), F.col("vision")).alias("vision_outcome"),
        _outcome(F.col("value"), F.col("text")).alias("text_outcome"), F.coalesce("present", F.lit(False)).alias("text_present"),
    )


def reader_tally(outcomes: DataFrame) -> DataFrame:
    """(stage, n, vision_right, text_right, text_present, only_vision, only_text, unscored, p) a stage, and pooled over the decisive ones as 'decisive'."""
    pooled = outcomes.filter(F.col("stage").isin(*DECISIVE)).withColumn("stage", F.lit("decisive"))
    v, t, stated = F.col("vision_outcome") == "right", F.col("text_outcome") == "right", F.col("gold").isNotNull()
    counts = outcomes.unionByName(pooled).groupBy("stage").agg(
        F.count_if(stated).alias("n"), F.count_if(v).alias("vision_right"), F.count_if(t).alias("text_right"), F.count_if(stated & F.col("text_present")).alias("text_present"),
        F.count_if(v & ~t).alias("only_vision"), F.count_if(t & ~v).alias("only_text"), F.count_if(~stated & F.col("vision").isNotNull()).alias("unscored"),
    )
    return counts.withColumn("p", mcnemar(F.col("only_vision"), F.col("only_text")))


def reader_rule(tally: DataFrame, other_figures: DataFrame, gap: float = 15.0, most_p: float = 0.05) -> DataFrame:
    """One row: points by which vision leads, p, other figures and the silent ones among them, and whether the rule passes.

    other_figures (paper_id, reported): figures of another kind; the reader must be silent on over half of them, if there are any.
    """
    lead = tally.filter("stage = 'decisive'").select((100 * F.try_divide(F.col("vision_right") - F.col("text_right"), "n")).alias("gap"), "p")
    silent = other_figures.agg(F.count(F.lit(1)).alias("others"), F.count_if(~F.col("reported")).alias("silent"))
    calm = (F.col("others") == 0) | (F.col("silent") > F.col("others") / 2)
    one = lead.agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("gap"), F.coalesce(F.max("p"), F.lit(1.0)).alias("p"))
    key = lambda df: df.withColumn("one", F.lit(1))
    return key(one).join(key(silent), "one").select("gap", "p", "others", "silent", ((F.col("gap") >= gap) & (F.col("p") < most_p) & calm).alias("passes"))


def compared(key: DataFrame, second: DataFrame) -> DataFrame:
    """(figure, stage, provider, key, second, agrees) of an answer key and second readings (figure, stage, value; the latter with provider). Two nulls agree."""
    joined = second.select("figure", "stage", "provider", F.col("value").alias("second")).join(key.select("figure", "stage", F.col("value").alias("key")), ["figure", "stage"])
    return joined.withColumn("agrees", F.col("key").eqNullSafe(F.col("second")))


def agreement(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """A row a provider: figures, values, agreed, disagreements by decision (figure, stage, decision), and undecided ones, which should be none."""
    joined = pairs.join(decisions, ["figure", "stage"], "left")
    off, is_ = ~F.col("agrees"), lambda d: F.col("decision") == d
    return joined.groupBy("provider").agg(
        F.count_distinct("figure").alias("figures"), F.count(F.lit(1)).alias("n_values"), F.count_if("agrees").alias("agreed"), F.count_if(off).alias("disagreements"),
        F.count_if(off & is_("second_annotator_error")).alias("second_annotator_errors"), F.count_if(off & is_("ambiguous")).alias("ambiguous"),
        F.count_if(off & is_("key_error")).alias("key_errors"), F.count_if(off & F.col("decision").isNull()).alias("undecided"),
    )


def evidence_pack(papers: DataFrame, edges: DataFrame, max_papers: int = 40, max_edges: int = 500) -> DataFrame:
    """(seed_id, pack): one text a seed of its best papers and first edges.

    papers: seed_id, rank, title, year, journal, authors (array), doi, abstract; edges: seed_id, seq, source, target.
    A seed without papers has no pack. Both lists are cut by rank before they are gathered, so a row is bounded.
    """
    shown = F.array_join(F.slice("authors", 1, 3), ", ")
    people = F.when(F.size("authors") > 3, F.concat(shown, F.lit(" et al."))).when(F.size("authors") > 0, shown)
    line = F.concat_ws(
        " ", F.concat(F.col("rank"), F.lit(". "), F.coalesce("title", F.lit("Untitled"))), F.concat(F.lit("("), F.col("year"), F.lit(")")), F.concat(F.lit("- "), F.nullif("journal", F.lit(""))),
        F.concat(F.lit("- "), people), F.concat(F.lit("DOI: "), F.nullif("doi", F.lit(""))), F.concat(F.lit("- Abstract: "), F.nullif(F.left("abstract", F.lit(600)), F.lit(""))),
    )
    listed = papers.filter(F.col("rank") <= max_papers).groupBy("seed_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("papers"))
    order = Window.partitionBy("seed_id").orderBy("seq", "source", "target")
    placed = edges.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_edges)
    first = placed.groupBy("seed_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat("source", F.lit(" -> "), "target").alias("line")))).alias("edges"))
    total = edges.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n"))
    joined = listed.join(first, "seed_id", "left").join(total, "seed_id", "left")
    more = F.when(F.col("n") > max_edges, F.concat(F.lit("... and "), F.col("n") - max_edges, F.lit(" more links")))
    links = F.when(F.col("n") > 0, F.concat_ws("\n", F.concat(F.lit("Links ("), F.col("n"), F.lit("):")), F.array_join(F.col("edges.line"), "\n"), more))
    return joined.select("seed_id", F.concat_ws("\n", F.lit("Papers:"), F.array_join(F.col("papers.line"), "\n"), links).alias("pack"))


def log_hosts(requests: DataFrame) -> DataFrame:
    """(host, requests) of a request log."""
    return requests.groupBy("host").agg(F.count(F.lit(1)).alias("requests"))


def log_paths(requests: DataFrame) -> DataFrame:
    """The first request of each path (log_id, seq, method, url, status, mime, size): the query cut off, static files left out."""
    path = F.substring_index("url", "?", 1)
    kept = requests.withColumn("path", path).filter(~F.col("path").rlike(STATIC) & ~F.col("path").rlike(STATIC_FOLDERS))
    first = kept.groupBy("log_id", "path").agg(F.min_by(F.struct("method", "status", F.substring_index("mime", ";", 1).alias("mime"), "size"), "seq").alias("r"))
    return first.select("log_id", "path", "r.*")


def log_secrets(requests: DataFrame) -> DataFrame:
    """(header, requests): how often each secret header stands in ``headers`` (array of name and value); values are not read."""
    names = requests.select(F.explode("headers.name").alias("header")).filter(F.lower("header").isin(*SECRET_HEADERS))
    return names.groupBy("header").agg(F.count(F.lit(1)).alias("requests"))


def body_shape(body: Column) -> Column:
    """Names and types of a JSON body, never a value; null for what is no JSON."""
    return F.schema_of_variant(F.try_parse_json(body))
