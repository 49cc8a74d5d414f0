"""Exact deduplication by skew-safe combining.

Copies are combined three times, each time by their full content beside the digest:
inside each input partition (the map side of the first aggregation), then among the
partitions that share a salt, then over all salts. A text that fills a third of the
table leaves each task as one row, so no stage gathers its copies.

Defined cases. A null text counts as empty, and empty texts are copies of each other. A
null id is the smallest id. Rows that repeat id and text carry the same decision;
``deduplicate`` keeps one of them. An empty table gives an empty result. Other columns of
the input may have any name: only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import column, sha256, text_of, written

SALTS = 16


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256) -> DataFrame:
    """One row per distinct text: digest, content, keep_id (largest id), group_size."""
    text = text_of(text_col)
    tagged = docs.select(
        digest(text).alias("digest"), text.alias("content"), column(id_col).alias("id"), (F.spark_partition_id() % salts).alias("salt")
    )
    salted = tagged.groupBy("digest", "salt", "content").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return (
        salted.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    )


def _decisions(docs: DataFrame, id_col: str, text_col: str, salts: int, digest) -> DataFrame:
    """winners without the content where a digest has one text only; with it where texts share a digest."""
    found = winners(docs, id_col, text_col, salts, digest)
    spread = found.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"),
        F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size"),
    )
    return spread if digest is sha256 else _with_content(found, spread)


def _with_content(found: DataFrame, spread: DataFrame) -> DataFrame:
    shared = spread.filter("texts > 1").select("digest")
    return spread.filter("texts = 1").withColumn("content", F.lit(None).cast("string")).unionByName(
        found.join(shared, "digest", "left_semi").withColumn("texts", F.lit(2).cast("long"))
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256
) -> DataFrame:
    """For every row: its id, digest, keep_id, group_size and kept.

    ``digest`` maps a text column to a key. A key that two different texts share is told
    apart by the texts themselves, so a weak digest costs time, never a wrong group.
    """
    # a table, so that the join below can split a hot digest
    decided = written(_decisions(docs, id_col, text_col, salts, digest))
    rows = docs.select(column(id_col).alias("id"), digest(text_of(text_col)).alias("digest"), text_of(text_col).alias("content"))
    shared = decided.filter("texts > 1")
    if shared.isEmpty():
        joined = rows.drop("content").join(decided.select("digest", "keep_id", "group_size"), "digest")
    else:
        if "content" not in decided.columns:
            raise ValueError("two texts share a SHA-256 digest; give another digest")
        clash = shared.select("digest").distinct()
        plain = rows.join(clash, "digest", "left_anti").drop("content").join(
            decided.filter("texts = 1").select("digest", "keep_id", "group_size"), "digest"
        )
        told = rows.join(shared.select("digest", "content", "keep_id", "group_size"), ["digest", "content"]).drop("content")
        joined = plain.unionByName(told)
    return joined.select(
        F.col("id").alias(id_col), "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with their own columns: of equal texts the row with the largest id.

    The winner's other columns travel with its text, so the texts are dealt out twice (by
    salted digest, by digest) and never joined back.
    """
    text = text_of(text_col)
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(column(text_col).isNull().alias("none"), F.struct(*[column(c) for c in others]).alias("rest") if others else F.lit(1).alias("rest"))
    rank = F.struct(column(id_col).isNotNull().alias("some"), column(id_col).alias("id"))
    tagged = docs.select(sha256(text).alias("digest"), text.alias("content"), rank.alias("rank"), row.alias("row"), (F.spark_partition_id() % salts).alias("salt"))
    best = [F.max_by("row", "rank").alias("row"), F.max("rank").alias("rank")]
    salted = tagged.groupBy("digest", "salt", "content").agg(*best)
    found = salted.repartition("digest").groupBy("digest", "content").agg(*best)
    whole = F.when(~F.col("row.none"), F.col("content"))
    return found.select(*[whole.alias(c) if c == text_col else F.col("row.rest").getField(c).alias(c) for c in docs.columns])


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def query(spark, sf_dir: str) -> DataFrame:
    from bibloom.llm.common import documents

    return exact_groups(documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")
