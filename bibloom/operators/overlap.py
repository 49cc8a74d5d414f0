"""Verbatim overlap of texts by word n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.functions.storage import written

WIDTH = 8


def normalised_words(text: Column) -> Column:
    """Lower-case ASCII words, without code blocks, tables, inline code and addresses."""
    t = text
    for pattern in (r"(?s)```.*?```", r"(?m)^\s*\|.*$", r"`[^`]*`", r"https?://\S+", r"[^A-Za-z0-9 ]"):
        t = F.regexp_replace(t, pattern, " ")
    return F.filter(F.split(F.lower(t), " +"), lambda w: w != "")


def grams(df: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """(key, pos, gram): each n-gram with its place; texts shorter than ``width`` have none."""
    words = df.select(key, normalised_words(F.col(text)).alias("words"))
    # sliding windows over the array; a filter on its size would work the words out a second time
    starts = F.when(F.size("words") >= width, F.sequence(F.lit(0), F.size("words") - width))
    return words.select(key, F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, width), " "))).alias("pos", "gram"))


def gram_counts(df: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """(key, grams) of the texts that have any, from their numbers of words."""
    counts = df.select(key, (F.size(normalised_words(F.col(text))) - (width - 1)).cast("long").alias("grams"))
    return counts.filter("grams > 0")


def shared_grams(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """The targets' grams that occur in any source.

    Sources are deduplicated into two tables first, of 64-bit hashes and of texts. The hashes, 8 bytes a gram, sift
    the targets' grams, in the scan itself while that table's size allows a broadcast; what passes is confirmed
    by its text, so a collision adds nothing. A common gram joins once.
    """
    texts = written(sources.select("gram").distinct())
    hashes = written(texts.select(F.xxhash64("gram").alias("hash")).distinct())
    sifted = targets.withColumn("hash", F.xxhash64("gram")).join(hashes, "hash", "left_semi").drop("hash")
    return sifted.join(texts, "gram", "left_semi")


def overlap(targets: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """(key, grams, shared, percent, band) of every target."""
    return _shares(targets.groupBy(key).agg(F.count(F.lit(1)).alias("grams")), targets, sources, key)


def text_overlap(targets: DataFrame, sources: DataFrame, key: str, source_key: str, text: str = "text", width: int = WIDTH) -> DataFrame:
    """``overlap`` of texts: totals come from numbers of words, so grams that no source has never leave the scan."""
    return _shares(gram_counts(targets, key, text, width), grams(targets, key, text, width), grams(sources, source_key, text, width), key)


def _shares(total: DataFrame, targets: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    hit = shared_grams(targets, sources).groupBy(key).agg(F.count(F.lit(1)).alias("shared"))
    share = 100.0 * F.coalesce("shared", F.lit(0)) / F.col("grams")
    joined = total.join(hit, key, "left")
    band = F.when(share < 1, "low").when(share < 5, "medium").otherwise("high")
    return joined.select(key, "grams", F.coalesce("shared", F.lit(0)).alias("shared"), F.round(share, 6).alias("percent"), band.alias("band"))


def passages(targets: DataFrame, sources: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """(key, first_word, n_words): maximal runs of shared grams; a run begins after the last word of the one before."""
    hit = shared_grams(targets, sources)
    place = Window.partitionBy(key).orderBy("pos")
    islands = hit.withColumn("island", F.col("pos") - F.row_number().over(place)).groupBy(key, "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    runs = islands.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))
    none = F.array().cast("array<struct<first:int,last:int>>")

    def step(acc: Column, run: Column) -> Column:
        # a run that begins inside the words of the last one starts after them, if it reaches that far
        free = F.when(F.size(acc) > 0, F.element_at(acc, -1)["last"] + width).otherwise(F.lit(0))
        start = F.greatest(run["first"], free)
        return F.when(start <= run["last"], F.array_append(acc, F.struct(start.alias("first"), run["last"].alias("last")))).otherwise(acc)

    kept = runs.select(key, F.explode(F.aggregate("runs", none, step)).alias("run"))
    return kept.select(key, F.col("run.first").alias("first_word"), (F.col("run.last") - F.col("run.first") + width).alias("n_words"))
