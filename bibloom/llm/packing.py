"""Packing into optimal length buckets.

Documents become sequences of at most ``max_tokens`` tokens (whole documents: a longer one
gives several sequences). One global histogram of sequence lengths, at most
``max_tokens`` + 1 numbers, goes to the driver, where dynamic programming places ``buckets``
boundaries so that the padding, every sequence being filled up to its bucket's boundary, is
the least possible. Inside a bucket sequences stand in a seeded random order and fill
batches of ``budget`` padded tokens without gaps.

Defined cases. A token is a maximal run of characters other than space and U+0009-U+000D. A
null or empty text is one sequence of no tokens, which takes a place in the shortest bucket. Null, repeated or
tied ids are rows like any others: rows alike in id, piece and length are counted before they
move, and each copy gets a place of its own. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.llm.common import column, documents, text_of, written

MAX_TOKENS = 2048
BUCKETS = 8
BUDGET = 16384
LEAST_PARTS = 256
PART_ROWS = 200_000
#: Copies of a piece that one row of the written table stands for, at most
COPIES = 64


def count_tokens(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    return F.when(F.length(trimmed) == 0, 0).otherwise(
        F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")) - F.when(trimmed.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    )


def sequences(docs: DataFrame, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, seq, first_token, n_tokens): the pieces of each document, in order."""
    counted = docs.select(column(id_col).alias("id"), count_tokens(text_of(text_col)).alias("total"))
    last = F.greatest(F.ceil(F.col("total") / max_tokens) - 1, F.lit(0))
    return counted.select("id", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("seq")).select(
        "id",
        F.col("seq").cast("int").alias("seq"),
        (F.col("seq") * max_tokens).alias("first_token"),
        F.least(F.col("total") - F.col("seq") * max_tokens, F.lit(max_tokens)).cast("int").alias("n_tokens"),
    )


def counted(pieces: DataFrame) -> DataFrame:
    """Pieces alike in every column as rows of at most COPIES of them: first_copy, copies; spread by a hash of all."""
    alike = pieces.groupBy(*pieces.columns).agg(F.count(F.lit(1)).alias("n"))
    blocks = alike.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("block"))
    first = F.col("block") * COPIES
    found = blocks.select(*pieces.columns, first.alias("first_copy"), F.least(F.col("n") - first, F.lit(COPIES)).alias("copies"))
    return found.repartition("id", "seq", "n_tokens", "first_copy")


def length_histogram(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> np.ndarray:
    """counts[l]: sequences of length l; the driver holds max_tokens + 1 numbers."""
    counts = np.zeros(max_tokens + 1, dtype=np.int64)
    for row in pieces.groupBy("n_tokens").agg(F.sum("copies").alias("n")).collect():
        counts[row["n_tokens"]] = row["n"]
    return counts


def optimal_boundaries(counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries that minimise sum(counts[l] * (boundary(l) - l)); ties: the shortest boundaries.

    cost[k][j]: the least padded total when lengths up to the j-th present one fill k buckets.
    """
    lengths = np.nonzero(counts)[0]
    if not len(lengths):
        return []
    upto = np.concatenate([[0], np.cumsum(counts[lengths])])
    m, k = len(lengths), min(buckets, len(lengths))
    cost = np.where(np.arange(m + 1) == 0, 0.0, np.inf)
    cuts = []
    for _ in range(k):
        fresh, cut_at = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        for j in range(1, m + 1):
            total = cost[:j] + (upto[j] - upto[:j]) * float(lengths[j - 1])
            cut_at[j] = int(np.argmin(total))
            fresh[j] = total[cut_at[j]]
        cost = fresh
        cuts.append(cut_at)
    found, j = [], m
    for cut_at in reversed(cuts):
        found.append(int(lengths[j - 1]))
        j = int(cut_at[j])
    return found[::-1]


def pack(
    docs: DataFrame,
    max_tokens: int = MAX_TOKENS,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per sequence: id, seq, first_token, n_tokens, bucket_tokens, padding, batch, slot.

    ``batch`` counts from 0 inside a bucket; (bucket_tokens, batch) names a batch, and a
    batch holds budget // bucket_tokens sequences at most (one at least).
    """
    if budget < max_tokens:
        raise ValueError("the budget must hold one sequence of max_tokens")
    # a narrow table: the texts are read once, for three passes over their lengths
    pieces = written(counted(sequences(docs, max_tokens, id_col, text_col)))
    counts = length_histogram(pieces, max_tokens)
    bounds = optimal_boundaries(counts, buckets) or [max_tokens]
    sums = np.cumsum(counts)
    held = [int(sums[b] - (sums[a] if a is not None else 0)) for a, b in zip([None, *bounds[:-1]], bounds)]
    share = max(1, min(PART_ROWS, math.ceil(sum(held) / LEAST_PARTS)))
    parts = [max(1, math.ceil(h / share)) for h in held]
    # bounded by the number of buckets
    bucket = F.array_position(F.array(*[F.col("n_tokens") <= b for b in bounds]), True).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("bucket"))
    copy = F.explode(F.sequence(F.col("first_copy"), F.col("first_copy") + F.col("copies") - 1))
    placed = pieces.withColumn("bucket", bucket).withColumn("copy", copy).drop("first_copy", "copies")
    mixed = F.xxhash64(F.lit(seed), "id", "seq")
    placed = placed.withColumn("mixed", F.when(F.col("copy") == 0, mixed).otherwise(F.xxhash64(mixed, "copy")))
    placed = placed.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "mixed", "n_tokens"), pick(parts)).cast("int"))
    sizes = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("bucket", "part").orderBy("mixed", "id", "seq", "copy")
    numbered = placed.withColumn("at", F.row_number().over(within) - 1).join(offsets, ["bucket", "part"])
    place = F.col("first") + F.col("at")
    per_batch = pick([max(1, budget // max(1, b)) for b in bounds])
    return numbered.select(
        F.col("id").alias(id_col),
        "seq",
        "first_token",
        "n_tokens",
        pick(bounds).alias("bucket_tokens"),
        (pick(bounds) - F.col("n_tokens")).alias("padding"),
        F.floor(place / per_batch).cast("long").alias("batch"),
        F.pmod(place, per_batch).cast("int").alias("slot"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
