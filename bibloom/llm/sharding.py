"""Global shuffle in two passes, and sharding by the shuffled order.

Pass one scatters the records by a seeded hash of the whole record into buckets that fit
in a task's memory. Pass two reads each bucket and applies a seeded Fisher-Yates shuffle.
The shuffled buckets, end to end, are one random order of all records; dealing that order
out in turn gives shards whose row counts differ by one at most (the ``rows`` law).

Defined cases. A null text counts as 0 bytes, and any id may be null or repeated: the hash
covers id and text, so copies of a text under different ids spread over all buckets. Rows
that repeat both are dealt out like any others. An empty table gives an empty result.
The order depends on the seed and the records, not on how the input is partitioned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibloom.llm.common import documents, text_of, written

BUCKET_BYTES = 32 << 20
MIN_BUCKETS = 256
SHARDS = 24
BLOCK = 1024
BUCKETS_A_TASK = 8


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of range(n): for i from the end, swap i with a uniform j <= i."""
    order = list(range(n))
    if n > 1:
        draws = np.random.Generator(np.random.PCG64(seed)).random(n - 1)
        for i, at in zip(range(n - 1, 0, -1), (draws * np.arange(n, 1, -1)).astype(np.int64).tolist()):
            order[i], order[at] = order[at], order[i]
    return np.array(order, dtype=np.int64)


def bucket_count(docs: DataFrame, text_col: str, bucket_bytes: int, min_buckets: int) -> int:
    total = docs.agg(F.sum(F.octet_length(text_of(text_col)).cast("long") + 64)).first()[0] or 0
    return max(min_buckets, math.ceil(total / bucket_bytes))


def shuffle_records(
    docs: DataFrame,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    min_buckets: int = MIN_BUCKETS,
) -> DataFrame:
    """The id, the text and ``position``: the record's place in one global random order, from 0."""
    n = bucket_count(docs, text_col, bucket_bytes, min_buckets)
    records = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("content")).withColumns(
        {"order_key": F.xxhash64(F.lit(seed), "id", "content"), "bucket": F.pmod(F.xxhash64("content", F.lit(seed + 1), "id"), F.lit(n)).cast("int")}
    )
    counts = records.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("bucket") / BLOCK))
    # sums over blocks of buckets, then inside each block: no window holds all buckets
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).select("block", ahead(Window.orderBy("block")).alias("ahead"))
    within = counts.select("bucket", "block", ahead(Window.partitionBy("block").orderBy("bucket")).alias("inside"))
    offsets = written(within.join(blocks, "block").select("bucket", (F.col("ahead") + F.col("inside")).alias("first")))

    def shuffled(rows: pa.Table, first: pa.Table) -> pa.Table:
        # a fixed order first: a task that is run again sees its rows in another order
        rows = rows.take(pc.sort_indices(rows, [("order_key", "ascending"), ("id", "ascending"), ("content", "ascending")]))
        k = rows.num_rows
        bucket = rows.column("bucket")[0].as_py() if k else 0
        taken = rows.take(pa.array(fisher_yates(k, seed * 1_000_003 + bucket)))
        start = first.column("first")[0].as_py() if k else 0
        return pa.table([taken.column("id"), taken.column("content"), pa.array(np.arange(start, start + k))], ["id", "content", "position"])

    schema = T.StructType([docs.schema[id_col], docs.schema[text_col], T.StructField("position", T.LongType())])
    schema = T.StructType([T.StructField(name, f.dataType) for name, f in zip(("id", "content", "position"), schema)])
    dealt = records.repartition(math.ceil(n / BUCKETS_A_TASK), "bucket").groupBy("bucket").cogroup(offsets.groupBy("bucket")).applyInArrow(shuffled, schema)
    return dealt.select(F.col("id").alias(id_col), F.col("content").alias(text_col), "position")


def deal_shards(shuffled: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds shard and slot: consecutive positions go to consecutive shards."""
    at = F.col("position")
    return shuffled.withColumns({"shard": F.pmod(at, F.lit(shards)).cast("int"), "slot": F.floor(at / F.lit(shards)).cast("long")})


def write_shards(dealt: DataFrame, path: str) -> None:
    """One folder a shard, its records in slot order inside each file."""
    dealt.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    dealt = deal_shards(shuffle_records(documents(spark, sf_dir)))
    return dealt.select(
        "doc_id",
        (F.octet_length(text_of()).cast("long") + 8).alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
