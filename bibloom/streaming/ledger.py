"""The same reductions over arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.functions.storage import shared_folder


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """A file stream of one table; its timestamps become instants, which watermarks need."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def daily(stream: DataFrame, value: str = "value") -> DataFrame:
    """Sums and counts a day; in update mode, days that ended over a day before the newest row are final: later rows for them are dropped."""
    day = F.window("ts", "1 day")
    return stream.withWatermark("ts", "1 day").groupBy(day).agg(F.sum(value).alias("spent"), F.count(F.lit(1)).alias("calls"))


def budgeted(days: DataFrame, limit: float) -> DataFrame:
    """Days with what is left of a daily limit, and whether it is used up."""
    left = F.greatest(F.lit(0.0), limit - F.col("spent"))
    return days.withColumns({"remaining": left, "exhausted": F.col("spent") >= limit})


def drained(aggregated: DataFrame, name: str) -> DataFrame:
    """Runs a stream in update mode over what its folder holds now; the table of each window's last result.

    Each batch's changed windows are a folder of their own beside the stream's checkpoint, in the shared
    folder; a batch that runs again after a failure overwrites its own folder only.
    """
    spark = aggregated.sparkSession
    folder = f"{shared_folder(spark)}/{name}"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")

    query = aggregated.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(store).trigger(availableNow=True).start()
    query.awaitTermination()
    written = spark.read.parquet(f"{folder}/batches")
    values = [c for c in aggregated.columns if c != "window"]
    last = written.groupBy("window").agg(F.max_by(F.struct(*values), "batch").alias("r"))
    return last.select("window", "r.*")
