"""Study sizes of papers as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bibloom.functions.storage import shared_folder
from bibloom.operators import evidence


def arriving(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A file stream of one Parquet table."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def extract(texts: DataFrame, name: str) -> DataFrame:
    """Appends the candidates of a stream of texts (paper_id, section, text) to a table until the stream is drained.

    Every text is judged by itself, so nothing is kept between batches. ``name`` names the table and its
    checkpoint in the shared folder: run again with the same name, only texts of new files are read.
    """
    return _appended(evidence.candidates(texts), name)


def resolve(texts: DataFrame, name: str) -> DataFrame:
    """Appends the study size of every text of a stream (paper_id, section, text), resolved inside its row, as ``extract`` does candidates."""
    return _appended(texts.select("paper_id", evidence.resolve_in_row().alias("found")).select("paper_id", "found.*"), name)


def _appended(found: DataFrame, name: str) -> DataFrame:
    spark = found.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    query = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-checkpoint").option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(path)
