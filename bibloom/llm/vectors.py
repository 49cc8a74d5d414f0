"""Vectors as numpy blocks: what the three vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or a component that is not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def doubles(vector: Column) -> Column:
    """Components as doubles, negative zeros as zeros, so that equal vectors have equal bits."""
    return F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix of doubles."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    if not len(lists):
        return np.zeros((0, 0))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def by_length(table: pa.Table | pa.RecordBatch, name: str) -> dict[int, np.ndarray]:
    """Places of the rows of each length of the list column ``name``."""
    sizes = pc.list_value_length(table.column(name)).to_numpy(zero_copy_only=False)
    return {int(d): np.nonzero(sizes == d)[0] for d in np.unique(sizes)}


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square over- or underflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
