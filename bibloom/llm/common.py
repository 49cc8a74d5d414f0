"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_of(name: str = "text") -> Column:
    """The text, a null being empty."""
    return F.coalesce(column(name), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """Where checkpoints go: what spark.checkpoint.dir names; a temporary folder only where it is unset in a local session."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df; its lineage ends there."""
    shared_folder(df.sparkSession)
    # Spark 4.1 fails to carry a union's constraints over to its checkpoint
    conf, name = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(name, before)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings in force for the actions inside; double underscores stand for dots."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 1000):
    """Texts go to Python by fewer rows at a time in the actions inside, so that workers hold less."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows))


def tidy(spark: SparkSession):
    """Shuffle files of an action inside go when it ends; what later ones read is written to tables."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: smaller than a checkpoint, and joins with it can split hot keys."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables from ``written`` that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for name in table.inputFiles()[:1]:
            path = context._jvm.org.apache.hadoop.fs.Path(name).getParent()
            if path.getName().startswith("table-"):
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(docs: DataFrame) -> Column:
    """The row as one struct, so that no name of a helper column can clash with its names."""
    return F.struct(*[column(c) for c in docs.columns])


def span_text(spans: Column) -> Column:
    """An array of (kind, start, end) as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
