"""Where iterations cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(session: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where that is unset in a local session."""
    context = session.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = session.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; lineage ends there."""
    session = df.sparkSession
    shared_folder(session)
    # Spark 4.1 fails to carry a union's constraints over to its checkpoint
    name = "spark.sql.constraintPropagation.enabled"
    before = session.conf.get(name)
    session.conf.set(name, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        session.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: one job where a checkpoint takes two, and joins know its size."""
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
