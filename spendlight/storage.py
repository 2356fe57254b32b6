"""Cutting lineage through the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task where partitions are counted by rows.
TASK_ROWS = 1_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; where it is unset, a private one in local mode alone."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        if not context.getCheckpointDir():
            context.setCheckpointDir(folder)
    elif not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a reliable checkpoint: a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder (or ``folder`` there) and read back.

    A checkpointed frame also carries its plan's size estimate and constraints, which each join
    multiplies: over the rounds of an iteration they outgrow the driver. A table that is read back
    has its true size.
    """
    spark = df.sparkSession
    path = f"{folder or ensure_checkpoint_dir(spark) + '/tables'}/{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A ``store`` whose tables are deleted at the end of the block; what outlives it must be stored elsewhere."""
    folder = f"{ensure_checkpoint_dir(spark)}/tables/{uuid4().hex}"
    try:
        yield lambda df: store(df, folder)
    finally:
        discard(spark, folder)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` shuffled by ``keys`` into partitions of at most about ``TASK_ROWS`` rows, so that a task's memory doesn't grow with the table."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))
    return df.repartition(tasks, *keys)


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of spent tables."""
    path, files = _file_system(spark, folder)
    files.delete(path, True)


def exists(spark: SparkSession, path_: str) -> bool:
    path, files = _file_system(spark, path_)
    return files.exists(path)


def folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders in ``folder``, none where it doesn't exist."""
    path, files = _file_system(spark, folder)
    return [s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()] if files.exists(path) else []


def place_for(spark: SparkSession, kind: str) -> str:
    """A new folder name in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/{kind}/{uuid4().hex}"


@contextmanager
def bucketed(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """``df`` as a table bucketed by ``key``, for several joins on it without a shuffle; dropped at the end of the block.

    There are as many buckets as shuffle partitions, so a shuffle by ``key`` meets them as it is.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid4().hex}"
    folder = f"{ensure_checkpoint_dir(spark)}/tables/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).format("parquet").option("path", folder).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(spark, folder)
