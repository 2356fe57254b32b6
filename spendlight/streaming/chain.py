"""Streams that follow one another over their output tables, with retries and dead letters.

Every stage is a streaming query of its own: it reads the table that the stage before it writes, and keeps
its place in a checkpoint of its own, so that each can be stopped, lost and started again by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlight.storage import exists, folders

#: An event on its way; ``failed`` stages send it again as attempt 1 to MOST, then it is dead.
EVENT = "event_id string, event_type string, artifact_id string, idempotency_key string, attempt int"
MOST = 3


def _opened(spark: SparkSession, folder: str, schema: str, files: int | None) -> DataFrame:
    """All parquet files under ``folder``, at any depth, as a stream."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def _once(batch: DataFrame, folder: str, number: int) -> None:
    """Writes what a batch sends to a sink, if anything; a batch that is run again finds its folder finished and leaves it alone."""
    path = f"{folder}/batch={number}"
    if not exists(batch.sparkSession, f"{path}/_SUCCESS") and not batch.isEmpty():
        batch.write.mode("overwrite").parquet(path)


def run_stage(spark: SparkSession, home: str, name: str, source: str, handle: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]], files: int | None = None) -> None:
    """Works off what is new in the table ``source`` and the stage's own retries.

    ``handle(batch)`` gives the rows a stage keeps, the events that follow and the events that failed. They go to
    ``home/name/kept``, ``/next``, and ``/retries`` or, after MOST attempts, ``/dead``.
    """
    out = f"{home}/{name}"

    def step(batch: DataFrame, number: int) -> None:
        kept, after, failed = handle(batch)
        again = failed.where(F.col("attempt") < MOST).withColumn("attempt", F.col("attempt") + 1)
        # the key of an attempt names its event and its number, whatever attempt failed
        again = again.withColumn("idempotency_key", F.concat(F.regexp_replace("idempotency_key", ":retry:[0-9]+$", ""), F.lit(":retry:"), "attempt"))
        for rows, sink in ((kept, "kept"), (after, "next"), (failed.where(F.col("attempt") >= MOST), "dead"), (again, "retries")):
            _once(rows, f"{out}/{sink}", number)

    for folder, kind in ((source, "fresh"), (f"{out}/retries", "again")):
        # retries make retries: they are worked off until an attempt brings no new ones
        while exists(spark, folder):
            done = len(folders(spark, f"{out}/retries"))
            numbered = (lambda batch, n: step(batch, 2 * n)) if kind == "fresh" else (lambda batch, n: step(batch, 2 * n + 1))
            query = _opened(spark, folder, EVENT, files).writeStream.option("checkpointLocation", f"{out}/state-{kind}").trigger(availableNow=True).foreachBatch(numbered).start()
            query.awaitTermination()
            if kind == "fresh" or len(folders(spark, f"{out}/retries")) == done:
                break


def run_chain(spark: SparkSession, home: str, source: str, stages: dict[str, Callable], files: int | None = None) -> None:
    """Runs the stages one after the other; each reads the events that the one before it sent on."""
    for name, handle in stages.items():
        run_stage(spark, home, name, source, handle, files)
        source = f"{home}/{name}/next"


def read_sink(spark: SparkSession, home: str, name: str, sink: str, schema: str = EVENT) -> DataFrame:
    """What a stage has sent to one of its sinks so far."""
    folder = f"{home}/{name}/{sink}"
    if not folders(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)


def follow(done: DataFrame, event_type: str, prefix: str) -> DataFrame:
    """The event that follows each finished one: its key names the artifact, so that it is sent once."""
    key = F.concat(F.lit(prefix), "artifact_id")
    return done.select(F.concat(F.lit(prefix), "event_id").alias("event_id"), F.lit(event_type).alias("event_type"), "artifact_id", key.alias("idempotency_key"), F.lit(0).alias("attempt"))
