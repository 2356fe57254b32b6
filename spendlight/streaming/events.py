"""The event-driven parts as Structured Streaming, each with the batch twin it equals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spendlight.sources.tables import KeyedTable

# fixed values: event types and the envelope
TYPES = ("artifact.ingested", "artifact.parse_requested", "artifact.normalize_requested", "case.created")
ENVELOPE = "event_id string, event_type string, source string, timestamp timestamp, payload string, idempotency_key string"


def parse_envelopes(raw: DataFrame, types: tuple[str, ...] = TYPES) -> tuple[DataFrame, DataFrame]:
    """Valid events, and dead letters with a reason, of a column ``value`` of JSON text (batch or stream)."""
    parsed = raw.select("value", F.from_json("value", ENVELOPE).alias("e"))
    reason = F.when(F.col("e").isNull() | F.col("e.event_id").isNull(), "malformed").when(F.coalesce(F.trim("e.idempotency_key"), F.lit("")) == "", "blank key").when(~F.coalesce(F.col("e.event_type").isin(*types), F.lit(False)), "unknown type")
    marked = parsed.withColumn("reason", reason)
    return marked.where("reason is null").select("e.*"), marked.where("reason is not null").select("value", "reason")


def route(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("event_type") == kind)


def dedup(events: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """One event per idempotency key within the ttl, for streams with a timestamp column ``ts``."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["idempotency_key"])


def latest_status(changes: DataFrame) -> DataFrame:
    """The last change of each case."""
    return changes.groupBy("case_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("m")).select("case_id", "m.status", "m.ts")


def window_counts(events: DataFrame, width: str, slide: str | None = None, keys: tuple[str, ...] = ("scope",)) -> DataFrame:
    """Counts by tumbling or sliding window of ``ts``."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def late_counts(events: DataFrame, delay: str, width: str, keys: tuple[str, ...] = ("scope",)) -> DataFrame:
    """Counts by window for streams that run on: rows later than ``delay`` are left out, finished windows leave the state."""
    return window_counts(events.withWatermark("ts", delay), width, keys=keys)


def _home(spark, name: str) -> str:
    from uuid import uuid4

    from spendlight.storage import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark)}/streams/{name}-{uuid4().hex}"


def _opened(spark, source: str, schema, files: int | None) -> DataFrame:
    """The parquet files under ``source`` (a folder or one file) as a stream, ``files`` a micro-batch."""
    folder, names = source, "*.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        # a stream reads folders: a single file is the only one of its name in its folder
        folder, names = str(path.getParent()), path.getName()
    reader = spark.readStream.schema(schema or spark.read.parquet(source).schema).option("pathGlobFilter", names)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def replay(spark, source: str, build, name: str, keys: tuple[str, ...] = (), order: str | None = None, schema=None, files: int | None = None, slices=(), opened=None) -> DataFrame:
    """Runs ``build`` over the parquet files under ``source`` as a stream to its end and returns the result.

    The result goes to a table in the shared checkpoint folder, so it survives lost executors. With ``keys`` the stream
    runs in update mode, and each micro-batch replaces the rows of its keys in a keyed table (with ``order``: those
    that aren't newer); nothing else is written again. ``opened(spark, source)`` opens other files. ``slices`` are landed one after the other, with a run of the stream after each.
    """
    home = _home(spark, name)

    def run() -> StructType:
        stream = build(opened(spark, source) if opened else _opened(spark, source, schema, files))
        writer = stream.writeStream.option("checkpointLocation", f"{home}/state").trigger(availableNow=True)
        if keys:
            table = _keyed(stream.schema)
            query = writer.outputMode("update").foreachBatch(lambda df, n: table.upsert(df, order, keep_newer=order is not None)).start()
        else:
            query = writer.format("parquet").option("path", f"{home}/out").outputMode("append").start()
        query.awaitTermination()
        return stream.schema

    def _keyed(shape: StructType) -> KeyedTable:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.fields)
        return KeyedTable(spark, f"{home}/out", fields, keys, parts=16)

    for part in slices:
        part.write.mode("append").parquet(source)
        shape = run()
    if not slices:
        shape = run()
    return _keyed(shape).read() if keys else spark.read.schema(shape).parquet(f"{home}/out")


def ingest_stream(spark, source: str, new_rows, name: str = "ingest", files: int | None = None) -> DataFrame:
    """Stores of each micro-batch what ``new_rows(batch, stored)`` takes as new beside what the batches before it stored.

    A batch that is run again after a failure replaces its own folder, so nothing is stored twice.
    """
    home = _home(spark, name)
    stream = _opened(spark, source, None, files)

    def step(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        stored = session.createDataFrame([], batch.schema)
        if n:
            stored = session.read.schema(StructType([*batch.schema.fields, StructField("batch", LongType())])).parquet(f"{home}/out").where(F.col("batch") < n).drop("batch")
        new_rows(batch, stored).write.mode("overwrite").parquet(f"{home}/out/batch={n}")

    stream.writeStream.option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    return spark.read.parquet(f"{home}/out").drop("batch")
