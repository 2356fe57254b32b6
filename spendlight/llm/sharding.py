"""Rendezvous hashing of stable record keys over weighted shards, in DataFrame functions only.

A record's cost at a shard is -ln(u) / weight with u in (0, 1) from a hash of key and shard number;
the cheapest shard gets it. A shard that is added only takes the records for which it is cheapest,
so no record moves between old shards. Slots number the rows of a shard without gaps: rows are
spread over cells by a hash, the cells' counts give each cell's first slot, and rows are numbered
inside their cell, so that no task sorts a whole shard.

Nulls: a null key hashes like any other value, a null text counts as empty (size 1, crc32 0).
Equal rows get different slots. A weight must be positive. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlight.llm.tables import blocks, table

SHARDS = 16
ROWS_PER_CELL = 20_000


def cost(key: str, shard: int, weight: float = 1.0):
    u = (F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(float(weight))


def choose(key: str, weights: Sequence[float]):
    """The shard (int) that gets ``key``; ties go to the smaller shard."""
    return F.array_min(F.array(*(F.struct(cost(key, s, w).alias("c"), F.lit(s).alias("s")) for s, w in enumerate(weights))))


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, new_weight: float = 1.0) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    best = choose("doc_id", weights)
    cells = blocks(docs.count() // len(weights), ROWS_PER_CELL)
    base = (
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), best.alias("best"))
        .withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("cell")), F.lit(cells)).cast("int"))
        .select(
            "doc_id", "size", "text_crc32", "cell",
            F.col("best.s").alias("shard"),
            F.when(cost("doc_id", len(weights), new_weight) < F.col("best.c"), F.lit(len(weights))).otherwise(F.col("best.s")).alias("grown_shard"),
        )
    )
    counts = base.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32")
    return base.join(first.hint("merge"), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first") + F.row_number().over(inside) - 1).cast("long").alias("slot"), "grown_shard",
    )


def op9_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard (of 16), slot (gapless from 0 in it), grown_shard (with one shard more)."""
    return shard_documents(table(spark, sf_dir, "documents"))
