"""Reading the given tables and the helpers that the operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key() -> Column:
    """A digest that names a text; a null text is an empty one."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def without_texts(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose text isn't among ``keys``, whatever their doc_id is."""
    own = fresh(docs, key)
    found = keys.select(F.col(key).alias(own)).distinct()
    return docs.withColumn(own, text_key()).hint("merge").join(found.hint("merge"), own, "left_anti").select(columns(docs))


def held_out(fold: int, folds: int):
    """Whether crc32 of doc_id as text leaves ``fold`` when divided by ``folds`` (null ids: not held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def blocks(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))


#: Above this many documents the share of labelled rows that is drawn is thinned to keep the sample bounded.
def share(bound: int, rows: int) -> float:
    return 1.0 if rows <= bound else bound / rows
