"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks.

Words are maximal runs without ASCII white space, after A-Z are lower-cased; shingles are three
words joined by one space (fewer words: the whole sequence; none: fingerprint zero). A fingerprint
bit is set if it is set in over half of the shingles' XXH64 hashes, repeats included.

Fingerprints at distance two or less agree on three of five blocks, so each fingerprint is filed
under its ten choices of three blocks; fingerprints filed together are joined and their Hamming
distance verified. A crowded choice (a large group of near copies) is not joined pair by pair: its
members are filed under themselves and their 64 one-bit neighbours instead, where two fingerprints
meet exactly if they differ in two bits or fewer, and each is linked to the smallest one it meets.

Nulls: a null text counts as empty; rows with a null doc_id keep a fingerprint, get a null
component and link nothing. Rows that repeat a doc_id are documents of their own, which share its name. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlight.llm.tables import columns, fresh, table
from spendlight.operators.components import connected_components
from spendlight.storage import cut

MAX_DISTANCE = 2
SHINGLE_WORDS = 3
#: Bit ranges (start, width) of the five blocks.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Fingerprints under one choice of blocks from which the linear way is taken.
CROWDED = 24


def fingerprint(text: bytes | None, n: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 ``text``."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < n:
        return digest(b" ".join(words), 42)
    ones, total = np.zeros(64, np.int64), len(words) - n + 1
    for at in range(0, total, 65536):
        part = words[at : at + 65536 + n - 1]
        hashes = np.array([digest(b" ".join(x), 42) for x in zip(*(part[i:] for i in range(n)), strict=False)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, version, fp)`` with the text's hash and the fingerprint as signed longs, one row per document."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "version", "fp"])

    text = F.col("text").cast("string")
    slim = docs.select("doc_id", F.xxhash64(text).alias("version"), text.alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, version long, fp long")


def _choices(fp):
    keys = []
    for number, chosen in enumerate(combinations(BLOCKS, 3)):
        mask = sum(((1 << width) - 1) << start for start, width in chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(number).alias("choice"), fp.bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def _one_bit_away(fp):
    masks = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    return F.array(fp, *(fp.bitwiseXOR(F.lit(m)) for m in masks))


def links(classes: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Edges ``(a, b)`` between representatives whose fingerprints differ in two bits or fewer.

    ``classes`` is ``(fp, rep)``, one row per distinct fingerprint. All such pairs are connected by
    the edges; only under crowded choices are some of them connected through a third fingerprint.
    """
    filed = classes.select("fp", "rep", F.explode(_choices(F.col("fp"))).alias("k")).select("fp", "rep", "k.choice", "k.bits")
    sizes = cut(filed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = cut(filed.hint("merge").join(sizes.hint("merge"), ["choice", "bits"]))
    few = shared.where(F.col("n") <= crowded)
    left, right = few.select("choice", "bits", "fp", "rep"), few.select("choice", "bits", F.col("fp").alias("fp2"), F.col("rep").alias("rep2"))
    pairs = (
        left.hint("merge")
        .join(right, ["choice", "bits"])
        .where((F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= MAX_DISTANCE))
        .select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    )
    dense = cut(shared.where(F.col("n") > crowded).select("fp", "rep").distinct())
    near = dense.select("fp", "rep", F.explode(_one_bit_away(F.col("fp"))).alias("centre"))
    # the low half of the centre spreads a crowded neighbourhood's rows; nothing but equal centres meets
    firsts = cut(near.groupBy("centre").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("centre", "b"))
    stars = near.hint("merge").join(firsts.hint("merge"), "centre").where(F.col("rep") != F.col("b")).select(F.col("rep").alias("a"), "b")
    return pairs.union(stars).distinct()


def _rooted(marked: DataFrame) -> DataFrame:
    """``(fp, root)``: each distinct fingerprint of ``marked`` and the least one reachable from it."""
    classes = cut(marked.where(F.col("doc_id").isNotNull()).select("fp").distinct())
    joined = connected_components(links(classes.withColumn("rep", F.col("fp"))))
    return classes.hint("merge").join(joined.withColumnRenamed("id", "fp").hint("merge"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``."""
    marked = cut(fingerprints(docs))
    rooted = cut(_rooted(marked))
    least = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    firsts = cut(rooted.hint("merge").join(least.hint("merge"), "fp").groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(rooted.hint("merge").join(firsts.hint("merge"), "root").select("fp", "component_id"))
    return (
        marked.hint("merge")
        .join(named.hint("merge"), "fp", "left")
        .select(
            "doc_id",
            F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
            F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
        )
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest doc_id, then of the smallest text hash.

    Rows with a null doc_id stay. Of rows that repeat both doc_id and text one stays, by the least hash of the row.
    """
    version, first = fresh(docs, "version"), fresh(docs, "first")
    marked = cut(fingerprints(docs).where(F.col("doc_id").isNotNull()))
    keys = marked.groupBy("fp", "doc_id", "version").agg(F.count(F.lit(1)).alias("n"))
    keys = cut(keys.hint("merge").join(cut(_rooted(marked)).hint("merge"), "fp"))
    kept = cut(keys.groupBy("root").agg(F.min(F.struct("doc_id", "version")).alias("keep")).select("keep.doc_id", "keep.version"))
    gone = cut(keys.select("doc_id", "version").distinct().hint("merge").join(kept.hint("merge"), ["doc_id", "version"], "left_anti"))
    repeated = cut(keys.where("n > 1").select("doc_id", "version").distinct())
    named = lambda df: df.withColumnRenamed("version", version).hint("merge")
    left = docs.withColumn(version, F.xxhash64(F.col("text").cast("string"))).hint("merge").join(named(gone), ["doc_id", version], "left_anti")
    if repeated.isEmpty():
        return left.select(columns(docs))
    once = left.hint("merge").join(named(repeated), ["doc_id", version], "left_anti").select(columns(docs))
    several = left.hint("merge").join(named(repeated), ["doc_id", version], "left_semi")
    one = several.groupBy("doc_id", version).agg(F.min_by(F.struct(*columns(docs)), F.xxhash64(*columns(docs))).alias(first))
    return once.unionByName(one.select(f"{first}.*"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable by links of two bits or fewer)."""
    return near_duplicates(table(spark, sf_dir, "documents"))
