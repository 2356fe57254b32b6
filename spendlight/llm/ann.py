"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Every vector is projected on ``projections`` random directions; each direction keeps its
projections sorted. A query opens a window around its own projection in each array and widens it
by virtual rehashing (radius times ``growth`` a round); a vector met in at least ``threshold`` of
the windows is verified by its exact distance. A query ends once ``k`` verified vectors lie within
the radius, or when every vector was met. No candidate is capped.

The rows are dealt into blocks by a hash of the vector and up to QUERIES queries make a block; a task
indexes one vector block and answers one query block, so neither side is ever held whole, and the
blocks' lists are merged by rank. Vectors are sent once for every QUERIES queries, queries once for
every vector block. The directions depend on the dimension and a seed alone: nothing
is fitted, and every row is indexed.

Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors
meet only those of their own dimension. Repeated vec_ids are separate candidates, but a query
never meets rows of its own id; a repeated query id asks once, with its least vector of each dimension,
and takes the nearest of all. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlight.llm.tables import blocks, table

K = 10
PROJECTIONS = 40
#: Windows that must hold a vector before it is verified, and a window's width for radius 1.
THRESHOLD, WIDTH = 24, 2.8
GROWTH = 1.25
SEED = 20240
#: Vectors of a block (fewer in small tables, for parallel work) and queries of a block.
VECTORS, LEAST_VECTORS, QUERIES = 131072, 8192, 4096


def directions(dim: int, projections: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, projections))


def search_block(vectors, ids, queries, query_ids, k=K, threshold=THRESHOLD, width=WIDTH, growth=GROWTH):
    """The ``k`` nearest found in ``vectors`` for each query: lists of (query, id, distance)."""
    x, q = np.asarray(vectors, np.float64), np.asarray(queries, np.float64)
    n, axes = len(x), directions(x.shape[1])
    proj, own = x @ axes, q @ axes
    m = axes.shape[1]
    order = np.ascontiguousarray(np.argsort(proj, axis=0, kind="stable").T.astype(np.int32))
    keys = np.ascontiguousarray(np.sort(proj, axis=0).T)
    # first radius: a small quantile of the distances between a few rows
    few = x[np.linspace(0, n - 1, min(n, 200)).astype(int)]
    gaps = np.sqrt(np.maximum(((few[:, None, :64] - few[None, :40, :64]) ** 2).sum(-1), 0))
    gaps = gaps[gaps > 0]
    start = max(float(np.quantile(gaps, 0.02)) * 0.5 if len(gaps) else 1e-9, 1e-12)
    out = []
    for i in range(len(q)):
        counts, done = np.zeros(n, np.int16), np.zeros(n, bool)
        low = np.array([np.searchsorted(keys[j], own[i, j]) for j in range(m)])
        high, found, dist = low.copy(), [], []
        radius, met, seen = start, 0, 0
        mine = ids == query_ids[i]
        while True:
            half = width * radius / 2
            parts = []
            for j in range(m):
                a = np.searchsorted(keys[j], own[i, j] - half, "left")
                b = np.searchsorted(keys[j], own[i, j] + half, "right")
                if a < low[j]:
                    parts.append(order[j, a : low[j]])
                if b > high[j]:
                    parts.append(order[j, high[j] : b])
                low[j], high[j] = min(a, low[j]), max(b, high[j])
            if parts:
                new = np.concatenate(parts)
                met += len(new)
                counts += np.bincount(new, minlength=n).astype(np.int16)
            hit = np.flatnonzero((counts >= threshold) & ~done)
            if len(hit):
                done[hit] = True
                seen += len(hit)
                hit = hit[~mine[hit]]
                found.append(hit)
                dist.append(np.sqrt(((x[hit] - q[i]) ** 2).sum(axis=1)))
            near = sum(int((d <= radius).sum()) for d in dist)
            if near >= k or seen == n or met == n * m:
                break
            radius *= growth
        if found:
            hit, d = np.concatenate(found), np.concatenate(dist)
            for j in np.lexsort((ids[hit], d))[:k]:
                out.append((query_ids[i], ids[hit[j]], d[j]))
    return out


def nearest(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for the rows where ``is_query`` holds, the ``k`` nearest others found."""
    v = F.col(vector_col)
    good = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(good, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    n_blocks = blocks(count["n"], min(VECTORS, max(LEAST_VECTORS, count["n"] // 24)))
    q_blocks = blocks(count["q"], QUERIES)
    cell = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    left = rows.withColumn("vb", cell(n_blocks, "id", "v")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    asked = rows.where("asks").groupBy("id", "dim").agg(F.min("v").alias("v"))
    right = asked.withColumn("qb", cell(q_blocks, "id", F.lit("q"))).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def matrix(t: pa.Table) -> np.ndarray:
        values = t.column("v").combine_chunks()
        return values.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def run(one: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if one.num_rows and asked.num_rows:
            found = search_block(matrix(one), one.column("id").to_numpy(), matrix(asked), asked.column("id").to_numpy(), k)
        return pa.table({"query_id": pa.array([x[0] for x in found], pa.int64()), "vec_id": pa.array([x[1] for x in found], pa.int64()), "score": pa.array([x[2] for x in found], pa.float64())})

    near = left.select("dim", "vb", "qb", "id", "v").groupBy("dim", "vb", "qb").cogroup(right.select("dim", "vb", "qb", "id", "v").groupBy("dim", "vb", "qb"))
    near = near.applyInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.select("query_id", F.row_number().over(best).cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op3_collision_counting_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query (vec_id divisible by 100) its 10 nearest found: query_id, rank (from 1), vec_id, score (Euclidean distance)."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
