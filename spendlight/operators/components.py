"""Connected components as alternating star contractions over an edge table.

Each round rewires every edge towards the smallest neighbour (first among larger neighbours, then
among smaller ones), so long chains shrink by a constant factor a round. The minimum of each node
is written out before it is joined back: both join sides are then plain shuffles, which adaptive
execution can split when one node has very many edges. A round's tables go when the next has read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlight.storage import scratch, store


def _digest(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every node that has an edge; component is the smallest id reachable.

    Null ends and self-loops carry no link and are left out; repeated edges count once. The result is a stored table.
    """
    pairs = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("p"), F.col(b).alias("q"))
        .where(F.col("p").isNotNull() & F.col("q").isNotNull() & (F.col("u") != F.col("v")))
        .select("u", "v")
        .distinct()
    )
    with scratch(edges.sparkSession) as keep:
        current = keep(pairs)
        before = _digest(current)
        for _ in range(max_rounds if before[0] else 0):
            both = current.union(current.select(F.col("v"), F.col("u")))
            lows = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
            large = keep(
                both.hint("merge").join(lows.hint("merge"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            )
            lows = keep(large.groupBy("u").agg(F.min("v").alias("m")))
            small = large.hint("merge").join(lows.hint("merge"), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            current = keep(small.union(lows.select("u", F.col("m").alias("v"))).distinct())
            after = _digest(current)
            if after == before:
                break
            before = after
        else:
            if before[0]:
                raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        ends = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
        return store(ends.union(current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
