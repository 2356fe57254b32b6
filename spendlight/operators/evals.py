"""Evaluation metrics per case and per suite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlight.functions import text as X
from spendlight.operators.ranking import ranked

# fixed values: release gates
GATES = [("grounding_rate", ">=", 0.95), ("citation_validity", ">=", 1.0), ("hallucination_block_rate", ">=", 0.95), ("retrieval_recall_at_10", ">=", 0.80), ("replay_determinism", "==", 1.0), ("cost_per_case_usd", "<=", 1.0), ("coverage_percent", ">=", 80.0)]


def grounding(claims: DataFrame, citations: DataFrame, artifacts: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Share of a case's claims that are cited; it passes where all are and no cited artifact is unknown. Of ``cases`` those without claims score 1."""
    cited = citations.groupBy("case_id", "claim_id").agg(F.lit(True).alias("cited"))
    invalid = citations.hint("merge").join(artifacts.select("artifact_id").hint("merge"), "artifact_id", "left_anti").groupBy("case_id").agg(F.count(F.lit(1)).alias("invalid"))
    by = claims.hint("merge").join(cited.hint("merge"), ["case_id", "claim_id"], "left").groupBy("case_id").agg((F.countDistinct(F.when(F.col("cited"), F.col("claim_id"))) / F.countDistinct("claim_id")).alias("score"), F.count_if(F.col("claim_type") == "cannot_conclude").alias("cannot_conclude"))
    if cases is not None:
        by = cases.select("case_id").distinct().hint("merge").join(by.hint("merge"), "case_id", "left").select("case_id", F.coalesce("score", F.lit(1.0)).alias("score"), F.coalesce("cannot_conclude", F.lit(0)).cast("long").alias("cannot_conclude"))
    return by.join(invalid, "case_id", "left").select("case_id", "score", "cannot_conclude", ((F.col("score") == 1) & F.col("invalid").isNull()).alias("passed"))


def hallucination(claims: DataFrame) -> DataFrame:
    rejected = ~F.coalesce("audit_passed", F.lit(True))
    certain = F.size(X.certainty(F.col("statement"))) > 0
    unhedged = ~X.has_hedge(F.col("statement")) & F.col("claim_type").isin("risk_signal", "hypothesis", "cannot_conclude")
    bad = rejected | certain | unhedged
    return claims.groupBy("case_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(bad).alias("bad"), (1 - F.count_if(bad) / F.count(F.lit(1))).alias("score"))


def retrieval(runs: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Recall and precision at ``k``, average precision and F1 of each case (runs: case_id, rank from 1, artifact_id)."""
    wanted = relevant.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    hits = runs.join(relevant.withColumn("hit", F.lit(1)), ["case_id", "artifact_id"], "left")
    at = ranked(hits.withColumnRenamed("rank", "place"), "case_id", [F.col("place"), F.col("artifact_id")], "hit").drop("rank").withColumnsRenamed({"place": "rank", "so_far": "seen"})
    early = (F.col("rank") <= k) & F.col("hit").isNotNull()
    by = at.groupBy("case_id").agg(F.countDistinct(F.when(early, F.col("artifact_id"))).alias("found"), F.count_if(early).alias("hits"), F.sum(F.when(F.col("hit").isNotNull(), F.col("seen") / F.col("rank"))).alias("gain"))
    out = wanted.join(by, "case_id", "left")
    recall, precision = F.coalesce("found", F.lit(0)) / F.col("n"), F.coalesce("hits", F.lit(0)) / k
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
    return out.select("case_id", recall.alias("recall"), precision.alias("precision"), (F.coalesce("gain", F.lit(0.0)) / F.col("n")).alias("average_precision"), f1.alias("f1"), (recall >= 0.8).alias("passed"))


def determinism(replays: DataFrame, min_runs: int = 3) -> DataFrame:
    by = replays.groupBy("case_id").agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("pack_hash").alias("hashes"), (F.max("n_claims") - F.min("n_claims")).alias("spread"))
    return by.select("case_id", "runs", (1 / F.col("hashes")).alias("score"), ((F.col("runs") >= min_runs) & (F.col("hashes") == 1) & (F.col("spread") == 0)).alias("passed"))


def report(results: DataFrame) -> DataFrame:
    return results.groupBy("suite").agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), (F.count_if("passed") / F.count(F.lit(1))).alias("pass_rate"))


def check_gates(metrics: DataFrame, gates: list = GATES) -> DataFrame:
    """``(name, actual, passed)`` of each gate; a metric that is missing fails."""
    spark: SparkSession = metrics.sparkSession
    table = spark.createDataFrame(gates, "name string, op string, limit double")
    joined = table.join(metrics, "name", "left")
    ok = F.when(F.col("op") == ">=", F.col("actual") >= F.col("limit")).when(F.col("op") == "<=", F.col("actual") <= F.col("limit")).otherwise(F.col("actual") == F.col("limit"))
    return joined.select("name", "actual", F.coalesce(ok, F.lit(False)).alias("passed"))


def gate_summary(checked: DataFrame) -> DataFrame:
    """One row: whether every gate passes, and the names of those that don't."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name"))))  # one row a gate
    return checked.agg(F.bool_and("passed").alias("all_passed"), F.array_join(failed, ",").alias("failed"))
