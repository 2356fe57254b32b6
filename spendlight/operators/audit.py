"""The gate: seven rules over all case packs, each a table of violations ``(case_id, claim_id, rule)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlight.functions import text as X


def _violations(df: DataFrame, rule: str) -> DataFrame:
    return df.select("case_id", "claim_id", F.lit(rule).alias("rule"))


def citation_index(claims: DataFrame) -> DataFrame:
    """``(case_id, claim_id, artifact_id)``: a claim's citations, else its artifacts."""
    ids = F.when(F.size("citation_ids") > 0, F.col("citation_ids")).otherwise(F.col("artifact_ids") if "artifact_ids" in claims.columns else F.col("citation_ids"))
    return claims.select("case_id", "claim_id", F.explode(ids).alias("artifact_id"))


def citation_required(claims: DataFrame, citations: DataFrame) -> DataFrame:
    factual = claims.where(F.col("claim_type").isin("finding", "factual"))
    return _violations(factual.join(citations.select("claim_id").distinct().hint("merge"), "claim_id", "left_anti"), "citation_required")


def citation_valid(citations: DataFrame, artifacts: DataFrame) -> DataFrame:
    return _violations(citations.hint("merge").join(artifacts.select("artifact_id").hint("merge"), "artifact_id", "left_anti"), "citation_valid")


def hash_match(citations: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``citations`` with a content_hash that differs from the stored one, and once each case that cites artifacts of which none has a stored hash."""
    stored = artifacts.select("artifact_id", F.nullif(F.col("content_hash"), F.lit("")).alias("stored"))
    both = citations.where(F.col("artifact_id").isNotNull()).hint("merge").join(stored.hint("merge"), "artifact_id", "left")
    wrong = both.where((F.coalesce("content_hash", F.lit("")) != "") & (F.col("content_hash") != F.col("stored")))
    unknown = both.groupBy("case_id").agg(F.count("stored").alias("n")).where("n = 0").select("case_id", F.lit(None).cast(dict(citations.dtypes)["claim_id"]).alias("claim_id"))
    return _violations(wrong, "hash_match").unionByName(_violations(unknown, "hash_match"))


def language(claims: DataFrame) -> DataFrame:
    return _violations(claims.where(X.banned_phrase(F.col("statement")).isNotNull()), "language")


def hypothesis_label(claims: DataFrame, citations: DataFrame) -> DataFrame:
    loose = claims.where(~F.col("claim_type").isin("hypothesis", "risk_signal", "cannot_conclude"))
    return _violations(loose.join(citations.select("claim_id").distinct().hint("merge"), "claim_id", "left_anti"), "hypothesis_label")


def min_sources(case_sources: DataFrame, n: int = 2) -> DataFrame:
    few = case_sources.groupBy("case_id").agg(F.countDistinct("source").alias("n")).where(F.col("n") < n)
    return few.select("case_id", F.lit(None).cast("long").alias("claim_id"), F.lit("min_sources").alias("rule"))


def pii(claims: DataFrame, packs: DataFrame | None = None) -> DataFrame:
    """Each kind of personal data in a statement, or in a pack's title or summary (no claim), ``packs`` being (case_id, title, summary)."""
    texts = claims.select("case_id", "claim_id", F.col("statement").alias("text"))
    if packs is not None:
        own = packs.select("case_id", F.lit(None).cast(dict(claims.dtypes)["claim_id"]).alias("claim_id"), F.explode(F.array("title", "summary")).alias("text"))
        texts = texts.unionByName(own)
    return _violations(texts.where("text is not null").withColumn("kind", F.explode(X.detect_pii(F.col("text")))), "pii")


def verdicts(cases: DataFrame, violations: DataFrame) -> DataFrame:
    """``(case_id, approved, n_violations, rules)`` for every case; rules names each broken rule and how often, as ``rule:n,...``."""
    each = violations.groupBy("case_id", "rule").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "rule", "n"))), ",")  # seven rules at most
    by = each.groupBy("case_id").agg(F.sum("n").alias("n"), rules.alias("rules"))
    return cases.join(by, "case_id", "left").select("case_id", F.col("n").isNull().alias("approved"), F.coalesce("n", F.lit(0)).alias("n_violations"), F.coalesce("rules", F.lit("")).alias("rules"))


def case_status(verdict: DataFrame, failed: DataFrame) -> DataFrame:
    joined = verdict.join(failed.select("case_id").distinct().withColumn("failed", F.lit(True)), "case_id", "left")
    return joined.select("case_id", F.when(F.col("failed"), "failed").when(F.col("approved"), "complete").otherwise("insufficient_evidence").alias("status"))
