"""Case composition: cited claims, timelines and packs for all cases at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlight.functions.columns import claim_id

# fixed values: codes of awards without competition, as the composer reads them
SOLE_SOURCE_COMPOSER = ("NOT COMPETED", "SOLE SOURCE", "C", "D")
CLOSING = "All factual claims are supported by cited artifacts. This document contains risk signals and hypotheses only; it does not constitute an accusation of wrongdoing."


def _claim(df: DataFrame, key: str, statement: Column, kind: str, confidence: Column | float, cited: int, listed: int) -> DataFrame:
    value = confidence if isinstance(confidence, Column) else F.lit(confidence)
    out = df.withColumn("statement", statement)
    return out.select(
        "case_id", claim_id(F.col("case_id").cast("string"), F.lit(key), F.col("statement")).alias("claim_id"), "statement", F.lit(kind).alias("claim_type"), value.alias("confidence"),
        F.slice("artifact_ids", 1, cited).alias("citation_ids"), F.slice("artifact_ids", 1, listed).alias("artifact_ids"),
    )


def entity_claims(profiles: DataFrame) -> DataFrame:
    """Findings on registration and identifier, for profiles with artifacts."""
    with_ids = profiles.where(F.size("artifact_ids") > 0)
    registered = _claim(with_ids.where("canonical_name <> ''"), "entity_registered", F.concat("canonical_name", F.lit(" is registered as a federal "), "entity_type", F.lit(".")), "finding", 1.0, 1, 3)
    uei = F.concat("canonical_name", F.lit(" has Unique Entity Identifier (UEI): "), "uei", F.lit("."))
    return registered.unionByName(_claim(with_ids.where(F.coalesce("uei", F.lit("")) != ""), "entity_uei", uei, "finding", 1.0, 1, 1))


def award_digest(awards: DataFrame) -> DataFrame:
    """Per case the number of awards, their total in cents and the distinct agencies."""
    sole = F.coalesce("is_sole_source", F.lit(False)) | F.coalesce(F.upper("extent_competed").isin(*SOLE_SOURCE_COMPOSER), F.lit(False))
    cents = F.round(F.coalesce("award_amount", F.lit(0.0)) * 100).cast("long")
    return awards.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_awards"), F.sum(cents).alias("total_cents"), F.countDistinct("awarding_agency").alias("agencies"), F.count_if(sole).alias("sole"))


def award_total_claims(digest: DataFrame) -> DataFrame:
    total = F.format_number((F.col("total_cents") / 100).cast("decimal(38,2)"), 2)
    return _claim(digest.where("total_cents > 0"), "award_total", F.concat(F.lit("Entity has received "), "n_awards", F.lit(" federal award(s) totaling $"), total, F.lit(".")), "finding", 1.0, 3, 5)


def sole_source_claims(digest: DataFrame) -> DataFrame:
    share = F.bround(100 * F.col("sole") / F.col("n_awards"), 0).cast("int")
    text = F.concat("sole", F.lit(" of "), "n_awards", F.lit(" awards ("), share, F.lit("%) were sole-source."))
    return _claim(digest.where("sole > 0"), "sole_source", text, "finding", 0.95, 2, 3)


def risk_claims(signals: DataFrame) -> DataFrame:
    """One risk_signal claim for each signal (case_id, rank, description, score)."""
    return signals.select("case_id", claim_id(F.col("case_id").cast("string"), F.concat(F.lit("risk_"), "rank"), F.col("description")).alias("claim_id"), F.col("description").alias("statement"), F.lit("risk_signal").alias("claim_type"), F.col("score").alias("confidence"))


def hypothesis_claims(claims: DataFrame, hypotheses: DataFrame, cap: int = 5) -> DataFrame:
    order = Window.partitionBy("case_id").orderBy(F.desc("confidence"), "statement")
    extra = hypotheses.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cap)
    extra = extra.select("case_id", claim_id(F.col("case_id").cast("string"), F.lit("hypothesis"), F.col("statement")).alias("claim_id"), "statement", F.lit("hypothesis").alias("claim_type"), "confidence")
    return claims.select("case_id", "claim_id", "statement", "claim_type", "confidence").unionByName(extra)


def pack_hash(claims: DataFrame, signals: DataFrame) -> DataFrame:
    """SHA-256 over each case's claims by claim_id, with sorted ids, and its signals by type; order of rows doesn't matter."""
    one = F.struct("claim_id", "statement", "claim_type", "confidence", F.array_sort("citation_ids").alias("citation_ids"))
    c = claims.groupBy("case_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("c"))
    s = signals.groupBy("case_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("anomaly_type", "severity", "score")))).alias("s"))
    return c.join(s, "case_id", "full").select("case_id", F.sha2(F.concat(F.coalesce("c", F.lit("[]")), F.lit("|"), F.coalesce("s", F.lit("[]"))), 256).alias("pack_hash"))


def timeline(awards: DataFrame) -> DataFrame:
    """Dated award events; dates stay text and sort as text."""
    return awards.where(F.coalesce("date", F.lit("")) != "").select("case_id", "date", F.concat(F.lit("Award "), "award_id").alias("event"), F.lit("award").alias("type"))


def summary(profiles: DataFrame, signals: DataFrame) -> DataFrame:
    counted = signals.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "high").alias("high"))
    joined = profiles.join(counted, "case_id", "left")
    name = F.coalesce("canonical_name", F.lit("Unknown Entity"))
    high = F.when(F.col("high") > 0, F.concat(F.lit(", including "), "high", F.lit(" high-severity"))).otherwise("")
    found = F.when(F.col("n") > 0, F.concat(F.lit("Analysis identified "), "n", F.lit(" risk signal(s)"), high, F.lit("."))).otherwise("No significant risk signals identified.")
    return joined.select("case_id", F.concat(F.lit("Investigative Case Pack: "), name).alias("title"), F.concat_ws(" ", F.concat(F.lit("Investigation of "), name, F.lit(".")), found, F.lit(CLOSING)).alias("summary"))


def evidence_summary(claims: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per case the claims by kind, their citations, and the distinct artifacts and sources that they cite."""
    cited = claims.select("case_id", F.explode("citation_ids").alias("artifact_id")).distinct()
    known = cited.hint("merge").join(artifacts.select("artifact_id", "source").hint("merge"), "artifact_id", "left")
    met = known.groupBy("case_id").agg(F.count(F.lit(1)).alias("artifacts"), F.countDistinct("source").alias("sources"))
    zero = F.lit(0).cast("long")
    return _by_kind(claims).hint("merge").join(met.hint("merge"), "case_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("artifacts", "sources")})


def _by_kind(claims: DataFrame) -> DataFrame:
    kinds = ("finding", "risk_signal", "hypothesis")
    return claims.groupBy("case_id").agg(F.count(F.lit(1)).alias("claims"), *(F.count_if(F.col("claim_type") == k).alias(k) for k in kinds), F.sum(F.size("citation_ids")).alias("citations"))


def pack_rollup(claims: DataFrame) -> DataFrame:
    return claims.groupBy("case_id").agg(F.count(F.lit(1)).alias("claim_count"), F.sum(F.size("citation_ids")).alias("citation_count"), F.bool_and("audit_passed").alias("all_audited")).withColumn("storage_path", F.concat(F.lit("packs/"), "case_id", F.lit(".json")))
