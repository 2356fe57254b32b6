"""Serving queries, indicators and usage analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlight.operators.ranking import median

# fixed values: price per thousand tokens by provider, per token by model
PROVIDER_RATES = {"vertex": 0.000125, "openrouter": 0.0002, "vllm": 0.0}
OTHER_RATE = 0.0002


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows, each with the ``total`` of all pages."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def list_cases(cases: DataFrame, status: str | None, number: int = 1, size: int = 20) -> DataFrame:
    chosen = cases if status is None else cases.where(F.col("status") == status)
    return page(chosen, [F.desc("created_at"), "case_id"], number, size)


def dedupe_cases(requests: DataFrame, cases: DataFrame) -> DataFrame:
    """Each request's existing case: the first that hasn't failed with equal title and seed, else none."""
    key = F.sha2(F.concat_ws(":", "title", "seed"), 256)
    first = cases.where("status <> 'failed'").withColumn("key", key).groupBy("key").agg(F.min_by("case_id", F.struct("created_at", "case_id")).alias("existing"))
    return requests.withColumn("key", key).join(first, "key", "left").select("request_id", "existing")


def case_pack(cases: DataFrame, claims: DataFrame, citations: DataFrame, events: DataFrame, packs: DataFrame) -> DataFrame:
    """Complete or auditing cases with their newest pack, if any, and its claims, citations and audit events as lists.

    A case's lists are its pack, as it is served; each is gathered and sorted by itself.
    """
    ready = cases.where(F.col("status").isin("complete", "auditing")).select("case_id")
    newest = packs.groupBy("case_id").agg(F.max(F.struct("generated_at", "pack_id")).alias("m")).select("case_id", "m.pack_id", "m.generated_at")
    out = ready.hint("merge").join(newest.hint("merge"), "case_id", "left")
    for name, rows in (("claims", claims), ("citations", citations), ("audit_events", events)):
        fields = [c for c in rows.columns if c != "case_id"]
        part = rows.hint("merge").join(ready.hint("merge"), "case_id", "left_semi").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        kind = dict(part.dtypes)[name]
        out = out.hint("merge").join(part.hint("merge"), "case_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def search_entities(entities: DataFrame, q: str, kind: str | None = None, number: int = 1, size: int = 20, wildcards: bool = False) -> DataFrame:
    """Names that contain ``q`` in any case, or equal identifiers; ``wildcards`` reads % and _ in ``q``."""
    name = F.col("canonical_name").ilike(f"%{q}%") if wildcards else F.contains(F.lower("canonical_name"), F.lit(q.lower()))
    hit = entities.where(name | (F.col("uei") == q) | (F.col("cage_code") == q))
    return page(hit if kind is None else hit.where(F.col("entity_type") == kind), ["canonical_name", "entity_id"], number, size)


def search_artifacts(artifacts: DataFrame, q: str, source: str | None = None, number: int = 1, size: int = 20) -> DataFrame:
    hit = artifacts.where(F.contains(F.lower("source_url"), F.lit(q.lower())) | (F.col("content_hash") == q))
    return page(hit if source is None else hit.where(F.col("source") == source), [F.desc("retrieved_at"), "artifact_id"], number, size)


def status_counts(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count(F.lit(1)).alias("all_cases"), F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status").isin("pending", "processing", "auditing")).alias("processing"), F.count_if(F.col("status") == "insufficient_evidence").alias("blocked"))


def sort_cases(cases: DataFrame, field: str, desc: bool = False, status: str | None = None, size: int = 50) -> DataFrame:
    """The first ``size`` cases by any field, ties by id."""
    chosen = cases if status is None else cases.where(F.col("status") == status)
    return chosen.orderBy(F.desc(field) if desc else F.asc(field), "case_id").limit(size)


def pass_rate(packs: DataFrame) -> DataFrame:
    return packs.agg((F.count_if("all_audited") / F.count(F.lit(1))).alias("pass_rate"))


def block_rate(events: DataFrame) -> DataFrame:
    return events.agg((F.count_if(F.col("decision") == "blocked") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("block_rate"))


def median_latency(cases: DataFrame, packs: DataFrame) -> DataFrame:
    """Median seconds from case to pack; negative ones are left out."""
    seconds = F.unix_seconds(F.col("generated_at").cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    waited = cases.join(packs, "case_id").select(seconds.alias("s")).where("s >= 0")
    return cases.sparkSession.createDataFrame([(median(waited, "s"),)], "median_seconds double")


def totals(cases: DataFrame, artifacts: DataFrame, sources: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(cases, "cases").crossJoin(one(artifacts, "artifacts")).crossJoin(one(sources, "sources"))


def last_24h(tables: dict[str, tuple[DataFrame, str]], as_of: Column) -> DataFrame:
    out = None
    for name, (df, ts) in tables.items():
        n = df.agg(F.count_if(F.col(ts) >= as_of - F.expr("interval 1 day")).alias(name))
        out = n if out is None else out.crossJoin(n)
    return out


def pack_report(claims: DataFrame, events: DataFrame) -> DataFrame:
    """Per case its findings, risk signals, the share of claims that passed the audit, and the distinct stages of its audit events."""
    stages = events.groupBy("case_id").agg(F.countDistinct("stage").alias("stages"))
    return _pack_counts(claims).join(stages, "case_id", "left").withColumn("stages", F.coalesce("stages", F.lit(0)).cast("long"))


def public_kpis(packs: DataFrame, audit_events: DataFrame, cases: DataFrame, artifacts: DataFrame, sources: DataFrame, mentions: DataFrame, as_of: Column) -> DataFrame:
    """One row: pass and block rates and resolution coverage to four places, median latency to two, totals and those of the last day; no rows count as 0."""
    one = lambda df, name, places: df.select(F.round(F.coalesce(name, F.lit(0.0)), places).alias(name))
    coverage = mentions.agg((F.count("resolved_entity_id") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("entity_coverage"))
    blocked = audit_events.where("decision = 'blocked'")
    out = one(pass_rate(packs), "pass_rate", 4)
    for df in (
        one(block_rate(audit_events), "block_rate", 4), one(median_latency(cases, packs), "median_seconds", 2), one(coverage, "entity_coverage", 4), totals(cases, artifacts, sources),
        last_24h({"cases_24h": (cases, "created_at"), "artifacts_24h": (artifacts, "retrieved_at"), "blocks_24h": (blocked, "ts")}, as_of),
    ):
        out = out.crossJoin(F.broadcast(df))  # one row each
    return out


def _pack_counts(claims: DataFrame) -> DataFrame:
    return claims.groupBy("case_id").agg(F.count_if(F.col("claim_type").isin("finding", "factual")).alias("findings"), F.count_if(F.col("claim_type") == "risk_signal").alias("risk_signals"), (F.count_if("audit_passed") / F.count(F.lit(1))).alias("audited_share"))


def usage_cost(usage: DataFrame) -> DataFrame:
    """Each call's cost by its provider's rate."""
    rate = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in PROVIDER_RATES.items() for x in pair)), F.col("provider")), F.lit(OTHER_RATE))
    return usage.withColumn("cost", (F.col("prompt_tokens") + F.col("output_tokens")) / 1000.0 * rate)


def usage_cost_model(usage: DataFrame, prices: DataFrame, default: tuple[float, float]) -> DataFrame:
    joined = usage.join(prices, "model", "left")
    return joined.withColumn("cost", F.col("prompt_tokens") * F.coalesce("input_price", F.lit(default[0])) + F.col("output_tokens") * F.coalesce("output_price", F.lit(default[1])))


def case_budget(costed: DataFrame, limit: float = 0.5) -> DataFrame:
    by = costed.groupBy("case_id").agg(F.sum(F.col("cost").cast("decimal(28,12)")).cast("double").alias("spent"))
    return by.select("case_id", "spent", (F.col("spent") < limit).alias("within"))


def daily_spend(costed: DataFrame) -> DataFrame:
    return costed.groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.col("cost").cast("decimal(28,12)")).cast("double").alias("spent"))


def rate_per_minute(requests: DataFrame, limit: int = 60) -> DataFrame:
    by = requests.groupBy("scope", F.date_trunc("minute", "ts").alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    return by.select("scope", "minute", "n", (F.col("n") > limit).alias("over_limit"), F.greatest(F.lit(0), limit - F.col("n")).alias("remaining"))


def rate_verdicts(requests: DataFrame, limit: int = 60) -> DataFrame:
    """Whether each request was within its minute's limit."""
    order = Window.partitionBy("scope", F.date_trunc("minute", "ts")).orderBy("ts", "request_id")
    return requests.select("request_id", (F.row_number().over(order) <= limit).alias("allowed"))


def repeat_share(requests: DataFrame) -> DataFrame:
    key = F.sha2(F.to_json(F.struct("model", "prompt", "system")), 256)
    return requests.agg(((F.count(F.lit(1)) - F.countDistinct(key)) / F.count(F.lit(1))).alias("repeated"))
