"""Jobs over whole tables of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlight.functions import text as X


def spread(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``docs`` dealt out by doc_id before many patterns are run over it, into as many partitions as shuffles have or ``parts``."""
    return docs.repartition(parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def extract_facts(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, fact_type, value, value_usd)``: every fact of every document (title and body)."""
    whole = F.concat_ws(" ", "title", "body")
    base = spread(docs).select("doc_id", "source", "title", whole.alias("whole"))
    texts = {
        "docket": X.case_numbers(F.col("whole")),
        "district": X.districts(F.col("whole")),
        "statute": X.statutes(F.col("whole")),
        "action": X.actions(F.col("whole")),
        "uei": X.identifiers(F.col("whole"))["uei"],
        "defendant": F.array_compact(F.array(X.defendant(F.col("title")))),
    }

    def fact(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("fact_type"), x.alias("value"), F.lit(None).cast("double").alias("value_usd"))

    values = F.transform(X.amounts(F.col("whole")), lambda x: F.struct(F.lit("amount").alias("fact_type"), F.lit(None).cast("string").alias("value"), x.alias("value_usd")))
    facts = F.flatten(F.array(*(F.transform(v, fact(k)) for k, v in texts.items()), values))
    return base.select("doc_id", "source", F.explode(facts).alias("f")).select("doc_id", "source", "f.fact_type", "f.value", "f.value_usd")


def relevance(docs: DataFrame, keywords: list[str]) -> DataFrame:
    """``(doc_id, source, matches, score)`` of the documents that hold a keyword."""
    scored = docs.withColumn("r", X.relevance(F.concat_ws(" ", "title", "body"), keywords)).where("r.relevant")
    return scored.select("doc_id", "source", F.size("r.matches").alias("n_matches"), F.col("r.score").alias("score"))


def privacy_report(docs: DataFrame) -> DataFrame:
    """``(source, kind, docs, hits)``: personal data by kind and source."""
    kinds = {"ssn": X.SSN, "phone": X.PHONE, "personal_email": X.PERSONAL_EMAIL}
    hits = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_count(F.col("body"), F.lit(p)).alias("n")) for k, p in kinds.items()))
    long = docs.select("source", F.explode(hits).alias("h")).where("h.n > 0")
    return long.groupBy("source", F.col("h.kind").alias("kind")).agg(F.count(F.lit(1)).alias("docs"), F.sum("h.n").alias("hits"))


def masked_copy(docs: DataFrame) -> DataFrame:
    """``docs`` with numbers and personal addresses masked in title and body."""
    return docs.select(*(X.mask_mention(F.col(c)).alias(c) if c in ("title", "body") else F.col(c) for c in docs.columns))


def screen(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents that may pass, and ``(doc_id, reason)`` of those that may not."""
    reasons = F.array_compact(F.concat(X.screen_input(F.col("body"))["reasons"], F.array(F.when(X.banned_phrase(F.col("body")).isNotNull(), "banned_phrase"), F.when(F.size(X.certainty(F.col("body"))) > 0, "certainty"))))
    marked = docs.withColumn("reasons", reasons)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.select("doc_id", F.explode("reasons").alias("reason"))


def release_mentions(docs: DataFrame) -> DataFrame:
    """``(doc_id, name, type, role)``: topics over three characters, the component, the defendant."""
    topics = F.transform(F.filter("topics", lambda x: F.length(x) > 3), lambda x: F.struct(x.alias("name"), F.lit("topic").alias("type"), F.lit("subject").alias("role")))
    one = lambda name, kind, role: F.when(F.coalesce(name, F.lit("")) != "", F.struct(name.alias("name"), F.lit(kind).alias("type"), F.lit(role).alias("role")))
    named = F.array_compact(F.array(one(F.col("component"), "agency", "prosecutor"), one(X.defendant(X.sanitize(F.col("title"))), "vendor", "defendant")))
    return docs.select("doc_id", F.explode(F.concat(topics, named)).alias("m")).select("doc_id", "m.name", "m.type", "m.role")
