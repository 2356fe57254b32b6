"""Parsed forms of landed records: releases, filings and inspection reports, one row per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlight.functions import text as X


def _given(*names: str) -> list[Column]:
    """Text columns with nulls as blanks."""
    return [F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names]


def _mention(name: str, kind: str, role: str) -> Column:
    """An array of the one mention, empty where the name is blank."""
    own = F.coalesce(F.col(name), F.lit(""))
    return F.when(own != "", F.array(F.struct(own.alias("name"), F.lit(kind).alias("type"), F.lit(role).alias("role")))).otherwise(F.array().cast("array<struct<name:string,type:string,role:string>>"))


def _release_mentions() -> Column:
    one = lambda name, kind, role: F.struct(name.alias("name"), F.lit(kind).alias("type"), F.lit(role).alias("role"))
    topics = F.transform(F.filter("topics", lambda x: F.length(x) > 3), lambda x: one(X.sanitize(x), "topic", "topic"))
    component, defendant = F.col("component"), X.defendant(X.sanitize(F.col("title")))
    others = F.array(F.when(component != "", one(X.sanitize(component), "government_agency", "doj_component")), F.when(defendant.isNotNull(), one(defendant, "vendor", "defendant")))
    return F.concat(topics, F.array_compact(others))


def parse_releases(releases: DataFrame) -> DataFrame:
    """Press releases (doc_id, title, body, date, component, topics) with amounts, dockets, districts, statutes and actions of title and body.

    Their mentions are the topics of more than three letters, the component and the defendant that the title names, without markup.
    """
    base = releases.select("doc_id", *_given("title", "body", "date", "component"), F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))
    base = base.withColumn("whole", F.concat_ws("\n\n", "title", "body"))
    whole = F.col("whole")
    found = base.select(
        "doc_id", F.lit("press_release").alias("doc_type"), F.lit("doj").alias("source"), "title", "date", "component", "topics",
        X.amounts(whole).alias("settlement_amounts"), X.case_numbers(whole).alias("case_numbers"), X.districts(whole).alias("districts"),
        X.statutes(whole).alias("statutes_cited"), X.actions(whole).alias("enforcement_actions"), _release_mentions().alias("entities_found"),
    )
    return found.withColumn("fraud_relevant", (F.size("statutes_cited") > 0) | (F.size("enforcement_actions") > 0))


def parse_filings(filings: DataFrame) -> DataFrame:
    """Filings of the sec flattener with the filing entity, the details, the relevance to government contracts and the filer as mention."""
    filings = filings if "sic_code" in filings.columns else filings.withColumn("sic_code", F.lit(""))
    named = ["entity_name", "cik", "file_number", "sic_code", "accession_number", "form_type", "file_date", "period_of_report", "document_url", "description"]
    base = filings.select("doc_id", *_given(*named))
    details = F.struct("accession_number", "form_type", "file_date", "period_of_report", "document_url", "description")
    entity = F.struct(F.col("entity_name").alias("name"), "cik", "file_number", "sic_code")
    relevance = X.relevance(F.concat_ws(" ", "entity_name", "description"), X.GOVERNMENT_KEYWORDS)
    return base.select("doc_id", F.lit("sec_filing").alias("doc_type"), F.lit("sec_edgar").alias("source"), entity.alias("entity"), details.alias("filing_details"), relevance.alias("gov_contract_relevance"), _mention("entity_name", "vendor", "filer").alias("entities_found"))


def parse_reports(reports: DataFrame) -> DataFrame:
    """Inspection reports with the report, its findings and amounts, the relevance to procurement and the inspected agency as mention."""
    counts = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("recommendations_count", "monetary_findings")]
    base = reports.select("doc_id", *_given("report_id", "title", "agency", "report_type", "published_date", "report_number", "url", "summary"), *counts)
    whole = F.concat_ws("\n", "title", "summary")
    report = F.struct("report_id", "title", "agency", "report_type", "published_date", "report_number", "url")
    findings = F.struct("summary", "recommendations_count", "monetary_findings", X.amounts_plain(whole).alias("extracted_amounts"))
    return base.select("doc_id", F.lit("ig_report").alias("doc_type"), F.lit("oversight_gov").alias("source"), report.alias("report"), findings.alias("findings"), X.relevance(whole, X.PROCUREMENT_KEYWORDS).alias("procurement_relevance"), _mention("agency", "government_agency", "inspected_agency").alias("entities_found"))
