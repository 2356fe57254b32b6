"""Flatteners of landed API responses: one row per record, missing keys null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlight.functions import text as X
from spendlight.operators.matching import contained

# fixed values: field names of the responses and what they are called here
USASPENDING = {"Award ID": "award_id", "Recipient Name": "recipient_name", "Award Amount": "award_amount", "Awarding Agency": "awarding_agency", "Award Type": "award_type", "Start Date": "start_date", "End Date": "end_date", "Recipient UEI": "recipient_uei", "Extent Competed": "extent_competed", "NAICS Code": "naics_code", "internal_id": "internal_id", "generated_internal_id": "generated_internal_id"}
SAM = {"noticeId": "notice_id", "title": "title", "solicitationNumber": "solicitation_number", "fullParentPathName": "agency", "naicsCode": "naics_code", "classificationCode": "classification_code", "postedDate": "posted_date", "responseDeadLine": "response_deadline", "type": "type", "baseType": "base_type", "typeOfSetAside": "set_aside", "typeOfSetAsideDescription": "set_aside_description", "officeAddress": "office_address", "award": "award", "uiLink": "ui_link"}
SEC = {"accession_no": "accession_number", "cik": "cik", "entity_name": "entity_name", "form_type": "form_type", "file_date": "file_date", "period_of_report": "period_of_report", "file_num": "file_number", "file_name": "file_name", "display_name": "description"}
COMMITTEE = ["committee_id", "name", "committee_type", "designation", "organization_type", "state", "party", "treasurer_name", "first_file_date"]
RECEIPT = ["sub_id", "committee_id", "contributor_name", "contributor_employer", "contributor_occupation", "contributor_city", "contributor_state", "contribution_receipt_amount", "contribution_receipt_date", "memo_text", "line_number"]
DOC_TYPES = {"usaspending": "contract_award", "doj": "press_release", "sec_edgar": "financial_filing", "oversight": "ig_report", "openfec": "fec_record", "sam_gov": "contract_opportunity"}
AWARD_TYPES = ("A", "B", "C", "D")
FORMS = ("10-K", "10-Q", "8-K", "DEF 14A", "S-1")


def _struct(names) -> str:
    return "struct<" + ",".join(f"`{n}`:string" for n in names) + ">"


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Landed responses: one JSON document a file, or with ``lines`` one a line, which Spark can split."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def _flat(raw: DataFrame, path: str, names: dict[str, str]) -> DataFrame:
    return raw.select(F.explode(path).alias("r")).select(*(F.col("r").getField(k).alias(v) for k, v in names.items()))


USASPENDING_SCHEMA = f"results array<{_struct(USASPENDING)}>"
SAM_SCHEMA = f"opportunitiesData array<struct<{','.join(f'`{n}`:string' for n in SAM)},pointOfContact:array<struct<fullName:string,email:string,type:string>>>>"
SEC_SCHEMA = f"hits struct<hits:array<struct<_source:{_struct(SEC)}>>>"
DOJ_SCHEMA = "results array<struct<uuid:string,title:string,date:string,body:string,url:string,component:struct<name:string>,topic:array<struct<name:string>>>>"
OVERSIGHT_RECORD = "struct<id:string,title:string,agency:string,report_type:string,published_date:string,url:string,summary:string,report_number:string,recommendations_count:bigint,monetary_findings:bigint>"
COMMITTEE_LISTS = {"cycles": "array<int>", "sponsor_candidate_ids": "array<string>"}
FEC_SCHEMA = {"committee": f"results array<struct<{','.join([*(f'`{n}`:string' for n in COMMITTEE), *(f'`{n}`:{k}' for n, k in COMMITTEE_LISTS.items())])}>>", "receipt": f"results array<struct<{','.join(f'`{n}`:string' for n in RECEIPT)},committee:struct<name:string>>>"}


def flatten_usaspending(raw: DataFrame) -> DataFrame:
    return _flat(raw, "results", USASPENDING).withColumn("source", F.lit("usaspending"))


def flatten_sam(raw: DataFrame) -> DataFrame:
    base = raw.select(F.explode("opportunitiesData").alias("r"))
    contacts = F.transform("r.pointOfContact", lambda c: F.struct(c["fullName"].alias("name"), c["email"].alias("email"), c["type"].alias("type")))
    return base.select(*(F.col(f"r.{k}").alias(v) for k, v in SAM.items()), contacts.alias("point_of_contact"))


def flatten_sec(raw: DataFrame) -> DataFrame:
    """Filings; the document's address only where cik, accession number and file name are all there."""
    out = raw.select(F.explode("hits.hits").alias("h")).select(*(F.col(f"h._source.{k}").alias(v) for k, v in SEC.items()))
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), "cik", F.lit("/"), F.regexp_replace("accession_number", "-", ""), F.lit("/"), "file_name")
    return out.withColumn("document_url", F.when((F.col("cik") != "") & (F.col("accession_number") != "") & (F.col("file_name") != ""), url).otherwise(""))


def flatten_doj(raw: DataFrame) -> DataFrame:
    r = raw.select(F.explode("results").alias("r")).select("r.uuid", "r.title", "r.date", "r.body", "r.url", F.col("r.component.name").alias("component"), F.transform("r.topic", lambda t: t["name"]).alias("topics"))
    both = F.concat_ws(" ", "title", "body")
    return r.select("*", X.amounts_raw(both).alias("amounts"), X.case_numbers_raw(both).alias("case_numbers"), X.districts(both, raw=True).alias("districts"), fraud_topic(both).alias("is_fraud"))


def flatten_oversight(raw_text: DataFrame) -> DataFrame:
    """Inspection reports of a column ``value`` of JSON text: a bare list, or an object with results."""
    records = F.coalesce(F.from_json("value", f"array<{OVERSIGHT_RECORD}>"), F.from_json("value", f"results array<{OVERSIGHT_RECORD}>")["results"])
    bare = F.startswith(F.ltrim("value"), F.lit("["))
    chosen = F.when(bare, F.from_json("value", f"array<{OVERSIGHT_RECORD}>")).otherwise(F.from_json("value", f"results array<{OVERSIGHT_RECORD}>")["results"])
    return raw_text.select(F.explode(F.coalesce(chosen, records)).alias("r")).select("r.*").withColumnRenamed("id", "report_id")


def flatten_fec_committee(raw: DataFrame) -> DataFrame:
    return _flat(raw, "results", {n: n for n in [*COMMITTEE, *COMMITTEE_LISTS]})


def flatten_fec_receipt(raw: DataFrame) -> DataFrame:
    return raw.select(F.explode("results").alias("r")).select(*(F.col(f"r.{n}").alias(n) for n in RECEIPT), F.col("r.committee.name").alias("committee_name"))


def canonical_url(source: Column, base: Column, url: Column, record_id: Column) -> Column:
    """One stable address per record: its own (completed by ``base``), else one made of its id."""
    own = F.coalesce(url, F.lit(""))
    completed = F.when(own == "", None).when(F.startswith(own, F.lit("http")), own).otherwise(F.concat(base, own))
    made = F.when(source == "usaspending", F.concat(base, F.lit("/api/v2/awards/"), record_id, F.lit("/")))
    for name, pattern in (("doj", "/press-release/"), ("oversight", "/reports/"), ("sam_gov", "/opp/"), ("openfec", "/committees/"), ("sec_edgar", "/cgi-bin/browse-edgar?action=getcompany&accession=")):
        made = made.when(source == name, F.concat(base, F.lit(pattern), record_id))
    return F.when(source.isin("usaspending", "sam_gov", "openfec"), made).otherwise(F.coalesce(completed, made))


def doc_type(source: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in DOC_TYPES.items() for x in pair)), source)


def time_slice(df: DataFrame, ts: str, since, until) -> DataFrame:
    return df.where(F.col(ts).between(since, until))


def clamp_since(since: Column, now: Column) -> Column:
    """``since`` where it is later than a year before ``now``, else that."""
    floor = now - F.expr("interval 365 days")
    return F.when(since > floor, since).otherwise(floor)


def award_filter(df: DataFrame, types=AWARD_TYPES, naics: list[str] | None = None, recipient: str | None = None) -> DataFrame:
    out = df.where(F.col("award_type").isin(*types))
    out = out.where(F.col("naics_code").isin(*naics)) if naics else out
    return out.where(F.contains(F.lower("recipient_name"), F.lit(recipient.lower()))) if recipient else out


def form_filter(df: DataFrame, forms=FORMS) -> DataFrame:
    return df.where(F.col("form_type").isin(*forms))


def fec_filter(df: DataFrame, committee_type: str | None = None, contributor: str | None = None, employer: str | None = None, least: float | None = None, since=None, until=None) -> DataFrame:
    """Committees of one type from a first filing on, or receipts by contributor, employer, amount and dates; names match in part and in any case."""
    part = lambda name, value: F.contains(F.lower(name), F.lit(value.lower()))
    date = "contribution_receipt_date" if "contribution_receipt_date" in df.columns else "first_file_date"
    given = [
        committee_type and (F.col("committee_type") == committee_type),
        contributor and part("contributor_name", contributor),
        employer and part("contributor_employer", employer),
        None if least is None else F.col("contribution_receipt_amount").try_cast("double") >= least,
        None if since is None else F.col(date) >= since,
        # committees have a first date only
        None if until is None or date == "first_file_date" else F.col(date) <= until,
    ]
    for condition in given:
        df = df if condition is None else df.where(condition)
    return df


def pass_through(df: DataFrame, *keys: str) -> DataFrame:
    """Records of an endpoint that has no flattener: their keys, and the record as it is, as JSON text."""
    others = [c for c in df.columns if c not in keys]
    return df.select(*keys, (F.col(others[0]) if len(others) == 1 and dict(df.dtypes)[others[0]] == "string" else F.to_json(F.struct(*others))).alias("record"))


CORRUPT = "corrupt__"


def open_landed(spark: SparkSession, folder: str, schema: str, files: int | None = None) -> DataFrame:
    """New files of landed responses (one a line) as a stream; a line that is no JSON is kept in CORRUPT, its fields null."""
    reader = spark.readStream.option("maxFilesPerTrigger", files) if files else spark.readStream
    # as text first: a stream of JSON files can't be asked for its corrupt lines alone
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return reader.text(folder).select(F.from_json("value", f"{schema}, {CORRUPT} string", options).alias("r")).select("r.*")


def fraud_topic(text: Column) -> Column:
    lowered = F.lower(text)
    out = F.lit(False)
    for topic in X.FRAUD_TOPICS:
        out = out | F.contains(lowered, F.lit(topic))
    return out


def mentions_entity(releases: DataFrame, names: DataFrame) -> DataFrame:
    """``(doc_id, name)``: names that title and body contain, in any case."""
    texts = releases.select("doc_id", F.lower(F.concat_ws(" ", "title", "body")).alias("body"))
    return contained(texts, "body", names.select("name", F.lower("name").alias("lowered")).distinct(), "lowered").select("doc_id", "name").distinct()


def write_table(df: DataFrame, path: str, partition: str | None = None, mode: str = "append") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(partition) if partition else writer).parquet(path)
