"""Queries of landing, ingest, parsing and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendlight.functions import text as X
from spendlight.operators import awards as W
from spendlight.operators import ingest as I
from spendlight.operators import parsing as P
from spendlight.plans import bridges as B
from spendlight.plans.catalog import query
from spendlight.sources import landing as L
from spendlight.sources.tables import KeyedTable
from spendlight.storage import place_for
from spendlight.streaming import chain as C
from spendlight.streaming import events as S
from spendlight.streaming.state import first_in_ttl, timed_state

# ---- sources: landed responses are derived from the given tables as JSON text and parsed back with the declared schemas


#: Records of a landed response.
PAGE = 100


def _pages(df, record):
    """Landed responses of up to PAGE records each, in the order in which they come: ``(r array)``."""
    numbered = df.select(record.alias("record"), F.monotonically_increasing_id().alias("n"))
    return numbered.groupBy(F.floor(F.col("n") / PAGE).alias("page")).agg(F.collect_list("record").alias("r"))


def _landed(t, df, schema, record, wrap):
    """``df`` landed as files of JSON responses in the shared folder, read back with ``schema``."""
    path = place_for(t.spark, "landed")
    _pages(df, record).select(F.to_json(wrap(F.col("r"))).alias("value")).write.option("compression", "gzip").text(path)
    return L.read_json(t.spark, path, schema, lines=True)


def _usaspending(t):
    kinds = F.array(*(F.lit(x) for x in "ABCDE"))
    day = F.date_format("start_ts", "yyyy-MM-dd")
    rec = F.struct(
        F.col("award_id").alias("Award ID"), F.col("vendor_id").alias("Recipient Name"), F.col("award_amount").cast("string").alias("Award Amount"), F.col("awarding_agency").alias("Awarding Agency"),
        kinds[(F.col("order_id") % 5).cast("int")].alias("Award Type"), day.alias("Start Date"), F.when(F.col("order_id") % 2 == 0, day).alias("End Date"), F.concat(F.lit("U"), "vendor_id").alias("Recipient UEI"),
        F.col("extent_competed").alias("Extent Competed"), F.lit("336411").alias("NAICS Code"), F.col("order_id").cast("string").alias("internal_id"), F.concat(F.lit("CONT_"), "award_id").alias("generated_internal_id"),
    )
    return L.flatten_usaspending(_landed(t, B.awards(t), L.USASPENDING_SCHEMA, rec, lambda r: F.struct(r.alias("results"))))


_USA = f"with {B.AWARDS} select 'usaspending' source, award_id, vendor_id recipient_name, cast(award_amount as double) award_amount, awarding_agency, (['A','B','C','D','E'])[order_id%5+1] award_type, strftime(start_ts,'%Y-%m-%d') start_date, case when order_id%2=0 then strftime(start_ts,'%Y-%m-%d') end end_date, concat('U',vendor_id) recipient_uei, extent_competed, '336411' naics_code, cast(order_id as varchar) internal_id, concat('CONT_',award_id) generated_internal_id from awards"


@query("src_usaspending", _USA)
def _(t):
    return _usaspending(t).withColumn("award_amount", F.col("award_amount").cast("double"))


@query("src_award_filter", f"select * from ({_USA}) where award_type in ('A','B','C','D') and contains(lower(recipient_name), '1')")
def _(t):
    return L.award_filter(_usaspending(t), recipient="1").withColumn("award_amount", F.col("award_amount").cast("double"))


@query("src_sam", "select cast(p_partkey as varchar) notice_id, p_name title, concat('S-',p_partkey) solicitation_number, p_brand agency, '541' naics_code, concat('C',p_size) classification_code, '2024-01-02' posted_date, case when p_partkey%2=0 then '2024-02-02' end response_deadline, p_type as type, 'base' base_type, 'SBA' set_aside, 'Small business' set_aside_description, concat('{\"city\":\"',p_brand,'\"}') office_address, case when p_partkey%3=0 then concat('{\"amount\":',p_size,'}') end award, concat('https://sam.gov/opp/',p_partkey) ui_link, 1 contacts from part")
def _(t):
    k = F.col("p_partkey")
    rec = F.struct(
        k.cast("string").alias("noticeId"), F.col("p_name").alias("title"), F.concat(F.lit("S-"), k).alias("solicitationNumber"), F.col("p_brand").alias("fullParentPathName"), F.lit("541").alias("naicsCode"), F.concat(F.lit("C"), "p_size").alias("classificationCode"),
        F.lit("2024-01-02").alias("postedDate"), F.when(k % 2 == 0, "2024-02-02").alias("responseDeadLine"), F.col("p_type").alias("type"), F.lit("base").alias("baseType"), F.lit("SBA").alias("typeOfSetAside"), F.lit("Small business").alias("typeOfSetAsideDescription"),
        F.struct(F.col("p_brand").alias("city")).alias("officeAddress"), F.when(k % 3 == 0, F.struct(F.col("p_size").alias("amount"))).alias("award"), F.concat(F.lit("https://sam.gov/opp/"), k).alias("uiLink"), F.array(F.struct(F.lit("A").alias("fullName"))).alias("pointOfContact"),
    )
    raw = _landed(t, t("part"), L.SAM_SCHEMA, rec, lambda r: F.struct(r.alias("opportunitiesData")))
    return L.flatten_sam(raw).withColumn("contacts", F.size("point_of_contact")).drop("point_of_contact")


def _sec(t):
    k = F.col("o_orderkey")
    forms = F.array(*(F.lit(x) for x in ("10-K", "8-K", "S-1", "4")))
    src = F.struct(
        F.concat_ws("-", F.lit("0001"), k.cast("string")).alias("accession_no"), F.col("o_custkey").cast("string").alias("cik"), F.concat(F.lit("Firm "), "o_custkey").alias("entity_name"), forms[(k % 4).cast("int")].alias("form_type"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("file_date"), F.lit("2023").alias("period_of_report"), F.concat(F.lit("f-"), k).alias("file_num"), F.when(k % 3 != 0, F.concat(F.lit("f"), k, F.lit(".htm"))).alias("file_name"), F.concat(F.lit("procurement report of "), "o_orderpriority").alias("display_name"),
    )
    return L.flatten_sec(_landed(t, t("orders"), L.SEC_SCHEMA, F.struct(src.alias("_source")), lambda r: F.struct(F.struct(r.alias("hits")).alias("hits"))))


_SEC = "select concat('0001-',o_orderkey) accession_number, cast(o_custkey as varchar) cik, concat('Firm ',o_custkey) entity_name, (['10-K','8-K','S-1','4'])[o_orderkey%4+1] form_type, strftime(o_orderdate,'%Y-%m-%d') file_date, '2023' period_of_report, concat('f-',o_orderkey) file_number, case when o_orderkey%3<>0 then concat('f',o_orderkey,'.htm') end file_name, concat('procurement report of ',o_orderpriority) description, case when o_orderkey%3<>0 then concat('https://www.sec.gov/Archives/edgar/data/',o_custkey,'/0001',o_orderkey,'/f',o_orderkey,'.htm') else '' end document_url from orders"


@query("src_sec", _SEC)
def _(t):
    return _sec(t)


@query("src_form_filter", f"select * from ({_SEC}) where form_type<>'4'")
def _(t):
    return L.form_filter(_sec(t))


@query("src_doj", f"with {B.RELEASES} select cast(doc_id as varchar) uuid, title, source component, len(regexp_extract_all(concat(title,' ',body), '{X.AMOUNT_RAW}')) amounts, len(regexp_extract_all(concat(title,' ',body), '{X.DISTRICT_RAW}')) districts from releases")
def _(t):
    rec = F.struct(F.col("doc_id").cast("string").alias("uuid"), "title", "body", F.struct(F.col("source").alias("name")).alias("component"), F.array(F.struct(F.lit("Fraud").alias("name"))).alias("topic"))
    raw = _landed(t, B.releases(t), L.DOJ_SCHEMA, rec, lambda r: F.struct(r.alias("results")))
    return L.flatten_doj(raw).select("uuid", "title", "component", F.size("amounts").alias("amounts"), F.size("districts").alias("districts"))


@query("src_oversight", "select cast(p_partkey as varchar) report_id, p_name title, p_brand agency, p_type report_type, '2024-02-03' published_date, concat('/r/', p_partkey) url, concat('audit of ', p_name) summary, concat('R-', p_partkey) report_number, p_partkey%7 recommendations_count, p_size::bigint monetary_findings from part")
def _(t):
    k = F.col("p_partkey")
    rec = F.struct(
        k.cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("agency"), F.col("p_type").alias("report_type"), F.lit("2024-02-03").alias("published_date"), F.concat(F.lit("/r/"), k).alias("url"),
        F.concat(F.lit("audit of "), "p_name").alias("summary"), F.concat(F.lit("R-"), k).alias("report_number"), (k % 7).alias("recommendations_count"), F.col("p_size").alias("monetary_findings"),
    )
    bodies = _pages(t("part"), rec)
    value = F.when(F.col("page") % 3 == 1, F.to_json("r")).otherwise(F.to_json(F.struct(F.col("r").alias("results"), F.size("r").alias("total"))))
    path = place_for(t.spark, "landed")
    bodies.select(value.alias("value")).write.text(path)
    return L.flatten_oversight(t.spark.read.text(path))


@query("src_fec_committee", "select cast(s_suppkey as varchar) committee_id, s_name as name, 'N' committee_type, 'U' designation, null::varchar organization_type, cast(s_nationkey as varchar) state, 'P' party, concat('T ',s_name) treasurer_name, '2001-02-03' first_file_date, [2020, 2022] cycles, case when s_suppkey%2=0 then [concat('P',s_suppkey)] end sponsor_candidate_ids from supplier")
def _(t):
    k = F.col("s_suppkey")
    rec = F.struct(
        k.cast("string").alias("committee_id"), F.col("s_name").alias("name"), F.lit("N").alias("committee_type"), F.lit("U").alias("designation"), F.col("s_nationkey").cast("string").alias("state"), F.lit("P").alias("party"), F.concat(F.lit("T "), "s_name").alias("treasurer_name"),
        F.lit("2001-02-03").alias("first_file_date"), F.array(F.lit(2020), F.lit(2022)).alias("cycles"), F.when(k % 2 == 0, F.array(F.concat(F.lit("P"), k))).alias("sponsor_candidate_ids"),
    )
    return L.flatten_fec_committee(_landed(t, t("supplier"), L.FEC_SCHEMA["committee"], rec, lambda r: F.struct(r.alias("results"))))


def _receipts(t):
    k = F.col("o_orderkey")
    rec = F.struct(
        k.cast("string").alias("sub_id"), F.concat(F.lit("C"), k % 13).alias("committee_id"), F.concat(F.lit("Donor "), "o_custkey").alias("contributor_name"), F.when(k % 3 != 0, F.concat(F.lit("Works "), k % 5)).alias("contributor_employer"), F.lit("clerk").alias("contributor_occupation"),
        F.lit("Reston").alias("contributor_city"), F.lit("VA").alias("contributor_state"), F.round("o_totalprice").cast("long").cast("string").alias("contribution_receipt_amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("contribution_receipt_date"),
        F.col("o_orderstatus").alias("memo_text"), F.lit("11AI").alias("line_number"), F.struct(F.col("o_orderpriority").alias("name")).alias("committee"),
    )
    return L.flatten_fec_receipt(_landed(t, t("orders"), L.FEC_SCHEMA["receipt"], rec, lambda r: F.struct(r.alias("results"))))


_REC = """select cast(o_orderkey as varchar) sub_id, concat('C', o_orderkey%13) committee_id, concat('Donor ',o_custkey) contributor_name, case when o_orderkey%3<>0 then concat('Works ', o_orderkey%5) end contributor_employer, 'clerk' contributor_occupation, 'Reston' contributor_city, 'VA' contributor_state,
 cast(cast(round(o_totalprice) as bigint) as varchar) contribution_receipt_amount, strftime(o_orderdate,'%Y-%m-%d') contribution_receipt_date, o_orderstatus memo_text, '11AI' line_number, o_orderpriority committee_name from orders"""


@query("src_fec_receipt", _REC)
def _(t):
    return _receipts(t)


@query("src_fec_filter", f"{_REC} where o_totalprice >= 200000 and o_orderdate >= timestamp '1995-01-01' and contains(lower(concat('Donor ',o_custkey)), 'donor 1') and o_orderkey%3<>0 and o_orderkey%5=2")
def _(t):
    return L.fec_filter(_receipts(t), contributor="DONOR 1", employer="works 2", least=200000.0, since="1995-01-01")


@query("src_fec_committees_filter", "select cast(s_suppkey as varchar) committee_id, concat('T', s_suppkey%4) committee_type, concat(2000+s_suppkey%9, '-01-01') first_file_date from supplier where s_suppkey%4=1 and 2000+s_suppkey%9>=2004")
def _(t):
    k = F.col("s_suppkey")
    committees = t("supplier").select(k.cast("string").alias("committee_id"), F.concat(F.lit("T"), k % 4).alias("committee_type"), F.concat(2000 + k % 9, F.lit("-01-01")).alias("first_file_date"))
    return L.fec_filter(committees, committee_type="T1", since="2004-01-01", until="2005-01-01")


@query("src_fec_generic", "select event_id, props as record from events")
def _(t):
    return L.pass_through(t("events").select("event_id", "props"), "event_id")


@query("src_landed_stream", "select 'award' kind, l_returnflag code, count(*) n from lineitem group by 1,2 union all select 'corrupt', left(o_orderstatus, 1), count(*) from orders where o_orderkey%10=3 group by 1,2")
def _(t):
    # responses of one record each, and lines that were cut off, which are kept beside them
    rec = F.struct(F.col("l_returnflag").alias("Award Type"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("Award ID"))
    lines = t("lineitem").select(F.to_json(F.struct(F.array(rec).alias("results"))).alias("value"))
    cut_off = t("orders").where("o_orderkey % 10 = 3").select(F.concat("o_orderstatus", F.lit('{"results": [{"Award')).alias("value"))
    path = place_for(t.spark, "landed")
    lines.unionByName(cut_off).write.text(path)

    def build(raw):
        good = L.flatten_usaspending(raw.where(F.col(L.CORRUPT).isNull())).select(F.lit("award").alias("kind"), F.col("award_type").alias("code"))
        return good.unionByName(raw.where(F.col(L.CORRUPT).isNotNull()).select(F.lit("corrupt").alias("kind"), F.substring(L.CORRUPT, 1, 1).alias("code")))

    out = S.replay(t.spark, path, build, "landed", opened=lambda spark, source: L.open_landed(spark, source, L.USASPENDING_SCHEMA))
    return out.groupBy("kind", "code").agg(F.count(F.lit(1)).alias("n"))


@query("src_canonical_url", "select o_orderkey, case o_orderkey%4 when 0 then concat('https://x.gov/api/v2/awards/',o_orderkey,'/') when 1 then concat('https://x.gov/press-release/',o_orderkey) when 2 then 'https://x.gov/n/1' else 'http://y/2' end url from orders")
def _(t):
    k = F.col("o_orderkey") % 4
    source = F.when(k == 0, "usaspending").when(k == 1, "doj").otherwise("oversight")
    url = F.when(k == 2, "/n/1").when(k == 3, "http://y/2").otherwise("")
    return t("orders").select("o_orderkey", L.canonical_url(source, F.lit("https://x.gov"), url, F.col("o_orderkey")).alias("url"))


@query("src_doc_type", "select n_nationkey, (['contract_award','press_release','ig_report'])[n_nationkey%3+1] doc_type from nation")
def _(t):
    return t("nation").select("n_nationkey", L.doc_type(F.array(*(F.lit(x) for x in ("usaspending", "doj", "oversight")))[F.col("n_nationkey") % 3]).alias("doc_type"))


@query("src_time_slice", "select event_id from events where ts between timestamp '2024-01-05' and timestamp '2024-01-09 23:59:59.999999'")
def _(t):
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    return L.time_slice(t("events"), "ts", ts("2024-01-05 00:00:00"), ts("2024-01-09 23:59:59.999999")).select("event_id")


@query("src_sam_clamp", "select o_orderkey, case when o_orderkey%3=0 or o_orderdate <= timestamp '1998-01-01' - interval 365 day then timestamp '1998-01-01' - interval 365 day else o_orderdate end since from orders")
def _(t):
    now = F.lit("1998-01-01").cast("timestamp_ntz")
    return t("orders").select("o_orderkey", L.clamp_since(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")), now).alias("since"))


@query("src_entity_relevance", f"with {B.RELEASES} select distinct doc_id, c_name as name from releases join customer on contains(lower(concat(title,' ',body)), lower(c_name))")
def _(t):
    return L.mentions_entity(B.releases(t), t("customer").select(F.col("c_name").alias("name")))


@query("src_serialize", "select n_nationkey, concat('{\"n_name\":\"', n_name, '\",\"n_nationkey\":', n_nationkey, ',\"n_regionkey\":', n_regionkey, '}') record from nation")
def _(t):
    return t("nation").withColumn("_private", F.lit(1)).select("n_nationkey", I.canonical_json(t("nation").withColumn("_private", F.lit(1))).alias("record"))


@query("src_hash", "select doc_id, sha256(text) digest from documents")
def _(t):
    return t("documents").select("doc_id", I.content_hash(F.col("text")).alias("digest"))


_OUT = "case o_orderstatus when 'F' then 'stored' when 'O' then 'duplicate' else 'error' end"


@query("src_run_summary", f"select o_orderpriority run_id, count(*) fetched, count(*) filter ({_OUT}='stored') stored, count(*) filter ({_OUT}='duplicate') deduplicated, count(*) filter ({_OUT}='error') errors, case when count(*) filter ({_OUT}='error')>0 then 'partial' else 'completed' end status from orders group by 1")
def _(t):
    outcome = F.when(F.col("o_orderstatus") == "F", "stored").when(F.col("o_orderstatus") == "O", "duplicate").otherwise("error")
    return I.run_summary(t("orders").select(F.col("o_orderpriority").alias("run_id"), outcome.alias("outcome")))


@query("src_registry", "select n_name as name, case when n_nationkey>=10 then 'new' else 'old' end base_url, n_nationkey<10 or n_nationkey%2=0 is_active from nation")
def _(t):
    n = t("nation")
    old = n.where("n_nationkey < 20").select(F.col("n_name").alias("name"), F.lit("old").alias("base_url"), F.lit(True).alias("is_active"))
    new = n.where("n_nationkey >= 10").select(F.col("n_name").alias("name"), F.lit("new").alias("base_url"), (F.col("n_nationkey") % 2 == 0).alias("is_active"))
    return I.upsert_sources(old, new)


@query("src_registry_active", "select n_name as name, 'https://' || n_nationkey base_url, true is_active from nation where n_nationkey%2=0 and n_nationkey%5<>0")
def _(t):
    k = F.col("n_nationkey")
    registry = t("nation").select(F.col("n_name").alias("name"), F.concat(F.lit("https://"), k).alias("base_url"), F.when(k % 5 != 0, k % 2 == 0).alias("is_active"))
    return I.active_sources(registry)


@query("sink_tables", "select o_orderkey, o_orderpriority, 1 as change from orders where o_orderkey%3<>0 union all select o_orderkey, o_orderstatus, 2 from orders where o_orderkey%3=0 union all select -o_orderkey-1, 'added', 2 from orders where o_orderkey%5=0")
def _(t):
    orders = t("orders")
    sink = KeyedTable(t.spark, place_for(t.spark, "sinks"), "o_orderkey long, o_orderpriority string, change int", ("o_orderkey",), parts=16)
    sink.upsert(orders.select("o_orderkey", "o_orderpriority", F.lit(1).alias("change")))
    # a third of the keys anew, each of them twice, and further ones
    replaced = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.explode(F.array(F.col("o_orderstatus"), F.lit("-"))).alias("o_orderpriority"), F.lit(2).alias("change"))
    added = orders.where("o_orderkey % 5 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("added").alias("o_orderpriority"), F.lit(2).alias("change"))
    sink.upsert(replaced.unionByName(added), order="o_orderpriority")
    return sink.read()


@query("sink_append", "select o_orderkey, o_orderpriority from orders")
def _(t):
    path = place_for(t.spark, "sinks")
    L.write_table(t("orders").select("o_orderkey", "o_orderpriority"), path, "o_orderpriority")
    return t.spark.read.schema("o_orderkey long, o_orderpriority string").parquet(path)


# ---- ingest and parsing


def _payloads(t):
    hexed = F.when(F.col("doc_id") % 9 == 0, "").when(F.col("doc_id") % 9 == 1, "zz").otherwise(F.hex(F.col("text").cast("binary")))
    wrong = F.when(F.col("doc_id") % 5 == 0, "00").otherwise(F.sha2("text", 256))
    return t("documents").select(F.col("doc_id").alias("artifact_id"), "source", hexed.alias("raw_data_hex"), wrong.alias("content_hash"), F.timestamp_seconds(F.col("doc_id")).alias("retrieved_at"))


@query("ing_decode", "select doc_id artifact_id, sha256(text) computed_hash from documents where doc_id%9>1")
def _(t):
    return I.decode_payload(_payloads(t))[0].select("artifact_id", "computed_hash")


@query("ing_verify", "select doc_id artifact_id, 'hash mismatch' reason from documents where doc_id%9>1 and doc_id%5=0")
def _(t):
    return I.verify_hash(I.decode_payload(_payloads(t))[0])[1].select("artifact_id", "reason")


def _batch(t):
    return t("documents").select(F.col("doc_id").alias("artifact_id"), F.lit("crawl").alias("source"), F.sha2("text", 256).alias("content_hash"), F.timestamp_seconds(F.col("doc_id")).alias("retrieved_at"))


@query("ing_dedup_artifact", "select min(doc_id) artifact_id, sha256(text) content_hash from documents where text not in (select text from documents where doc_id%10=3) group by text")
def _(t):
    return I.new_artifacts(_batch(t), _batch(t).where("artifact_id % 10 = 3")).select("artifact_id", "content_hash")


@query("ing_storage_path", "select doc_id, concat('artifacts/', left(sha256(text),2), '/', sha256(text), '/', source, '.raw') path, concat('artifacts/', source, '/', left(sha256(text),16), '.json') json_path from documents")
def _(t):
    h = F.sha2("text", 256)
    return t("documents").select("doc_id", I.storage_path(F.col("source"), h).alias("path"), I.json_path(F.col("source"), h).alias("json_path"))


_TTL_SQL = """with recursive e as (select concat('u', user_id) k, ts, event_id from events),
 taken(k, ts) as (select k, min(ts) from e group by 1 union all select t.k, min(e.ts) from taken t join e on e.k=t.k and e.ts >= t.ts + interval 1 hour group by t.k, t.ts)
select k idempotency_key, min(event_id) event_id from taken join e using (k, ts) group by k, ts"""


def _repeats(t):
    """Events whose key is their user: many come again within the hour, and after it."""
    return t("events").select("event_id", F.concat(F.lit("u"), "user_id").alias("idempotency_key"), F.col("ts").cast("timestamp").alias("ts"))


@query("ing_idempotent", _TTL_SQL)
def _(t):
    return I.first_in_ttl(_repeats(t))


@query("par_text", "select event_id, regexp_extract(props, ':\\s*([0-9]+)', 1) as text from events")
def _(t):
    return I.extract_text(t("events").select("event_id", F.col("props").alias("content"), F.lit("api").alias("doc_type")), ("api",)).select("event_id", "text")


@query("par_flatten", "select n_nationkey, concat('1 ', n_name, ' True ', n_nationkey, '.5') as text from nation")
def _(t):
    content = F.concat(F.lit('{"a": [1, null, " "], "b": {"c": "'), "n_name", F.lit('", "d": true}, "e": '), "n_nationkey", F.lit(".5}"))
    return I.extract_text(t("nation").select("n_nationkey", content.alias("content"), F.lit("api").alias("doc_type")), ("api",)).select("n_nationkey", "text")


@query("par_once", "select distinct l_orderkey artifact_id from lineitem where l_orderkey%3<>0")
def _(t):
    docs = t("lineitem").select(F.col("l_orderkey").alias("artifact_id"))
    return I.new_docs(docs, docs.where("artifact_id % 3 = 0"))


def _award_docs(t):
    """Orders as award records of three shapes (flat, titled keys, nested), landed as JSON texts and read back."""
    k, lit = F.col("o_orderkey"), F.lit
    extent = F.array(*(lit(x) for x in EXTENTS))[(k % 4).cast("int")]
    key, cust, pri = k.cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderpriority")
    amount = k * 10007
    flat = {
        "recipient_name": F.concat(lit("Firm "), cust), "recipient_uei": F.concat(lit("U"), key), "recipient_duns": F.concat(lit("D"), key), "award_id": F.concat(lit("A"), key), "generated_internal_id": F.concat(lit("G"), key),
        "award_amount": amount, "total_outlays": lit("n/a"), "award_type": lit("C"), "contract_award_type": lit("DELIVERY"), "awarding_agency": pri, "awarding_sub_agency": pri, "funding_agency": lit("Fund"),
        "start_date": lit("2020-01-01"), "end_date": lit("2021-01-01"), "naics_code": lit("5415"), "naics_description": lit("Systems"), "psc_code": lit("R4"), "place_of_performance": lit("Reston"), "pop_city_code": lit("C1"),
        "pop_state_code": lit("VA"), "extent_competed": extent, "set_aside_type": lit("SBA"), "pricing_type": lit("Cost Plus Fixed Fee"), "number_of_offers_received": k % 5,
    }
    titled = {
        "recipient_name": lit(""), "Recipient Name": F.concat(lit("FIRM "), cust), "Recipient UEI": F.concat(lit("u"), key), "Recipient DUNS": F.concat(lit("d"), key), "Award ID": F.concat(lit("a"), key), "Award Amount": amount.cast("string"),
        "Total Outlays": k * 0.5, "Award Type": lit("D"), "Contract Award Type": lit("BPA"), "Awarding Agency": pri, "Awarding Sub Agency": lit("Sub"), "Start Date": lit("2019-01-01"), "End Date": lit("2022-01-01"),
        "NAICS Code": lit("23"), "PSC Code": lit("Y1"), "Extent Competed": extent, "Set Aside Type": lit("8A"), "Pricing Type": lit("Firm Fixed"), "recipient": lit("no record"),
    }
    location = F.struct(F.concat(key, lit(" Main St")).alias("address_line1"), lit("Reston").alias("city_name"), lit("VA").alias("state_code"), lit("20190").alias("zip5"), lit("CAN").alias("country_code"))
    inner = F.struct(F.concat(lit("Nested "), cust).alias("recipient_name"), lit("NU").alias("recipient_uei"), lit("ND").alias("recipient_duns"), F.concat(lit("Parent "), pri).alias("parent_recipient_name"), lit("PU").alias("parent_recipient_uei"), F.array(lit("small"), lit("veteran")).alias("business_types"), location.alias("location"))
    nested = {"award_id": key, "award_amount": lit(None).cast("long"), "recipient": inner, "place_of_performance": F.struct(lit("Denver").alias("city_name"), lit("CO").alias("state_code"), lit("80202").alias("zip5"), lit("01").alias("congressional_code"))}
    shape = lambda fields: F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))
    record = F.when(k % 3 == 0, shape(flat)).when(k % 3 == 1, shape(titled)).otherwise(shape(nested))
    path = place_for(t.spark, "landed")
    t("orders").select(F.to_json(F.struct(k.alias("doc_id"), record.alias("content"))).alias("value")).write.text(path)
    return t.spark.read.schema("doc_id long, content string").json(path)


EXTENTS = (" c ", "FULL AND OPEN", "cdo", "")


def _award_sql(**columns):
    """SQL over orders of the given columns, each as its value for flat, titled and nested records."""
    one = lambda v: v if isinstance(v, str) else f"case o_orderkey%3 when 0 then {v[0]} when 1 then {v[1]} else {v[2]} end"
    return "select o_orderkey doc_id, " + ", ".join(f"{one(v)} as {n}" for n, v in columns.items()) + " from orders"


_KEY = "cast(o_orderkey as varchar)"
_RECIPIENT_SQL = {
    "name": ("concat('Firm ', o_custkey)", "concat('FIRM ', o_custkey)", "concat('Nested ', o_custkey)"), "uei": (f"concat('U', {_KEY})", f"concat('u', {_KEY})", "'NU'"), "duns": (f"concat('D', {_KEY})", f"concat('d', {_KEY})", "'ND'"),
    "parent_name": ("''", "''", "concat('Parent ', o_orderpriority)"), "parent_uei": ("''", "''", "'PU'"), "business_types": ("cast([] as varchar[])", "cast([] as varchar[])", "['small','veteran']"),
    "address_line1": ("''", "''", f"concat({_KEY}, ' Main St')"), "city": ("''", "''", "'Reston'"), "state": ("''", "''", "'VA'"), "zip": ("''", "''", "'20190'"), "country": ("'USA'", "'USA'", "'CAN'"),
}
_DETAIL_SQL = {
    "award_id": (f"concat('A', {_KEY})", f"concat('a', {_KEY})", _KEY), "generated_internal_id": (f"concat('G', {_KEY})", "''", "''"), "award_amount": ("o_orderkey*10007.0::double", "o_orderkey*10007.0::double", "0.0::double"), "total_outlays": ("0.0::double", "o_orderkey*0.5::double", "0.0::double"),
    "award_type": ("'C'", "'D'", "''"), "contract_award_type": ("'DELIVERY'", "'BPA'", "''"), "awarding_agency": ("o_orderpriority", "o_orderpriority", "''"), "awarding_sub_agency": ("o_orderpriority", "'Sub'", "''"), "funding_agency": ("'Fund'", "''", "''"),
    "start_date": ("'2020-01-01'", "'2019-01-01'", "''"), "end_date": ("'2021-01-01'", "'2022-01-01'", "''"), "naics_code": ("'5415'", "'23'", "''"), "naics_description": ("'Systems'", "''", "''"), "psc_code": ("'R4'", "'Y1'", "''"),
}
_PLACE_SQL = {"city": ("'C1'", "''", "'Denver'"), "state": ("'VA'", "''", "'CO'"), "zip": ("''", "''", "'80202'"), "country": "'USA'", "congressional_district": ("''", "''", "'01'")}
_EXT = "([' c ','FULL AND OPEN','cdo',''])[o_orderkey%4+1]"
_COMPETITION_SQL = {"extent_competed": (_EXT, _EXT, "''"), "set_aside_type": ("'SBA'", "'8A'", "''"), "pricing_type": ("'Cost Plus Fixed Fee'", "'Firm Fixed'", "''"), "number_of_offers": ("(o_orderkey%5)::int", "null", "null"), "is_sole_source": ("o_orderkey%4 in (0,2)", "o_orderkey%4 in (0,2)", "false")}
_INDICATORS_SQL = """select o_orderkey doc_id, 'sole_source' as type, 'Award was not competed (sole source)' description, 'medium' severity from orders where o_orderkey%3<2 and o_orderkey%4 in (0,2)
 union all select o_orderkey, 'high_value', concat('Award value exceeds $10M: $', format('{:,}', o_orderkey*10007), '.00'), 'low' from orders where o_orderkey%3<2 and o_orderkey*10007>10000000
 union all select o_orderkey, 'cost_plus_pricing', 'Cost-plus pricing type may warrant closer review', 'low' from orders where o_orderkey%3=0"""
_MENTIONS_SQL = """select o_orderkey doc_id, concat(case o_orderkey%3 when 0 then 'Firm ' else 'FIRM ' end, o_custkey) as name, 'vendor' as type, 'recipient' as role from orders where o_orderkey%3<2
 union all select o_orderkey, o_orderpriority, 'government_agency', 'awarding_agency' from orders where o_orderkey%3<2 union all select o_orderkey, 'Sub', 'government_agency', 'awarding_sub_agency' from orders where o_orderkey%3=1"""


@query("par_recipient", _award_sql(**_RECIPIENT_SQL))
def _(t):
    return W.recipient(_award_docs(t)).select("*", "location.*").drop("location")


@query("par_award_detail", _award_sql(**_DETAIL_SQL))
def _(t):
    return W.award_detail(_award_docs(t))


@query("par_pop", _award_sql(**_PLACE_SQL))
def _(t):
    return W.place(_award_docs(t))


@query("par_competition", _award_sql(**_COMPETITION_SQL))
def _(t):
    return W.competition(_award_docs(t))


@query("par_risk_indicators", _INDICATORS_SQL)
def _(t):
    return W.award_indicators(_award_docs(t))


@query("par_award_mentions", _MENTIONS_SQL)
def _(t):
    return W.award_mentions(_award_docs(t))


_PARSED_SQL = {"doc_type": "'contract_award'", "source": "'usaspending'"} | {f"{part}_{n}": v for part, names in (("r", _RECIPIENT_SQL), ("d", _DETAIL_SQL), ("p", _PLACE_SQL), ("c", _COMPETITION_SQL)) for n, v in names.items()}


@query("par_usaspending", f"""select a.*, coalesce(i.risks, []) risks, coalesce(m.found, []) found from ({_award_sql(**_PARSED_SQL)}) a
 left join (select doc_id, list(concat(type, ':', severity) order by type) risks from ({_INDICATORS_SQL}) group by 1) i using (doc_id) left join (select doc_id, list(concat(role, ':', name) order by role) found from ({_MENTIONS_SQL}) group by 1) m using (doc_id)""")
def _(t):
    parsed = W.parse_awards(_award_docs(t))
    fields = [F.col(f"recipient.{n}").alias(f"r_{n}") if n in ("name", "uei", "duns", "parent_name", "parent_uei", "business_types") else F.col(f"recipient.location.{n}").alias(f"r_{n}") for n in _RECIPIENT_SQL]
    for part, struct, names in (("d", "award_details", _DETAIL_SQL), ("p", "place_of_performance", _PLACE_SQL), ("c", "competition", _COMPETITION_SQL)):
        fields += [F.col(f"{struct}.{n}").alias(f"{part}_{n}") for n in names]
    joined = lambda arr, a, b: F.array_sort(F.transform(arr, lambda x: F.concat_ws(":", x[a], x[b])))
    return parsed.select("doc_id", "doc_type", "source", *fields, joined("risk_indicators", "type", "severity").alias("risks"), joined("entities_found", "role", "name").alias("found"))


def _found(patterns):
    return "list_filter([" + ", ".join(f"case when regexp_matches(w, '(?i){p}') then '{n}' end" for n, p in patterns.items()) + "], lambda x: x is not null)"


_VALUES = f"list_transform(list_zip(regexp_extract_all(w, '{X.AMOUNT}', 1), regexp_extract_all(w, '{X.AMOUNT}', 2)), lambda z: try_cast(replace(z[1], ',', '') as double) * case lower(z[2]) when 'billion' then 1e9 when 'million' then 1e6 when 'thousand' then 1e3 else 1 end)"
_DOJ = f"""with {B.RELEASES}, p as (select *, concat(title, chr(10), chr(10), body) w from releases)
select doc_id, 'press_release' doc_type, 'doj' source, title, '2024-01-02' date, source component, ['<b>procurement</b> fraud', 'tax'] topics, list_sort(list_distinct({_VALUES}), 'DESC') settlement_amounts,
 list_sort(list_distinct(regexp_extract_all(w, '{X.CASE_NUMBER}', 1))) case_numbers, list_sort(list_distinct(regexp_extract_all(w, '{X.DISTRICT}', 1))) districts,
 {_found(X.STATUTES)} statutes_cited, {_found(X.ACTIONS)} enforcement_actions, len({_found(X.STATUTES)}) + len({_found(X.ACTIONS)}) > 0 fraud_relevant,
 concat('topic:procurement fraud;doj_component:', source, ';defendant:', regexp_extract(title, '^(.+?) Agrees', 1)) mentions from p"""


@query("par_doj", _DOJ)
def _(t):
    topics = F.array(F.lit("<b>procurement</b> fraud"), F.lit("tax"))
    docs = B.releases(t).select("doc_id", "title", "body", F.lit("2024-01-02").alias("date"), F.col("source").alias("component"), topics.alias("topics"))
    parsed = P.parse_releases(docs)
    return parsed.withColumn("mentions", F.array_join(F.transform("entities_found", lambda x: F.concat_ws(":", x["role"], x["name"])), ";")).drop("entities_found")


def _relevance_sql(words, text):
    found = "list_filter([" + ",".join(f"'{w}'" for w in words) + f"], lambda p: contains(lower({text}), p))"
    return f"{found} matches, len({found}) > 0 relevant, least(len({found})/3, 1.0) score"


@query("par_sec", f"select o_orderkey doc_id, 'sec_filing' doc_type, 'sec_edgar' source, entity_name as name, cik, concat('sic', o_orderkey%9) sic_code, file_number, accession_number, form_type, file_date, period_of_report, document_url, description, 1 mentions, {_relevance_sql(X.GOVERNMENT_KEYWORDS, 'concat(entity_name, chr(32), description)')} from (select *, cast(replace(accession_number, '0001-', '') as bigint) o_orderkey from ({_SEC}))")
def _(t):
    docs = _sec(t).withColumn("doc_id", F.replace("accession_number", F.lit("0001-"), F.lit("")).cast("long"))
    docs = docs.withColumn("sic_code", F.concat(F.lit("sic"), F.col("doc_id") % 9))
    r = P.parse_filings(docs)
    return r.select("doc_id", "doc_type", "source", "entity.name", "entity.cik", "entity.sic_code", "entity.file_number", *(f"filing_details.{c}" for c in ("accession_number", "form_type", "file_date", "period_of_report", "document_url", "description")), F.size("entities_found").alias("mentions"), "gov_contract_relevance.*")


@query("par_ig", f"with {B.RELEASES}, p as (select *, concat(title, chr(10), body) w from releases) select doc_id, 'ig_report' doc_type, 'oversight_gov' source, title, source agency, cast(doc_id as varchar) report_number, body summary, 0 monetary_findings, {_VALUES} amounts, 1 mentions, {_relevance_sql(X.PROCUREMENT_KEYWORDS, 'w')} from p")
def _(t):
    blank = F.lit(None).cast("string")
    docs = B.releases(t).select("doc_id", "title", F.col("source").alias("agency"), F.col("body").alias("summary"), F.col("doc_id").cast("string").alias("report_number"), blank.alias("report_id"), blank.alias("report_type"), blank.alias("published_date"), blank.alias("url"), F.lit(None).cast("long").alias("recommendations_count"), F.lit(None).cast("long").alias("monetary_findings"))
    r = P.parse_reports(docs)
    amounts = F.transform("findings.extracted_amounts", lambda x: x["value_usd"])
    return r.select("doc_id", "doc_type", "source", "report.title", "report.agency", "report.report_number", "findings.summary", "findings.monetary_findings", amounts.alias("amounts"), F.size("entities_found").alias("mentions"), "procurement_relevance.*")


# ---- streaming


def _envelopes(t):
    k = F.col("event_id")
    kind = F.when(k % 7 == 0, "unknown").otherwise(F.array(*(F.lit(x) for x in S.TYPES))[(k % 4).cast("int")])
    good = F.to_json(F.struct(k.cast("string").alias("event_id"), kind.alias("event_type"), F.lit("s").alias("source"), F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit("k"), k)).alias("idempotency_key")))
    return t("events").select(F.when(k % 13 == 0, "{broken").otherwise(good).alias("value"))


def _source(t, df, files=None):
    """``df`` landed as parquet files for a stream to read."""
    path = place_for(t.spark, "stream-source")
    (df.repartition(files) if files else df).write.parquet(path)
    return path


@query("str_envelope", "select case when event_id%13=0 then 'malformed' when event_id%11=0 then 'blank key' else 'unknown type' end reason, count(*) n from events where event_id%13=0 or event_id%11=0 or event_id%7=0 group by 1")
def _(t):
    dead = S.replay(t.spark, _source(t, _envelopes(t)), lambda s: S.parse_envelopes(s)[1], "envelope")
    return dead.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("str_route", "select cast(event_id as varchar) event_id from events where event_id%13<>0 and event_id%11<>0 and event_id%7<>0 and event_id%4=3")
def _(t):
    return S.replay(t.spark, _source(t, _envelopes(t)), lambda s: S.route(S.parse_envelopes(s)[0], "case.created"), "route").select("event_id")


@query("str_dedup", _TTL_SQL)
def _(t):
    days = [_repeats(t).where(F.dayofmonth("ts").between(low, high)) for low, high in ((1, 10), (11, 20), (21, 31))]
    with timed_state(t.spark):
        return S.replay(t.spark, place_for(t.spark, "stream-source"), lambda s: first_in_ttl(s), "dedup", schema="event_id long, idempotency_key string, ts timestamp", slices=days)


def _sent(df, key, event_type):
    """Events of ``df`` on their way, at their first attempt."""
    key = F.col(key).cast("string")
    return df.select(F.concat(F.lit("e"), key).alias("event_id"), F.lit(event_type).alias("event_type"), key.alias("artifact_id"), F.concat(F.lit("k"), key).alias("idempotency_key"), F.lit(0).alias("attempt"))


@query("str_retry", """select case when event_id%5=0 then 'dead' else 'kept' end sink, concat('e', event_id) event_id, n attempt, concat('k', event_id, case when n>0 then concat(':retry:', n) else '' end) idempotency_key
 from (select event_id, case event_id%5 when 0 then 3 when 1 then 2 else 0 end n from events)""")
def _(t):
    number = F.col("artifact_id").cast("long")
    # every fifth event never succeeds, the next at its third attempt
    fails = (number % 5 == 0) | ((number % 5 == 1) & (F.col("attempt") < 2))

    def handle(batch):
        return batch.where(~fails), batch.where("false"), batch.where(fails)

    home = place_for(t.spark, "streams")
    C.run_stage(t.spark, home, "work", _source(t, _sent(t("events"), "event_id", "artifact.ingested")), handle)
    sinks = [C.read_sink(t.spark, home, "work", sink).withColumn("sink", F.lit(sink)) for sink in ("kept", "dead")]
    return sinks[0].unionByName(sinks[1]).select("sink", "event_id", "attempt", "idempotency_key")


@query("str_chain", "select stage, concat(pre, 'e', doc_id) event_id, cast(doc_id as varchar) artifact_id, length(text) text_length from documents, (values ('ingest', ''), ('parse', 'parse:'), ('normalize', 'normalize:parse:')) s(stage, pre)")
def _(t):
    nothing = lambda batch: batch.where("false")
    late = (F.col("artifact_id").cast("long") % 10 == 0) & (F.col("attempt") == 0)
    stages = {
        # a tenth of the artifacts is taken in at the second attempt only
        "ingest": lambda b: (b.where(~late), C.follow(b.where(~late), "artifact.parse_requested", "parse:"), b.where(late)),
        "parse": lambda b: (b, C.follow(b, "artifact.normalize_requested", "normalize:"), nothing(b)),
        "normalize": lambda b: (b, nothing(b), nothing(b)),
    }
    home = place_for(t.spark, "streams")
    C.run_chain(t.spark, home, _source(t, _sent(t("documents"), "doc_id", "artifact.ingested")), stages)
    out = None
    for stage in stages:
        part = C.read_sink(t.spark, home, stage, "kept").withColumn("stage", F.lit(stage))
        out = part if out is None else out.unionByName(part)
    lengths = t("documents").select(F.col("doc_id").cast("string").alias("artifact_id"), F.length("text").alias("text_length"))
    return out.join(lengths, "artifact_id").select("stage", "event_id", "artifact_id", "text_length")


@query("str_ingest", "select sha256(text) content_hash, count(distinct text) stored from documents group by text")
def _(t):
    # several micro-batches, of which each meets what those before it stored
    stored = S.ingest_stream(t.spark, _source(t, _batch(t), files=3), I.new_artifacts, files=1)
    return stored.groupBy("content_hash").agg(F.count(F.lit(1)).alias("stored"))


def _stream(t, build, name, keys, order=None):
    return S.replay(t.spark, f"{t.sf_dir}/events.parquet", build, name, keys, order)


@query("str_case_status", "select user_id case_id, arg_max(event_type, (ts, event_id)) status, max(ts) ts from events group by 1")
def _(t):
    # no state in the stream: a change gives way to a later one in the table
    changes = lambda s: s.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    events = t("events")
    days = [events.where(F.dayofmonth("ts").between(low, high)) for low, high in ((11, 20), (1, 10), (21, 31))]
    out = S.replay(t.spark, place_for(t.spark, "stream-source"), lambda s: changes(s).withColumn("at", F.struct("ts", "event_id")).drop("event_id"), "status", ("case_id",), "at", schema=events.schema, slices=days)
    return out.select("case_id", "status", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("str_minute_counts", "select date_trunc('minute', ts) as start, event_type as scope, count(*) n from events group by 1,2")
def _(t):
    out = _stream(t, lambda s: S.late_counts(s.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("scope")), "1 hour", "1 minute"), "minutes", ("start", "scope"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "scope", "n")


@query("str_last_24h", "select date_trunc('hour', ts) - to_hours(i) as start, count(*) n from events, generate_series(0, 23) g(i) group by 1")
def _(t):
    out = _stream(t, lambda s: S.window_counts(s.select(F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour"), "1 day", "1 hour", ()), "day", ("start",))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")
