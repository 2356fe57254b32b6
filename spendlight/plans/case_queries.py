"""Queries of composition, the gate, evaluation, serving and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendlight.functions import text as X
from spendlight.operators import audit as U
from spendlight.operators import cases as C
from spendlight.operators import evals as E
from spendlight.operators import serving as S
from spendlight.operators.ranking import ranked
from spendlight.plans import bridges as B
from spendlight.plans.catalog import query
from spendlight.storage import store


def _case_awards(t):
    """A customer's orders as the awards of a case, lines' return flags as competition."""
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("o_custkey").alias("case_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("award_id"), F.col("l_extendedprice").alias("award_amount"), F.col("o_orderpriority").alias("awarding_agency"), F.when(F.col("l_returnflag") == "R", "c").otherwise("FULL").alias("extent_competed"), F.lit(None).cast("boolean").alias("is_sole_source"), F.when(F.col("l_orderkey") % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))


_AW = "aw as (select o_custkey case_id, concat(l_orderkey,'-',l_linenumber) award_id, l_extendedprice award_amount, o_orderpriority awarding_agency, l_returnflag='R' sole, case when l_orderkey%3<>0 then strftime(o_orderdate,'%Y-%m-%d') end as date from lineitem join orders on l_orderkey=o_orderkey)"
_DIGEST = f"{_AW}, dg as (select case_id, count(*) n_awards, sum(cast(round(award_amount*100) as bigint))::bigint total_cents, count(distinct awarding_agency) agencies, count(*) filter (sole) sole, ['x'||case_id, 'y'||case_id, 'z'||case_id] artifact_ids from aw group by 1)"


def _digest(t):
    ids = F.array(*(F.concat(F.lit(x), "case_id") for x in "xyz"))
    return C.award_digest(_case_awards(t)).withColumn("artifact_ids", ids)


def _claim_sql(key: str, statement: str, kind: str, confidence: str, cited: int, listed: int, source: str) -> str:
    return f"select case_id, left(sha256(concat(case_id, ':{key}:', statement)),32) claim_id, statement, '{kind}' claim_type, {confidence} confidence, artifact_ids[1:{cited}] citation_ids, artifact_ids[1:{listed}] artifact_ids from (select *, {statement} as statement from {source})"


@query("cas_award_digest", f"with {_DIGEST} select case_id, n_awards, total_cents, agencies, sole from dg")
def _(t):
    return C.award_digest(_case_awards(t))


@query("cas_award_total", f"with {_DIGEST} " + _claim_sql("award_total", "concat('Entity has received ', n_awards, ' federal award(s) totaling $', format('{:,}', total_cents // 100), '.', lpad(cast(total_cents % 100 as varchar),2,'0'), '.')", "finding", "1.0", 3, 5, "dg where total_cents>0"))
def _(t):
    return C.award_total_claims(_digest(t))


@query("cas_sole_source", f"with {_DIGEST} " + _claim_sql("sole_source", "concat(sole, ' of ', n_awards, ' awards (', cast(round_even(100*sole/n_awards, 0) as int), '%) were sole-source.')", "finding", "0.95", 2, 3, "dg where sole>0"))
def _(t):
    return C.sole_source_claims(_digest(t))


_PROF = "prof as (select c_custkey case_id, upper(c_name) canonical_name, 'vendor' entity_type, case when c_custkey%2=0 then lpad(cast(c_custkey as varchar),12,'A') end uei, case when c_custkey%5<>0 then ['x'||c_custkey, 'y'||c_custkey] else [] end artifact_ids from customer)"


def _profiles(t):
    k = F.col("c_custkey")
    ids = F.when(k % 5 != 0, F.array(F.concat(F.lit("x"), k), F.concat(F.lit("y"), k))).otherwise(F.array().cast("array<string>"))
    return t("customer").select(k.alias("case_id"), F.upper("c_name").alias("canonical_name"), F.lit("vendor").alias("entity_type"), F.when(k % 2 == 0, F.lpad(k.cast("string"), 12, "A")).alias("uei"), ids.alias("artifact_ids"))


@query("cas_entity_claims", f"with {_PROF} " + _claim_sql("entity_registered", "concat(canonical_name, ' is registered as a federal ', entity_type, '.')", "finding", "1.0", 1, 3, "prof where len(artifact_ids)>0") + " union all " + _claim_sql("entity_uei", "concat(canonical_name, ' has Unique Entity Identifier (UEI): ', uei, '.')", "finding", "1.0", 1, 1, "prof where len(artifact_ids)>0 and uei is not null"))
def _(t):
    return C.entity_claims(_profiles(t))


def _case_signals(t):
    k = F.col("o_orderkey")
    return t("orders").select(F.col("o_custkey").alias("case_id"), k.alias("rank"), F.concat(F.lit("Signal on order "), k).alias("description"), ((k % 10) / 10.0).alias("score"), F.when(k % 3 == 0, "high").otherwise("low").alias("severity"), F.lit("rapid_award").alias("anomaly_type"))


@query("cas_risk_claims", "select o_custkey case_id, left(sha256(concat(o_custkey, ':risk_', o_orderkey, ':Signal on order ', o_orderkey)),32) claim_id, concat('Signal on order ', o_orderkey) as statement, 'risk_signal' claim_type, (o_orderkey%10)/10.0 confidence from orders")
def _(t):
    return C.risk_claims(_case_signals(t))


@query("cas_hypotheses", "with h as (select o_custkey case_id, concat('May relate to ', o_orderkey) as statement, (o_orderkey%10)/10.0 confidence from orders) select case_id, left(sha256(concat(case_id, ':hypothesis:', statement)),32) claim_id, statement, 'hypothesis' claim_type, confidence from h qualify row_number() over (partition by case_id order by confidence desc, statement)<=5")
def _(t):
    hyps = t("orders").select(F.col("o_custkey").alias("case_id"), F.concat(F.lit("May relate to "), "o_orderkey").alias("statement"), ((F.col("o_orderkey") % 10) / 10.0).alias("confidence"))
    return C.hypothesis_claims(C.risk_claims(_case_signals(t).where("false")), hyps)


@query("cas_claim_id", "select o_orderkey, left(sha256(concat(o_custkey, ':k:', o_orderkey)),32) claim_id from orders")
def _(t):
    return t("orders").select("o_orderkey", C.claim_id(F.col("o_custkey").cast("string"), F.lit("k"), F.col("o_orderkey").cast("string")).alias("claim_id"))


@query("cas_pack_hash", f"""with {B.CLAIMS}, c as (select case_id, to_json(list({{claim_id: claim_id, statement: statement, claim_type: claim_type, confidence: confidence::double, citation_ids: list_sort(citation_ids)}} order by claim_id)) j from claims group by 1),
 g as (select o_custkey case_id, 'rapid_award' anomaly_type, case when o_orderkey%3=0 then 'high' else 'low' end severity, ((o_orderkey%10)/10.0)::double score from orders),
 s as (select case_id, to_json(list({{anomaly_type: anomaly_type, severity: severity, score: score}} order by anomaly_type, severity, score)) j from g group by 1)
 select case_id, sha256(concat(coalesce(c.j::varchar, '[]'), '|', coalesce(s.j::varchar, '[]'))) pack_hash from c full join s using (case_id)""")
def _(t):
    return C.pack_hash(B.claims(t), _case_signals(t))


@query("cas_timeline", f"with {_AW} select case_id, date, concat('Award ', award_id) event, 'award' as type from aw where date is not null")
def _(t):
    return C.timeline(_case_awards(t))


@query("cas_summary", f"with {_PROF}, s as (select o_custkey case_id, count(*) n, count(*) filter (o_orderkey%3=0) high from orders group by 1) select prof.case_id, concat('Investigative Case Pack: ', canonical_name) title, concat('Investigation of ', canonical_name, '. ', case when n>0 then concat('Analysis identified ', n, ' risk signal(s)', case when high>0 then concat(', including ', high, ' high-severity') else '' end, '.') else 'No significant risk signals identified.' end, ' {C.CLOSING}') summary from prof left join s on s.case_id=prof.case_id")
def _(t):
    return C.summary(_profiles(t), _case_signals(t))


@query("cas_evidence_summary", f"with {B.CLAIMS}, {B.ARTIFACTS} select case_id, count(*) claims, count(*) filter (claim_type='finding') finding, count(*) filter (claim_type='risk_signal') risk_signal, count(*) filter (claim_type='hypothesis') hypothesis, sum(len(citation_ids))::bigint citations, len(list_distinct(flatten(list(citation_ids)))) artifacts, coalesce(any_value(n), 0) sources from claims left join (select case_id, count(distinct source) n from (select case_id, unnest(citation_ids) artifact_id from claims) join artifacts using (artifact_id) group by 1) using (case_id) group by 1")
def _(t):
    return C.evidence_summary(B.claims(t), B.artifacts(t))


@query("cas_pack_rollup", f"with {B.CLAIMS} select case_id, count(*) claim_count, sum(len(citation_ids))::bigint citation_count, bool_and(audit_passed) all_audited, concat('packs/', case_id, '.json') storage_path from claims group by 1")
def _(t):
    return C.pack_rollup(B.claims(t))


# ---- the gate

_CIT = f"{B.CLAIMS}, {B.ARTIFACTS}, cit as (select case_id, claim_id, unnest(citation_ids) artifact_id from claims)"
_BANNED = " or ".join(f"contains(lower(statement), '{w}')" for w in X.BANNED)
_RULES = {
    "citation_required": "select case_id, claim_id, 'citation_required' as rule from claims where claim_type in ('finding','factual') and len(citation_ids)=0",
    "citation_valid": "select case_id, claim_id, 'citation_valid' as rule from cit where artifact_id not in (select artifact_id from artifacts)",
    "hash_match": "select case_id, claim_id, 'hash_match' as rule from cit join artifacts using (artifact_id) where claim_id%13=0 and artifact_id%3=0 union all select case_id, null, 'hash_match' from cit left join artifacts using (artifact_id) group by case_id having count(content_hash) filter (artifact_id%3=0)=0",
    "language": f"select case_id, claim_id, 'language' as rule from claims where {_BANNED}",
    "hypothesis_label": "select case_id, claim_id, 'hypothesis_label' as rule from claims where len(citation_ids)=0 and claim_type not in ('hypothesis','risk_signal','cannot_conclude')",
    "min_sources": "select c_custkey case_id, null::bigint claim_id, 'min_sources' as rule from customer where c_custkey%4=0",
    "pii": f"select case_id, claim_id, 'pii' as rule from claims where regexp_matches(statement, '{X.SSN}') union all select c_custkey, null, 'pii' from customer where c_custkey%6=1 union all select c_custkey, null, 'pii' from customer where c_custkey%9=1",
}


def _claims(t):
    """Claims; every tenth finding lost its citations, so that each rule has something to find."""
    return B.claims(t)


def _case_sources(t):
    return t("customer").select(F.col("c_custkey").alias("case_id"), F.explode(F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))).alias("source"))


def _rules(t):
    claims, artifacts = _claims(t), B.artifacts(t)
    citations = store(U.citation_index(claims))
    # two thirds of the artifacts have no stored hash
    hashes = artifacts.withColumn("content_hash", F.when(F.col("artifact_id") % 3 == 0, F.col("content_hash")))
    case = F.col("c_custkey")
    title, summary = F.when(case % 6 == 1, "On 123-45-6789").otherwise("Plain"), F.when(case % 9 == 1, "Write to jo.doe@gmail.com.")
    packs = t("customer").select(case.alias("case_id"), title.alias("title"), summary.alias("summary"))
    hashed = citations.withColumn("content_hash", F.when(F.col("claim_id") % 13 == 0, "0").otherwise(""))
    return {
        "citation_required": U.citation_required(claims, citations),
        "citation_valid": U.citation_valid(citations, artifacts),
        "hash_match": U.hash_match(hashed, hashes),
        "language": U.language(claims),
        "hypothesis_label": U.hypothesis_label(claims, citations),
        "min_sources": U.min_sources(_case_sources(t)),
        "pii": U.pii(claims, packs),
    }


def _rule(name: str):
    @query(f"aud_{name}", f"with {_CIT} {_RULES[name]}")
    def _(t):
        return _rules(t)[name]


for _name in _RULES:
    _rule(_name)


@query("aud_citation_index", f"with {_CIT} select * from cit")
def _(t):
    return U.citation_index(_claims(t))


def _verdicts(t):
    every = None
    for df in _rules(t).values():
        every = df if every is None else every.unionByName(df)
    return U.verdicts(t("customer").select(F.col("c_custkey").alias("case_id")), every)


_VERDICT = f"with {_CIT}, v as ({' union all '.join(_RULES.values())}), g as (select case_id, sum(n)::bigint n, array_to_string(list_sort(list(concat(rule, ':', n))), ',') rules from (select case_id, rule, count(*) n from v group by 1,2) group by 1), ver as (select c_custkey case_id, n is null approved, coalesce(n,0) n_violations, coalesce(rules,'') rules from customer left join g on g.case_id=c_custkey)"


@query("aud_verdict", f"{_VERDICT} select * from ver")
def _(t):
    return _verdicts(t)


@query("aud_case_status", f"{_VERDICT} select case_id, case when case_id%10=0 then 'failed' when approved then 'complete' else 'insufficient_evidence' end status from ver")
def _(t):
    return U.case_status(_verdicts(t), t("customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("case_id")))


# ---- evaluation


@query("evl_grounding", f"with {_CIT}, bad as (select case_id, count(*) n from cit where artifact_id not in (select artifact_id from artifacts) group by 1), s as (select case_id, (count(*) filter (len(citation_ids)>0))/count(*) score, count(*) filter (claim_type='cannot_conclude') cannot_conclude from claims group by 1) select c_custkey case_id, coalesce(score, 1.0) score, coalesce(cannot_conclude, 0) cannot_conclude, coalesce(score, 1.0)=1 and n is null passed from customer left join s on s.case_id=c_custkey left join bad on bad.case_id=c_custkey")
def _(t):
    claims = B.claims(t)
    return E.grounding(claims, U.citation_index(claims), B.artifacts(t), t("customer").select(F.col("c_custkey").alias("case_id")))


_CERTAIN = " or ".join(f"regexp_matches(statement, '{p}')" for p in X.CERTAINTY)
_HEDGED = " or ".join(f"regexp_matches(statement, '{p}')" for p in X.HEDGES)


@query("evl_hallucination", f"with {B.CLAIMS}, b as (select case_id, (not audit_passed) or {_CERTAIN} or (not ({_HEDGED}) and claim_type in ('risk_signal','hypothesis','cannot_conclude')) bad from claims) select case_id, count(*) claims, count(*) filter (bad) bad, 1-(count(*) filter (bad))/count(*) score from b group by 1")
def _(t):
    return E.hallucination(B.claims(t))


def _runs(t, k):
    labelled = t("documents").join(t("labels"), "doc_id").select(F.col("source").alias("case_id"), F.col("doc_id").alias("artifact_id"), "n_chars", "quality")
    runs = ranked(labelled, "case_id", [F.desc("n_chars"), F.col("artifact_id")]).select("case_id", "rank", "artifact_id")
    return E.retrieval(runs, labelled.where("quality = 1").select("case_id", "artifact_id"), k)


def _retrieval_sql(k):
    return f"""with r as (select source case_id, doc_id artifact_id, quality, row_number() over (partition by source order by n_chars desc, doc_id) rank from documents join labels using (doc_id)),
s as (select *, sum(quality) over (partition by case_id order by rank) seen from r),
g as (select case_id, sum(quality) n, sum(quality) filter (rank<={k}) hits, coalesce(sum(seen/rank) filter (quality=1),0) gain from s group by 1 having sum(quality)>0),
m as (select case_id, coalesce(hits,0)/n recall, coalesce(hits,0)/{k} as prec, gain/n ap from g)
select case_id, recall, prec as "precision", ap average_precision, case when recall+prec>0 then 2*recall*prec/(recall+prec) else 0 end f1, recall>=0.8 passed from m"""


for _id, _cols in {"evl_recall": "case_id, recall", "evl_precision": 'case_id, "precision"', "evl_avg_precision": "case_id, average_precision", "evl_f1": 'case_id, recall, "precision", average_precision, f1, passed'}.items():

    @query(_id, f"select {_cols} from ({_retrieval_sql(5)})")
    def _(t, _cols=_cols):
        return _runs(t, 5).select(*[c.strip(' "') for c in _cols.split(",")])


@query("evl_determinism", "select o_custkey case_id, count(*) runs, 1/count(distinct o_orderstatus) score, count(*)>=3 and count(distinct o_orderstatus)=1 and max(o_orderkey%2)=min(o_orderkey%2) passed from orders group by 1")
def _(t):
    return E.determinism(t("orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("pack_hash"), (F.col("o_orderkey") % 2).alias("n_claims")))


_PASS = "select o_orderpriority suite, count(*) total, count(*) filter (o_orderstatus='F') passed, count(*) filter (o_orderstatus<>'F') failed, (count(*) filter (o_orderstatus='F'))/count(*) pass_rate from orders group by 1"


@query("evl_report", _PASS)
def _(t):
    return E.report(t("orders").select(F.col("o_orderpriority").alias("suite"), (F.col("o_orderstatus") == "F").alias("passed")))


_GATES = "with g(name, op, lim) as (values " + ",".join(f"('{a}','{b}',{c})" for a, b, c in E.GATES) + "), m as (select 'grounding_rate' as name, (count(*) filter (o_orderstatus='F'))/count(*) actual from orders union all select 'cost_per_case_usd', avg(o_orderkey%2) from orders union all select 'replay_determinism', 1.0) select g.name, actual, coalesce(case op when '>=' then actual>=lim when '<=' then actual<=lim else actual=lim end, false) passed from g left join m on m.name=g.name"


def _gate_metrics(t):
    o = t("orders")
    one = lambda name, value: o.agg(value.alias("actual")).select(F.lit(name).alias("name"), F.col("actual").cast("double"))
    m = one("grounding_rate", F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).union(one("cost_per_case_usd", F.avg(F.col("o_orderkey") % 2))).union(one("replay_determinism", F.max(F.lit(1.0))))
    return m


@query("evl_gates", _GATES)
def _(t):
    return E.check_gates(_gate_metrics(t))


@query("evl_gate_summary", f"select bool_and(passed) all_passed, array_to_string(list_sort(list(name) filter (not passed)), ',') failed from ({_GATES})")
def _(t):
    return E.gate_summary(E.check_gates(_gate_metrics(t)))


# ---- serving and indicators


@query("qry_list_cases", f"with {B.CASES} select *, (select count(*) from cases where status='complete') total from cases where status='complete' order by created_at desc, case_id limit 20 offset 20")
def _(t):
    return S.list_cases(B.cases(t), "complete", 2)


@query("qry_case_dedupe", "with k as (select o_custkey, o_orderpriority, arg_min(o_orderkey, (o_orderdate, o_orderkey)) e from orders where o_orderstatus<>'P' group by 1,2) select o.o_orderkey request_id, e existing from orders o left join k on k.o_custkey=o.o_custkey and k.o_orderpriority=o.o_orderpriority")
def _(t):
    base = t("orders").select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("Case "), "o_custkey").alias("title"), F.col("o_orderpriority").alias("seed"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("open").alias("status"), F.col("o_orderdate").alias("created_at"))
    return S.dedupe_cases(base.withColumnRenamed("case_id", "request_id").select("request_id", "title", "seed"), base)


@query("qry_case", f"with {B.CASES} select * from cases where case_id=7")
def _(t):
    return B.cases(t).where("case_id = 7")


_PACK = f"""with {B.CASES}, {B.PACKS}, {B.CLAIMS}, audit as (select l_orderkey case_id, l_linenumber audit_event_id, (['compose','audit','publish'])[l_linenumber%3+1] stage, case when l_returnflag='R' then 'blocked' else 'approved' end policy_decision from lineitem),
 p as (select case_id, arg_max(pack_id, (generated_at, pack_id)) pack_id, max(generated_at) generated_at from packs group by 1),
 cl as (select claim_id case_id, list(concat_ws('|', claim_id, claim_type, statement)) claims, flatten(list(list_transform(citation_ids, lambda x: concat_ws('|', claim_id, x)))) citations from claims group by 1),
 au as (select case_id, list_sort(list(concat_ws('|', audit_event_id, stage, policy_decision))) audit_events from audit group by 1)
 select c.case_id, pack_id, generated_at, claims, list_sort(citations) citations, coalesce(audit_events, []) audit_events from cases c left join p using (case_id) join cl using (case_id) left join au using (case_id) where status in ('complete','auditing')"""


@query("qry_pack", _PACK)
def _(t):
    # each order is a case with the claim on it
    claims = B.claims(t).withColumn("case_id", F.col("claim_id"))
    citations = claims.select("case_id", "claim_id", F.explode("citation_ids").alias("artifact_id"))
    out = S.case_pack(B.cases(t), claims.select("case_id", "claim_id", "claim_type", "statement"), citations, _audit_events(t), B.packs(t))
    flat = lambda name, *fields: F.array_sort(F.transform(name, lambda x: F.concat_ws("|", *(x[f].cast("string") for f in fields)))).alias(name)
    return out.select("case_id", "pack_id", "generated_at", flat("claims", "claim_id", "claim_type", "statement"), flat("citations", "claim_id", "artifact_id"), flat("audit_events", "audit_event_id", "stage", "policy_decision"))


@query("qry_search_entities", f"with {B.ENTITIES} select *, (select count(*) from entities where contains(lower(canonical_name), '00001')) total from entities where contains(lower(canonical_name), '00001') order by canonical_name, entity_id limit 20")
def _(t):
    return S.search_entities(B.entities(t), "00001")


@query("qry_search_artifacts", f"with {B.ARTIFACTS} select *, (select count(*) from artifacts where contains(lower(source_url), 'example.gov/v1')) total from artifacts where contains(lower(source_url), 'example.gov/v1') order by retrieved_at desc, artifact_id limit 20")
def _(t):
    return S.search_artifacts(B.artifacts(t), "Example.gov/V1")


@query("qry_status_counts", f"with {B.CASES} select count(*) all_cases, count(*) filter (status='complete') complete, count(*) filter (status in ('pending','processing','auditing')) processing, count(*) filter (status='insufficient_evidence') blocked from cases")
def _(t):
    return S.status_counts(B.cases(t))


@query("qry_sort_filter", f"with {B.CASES} select * from cases where status='processing' order by title desc, case_id limit 50")
def _(t):
    return S.sort_cases(B.cases(t), "title", desc=True, status="processing")


_KPI = {
    "pass_rate": "select (count(*) filter (l_returnflag<>'R'))/count(*) pass_rate from lineitem",
    "block_rate": "select (count(*) filter (event_type='click'))/count(*) block_rate from events",
    "median_latency": "select median(epoch(l_shipdate)::bigint-epoch(o_orderdate)::bigint) median_seconds from lineitem join orders on l_orderkey=o_orderkey where l_shipdate>=o_orderdate",
    "totals": "select (select count(*) from orders) cases, (select count(*) from lineitem) artifacts, (select count(*) from nation) sources",
    "last_24h": "select (select count(*) from orders where o_orderdate >= timestamp '1998-06-30') cases, (select count(*) from orders where o_orderdate >= timestamp '1998-06-30') artifacts, (select count(*) from events where event_type='click' and ts >= timestamp '1998-06-30') blocks",
}


def _decisions(t):
    return t("events").select(F.when(F.col("event_type") == "click", "blocked").otherwise("passed").alias("decision"), "ts")


def _kpi(t):
    return {
        "pass_rate": S.pass_rate(B.packs(t)),
        "block_rate": S.block_rate(_decisions(t)),
        "median_latency": S.median_latency(B.cases(t), B.packs(t)),
        "totals": S.totals(B.cases(t), t("lineitem"), t("nation")),
        "last_24h": S.last_24h({"cases": (B.cases(t), "created_at"), "artifacts": (B.artifacts(t), "retrieved_at"), "blocks": (_decisions(t).where("decision = 'blocked'"), "ts")}, F.lit("1998-07-01").cast("timestamp_ntz")),
    }


def _register(name: str):
    @query(f"kpi_{name}", _KPI[name])
    def _(t):
        return _kpi(t)[name]


for _name in _KPI:
    _register(_name)


@query("kpi_public", f"""select * from (select round(pass_rate, 4) pass_rate from ({_KPI['pass_rate']})), (select round(block_rate, 4) block_rate from ({_KPI['block_rate']})), (select round(median_seconds, 2) median_seconds from ({_KPI['median_latency']})),
 (select round((count(*) filter (l_suppkey%7<>0))/count(*), 4) entity_coverage from lineitem), (select (select count(*) from orders) cases, (select count(*) from orders) artifacts, (select count(*) from nation) sources),
 (select cases cases_24h, artifacts artifacts_24h, blocks blocks_24h from ({_KPI['last_24h']}))""")
def _(t):
    mentions = t("lineitem").select(F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("resolved_entity_id"))
    return S.public_kpis(B.packs(t), _decisions(t), B.cases(t), B.artifacts(t), t("nation"), mentions, F.lit("1998-07-01").cast("timestamp_ntz"))


_STAGES = "audit as (select l_orderkey case_id, l_linenumber audit_event_id, (['compose','audit','publish'])[l_linenumber%3+1] stage, case when l_returnflag='R' then 'blocked' else 'approved' end policy_decision from lineitem)"


def _audit_events(t):
    stages = F.array(*(F.lit(x) for x in ("compose", "audit", "publish")))
    return t("lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("audit_event_id"), stages[(F.col("l_linenumber") % 3).cast("int")].alias("stage"), F.when(F.col("l_returnflag") == "R", "blocked").otherwise("approved").alias("policy_decision"))


@query("qry_demo_report", f"with {B.CLAIMS}, {_STAGES}, r as (select case_id, count(*) filter (claim_type in ('finding','factual')) findings, count(*) filter (claim_type='risk_signal') risk_signals, (count(*) filter (audit_passed))/count(*) audited_share from claims group by 1), s as (select case_id, count(distinct stage) stages from audit group by 1) select r.*, coalesce(stages, 0) stages from r left join s using (case_id)")
def _(t):
    return S.pack_report(B.claims(t), _audit_events(t))


# ---- usage

_RATE = "case provider when 'vertex' then 0.000125::double when 'openrouter' then 0.0002::double when 'vllm' then 0.0::double else 0.0002::double end"
_COST = f"with {B.USAGE}, cost as (select *, (prompt_tokens+output_tokens)/1000*{_RATE} cost from usage)"


@query("use_cost", f"{_COST} select event_id, provider, cost from cost")
def _(t):
    return S.usage_cost(B.usage(t)).select("event_id", "provider", "cost")


@query("use_cost_model", f"with {B.USAGE} select event_id, case provider when 'vertex' then prompt_tokens*3e-7+output_tokens*4e-7 else prompt_tokens*1e-7+output_tokens*2e-7 end as cost from usage")
def _(t):
    u = B.usage(t).withColumnRenamed("provider", "model")
    prices = u.select("model").distinct().where("model = 'vertex'").select("model", F.lit(3e-7).alias("input_price"), F.lit(4e-7).alias("output_price"))
    return S.usage_cost_model(u, prices, (1e-7, 2e-7)).select("event_id", "cost")


@query("use_case_budget", f"{_COST} select case_id, sum(cost::decimal(28,12))::double spent, sum(cost::decimal(28,12))<0.005 as \"within\" from cost group by 1")
def _(t):
    return S.case_budget(S.usage_cost(B.usage(t)), 0.005)


@query("use_daily_spend", f"{_COST} select cast(ts as date) as day, sum(cost::decimal(28,12))::double spent from cost group by 1")
def _(t):
    return S.daily_spend(S.usage_cost(B.usage(t)))


@query("use_rate_minute", "select event_type as scope, date_trunc('minute', ts) as minute, count(*) n, count(*)>1 over_limit, greatest(0, 1-count(*)) remaining from events group by 1,2")
def _(t):
    return S.rate_per_minute(t("events").withColumnRenamed("event_type", "scope"), 1)


@query("use_rate_verdict", "select event_id request_id, row_number() over (partition by event_type, date_trunc('minute', ts) order by ts, event_id)<=1 allowed from events")
def _(t):
    return S.rate_verdicts(t("events").select(F.col("event_type").alias("scope"), "ts", F.col("event_id").alias("request_id")), 1)


@query("use_cache_key", "select (count(*)-count(distinct (user_id, event_type)))/count(*) repeated from events")
def _(t):
    return S.repeat_share(t("events").select(F.col("event_type").alias("model"), F.col("user_id").cast("string").alias("prompt"), F.lit("s").alias("system")))
