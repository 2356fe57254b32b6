"""Queries of the risk signal detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendlight.functions.columns import address_key, number, parse_date
from spendlight.operators import anomalies as A
from spendlight.plans import bridges as B
from spendlight.plans.catalog import query

_AGENCY = "b as (select vendor_id, awarding_agency agency, count(*) total, count(*) filter (extent_competed='C') sole, (count(*) filter (extent_competed='C'))/count(*) ratio from awards group by 1,2)"
_SOLE = "w as (select * from b where not exists (select 1 from b c where c.vendor_id=b.vendor_id and (c.ratio>b.ratio or c.ratio=b.ratio and (c.total>b.total or c.total=b.total and c.agency<b.agency))))"
_SOLE_OUT = "select 'sole_source_concentration' anomaly_type, vendor_id subject, ratio>=0.8 and total>=3 detected, case when not (ratio>=0.8 and total>=3) then 'none' when ratio>=0.95 then 'high' when ratio>=0.9 then 'medium' else 'low' end severity, ratio score, case when ratio>0 then agency else '' end agency, total, sole from w"


@query("ano_sole_source", f"with {B.AWARDS}, {_AGENCY}, {_SOLE} {_SOLE_OUT}")
def _(t):
    return A.sole_source(B.awards(t))


@query("ano_sole_source_eligible_first", f"with {B.AWARDS}, {_AGENCY.replace('group by 1,2)', 'group by 1,2 having count(*)>=3)')}, {_SOLE} {_SOLE_OUT}")
def _(t):
    return A.sole_source(B.awards(t), eligible_first=True)


_INFLATION = f"""with {B.GROWING}, r as (select award_id, (current_amount-original_amount)/original_amount ratio from growing)
select 'modification_inflation' anomaly_type, award_id subject, ratio>0.5 detected, case when ratio>2 then 'high' when ratio>1 then 'medium' when ratio>0.5 then 'low' else 'none' end severity, least(ratio/2,1.0) score, ratio from r"""


@query("ano_mod_inflation", _INFLATION)
def _(t):
    return A.mod_inflation(B.growing_awards(t))


_CENTRES = "s(state, lat, lon) as (values " + ",".join(f"('{k}',{a},{b})" for k, (a, b) in A.STATE_CENTRES.items()) + ")"
_PLACES = "p as (select distinct concat(s_nationkey,'-',c_nationkey) pair_id, ([" + ",".join(f"'{x}'" for x in B.PLACES) + "])[s_nationkey+1] a, ([" + ",".join(f"'{x}'" for x in B.PLACES) + "])[c_nationkey+1] b from lineitem join supplier on l_suppkey=s_suppkey join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey)"
_MILES = "3959*2*asin(sqrt(pow(sin(radians(y.lat-x.lat)/2),2)+cos(radians(x.lat))*cos(radians(y.lat))*pow(sin(radians(y.lon-x.lon)/2),2)))"
_GEO = f"""with {_CENTRES}, {_PLACES}, d as (select pair_id, case when a='' or b='' then null when a=b then 0 else coalesce({_MILES}, 500.0) end distance from p left join s x on x.state=a left join s y on y.state=b)
select 'geographic_mismatch' anomaly_type, pair_id subject, coalesce(distance>1000,false) detected, case when distance>2500 then 'high' when distance>1500 then 'medium' when distance>1000 then 'low' else 'none' end severity, coalesce(least(distance/3000,1.0),0.0) score, distance from d"""


@query("ano_geo_mismatch", _GEO)
def _(t):
    return A.geo_mismatch(B.places(t))


def _rapid(days):
    return f"""with o as (select cast(o_custkey as varchar) v, o_orderdate t0 from orders), p as (select a.v, a.t0, count(*) n from (select distinct v, t0 from o) a join o b on a.v=b.v and b.t0>=a.t0 and b.t0<=a.t0+interval {days} day group by 1,2),
m as (select v, max(n) n from p group by 1) select 'rapid_award' anomaly_type, m.v subject, m.n>=3 detected, case when m.n>=8 then 'high' when m.n>=5 then 'medium' when m.n>=3 then 'low' else 'none' end severity, least(m.n/10,1.0) score, m.n in_window, (select min(t0) from p where p.v=m.v and p.n=m.n) window_start from m"""


@query("ano_rapid_award", _rapid(30))
def _(t):
    return A.rapid_award(B.ordered_awards(t)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("ano_rapid_award_180d", _rapid(180))
def _(t):
    return A.rapid_award(B.ordered_awards(t), days=180).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_RING = "select 'shared_address' anomaly_type, upper(concat(c_nationkey,', ',c_mktsegment)) subject, true detected, case when count(*)>=5 then 'high' else 'medium' end severity, least(count(*)/5,1.0) score, count(*) n from customer group by 2 having count(*)>=3"


@query("ano_address_ring", _RING)
def _(t):
    return A.address_ring(B.addressed(t))


_OVERLAP = f"""with {B.OFFICERS}, s as (select officer, list_sort(list(entity_id)) m from officers group by 1), d as (select distinct m from s where len(m)>=2)
select 'officer_overlap' anomaly_type, array_to_string(d.m,'|') subject, true detected, case when count(*)>=3 then 'high' else 'medium' end severity, least(count(*)/3,1.0) score, count(*) n, len(d.m) size from (select m, unnest(m) entity_id from d) d join officers o using (entity_id) join s using (officer) where d.entity_id=d.m[1] and list_has_all(s.m,d.m) group by d.m having count(*)>=2"""


@query("ano_officer_overlap", _OVERLAP)
def _(t):
    return A.officer_overlap(B.officers(t))


_COMMON = "anomaly_type, subject, detected, severity, score"


def _signals(t):
    return A.all_signals(A.sole_source(B.awards(t)), A.mod_inflation(B.growing_awards(t)), A.address_ring(B.addressed(t)), A.rapid_award(B.ordered_awards(t)), A.officer_overlap(B.officers(t)), A.geo_mismatch(B.places(t)))


_ALL = " union all ".join(f"select {_COMMON} from ({q}) where detected" for q in (f"with {B.AWARDS}, {_AGENCY}, {_SOLE} {_SOLE_OUT}", _INFLATION, _RING, _rapid(30), _OVERLAP, _GEO))


@query("ano_all", _ALL)
def _(t):
    return _signals(t)


@query("ano_composite", f"with g as ({_ALL}), w as (select subject, avg(score * case severity when 'low' then .2 when 'medium' then .5 when 'high' then .8 when 'critical' then 1 else .3 end) m from g where anomaly_type='sole_source_concentration' group by 1) select cast(s_suppkey as varchar) vendor_id, least(coalesce(m,0),1.0)::double composite_score from supplier left join w on subject=cast(s_suppkey as varchar)")
def _(t):
    return A.composite(A.all_signals(A.sole_source(B.awards(t))), t("supplier").select(F.col("s_suppkey").cast("string").alias("vendor_id")))


@query("ano_severity_external", f"with g as ({_RING}), h as (select o_custkey case_id, cast(o_orderkey as varchar) hypothesis_id, (o_orderkey%10)/10.0::double confidence from orders), r as (select *, row_number() over (partition by case_id order by confidence desc, hypothesis_id) rn from h) select {_COMMON} from g union all select 'hypothesis', hypothesis_id, true, case when confidence<0.7 then 'medium' else 'high' end, confidence from r where rn<=5")
def _(t):
    hyps = t("orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").cast("string").alias("hypothesis_id"), ((F.col("o_orderkey") % 10) / F.lit(10.0)).alias("confidence"))
    return A.merge_hypotheses(A.address_ring(B.addressed(t)), hyps)


@query("ano_award_concentration", f"with {B.AWARDS}, s as (select awarding_agency, vendor_id, sum(cast(round(award_amount*100) as bigint))::bigint cents from awards group by 1,2), r as (select *, sum(cents) over (partition by awarding_agency) total, row_number() over (partition by awarding_agency order by cents desc, vendor_id) rn from s) select awarding_agency, vendor_id, cents, (cents/total)::double share from r where rn=1")
def _(t):
    return A.award_concentration(B.awards(t))


@query("ano_addr_norm", "select c_custkey, case when c_custkey%3=0 then upper(trim(c_name)) else upper(concat_ws(', ', nullif(trim(c_mktsegment),''), cast(c_nationkey as varchar))) end address_key from customer")
def _(t):
    address = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name"))
    return t("customer").select("c_custkey", address_key(address, F.col("c_mktsegment"), F.col("c_nationkey").cast("string"), F.lit(" "), F.lit(None).cast("string")).alias("address_key"))


@query("ano_date_parse", "select o_orderkey, case when o_orderkey%4=3 then null else date_trunc('day', o_orderdate) end parsed from orders")
def _(t):
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("timestamp_ntz")
    text = F.when(k == 0, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("Z"))).when(k == 1, F.date_format(day, "M/d/yyyy")).when(k == 2, F.date_format(F.date_trunc("day", day), "yyyy-MM-dd'T'HH:mm:ss'ZZ'")).otherwise("13/45/2020")
    return t("orders").select("o_orderkey", parse_date(text).cast("timestamp_ntz").alias("parsed"))


@query("ano_safe_float", "select c_custkey, case when c_custkey%3=0 then c_acctbal else 0.0 end amount from customer")
def _(t):
    return t("customer").select("c_custkey", number(F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal").cast("string")).when(F.col("c_custkey") % 3 == 1, "n/a")).alias("amount"))
