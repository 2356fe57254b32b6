"""Queries of the text operators over releases and claims made of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendlight.functions import text as X
from spendlight.operators import documents as D
from spendlight.plans import bridges as B
from spendlight.plans.catalog import query

_R = f"with {B.RELEASES}"


def _duck(p: str) -> str:
    return p.replace("'", "''")


def _list(words) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _named(col: str, patterns: dict[str, str]) -> str:
    return "list_filter([" + ",".join(f"case when regexp_matches({col}, '{_duck(p if p.startswith('(?') and not p.startswith('(?:') else '(?i)' + p)}') then '{n}' end" for n, p in patterns.items()) + "], lambda x: x is not null)"


_VALUES = f"""list_filter(list_transform(list_zip(regexp_extract_all(body, '{X.AMOUNT}', 1), regexp_extract_all(body, '{X.AMOUNT}', 2)), lambda z: try_cast(replace(z[1], ',', '') as double) * case lower(z[2]) when 'billion' then 1e9 when 'million' then 1e6 when 'thousand' then 1e3 else 1 end), lambda v: v is not null)"""
_SORTED = "list_sort(list_distinct({0}))"


def _column(name: str, sql: str, expression, text: str = "body"):
    @query(name, f"{_R} select doc_id, {sql} v from releases")
    def _(t):
        return B.releases(t).select("doc_id", expression(F.col(text)).alias("v"))


_column("txt_amounts", f"list_sort(list_distinct({_VALUES}), 'DESC')", X.amounts)
_column("txt_amounts_ig", _VALUES, lambda c: F.transform(X.amounts_plain(c), lambda x: x["value_usd"]))
_column("txt_amounts_raw", f"regexp_extract_all(body, '{X.AMOUNT_RAW}')", X.amounts_raw)
_column("txt_case_numbers", _SORTED.format(f"regexp_extract_all(body, '{X.CASE_NUMBER}', 1)"), X.case_numbers)
_column("txt_case_numbers_raw", f"regexp_extract_all(body, '{X.CASE_NUMBER_RAW}')", X.case_numbers_raw)
_column("txt_districts", _SORTED.format(f"regexp_extract_all(body, '{X.DISTRICT}', 1)"), X.districts)
_column("txt_districts_raw", f"regexp_extract_all(body, '{X.DISTRICT_RAW}')", lambda c: X.districts(c, raw=True))
_column("txt_statutes", _named("body", X.STATUTES), X.statutes)
_column("txt_actions", _named("body", X.ACTIONS), X.actions)
_column("txt_defendant", "split_part(title, ' Agrees', 1)", X.defendant, "title")
_column("txt_pii_mask", f"regexp_replace(regexp_replace(regexp_replace(body, '{X.SSN}', '[SSN_REDACTED]', 'g'), '{X.PHONE}', '[PHONE_REDACTED]', 'g'), '{X.PERSONAL_EMAIL}', '[EMAIL_REDACTED]', 'g')", X.mask_mention)
_column("txt_pii_redact", f"regexp_replace(regexp_replace(regexp_replace(body, '{X.SSN}', '[SSN]', 'g'), '{X.CARD}', '[CARD]', 'g'), '{X.EMAIL}', '[EMAIL]', 'g')", lambda c: X.redact_pii(c)["text"])
_column("txt_output_filter", f"regexp_replace(regexp_replace(regexp_replace(title, '{X.SSN}', '[SSN]', 'g'), '{X.CARD}', '[CARD]', 'g'), '{X.EMAIL}', '[EMAIL]', 'g')", lambda c: X.redact_pii(c)["text"], "title")
_column("txt_injection", _named("body", X.INJECTION), lambda c: X.screen_input(c)["reasons"])
_column("txt_banned", f"list_filter({_list(X.BANNED)}, lambda p: contains(lower(body), p))[1]", X.banned_phrase)
_column("txt_certainty", "list_filter([" + ",".join(f"regexp_extract(body, '{p}', 1)" for p in X.CERTAINTY) + "], lambda x: x <> '')", X.certainty)
_column("txt_hedge", " or ".join(f"regexp_matches(body, '{p}')" for p in X.HEDGES), X.has_hedge)
_column("txt_gov_relevance", f"least(len(list_filter({_list(X.GOVERNMENT_KEYWORDS)}, lambda p: contains(lower(body), p)))/3, 1.0)", lambda c: X.relevance(c, X.GOVERNMENT_KEYWORDS)["score"])
_column("txt_proc_relevance", f"least(len(list_filter({_list(X.PROCUREMENT_KEYWORDS)}, lambda p: contains(lower(body), p)))/3, 1.0)", lambda c: X.relevance(c, X.PROCUREMENT_KEYWORDS)["score"])
_column("txt_ids", _SORTED.format(f"regexp_extract_all(body, '{X.UEI}')"), lambda c: X.identifiers(c)["uei"])
_column("txt_ids_cage", _SORTED.format(f"regexp_extract_all(body, '{X.CAGE}')"), lambda c: X.identifiers(c)["cage"])
_column("txt_snippet", "left(body, 80)", lambda c: X.snippet(c, 80))
_column("txt_pii_detect", f"list_filter([case when regexp_matches(body, '{X.SSN}') then concat('ssn:', left(regexp_extract(body, '{X.SSN}'), 5), '***') end, case when regexp_matches(body, '{X.PERSONAL_EMAIL}') then concat('email:', left(regexp_extract(body, '{X.PERSONAL_EMAIL}'), 10), '***') end], lambda x: x is not null)", X.detect_pii)
_column("src_fraud_topic", " or ".join(f"contains(lower(concat(title, ' ', body)), '{w}')" for w in X.FRAUD_TOPICS), lambda c: F.size(X._contained(F.lower(F.concat_ws(" ", "title", c)), X.FRAUD_TOPICS)) > 0)


@query("txt_sanitize", f"{_R} select doc_id, body v from releases")
def _(t):
    return B.releases(t).select("doc_id", X.sanitize(F.concat(F.lit("<b class='x'>\x07 "), "body", F.lit("</b>\n"))).alias("v"))


_PHRASES = f"select claim_id, list_filter(regexp_extract_all(statement, '{X.NAME_PHRASE}'), lambda x: len(x) > 2 and not list_contains({_list(X.PHRASE_STOP)}, x)) p from claims"


@query("txt_name_phrases", f"with {B.CLAIMS} select claim_id, array_to_string(p, '|') phrases from ({_PHRASES})")
def _(t):
    return B.claims(t).select("claim_id", F.array_join(X.name_phrases(F.col("statement")), "|").alias("phrases"))


@query("txt_release_mentions", f"{_R} select doc_id, split_part(title, ' Agrees', 1) as name, 'vendor' as type, 'defendant' as role from releases union all select doc_id, source, 'agency', 'prosecutor' from releases union all select doc_id, 'fraud', 'topic', 'subject' from releases")
def _(t):
    docs = B.releases(t).withColumn("topics", F.array(F.lit("fraud"), F.lit("tax"))).withColumn("component", F.col("source"))
    return D.release_mentions(docs)


_WHOLE = "concat(title, ' ', body)"
_FACTS = f"""{_R}, w as (select doc_id, source, title, {_WHOLE} body from releases), v as (select doc_id, source, title, body, list_distinct({_VALUES}) amounts from w)
select doc_id, source, 'amount' fact_type, null as value, unnest(amounts) value_usd from v
union all select doc_id, source, 'docket', unnest(list_distinct(regexp_extract_all(body, '{X.CASE_NUMBER}', 1))), null from v
union all select doc_id, source, 'district', unnest(list_distinct(regexp_extract_all(body, '{X.DISTRICT}', 1))), null from v
union all select doc_id, source, 'statute', unnest({_named("body", X.STATUTES)}), null from v
union all select doc_id, source, 'action', unnest({_named("body", X.ACTIONS)}), null from v
union all select doc_id, source, 'uei', unnest(list_distinct(regexp_extract_all(body, '{X.UEI}'))), null from v
union all select doc_id, source, 'defendant', split_part(title, ' Agrees', 1), null from v"""


@query("job_extract_facts", _FACTS)
def _(t):
    return D.extract_facts(B.releases(t))


@query("job_relevance", f"{_R}, m as (select doc_id, source, len(list_filter({_list(X.PROCUREMENT_KEYWORDS)}, lambda p: contains(lower({_WHOLE}), p))) n_matches from releases) select doc_id, source, n_matches, least(n_matches/3, 1.0) score from m where n_matches>0")
def _(t):
    return D.relevance(B.releases(t), X.PROCUREMENT_KEYWORDS)


@query("job_privacy_report", f"{_R}, h as (" + " union all ".join(f"select source, '{k}' kind, len(regexp_extract_all(body, '{p}')) n from releases" for k, p in (("ssn", X.SSN), ("phone", X.PHONE), ("personal_email", X.PERSONAL_EMAIL))) + ") select source, kind, count(*) docs, sum(n)::bigint hits from h where n>0 group by 1,2")
def _(t):
    return D.privacy_report(B.releases(t))


def _masked(column):
    return f"regexp_replace(regexp_replace(regexp_replace({column}, '{X.SSN}', '[SSN_REDACTED]', 'g'), '{X.PHONE}', '[PHONE_REDACTED]', 'g'), '{X.PERSONAL_EMAIL}', '[EMAIL_REDACTED]', 'g') as {column}"


@query("job_masked_copy", f"{_R} select doc_id, source, {_masked('title')}, {_masked('body')} from releases")
def _(t):
    return D.masked_copy(B.releases(t))


_REASONS = f"list_concat({_named('body', X.INJECTION)}, list_filter([case when {' or '.join(f'contains(lower(body), {chr(39)}{w}{chr(39)})' for w in X.BANNED)} then 'banned_phrase' end, case when {' or '.join(f'regexp_matches(body, {chr(39)}{p}{chr(39)})' for p in X.CERTAINTY)} then 'certainty' end], lambda x: x is not null))"


@query("job_screen_text", f"{_R}, r as (select unnest({_REASONS}) reason from releases) select reason, count(*) n from r group by 1")
def _(t):
    _, blocked = D.screen(B.releases(t))
    return blocked.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
