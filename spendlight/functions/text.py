"""Text operators as column expressions; the pattern tables are data.

District names use Unicode classes, as the source texts' own rules do; the other patterns hold ASCII words alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns and word lists by operator
AMOUNT = r"(?i)\$\s*([\d,]+(?:\.\d{1,2})?)\s*(million|billion|thousand)?"
AMOUNT_RAW = r"(?i)\$[\d,]+(?:\.\d{1,2})?\s*(?:million|billion)?"
CASE_NUMBER = r"(?i)(?:Case\s+(?:No\.\s*)?|No\.\s+)(\d{1,2}[:-]\d{2}[:-](?:cv|cr|mc|mj|po)-\d+(?:-\w+)?)"
CASE_NUMBER_RAW = r"(?i)(?:Case\s+(?:No\.\s*)?|No\.\s+)\d{1,2}[:-]\d{2}[:-](?:cv|cr|mc|mj|po)-\d+"
DISTRICT = r"(?i)((?:Eastern|Western|Northern|Southern|Central|Middle)\s+District\s+of\s+\w+(?:\s+\w+)?)"
DISTRICT_RAW = r"(?i)(?:Eastern|Western|Northern|Southern|Central|Middle)\s+District\s+of\s+\w+"
STATUTES = {
    "false_claims_act": r"False\s+Claims\s+Act",
    "anti_kickback": r"Anti-?Kickback\s+(?:Statute|Act)",
    "wire_fraud": r"wire\s+fraud",
    "mail_fraud": r"mail\s+fraud",
    "conspiracy": r"conspiracy\s+to\s+(?:defraud|commit)",
    "trade_secrets": r"(?:trade\s+secrets?|Economic\s+Espionage\s+Act)",
    "bribery": r"brib(?:ery|ing|e)",
    "money_laundering": r"money\s+laundering",
    "bid_rigging": r"bid\s+rig(?:ging|ged)",
    "qui_tam": r"qui\s+tam",
}
ACTIONS = {
    "civil_settlement": r"(?:agreed?\s+to\s+pay|settle(?:ment|d)|resolved|paid)",
    "criminal_conviction": r"(?:convicted|pleaded?\s+guilty|guilty\s+plea|sentenced)",
    "debarment": r"(?:debar(?:red|ment)|suspend(?:ed|sion)|excluded)",
    "indictment": r"(?:indicted|charged|arraigned)",
}
FRAUD_TOPICS = ["false claims act", "procurement fraud", "government contract fraud", "kickback", "bid rigging", "wire fraud", "fraud", "qui tam", "civil settlement", "debarment"]
GOVERNMENT_KEYWORDS = [
    "government contract", "federal contract", "defense contract", "department of defense", "dod", "department of homeland security", "dhs", "usaid", "fema", "gsa",
    "general services administration", "procurement", "sole source", "cost-plus", "far ", "dfars", "government customer", "government revenue", "classified program",
]
PROCUREMENT_KEYWORDS = [
    "procurement fraud", "contract fraud", "false claim", "overbilling", "cost mischarging", "defective pricing", "product substitution", "kickback", "bid rigging",
    "conflict of interest", "waste", "abuse", "mismanagement", "suspension", "debarment",
]
BANNED = [
    "committed fraud", "guilty of fraud", "is defrauding", "has defrauded", "criminals", "criminal enterprise", "is corrupt", "corrupt official", "stole taxpayer", "theft of public",
    "money laundering scheme", "convicted of", "should be prosecuted", "must be charged", "evidence proves guilt", "undeniable proof of fraud", "clearly guilty", "engaged in bribery",
    "is a fraudster", "criminal conspiracy proven",
]
INJECTION = {
    "ignore_previous": r"(?i)ignore\s+(all\s+)?previous\s+instructions?",
    "new_role": r"(?i)you\s+are\s+now\s+(?:acting\s+as|a\s+new)",
    "disregard": r"(?i)disregard\s+your\s+(?:previous\s+)?instructions?",
    "forget": r"(?i)forget\s+everything\s+(?:you\s+know|above)",
    "system_tag": r"(?i)<\s*system\s*>",
    "template": r"(?s)\{\{.*?\}\}",
    "prompt_injection": r"(?i)prompt\s*injection",
    "jailbreak": r"(?i)jailbreak",
    "dan_mode": r"(?i)DAN\s+mode",
}
CERTAINTY = [
    r"(?i)\b(definitely|certainly|undoubtedly|it is clear that|proof that|proven)\b",
    r"(?i)\b(committed fraud|is guilty|is a fraud|is fraudulent)\b",
    r"(?i)\b(we can confirm|this confirms|this proves)\b",
]
HEDGES = [
    r"(?i)\b(risk signal|hypothesis|suggests|may indicate|potential|alleged|suspected|appears to|could indicate)\b",
    r"(?i)\b(cannot conclude|insufficient evidence|further investigation)\b",
]
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PHONE = r"\b(?:\+?1[- ]?)?\(?\d{3}\)?[- ]?\d{3}[- ]?\d{4}\b"
CARD = r"\b(?:\d[ -]?){15,16}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PERSONAL_EMAIL = r"(?i)\b[A-Za-z0-9._%+-]+@(?:gmail|yahoo|hotmail|outlook|aol|icloud|protonmail)\.\w+\b"
UEI, CAGE = r"\b[A-Z0-9]{12}\b", r"\b[0-9A-Z]{5}\b"
DEFENDANT = [r"(?i)^(.+?)\s+(?:Agrees?|Pays?|Pleads?|Settles?|Convicted)", r"(?i)^(.+?)\s+(?:and\s+.+?\s+)?(?:to\s+Pay|Charged|Indicted)"]
NAME_PHRASE = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"
PHRASE_STOP = (
    "The", "This", "That", "These", "Those", "However", "Although", "While", "During", "Between",
    "Within", "Through", "Federal", "Contract", "Award", "Government",
)


def _all(text, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _named(text, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.regexp_like(text, F.lit(p if p.startswith("(?") and not p.startswith("(?:") else "(?i)" + p)), F.lit(n)) for n, p in patterns.items())))


def _contained(text, words: list[str]) -> Column:
    return F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w))


def amounts_plain(text) -> Column:
    """Dollar amounts in text order: array of (raw number, value)."""
    scale = lambda u: F.when(F.lower(u) == "billion", 1e9).when(F.lower(u) == "million", 1e6).when(F.lower(u) == "thousand", 1e3).otherwise(1.0)
    both = F.arrays_zip(_all(text, AMOUNT, 1).alias("n"), _all(text, AMOUNT, 2).alias("u"))
    found = F.transform(both, lambda x: F.struct(x["n"].alias("raw"), (F.replace(x["n"], F.lit(","), F.lit("")).try_cast("double") * scale(x["u"])).alias("value_usd")))
    return F.filter(found, lambda x: x["value_usd"].isNotNull())


def amounts(text) -> Column:
    """Distinct dollar values, largest first."""
    return F.sort_array(F.array_distinct(F.transform(amounts_plain(text), lambda x: x["value_usd"])), asc=False)


def amounts_raw(text) -> Column:
    return _all(text, AMOUNT_RAW, 0)


def case_numbers(text) -> Column:
    return F.array_sort(F.array_distinct(_all(text, CASE_NUMBER, 1)))


def case_numbers_raw(text) -> Column:
    return _all(text, CASE_NUMBER_RAW, 0)


def districts(text, raw: bool = False) -> Column:
    # (?U): a name's letters and blanks are those of any script
    return _all(text, "(?U)" + DISTRICT_RAW, 0) if raw else F.array_sort(F.array_distinct(_all(text, "(?U)" + DISTRICT, 1)))


def statutes(text) -> Column:
    return _named(text, STATUTES)


def actions(text) -> Column:
    return _named(text, ACTIONS)


def sanitize(text) -> Column:
    """Without tags and control characters, trimmed."""
    bare = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def defendant(title) -> Column:
    """The party a title names: the first pattern that matches decides, even if its length is out of bounds."""
    one, two = (F.trim(F.regexp_extract(title, p, 1)) for p in DEFENDANT)
    name = F.when(F.regexp_like(title, F.lit(DEFENDANT[0])), one).when(F.regexp_like(title, F.lit(DEFENDANT[1])), two)
    return F.when((F.length(name) > 2) & (F.length(name) < 200), name)


def relevance(text, keywords: list[str]) -> Column:
    """Struct of the keywords found in the lower-cased text, a flag and a score."""
    found = _contained(F.lower(text), keywords)
    return F.struct(found.alias("matches"), (F.size(found) > 0).alias("relevant"), F.least(F.size(found) / 3, F.lit(1.0)).alias("score"))


def identifiers(text) -> Column:
    return F.struct(F.array_sort(F.array_distinct(_all(text, UEI, 0))).alias("uei"), F.array_sort(F.array_distinct(_all(text, CAGE, 0))).alias("cage"))


def mask_mention(text) -> Column:
    out = F.regexp_replace(text, SSN, "[SSN_REDACTED]")
    return F.regexp_replace(F.regexp_replace(out, PHONE, "[PHONE_REDACTED]"), PERSONAL_EMAIL, "[EMAIL_REDACTED]")


def redact_pii(text) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, SSN, "[SSN]"), CARD, "[CARD]"), EMAIL, "[EMAIL]")
    return F.struct(out.alias("text"), (~out.eqNullSafe(text)).alias("changed"))


def detect_pii(text) -> Column:
    ssn, mail = F.regexp_extract(text, SSN, 0), F.regexp_extract(text, PERSONAL_EMAIL, 0)
    return F.array_compact(F.array(F.when(ssn != "", F.concat(F.lit("ssn:"), F.substring(ssn, 1, 5), F.lit("***"))), F.when(mail != "", F.concat(F.lit("email:"), F.substring(mail, 1, 10), F.lit("***")))))


def screen_input(text, redact: bool = True) -> Column:
    reasons = _named(text, INJECTION)
    safe = redact_pii(text)["text"] if redact else text
    return F.struct((F.size(reasons) == 0).alias("allowed"), F.when(F.size(reasons) > 0, "").otherwise(safe).alias("text"), reasons.alias("reasons"))


def banned_phrase(text) -> Column:
    return F.get(_contained(F.lower(text), BANNED), F.lit(0))


def certainty(text) -> Column:
    return F.filter(F.array(*(F.regexp_extract(text, p, 1) for p in CERTAINTY)), lambda x: x != "")


def has_hedge(text) -> Column:
    return F.regexp_like(text, F.lit(HEDGES[0])) | F.regexp_like(text, F.lit(HEDGES[1]))


def name_phrases(text) -> Column:
    found = F.array_distinct(F.filter(_all(text, NAME_PHRASE, 0), lambda x: F.length(x) > 2))
    return F.slice(F.array_except(found, F.array(*(F.lit(w) for w in PHRASE_STOP))), 1, 8)


def snippet(text, n: int) -> Column:
    return F.substring(text, 1, n)
