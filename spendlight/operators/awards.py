"""Landed award records as rows: either spelling of their keys, flat or nested under recipient and place.

A record is JSON text in a column ``content``; a key counts as given where its value is neither missing,
null nor empty, and the first spelling that is given counts. A record that is no JSON object has blank fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the keys of a landed award, in either spelling, and of the records nested in it
FLAT = (
    "recipient_name", "Recipient Name", "recipient_uei", "Recipient UEI", "recipient_duns", "Recipient DUNS", "award_id", "Award ID", "generated_internal_id", "award_amount", "Award Amount",
    "total_outlays", "Total Outlays", "award_type", "Award Type", "contract_award_type", "Contract Award Type", "awarding_agency", "Awarding Agency", "awarding_sub_agency", "Awarding Sub Agency",
    "funding_agency", "start_date", "Start Date", "end_date", "End Date", "naics_code", "NAICS Code", "naics_description", "psc_code", "PSC Code", "pop_city_code", "pop_state_code",
    "extent_competed", "Extent Competed", "set_aside_type", "Set Aside Type", "pricing_type", "Pricing Type", "number_of_offers_received",
)
LOCATION = ("address_line1", "city_name", "state_code", "zip5", "country_code")
RECIPIENT = ("recipient_name", "recipient_uei", "recipient_duns", "parent_recipient_name", "parent_recipient_uei")
PLACE = ("city_name", "state_code", "zip5", "country_code", "congressional_code")
# fixed values: codes of awards without competition, as the parser reads them
SOLE_SOURCE_PARSER = ("NOT COMPETED", "NOT AVAILABLE FOR COMPETITION", "SOLE SOURCE", "A", "B", "C", "D", "E", "CDO")
HIGH_VALUE = 10_000_000


def _fields(names) -> str:
    return ", ".join(f"`{n}`: string" for n in names)


# keys differ by case and blanks; a record that isn't nested where it should be is null
SCHEMA = f"struct<{_fields(FLAT)}, recipient: struct<{_fields(RECIPIENT)}, business_types: array<string>, location: struct<{_fields(LOCATION)}>>, place_of_performance: struct<{_fields(PLACE)}>>"


def read_awards(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, a)``: each record of ``content`` as a struct of all its keys."""
    return df.select(key, F.from_json("content", SCHEMA).alias("a"))


def _first(*paths: str, otherwise: str = "") -> Column:
    return F.coalesce(*(F.nullif(F.col(f"a.{p}"), F.lit("")) for p in paths), F.lit(otherwise))


def _both(name: str) -> Column:
    """The field in the one spelling or the other."""
    other = next((n for n in FLAT if n != name and n.lower().replace(" ", "_") == name), None)
    return _first(name, *([f"`{other}`"] if other else []))


def _amount(name: str) -> Column:
    return F.coalesce(_both(name).try_cast("double"), F.lit(0.0))


def _recipient() -> list[Column]:
    own = [_first(f"recipient_{n}", f"recipient.recipient_{n}", f"`Recipient {label}`").alias(n) for n, label in (("name", "Name"), ("uei", "UEI"), ("duns", "DUNS"))]
    place = F.struct(
        *(_first(f"recipient.location.{path}").alias(n) for n, path in (("address_line1", "address_line1"), ("city", "city_name"), ("state", "state_code"), ("zip", "zip5"))),
        _first("recipient.location.country_code", otherwise="USA").alias("country"),
    )
    types = F.coalesce("a.recipient.business_types", F.array().cast("array<string>")).alias("business_types")
    return [*own, _first("recipient.parent_recipient_name").alias("parent_name"), _first("recipient.parent_recipient_uei").alias("parent_uei"), types, place.alias("location")]


def _details() -> list[Column]:
    texts = ("award_type", "contract_award_type", "awarding_agency", "awarding_sub_agency", "funding_agency", "start_date", "end_date", "naics_code", "naics_description", "psc_code")
    amounts = [_amount(n).alias(n) for n in ("award_amount", "total_outlays")]
    return [_both("award_id").alias("award_id"), _first("generated_internal_id").alias("generated_internal_id"), *amounts, *(_both(n).alias(n) for n in texts)]


def _place() -> list[Column]:
    nested = "place_of_performance"
    return [
        _first(f"{nested}.city_name", "pop_city_code").alias("city"), _first(f"{nested}.state_code", "pop_state_code").alias("state"), _first(f"{nested}.zip5").alias("zip"),
        _first(f"{nested}.country_code", otherwise="USA").alias("country"), _first(f"{nested}.congressional_code").alias("congressional_district"),
    ]


def _competition() -> list[Column]:
    extent = _both("extent_competed")
    offers = F.col("a.number_of_offers_received").try_cast("int").alias("number_of_offers")
    sole = F.upper(F.trim(extent)).isin(*SOLE_SOURCE_PARSER).alias("is_sole_source")
    return [extent.alias("extent_competed"), _both("set_aside_type").alias("set_aside_type"), _both("pricing_type").alias("pricing_type"), offers, sole]


def _indicators() -> Column:
    """Sole source, high value and cost-plus pricing, which is read from the competition's pricing type."""
    pricing, amount = F.lower(_both("pricing_type")), _amount("award_amount")
    one = lambda hit, kind, said, level: F.when(hit, F.struct(F.lit(kind).alias("type"), said.alias("description"), F.lit(level).alias("severity")))
    sole = one(F.upper(F.trim(_both("extent_competed"))).isin(*SOLE_SOURCE_PARSER), "sole_source", F.lit("Award was not competed (sole source)"), "medium")
    high = one(amount > HIGH_VALUE, "high_value", F.concat(F.lit("Award value exceeds $10M: $"), F.format_number(amount, 2)), "low")
    plus = one(F.contains(pricing, F.lit("cost")) & F.contains(pricing, F.lit("plus")), "cost_plus_pricing", F.lit("Cost-plus pricing type may warrant closer review"), "low")
    return F.array_compact(F.array(sole, high, plus))


def _mentions() -> Column:
    """The names that are given flat: the recipient's, the agency's and, if another, the sub-agency's."""
    name, agency, sub = _both("recipient_name"), _both("awarding_agency"), _both("awarding_sub_agency")
    one = lambda what, kind, role, also: F.when((what != "") & also, F.struct(what.alias("name"), F.lit(kind).alias("type"), F.lit(role).alias("role")))
    yes = F.lit(True)
    return F.array_compact(F.array(one(name, "vendor", "recipient", yes), one(agency, "government_agency", "awarding_agency", yes), one(sub, "government_agency", "awarding_sub_agency", sub != agency)))


def _select(df: DataFrame, columns: list[Column], key: str) -> DataFrame:
    return read_awards(df, key).select(key, *columns)


def parse_awards(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per award record: recipient, details, place, competition, indicators and mentions, in one pass."""
    parts = {"recipient": _recipient(), "award_details": _details(), "place_of_performance": _place(), "competition": _competition()}
    kind = [F.lit("contract_award").alias("doc_type"), F.lit("usaspending").alias("source")]
    return _select(df, [*kind, *(F.struct(*columns).alias(name) for name, columns in parts.items()), _indicators().alias("risk_indicators"), _mentions().alias("entities_found")], key)


def recipient(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return _select(df, _recipient(), key)


def award_detail(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return _select(df, _details(), key)


def place(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return _select(df, _place(), key)


def competition(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return _select(df, _competition(), key)


def award_indicators(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, type, description, severity)`` of sole-source, high-value and cost-plus awards."""
    return _select(df, [F.explode(_indicators()).alias("h")], key).select(key, "h.*")


def award_mentions(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, name, type, role)`` of the names an award gives."""
    return _select(df, [F.explode(_mentions()).alias("m")], key).select(key, "m.*")
