"""Column expressions shared by the operators. All of them are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c) -> Column:
    """The text without surrounding blanks, null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def first_text(*names: str) -> Column:
    """The first of the columns that is neither null nor empty, else the empty text."""
    return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.lit(""))


def number(c) -> Column:
    """The text as a double; 0 where it is none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))


def parse_date(c) -> Column:
    """A timestamp from the accepted date forms, trailing Z letters dropped; null otherwise."""
    text = F.regexp_replace(c, "Z+$", "")
    # fixed values: the accepted forms, in the order they are tried
    forms = ("yyyy-M-d", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s.SSSSSS", "M/d/yyyy", "yyyy-M-d H:m:s")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in forms))


def address_key(address, line1, city, state, zip_code) -> Column:
    """Upper-cased address, else the non-blank parts joined by comma."""
    parts = F.concat_ws(", ", *(blank_to_null(x) for x in (line1, city, state, zip_code)))
    return F.upper(F.trim(F.coalesce(blank_to_null(address), parts)))


def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 3959 * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def claim_id(case, key, statement) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", case, key, statement), 256), 1, 32)


def severity(value, *steps: tuple[float, str], otherwise: str, strict: bool = False) -> Column:
    """The name of the first step that ``value`` reaches (exceeds, if strict)."""
    out = None
    for least, name in steps:
        hit = value > least if strict else value >= least
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)
