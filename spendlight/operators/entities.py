"""Entity resolution over whole tables: normalization, tiers of matching, upsert by components."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlight.functions.columns import blank_to_null
from spendlight.operators.components import connected_components
from spendlight.operators.matching import contained
from spendlight.storage import cut, store


def _compatible(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def normalize_name(name: Column) -> Column:
    """Upper-cased ASCII form with letters, digits, & , . - and single spaces in place of all else; a Python stage for every row."""
    return normalize_ascii(F.pandas_udf(_compatible, "string")(name))


def normalize_ascii(name: Column) -> Column:
    """``normalize_name`` for names known to be ASCII: no Python stage in the plan."""
    kept = F.regexp_replace(name, r"[^a-zA-Z0-9\s&,.\-]", " ")
    return F.upper(F.trim(F.regexp_replace(kept, r"\s+", " ")))


def with_normalized(df: DataFrame, source: str, target: str) -> DataFrame:
    """``df`` with ``target``, the normal form of ``source``; only rows with other than ASCII signs go through Python."""
    other = F.coalesce(F.regexp_like(F.col(source), F.lit(r"[^\x00-\x7F]")), F.lit(False))
    plain = df.where(~other).withColumn(target, normalize_ascii(F.col(source)))
    return plain.unionByName(df.where(other).withColumn(target, normalize_name(F.col(source))))


def vendor_names(df: DataFrame, fields: list[str], key: str) -> DataFrame:
    """``(key, name)``: the distinct non-blank values of the name fields."""
    names = F.array_distinct(F.array_compact(F.array(*(blank_to_null(F.col(c)) for c in fields))))
    return df.select(key, F.explode(names).alias("name"))


def pick_ids(uei: Column, uei_found: Column, cage: Column, cage_found: Column) -> tuple[Column, Column]:
    """The declared identifier, else the smallest candidate from the text."""
    return F.coalesce(F.nullif(uei, F.lit("")), F.array_min(uei_found)), F.coalesce(F.nullif(cage, F.lit("")), F.array_min(cage_found))


def upsert_entities(names: DataFrame) -> DataFrame:
    """``names`` (name_id long, name, uei, cage_code) merged into entities by equal canonical name or UEI.

    Members of a component become one entity: canonical name of its smallest name_id, the others'
    names as aliases, the smallest identifiers.
    """
    rows = with_normalized(names, "name", "canonical").where(F.coalesce("canonical", F.lit("")) != "")
    rows = cut(rows)
    heads = lambda c: rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("name_id").alias("b"))
    edges = rows.join(heads("canonical"), "canonical").select(F.col("name_id").alias("a"), "b")
    edges = edges.unionByName(rows.join(heads("uei"), "uei").select(F.col("name_id").alias("a"), "b"))
    linked = cut(connected_components(edges).withColumnRenamed("id", "name_id"))
    own = rows.join(linked, "name_id", "left").withColumn("entity", F.coalesce("component", "name_id"))
    return own.groupBy("entity").agg(
        F.min_by("canonical", "name_id").alias("canonical_name"), F.array_sort(F.collect_set("canonical")).alias("aliases"), F.min("uei").alias("uei"), F.min("cage_code").alias("cage_code"), F.count(F.lit(1)).alias("n_names")
    )


def mentions(names: DataFrame) -> DataFrame:
    """One mention per (artifact, raw name) with its whole extent."""
    return names.select("artifact_id", "raw_text").distinct().select("artifact_id", "raw_text", F.lit(0).alias("offset_start"), F.length("raw_text").alias("offset_end"))


def resolve_exact(seeds: DataFrame, entities: DataFrame) -> DataFrame:
    """Seeds met by UEI or CAGE code, at 1.0: two equal joins instead of one with OR."""
    least = lambda c: entities.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("entity_id").alias("entity_id"))
    by = lambda c: seeds.where(F.col(c).isNotNull()).join(least(c), c).select("seed_id", "entity_id")
    return by("uei").unionByName(by("cage_code")).groupBy("seed_id").agg(F.min("entity_id").alias("entity_id")).select("seed_id", "entity_id", F.lit(1.0).alias("confidence"), F.lit("exact").alias("method"), F.lit(1).alias("tier"))


def named(seeds: DataFrame) -> DataFrame:
    """``(seed_id, canonical)``: the seeds' names in normal form."""
    return with_normalized(seeds.select("seed_id", "name"), "name", "canonical").select("seed_id", "canonical")


def resolve_name(seeds: DataFrame, entities: DataFrame) -> DataFrame:
    return _by_name(named(seeds), entities)


def _by_name(names: DataFrame, entities: DataFrame) -> DataFrame:
    own = names.select("seed_id", F.col("canonical").alias("canonical_name")).where("canonical_name <> ''")
    least = entities.groupBy("canonical_name").agg(F.min("entity_id").alias("entity_id"))
    met = own.hint("merge").join(least.hint("merge"), "canonical_name")
    return met.groupBy("seed_id").agg(F.min("entity_id").alias("entity_id")).select("seed_id", "entity_id", F.lit(0.95).alias("confidence"), F.lit("canonical_name").alias("method"), F.lit(2).alias("tier"))


def resolve_partial(seeds: DataFrame, entities: DataFrame) -> DataFrame:
    """The shortest entity name that contains the seed's name: distinct names meet first, then their seeds."""
    return _by_part(named(seeds), entities)


def _by_part(names_: DataFrame, entities: DataFrame) -> DataFrame:
    own = names_.select("seed_id", F.col("canonical").alias("part")).where(F.length("part") > 0)
    names = entities.where(F.length("canonical_name") > 0).groupBy("canonical_name").agg(F.min("entity_id").alias("entity_id"))
    met = contained(store(names), "canonical_name", store(own.select("part").distinct()), "part")
    best = met.groupBy("part").agg(F.min(F.struct(F.length("canonical_name").alias("n"), "canonical_name", "entity_id")).alias("best"))
    return own.hint("merge").join(best.hint("merge"), "part").select("seed_id", "best.entity_id", F.lit(0.75).alias("confidence"), F.lit("partial_name").alias("method"), F.lit(3).alias("tier"))


def resolve(seeds: DataFrame, entities: DataFrame) -> DataFrame:
    """Each seed's best tier: exact, name, partial, or a new entity at 0.5 whose id hashes the name."""
    known = store(named(seeds))
    tiers = resolve_exact(seeds, entities).unionByName(_by_name(known, entities)).unionByName(_by_part(known, entities))
    best = tiers.groupBy("seed_id").agg(F.min_by(F.struct("entity_id", "confidence", "method"), "tier").alias("r"))
    return known.hint("merge").join(best.hint("merge"), "seed_id", "left").select(
        "seed_id", F.coalesce("r.entity_id", F.substring(F.sha2(F.concat(F.lit("vendor|"), "canonical"), 256), 1, 32)).alias("entity_id"), F.coalesce("r.confidence", F.lit(0.5)).alias("confidence"), F.coalesce("r.method", F.lit("new_entity")).alias("method")
    )


def create_entities(resolved: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows of the new entities; the raw name is an alias where it differs from the canonical one."""
    new = resolved.where("method = 'new_entity'").select("seed_id", "entity_id").hint("merge").join(with_normalized(seeds.select("seed_id", "name"), "name", "normal").hint("merge"), "seed_id")
    canonical = F.coalesce(F.nullif("normal", F.lit("")), F.upper("name"))
    return new.select("entity_id", F.lit("vendor").alias("entity_type"), canonical.alias("canonical_name"), F.when(canonical != F.col("name"), F.array("name")).otherwise(F.array().cast("array<string>")).alias("aliases"))


def apply_hints(resolved: DataFrame, hints: DataFrame) -> DataFrame:
    """Raises the confidence to that of a better hint (seed_id, confidence, aliases), 0.9 at most, and adds its aliases to the seed's own."""
    none = F.array().cast("array<string>")
    own = F.coalesce("aliases", none) if "aliases" in resolved.columns else none
    joined = resolved.withColumn("own", own).join(hints.select("seed_id", F.col("confidence").alias("hint"), F.col("aliases").alias("more")), "seed_id", "left")
    better = F.col("hint") > F.col("confidence")
    aliases = F.when(better, F.array_union("own", F.coalesce("more", none))).otherwise(F.col("own"))
    return joined.select("seed_id", "entity_id", F.when(better, F.least("hint", F.lit(0.9))).otherwise(F.col("confidence")).alias("confidence"), "method", F.array_sort(aliases).alias("aliases"))


def related(primaries: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """Up to ``limit`` neighbours of each primary by confidence (0 counts as 0.5), then id."""
    weight = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(0.5)).alias("confidence")
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("neighbour"), weight).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("neighbour"), weight))
    met = primaries.join(both, "id").where("id <> neighbour").groupBy("id", "neighbour").agg(F.max("confidence").alias("confidence"))
    order = Window.partitionBy("id").orderBy(F.desc("confidence"), "neighbour")
    return met.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit).select("id", "neighbour", "confidence", F.lit("graph").alias("method"))


def resolution_coverage(mentions: DataFrame) -> DataFrame:
    return mentions.agg((F.count("resolved_entity_id") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("coverage"))
