"""Risk signals for every vendor, award, address or officer in one pass.

Signals share the columns anomaly_type, subject, detected, severity, score; each detector adds its evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlight.functions.columns import haversine_miles, number, severity
from spendlight.operators.ranking import ranked
from spendlight.storage import store

# fixed values: codes and texts of awards without competition, as the detector reads them
SOLE_SOURCE_DETECTOR = ("NOT COMPETED", "SOLE SOURCE", "A", "B", "C", "D", "E")

# fixed values: rough state centres (latitude, longitude)
STATE_CENTRES = {
    "AL": (32.7, -86.7), "AK": (64.0, -153.0), "AZ": (34.3, -111.7), "AR": (34.8, -92.2), "CA": (37.2, -119.7), "CO": (38.9, -105.5),
    "CT": (41.6, -72.7), "DE": (38.9, -75.5), "FL": (28.6, -82.4), "GA": (32.7, -83.4), "HI": (20.5, -157.5), "ID": (44.4, -114.6),
    "IL": (40.0, -89.2), "IN": (39.9, -86.3), "IA": (42.0, -93.5), "KS": (38.5, -98.3), "KY": (37.5, -85.3), "LA": (31.0, -91.9),
    "ME": (45.4, -69.2), "MD": (39.0, -76.7), "MA": (42.2, -71.8), "MI": (44.3, -84.5), "MN": (46.3, -94.3), "MS": (32.7, -89.7),
    "MO": (38.6, -92.6), "MT": (47.0, -109.6), "NE": (41.5, -99.8), "NV": (39.3, -116.6), "NH": (43.7, -71.6), "NJ": (40.1, -74.7),
    "NM": (34.4, -106.1), "NY": (42.9, -75.5), "NC": (35.5, -79.8), "ND": (47.5, -100.5), "OH": (40.4, -82.7), "OK": (35.6, -97.5),
    "OR": (43.9, -120.6), "PA": (40.9, -77.8), "RI": (41.7, -71.5), "SC": (33.9, -80.9), "SD": (44.4, -100.2), "TN": (35.8, -86.3),
    "TX": (31.5, -99.3), "UT": (39.3, -111.7), "VT": (44.1, -72.6), "VA": (37.5, -78.8), "WA": (47.4, -120.7), "WV": (38.6, -80.6),
    "WI": (44.6, -89.8), "WY": (43.0, -107.6), "DC": (38.9, -77.0),
}
WEIGHTS = {"low": 0.2, "medium": 0.5, "high": 0.8, "critical": 1.0}


def _centre(state: Column, axis: int) -> Column:
    pairs = [F.lit(x) for s, c in STATE_CENTRES.items() for x in (s, c[axis])]
    return F.try_element_at(F.create_map(*pairs), state)


def sole_source(awards: DataFrame, threshold: float = 0.8, min_awards: int = 3, eligible_first: bool = False) -> DataFrame:
    """Per vendor the agency with the largest share of awards without competition.

    Ties go to more awards, then to the smaller agency name. With ``eligible_first`` agencies of
    fewer than ``min_awards`` awards are passed over before the worst is chosen.
    """
    sole = F.coalesce("is_sole_source", F.lit(False)) | F.coalesce(F.upper("extent_competed").isin(*SOLE_SOURCE_DETECTOR), F.lit(False))
    by_agency = awards.groupBy("vendor_id", F.coalesce("awarding_agency", F.lit("unknown")).alias("agency")).agg(F.count(F.lit(1)).alias("total"), F.count_if(sole).alias("sole"))
    if eligible_first:
        by_agency = by_agency.where(F.col("total") >= min_awards)
    ratio = F.col("sole") / F.col("total")
    worst = Window.partitionBy("vendor_id").orderBy(F.desc("ratio"), F.desc("total"), "agency")
    top = by_agency.withColumn("ratio", ratio).withColumn("rn", F.row_number().over(worst)).where("rn = 1")
    hit = (F.col("ratio") >= threshold) & (F.col("total") >= min_awards)
    level = F.when(hit, severity(F.col("ratio"), (0.95, "high"), (0.90, "medium"), otherwise="low")).otherwise("none")
    agency = F.when(F.col("ratio") > 0, F.col("agency")).otherwise("")
    return top.select(F.lit("sole_source_concentration").alias("anomaly_type"), F.col("vendor_id").alias("subject"), hit.alias("detected"), level.alias("severity"), F.col("ratio").alias("score"), agency.alias("agency"), "total", "sole")


def mod_inflation(awards: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per award the growth of its amount over the original one."""
    original, current = number("original_amount"), F.coalesce(F.nullif(number("current_amount"), F.lit(0.0)), number("award_amount"))
    ratio = F.when((original > 0) & ~F.isnan(original) & (original < float("inf")) & ~F.isnan(current), (current - original) / original)
    out = awards.withColumn("ratio", ratio)
    hit = F.coalesce(F.col("ratio") > threshold, F.lit(False))
    level = F.when(hit, severity(F.col("ratio"), (2.0, "high"), (1.0, "medium"), otherwise="low", strict=True)).otherwise("none")
    return out.select(F.lit("modification_inflation").alias("anomaly_type"), F.col("award_id").alias("subject"), hit.alias("detected"), level.alias("severity"), F.coalesce(F.least(F.col("ratio") / 2, F.lit(1.0)), F.lit(0.0)).alias("score"), "ratio")


def geo_mismatch(pairs: DataFrame, miles: float = 1000.0) -> DataFrame:
    """Per pair of vendor and performance place their distance, by coordinates or else by state centres."""
    exact = F.coalesce((F.col("lat1") != 0) & (F.col("lon1") != 0) & (F.col("lat2") != 0) & (F.col("lon2") != 0), F.lit(False))
    known = F.col("state1").isNotNull() & F.col("state2").isNotNull() & (F.col("state1") != "") & (F.col("state2") != "")
    centres = haversine_miles(_centre(F.col("state1"), 0), _centre(F.col("state1"), 1), _centre(F.col("state2"), 0), _centre(F.col("state2"), 1))
    by_state = F.when(~known, None).when(F.col("state1") == F.col("state2"), 0.0).otherwise(F.coalesce(centres, F.lit(500.0)))
    distance = F.when(exact, haversine_miles(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))).otherwise(by_state)
    out = pairs.withColumn("distance", distance)
    hit = F.coalesce(F.col("distance") > miles, F.lit(False))
    level = F.when(hit, severity(F.col("distance"), (2500.0, "high"), (1500.0, "medium"), otherwise="low", strict=True)).otherwise("none")
    return out.select(F.lit("geographic_mismatch").alias("anomaly_type"), F.col("pair_id").alias("subject"), hit.alias("detected"), level.alias("severity"), F.coalesce(F.least(F.col("distance") / 3000, F.lit(1.0)), F.lit(0.0)).alias("score"), "distance")


def rapid_award(awards: DataFrame, days: int = 30, min_awards: int = 3) -> DataFrame:
    """Per vendor the window of ``days`` days, both ends included, that starts with an award and holds most of them.

    Awards without a vendor or a time take no part.
    """
    dated = awards.where(F.col("start_ts").isNotNull()).withColumn("at", F.unix_micros(F.col("start_ts").cast("timestamp")))
    by_time = dated.groupBy("vendor_id", "at").agg(F.count(F.lit(1)).alias("n"))
    # each time asks, at the end of its window, how many awards there were by then; running sums go over range cells, so that
    # no task holds a whole vendor
    asks = by_time.select("vendor_id", (F.col("at") + days * 86_400_000_000).alias("at"), F.lit(0).cast("long").alias("n"), F.col("at").alias("of"))
    events = by_time.select("vendor_id", "at", "n", F.lit(None).cast("long").alias("of"))
    summed = ranked(events.unionByName(asks), "vendor_id", [F.col("at"), F.col("of").asc_nulls_first()], "n")
    start = F.coalesce("of", "at")
    inside = F.sum(F.when(F.col("of").isNotNull(), F.col("so_far")).otherwise(F.col("n") - F.col("so_far")))
    windows = summed.groupBy("vendor_id", start.alias("at")).agg(inside.alias("in_window"))
    best = windows.groupBy("vendor_id").agg(F.max(F.struct(F.col("in_window").alias("n"), (-F.col("at")).alias("back"))).alias("m"))
    best = best.select("vendor_id", F.col("m.n").alias("in_window"), (-F.col("m.back")).alias("at"))
    hit = F.col("in_window") >= min_awards
    level = F.when(hit, severity(F.col("in_window"), (8, "high"), (5, "medium"), otherwise="low")).otherwise("none")
    return best.select(F.lit("rapid_award").alias("anomaly_type"), F.col("vendor_id").alias("subject"), hit.alias("detected"), level.alias("severity"), F.least(F.col("in_window") / 10, F.lit(1.0)).alias("score"), "in_window", F.timestamp_micros("at").alias("window_start"))


def address_ring(entities: DataFrame, min_entities: int = 3) -> DataFrame:
    """Addresses (``address_key``) that at least ``min_entities`` entities share."""
    rings = entities.where(F.coalesce("address_key", F.lit("")) != "").groupBy("address_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_entities)
    level = severity(F.col("n"), (5, "high"), otherwise="medium")
    return rings.select(F.lit("shared_address").alias("anomaly_type"), F.col("address_key").alias("subject"), F.lit(True).alias("detected"), level.alias("severity"), F.least(F.col("n") / 5, F.lit(1.0)).alias("score"), "n")


def _bits(members: str, shift: int) -> Column:
    """A bit of 64 for each member, by its hash from bit ``shift`` on."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(F.xxhash64(x), shift), F.lit(64)).cast("int"))
    return F.aggregate(members, F.lit(0).cast("long"), lambda seen, x: seen.bitwiseOR(bit(x)))


def officer_overlap(officers: DataFrame, min_overlap: int = 2) -> DataFrame:
    """Entity sets of two or more that several officers serve: for each distinct set, officers whose own set contains it.

    Equal sets are one row. A set meets only the larger sets that hold that member of it which the fewest sets have, and
    there only those whose 128 bits, two of each member, hold its own; what is left is compared whole.
    """
    known = officers.where((F.coalesce("officer", F.lit("")) != "") & F.col("entity_id").isNotNull())
    served = known.groupBy(F.upper(F.trim("officer")).alias("officer")).agg(F.array_sort(F.collect_set("entity_id")).alias("members")).where(F.size("members") >= 2)
    counted = served.groupBy("members").agg(F.count(F.lit(1)).alias("own"))
    sets = store(counted.select(F.monotonically_increasing_id().alias("id"), "members", "own", F.size("members").alias("size"), _bits("members", 0).alias("low"), _bits("members", 6).alias("high")))
    placed = sets.select("id", "size", "low", "high", F.explode("members").alias("entity_id"))
    rarity = placed.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    each = placed.select("id", "entity_id").hint("merge").join(rarity.hint("merge"), "entity_id")
    rarest = store(each.groupBy("id").agg(F.min(F.struct("n", "entity_id")).alias("r")).select("id", F.col("r.entity_id").alias("entity_id")))
    asked = rarest.hint("merge").join(sets.select("id", "size", "low", "high").hint("merge"), "id").select(F.col("id").alias("a"), "entity_id", *(F.col(c).alias(f"{c}_a") for c in ("size", "low", "high")))
    held = (F.col("size") > F.col("size_a")) & (F.col("low_a").bitwiseAND(F.col("low")) == F.col("low_a")) & (F.col("high_a").bitwiseAND(F.col("high")) == F.col("high_a"))
    met = store(asked.hint("merge").join(placed.hint("merge"), "entity_id").where(held).select("a", F.col("id").alias("b")))
    wanted = met.hint("merge").join(sets.select(F.col("id").alias("a"), F.col("members").alias("wanted")).hint("merge"), "a")
    both = wanted.hint("merge").join(sets.select(F.col("id").alias("b"), "members", F.col("own").alias("theirs")).hint("merge"), "b")
    more = both.where(F.size(F.array_except("wanted", "members")) == 0).groupBy(F.col("a").alias("id")).agg(F.sum("theirs").alias("more"))
    total = F.col("own") + F.coalesce("more", F.lit(0).cast("long"))
    counted = sets.select("id", "members", "own", "size").hint("merge").join(more.hint("merge"), "id", "left").select(F.array_join("members", "|").alias("set_key"), total.alias("n"), "size").where(F.col("n") >= min_overlap)
    return counted.select(F.lit("officer_overlap").alias("anomaly_type"), F.col("set_key").alias("subject"), F.lit(True).alias("detected"), severity(F.col("n"), (3, "high"), otherwise="medium").alias("severity"), F.least(F.col("n") / 3, F.lit(1.0)).alias("score"), "n", "size")


COMMON = ("anomaly_type", "subject", "detected", "severity", "score")


def all_signals(*signals: DataFrame) -> DataFrame:
    """The detected rows of several detectors with their common columns."""
    out = None
    for s in signals:
        own = s.where("detected").select(*COMMON)
        out = own if out is None else out.unionByName(own)
    return out


def composite(signals: DataFrame, vendors: DataFrame) -> DataFrame:
    """Per vendor the mean of score times severity weight, at most 1; 0 without signals."""
    weight = F.lit(0.3)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("severity") == name, w).otherwise(weight)
    means = signals.groupBy(F.col("subject").alias("vendor_id")).agg(F.avg(F.col("score") * weight).alias("m"))
    return vendors.join(means, "vendor_id", "left").select("vendor_id", F.least(F.coalesce("m", F.lit(0.0)), F.lit(1.0)).alias("composite_score"))


def merge_hypotheses(signals: DataFrame, hypotheses: DataFrame, cap: int = 5) -> DataFrame:
    """Signals and each case's first ``cap`` external hypotheses by confidence, as signals."""
    order = Window.partitionBy("case_id").orderBy(F.desc("confidence"), "hypothesis_id")
    level = F.when(F.col("confidence") < 0.7, "medium").otherwise("high")
    extra = hypotheses.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cap)
    extra = extra.select(F.lit("hypothesis").alias("anomaly_type"), F.col("hypothesis_id").alias("subject"), F.lit(True).alias("detected"), level.alias("severity"), F.col("confidence").alias("score"))
    return signals.select(*COMMON).unionByName(extra)


def award_concentration(awards: DataFrame) -> DataFrame:
    """Per agency the vendor with the largest total, and its share."""
    cents = F.round(F.col("award_amount") * 100).cast("long")
    totals = awards.groupBy("awarding_agency", "vendor_id").agg(F.sum(cents).alias("cents"))
    by = Window.partitionBy("awarding_agency")
    ranked = totals.withColumn("all_cents", F.sum("cents").over(by)).withColumn("rn", F.row_number().over(by.orderBy(F.desc("cents"), "vendor_id")))
    return ranked.where("rn = 1").select("awarding_agency", "vendor_id", "cents", (F.col("cents") / F.col("all_cents")).alias("share"))
