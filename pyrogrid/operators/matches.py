"""Detections that belong to a facility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrogrid import constants as K
from pyrogrid.functions import geo
from pyrogrid.operators.nearest import CandidateIndex, nearest_facility, with_rank

JOIN_CELL_DEG = 0.02


def radius(facility: str = "match_radius_m") -> Column:
    own = F.col(facility)
    return F.when(own > 0, own).otherwise(F.lit(K.DEFAULT_MATCH_RADIUS_M))


def find_facility(facilities: DataFrame, wanted: str) -> DataFrame:
    """The first registry row with this id or, ignoring case, this name."""
    hit = (F.col("facility_id") == wanted) | (F.lower("name") == wanted.lower())
    found = with_rank(facilities).filter(hit).orderBy("registry_rank").limit(1)
    if found.isEmpty():
        raise LookupError(f"facility {wanted!r} was not found")
    return found


def facility_matches(
    records: DataFrame,
    facilities: DataFrame,
    wanted: str | None = None,
    index: CandidateIndex | None = None,
) -> DataFrame:
    """(facility_id, id) pairs: nearest within its radius, or same name and near.

    With ``wanted`` only that facility's pairs are returned.
    """
    targets = facilities if wanted is None else find_facility(facilities, wanted)
    points = records.select("id", "lat", "lon")
    near = nearest_facility(points, facilities, lat="lat", lon="lon", index=index)
    near = near.filter("facility_id is not null").select("facility_id", "id")
    if wanted is not None:
        near = near.join(targets.select("facility_id"), "facility_id", "left_semi")
    named = records.select("id", F.col("facility_name").alias("name"), "dist_facility_m")
    by_name = (
        named.filter("name is not null")
        .join(targets.select("facility_id", "name", radius().alias("_r")), "name")
        .filter(F.col("dist_facility_m").isNull() | (F.col("dist_facility_m") <= F.col("_r")))
        .select("facility_id", "id")
    )
    return near.unionByName(by_name).distinct()


def contained_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text, name) pairs where the text contains the name, as an equi-join.

    Both inputs have one column.  Texts are cut into their substrings of just the
    lengths that occur among the names, so only true pairs meet; a text of n
    characters gives at most n pieces per length.
    """
    names = names.filter(F.length("name") > 0).distinct()
    lengths = names.agg(F.collect_set(F.length("name")).alias("l")).select("l").scalar()
    pieces = (
        texts.distinct()
        .withColumn("_len", F.explode(lengths))
        .filter(F.length("text") >= F.col("_len"))
        .withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("_len") + 1)))
        .select("text", F.expr("substring(text, _at, _len)").alias("name"))
        .distinct()
    )
    return pieces.join(names, "name").select("text", "name")


def _within_radius(records: DataFrame, facilities: DataFrame) -> DataFrame:
    """Attributed detections inside a facility's circle, joined on grid cells."""
    reach = F.degrees(F.col("_r") / K.EARTH_RADIUS_M) * (1 + 1e-9)
    edge = F.least(F.abs("_flat") + reach, F.lit(89.9))
    lon_reach = reach / F.cos(F.radians(edge))

    def cells(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / JOIN_CELL_DEG), F.floor(high / JOIN_CELL_DEG)))

    circles = (
        facilities.filter("lat is not null and lon is not null")
        .select("facility_id", F.col("lat").alias("_flat"), F.col("lon").alias("_flon"), radius().alias("_r"))
        .select("*", cells(F.col("_flat") - reach, F.col("_flat") + reach).alias("_cy"))
        .select("*", cells(F.col("_flon") - lon_reach, F.col("_flon") + lon_reach).alias("_cx"))
    )
    points = records.filter(F.col("cls") != "UNRESOLVED").withColumns(
        {"_cy": F.floor(F.col("lat") / JOIN_CELL_DEG), "_cx": F.floor(F.col("lon") / JOIN_CELL_DEG)}
    )
    apart = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("_flat"), F.col("_flon"))
    return points.join(circles, ["_cy", "_cx"]).filter(apart <= F.col("_r")).select("facility_id", "id")


def profile_pairs(records: DataFrame, facilities: DataFrame) -> DataFrame:
    """(facility_id, id) pairs by id, by name contained in the detection's name, or by radius."""
    by_name = F.lower(F.coalesce(F.nullif(F.col("facility_name"), F.lit("")), F.lit("Unknown Facility")))
    named = records.select("id", by_name.alias("text"))
    low = facilities.select("facility_id", F.lower("name").alias("name"))
    contained = contained_names(named.select("text"), low.select("name")).join(low, "name")
    pairs = named.join(contained.select("text", "facility_id"), "text").select("facility_id", "id")
    pairs = pairs.unionByName(_within_radius(records.select("id", "lat", "lon", "cls"), facilities))
    if "facility_id" in records.columns:
        own = records.select("facility_id", "id").filter("facility_id is not null")
        pairs = pairs.unionByName(own.join(facilities.select("facility_id"), "facility_id", "left_semi"))
    return pairs.distinct()


def facility_profiles(records: DataFrame, facilities: DataFrame) -> DataFrame:
    """Match count, flares, leaks and peaks per facility; zero rows kept."""
    power = F.coalesce(
        F.when(F.col("frp_MW") > 0, F.col("frp_MW")), F.when(F.col("frp_max_MW") > 0, F.col("frp_max_MW")), F.lit(0.0)
    )
    facts = records.select("id", "cls", power.alias("power"), "temp_K")
    counted = (
        profile_pairs(records, facilities)
        .join(facts, "id")
        .groupBy("facility_id")
        .agg(
            F.count(F.lit(1)).alias("n_matches"),
            F.count_if(F.col("cls") == "FLARE").alias("n_flares"),
            F.count_if(F.col("cls") == "LEAK").alias("n_leaks"),
            F.max("power").alias("max_power_MW"),
            F.max("temp_K").alias("max_temp_K"),
        )
    )
    zero = {"n_matches": 0, "n_flares": 0, "n_leaks": 0, "max_power_MW": 0.0, "max_temp_K": 0.0}
    return facilities.select("facility_id", "name").join(counted, "facility_id", "left").fillna(zero)


def facility_directory(records: DataFrame, facilities: DataFrame) -> DataFrame:
    """Detections per facility whose name contains the facility's name or the reverse."""
    text = F.lower(F.coalesce(F.nullif(F.col("facility_name"), F.lit("")), F.lit("Unknown Facility")))
    # Counting per name first keeps a frequent name to one row in the joins.
    counts = records.groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("n"))
    low = facilities.select("facility_id", F.lower("name").alias("name"))
    forward = contained_names(counts.select("text"), low.select("name"))
    backward = contained_names(
        low.select(F.col("name").alias("text")), counts.select(F.col("text").alias("name"))
    ).select(F.col("name").alias("text"), F.col("text").alias("name"))
    pairs = forward.unionByName(backward).distinct()
    total = pairs.join(counts, "text").groupBy("name").agg(F.sum("n").alias("n_detections"))
    return low.join(total, "name", "left").select("facility_id", F.coalesce("n_detections", F.lit(0)).alias("n_detections"))
