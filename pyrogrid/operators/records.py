"""Final detection records: downgrade, suppression, severity, emissions, texts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyrogrid import constants as K
from pyrogrid.functions import text
from pyrogrid.functions.physics import emission_rates
from pyrogrid.operators.scoring import column_or
from pyrogrid.operators.severity import severity


def deviation_from_history(daily: DataFrame, key: str = "source_id", day: str = "acq_date") -> DataFrame:
    """Z-score of each source's last active day against its earlier days.

    ``daily`` has one row per source and day with ``power``, so a busy source has
    at most one row per calendar day in the window.
    """
    history = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    latest = Window.partitionBy(key).orderBy(F.col(day).desc())
    scored = daily.withColumns(
        {
            "_mean": F.avg("power").over(history),
            "_std": F.stddev_pop("power").over(history),
            "_n": F.row_number().over(latest),
        }
    )
    return scored.filter("_n = 1").select(
        key, F.when(F.col("_std") > 0, (F.col("power") - F.col("_mean")) / F.col("_std")).alias("deviation_z")
    )


def daily_power(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Mean power per key and day."""
    return detections.groupBy(*keys, "acq_date").agg(F.avg("frp").alias("power"))


def _share_evenly(probs: Column, cls: Column, conf: Column) -> Column:
    """Give ``conf`` to the class and share the rest among the other keys."""
    others = F.size(F.filter(F.map_keys(probs), lambda k: k != cls))
    each = F.when(others > 0, (F.lit(1.0) - conf) / others).otherwise(F.lit(0.0))
    shared = F.transform_values(probs, lambda k, _: F.when(k == cls, conf).otherwise(each))
    missing = ~F.array_contains(F.map_keys(probs), cls)
    return F.when(missing, F.map_concat(shared, F.create_map(cls, conf))).otherwise(shared)


def evidence_trail(stage_ms: dict[str, int] | None, score_cls: Column, score_conf: Column) -> Column:
    """Six structs, one per pipeline stage; times come from the measured run."""
    times = stage_ms or {}
    values = [
        F.concat(F.col("n_hits").cast("string"), F.lit(" detections")),
        F.lit("centroid inside mainland"),
        F.concat(F.col("n_days").cast("string"), F.lit(" days / "), F.col("n_hits").cast("string"), F.lit(" hits")),
        F.coalesce(
            F.concat(F.lit("T="), text.fixed(F.col("t_fire_K"), 0), F.lit(" K")), F.lit("retrieval unresolved")
        ),
        F.coalesce(F.nullif(F.col("facility_name"), F.lit("")), F.lit("no facility within 10 km")),
        F.concat(score_cls, F.lit(" conf="), text.fixed(score_conf, 2)),
    ]
    stages = []
    for number, (label, value) in enumerate(zip(K.STAGES, values), 1):
        warn = value.contains("no ") if number in (4, 5) else F.lit(False)
        stages.append(
            F.struct(
                F.lit(number).alias("stage"),
                F.lit(label).alias("label"),
                F.when(warn, "warn").otherwise(F.lit("ok")).alias("status"),
                value.alias("detail"),
                value.alias("value"),
                F.lit(max(1, int(round(times.get(label, 1))))).alias("ms"),
            )
        )
    return F.array(*stages)


def build_records(scored: DataFrame, stage_ms: dict[str, int] | None = None) -> DataFrame:
    """Detection records from scored feature rows (source columns included).

    An industrial fire far from every facility becomes unresolved unless it departs
    strongly from its own history; a suppressed source is unresolved, low, and has
    no emissions.
    """
    distance = F.coalesce("dist_facility_m", F.lit(math.inf))
    far = distance > K.OFFSHORE_DISTANCE_M
    z = column_or(scored, "deviation_z", F.lit(None).cast("double"))
    people = column_or(scored, "population_in_radius", F.lit(None).cast("long"))
    strong = F.coalesce((z >= 5) & (F.col("frp_max") >= 50), F.lit(False))
    downgrade = (F.col("cls") == "IND_FIRE") & far & ~strong
    water = F.coalesce(column_or(scored, "landcover_water", F.lit(0.0)) == 1.0, F.lit(False))
    suppressed = (
        F.coalesce("offshore_suppressed", F.lit(False))
        | water
        | (F.col("facility_name").isNull() & far & F.coalesce(F.col("frp_max") < K.OFFSHORE_POWER_MW, F.lit(False)))
    )
    df = scored.withColumns(
        {
            "_score_cls": F.col("cls"),
            "_score_conf": F.col("conf"),
            "_down": downgrade,
            "_supp": suppressed,
            "_probs": F.transform_values("probs", lambda _, v: text.rounded(v, 4)),
        }
    )
    lowered = F.when(F.col("_down"), F.least("conf", F.lit(0.35))).otherwise(F.col("conf"))
    df = df.withColumns(
        {
            "cls": F.when(F.col("_down") | F.col("_supp"), "UNRESOLVED").otherwise(F.col("cls")),
            "conf": F.when(F.col("_supp"), F.least(lowered, F.lit(0.10))).otherwise(lowered),
        }
    )
    df = df.withColumn(
        "_probs",
        F.when(F.col("_down") | F.col("_supp"), _share_evenly(F.col("_probs"), F.col("cls"), F.col("conf"))).otherwise(
            F.col("_probs")
        ),
    )
    gap = text.rounded(1 - F.aggregate(F.map_values("_probs"), F.lit(0.0), lambda a, v: a + v), 4)
    df = df.withColumn("_gap", gap).withColumn(
        "probs",
        F.transform_values(
            "_probs", lambda k, v: F.when(k == F.col("cls"), text.rounded(v + F.col("_gap"), 4)).otherwise(v)
        ),
    )
    level, why = severity(F.col("cls"), F.col("frp_max"), F.col("_supp"), z, people)
    power = F.coalesce(F.when(F.col("frp_derived_MW") > 0, F.col("frp_derived_MW")), F.col("frp_max"), F.lit(0.0))
    co2e, carbon = emission_rates(F.col("cls"), power)
    active = ~F.col("_supp")
    df = df.withColumns(
        {
            "severity": level,
            "severity_rationale": why,
            "co2e_rate_tph": F.when(active, co2e),
            "black_carbon_rate_kgph": F.when(active, carbon),
        }
    )
    span = F.greatest(F.lit(1.0), F.coalesce(F.col("span_days").cast("double"), F.lit(1.0)))
    df = df.withColumn("co2e_total_t", text.rounded(F.col("co2e_rate_tph") * span * 24.0, 3))
    names = [
        "cls", "conf", "lo", "hi", "facility_name", "facility_sector", "dist_facility_m", "t_fire_K", "frp_max",
        "n_days", "night_frac", "diurnal_shape", "landcover_class", "co2e_rate_tph",
    ]
    facts = {n: F.col(n) for n in names} | {"offshore_suppressed": F.col("_supp")}
    df = df.withColumn("_evidence", text.evidence(facts)).withColumn("_story", text.narrative(F.col("_evidence")))
    return df.select(
        F.col("source_id").alias("id"),
        F.col("centroid_lat").alias("lat"),
        F.col("centroid_lon").alias("lon"),
        "cls", "conf", "probs", "lo", "hi",
        F.col("t_fire_K").alias("temp_K"),
        F.col("ti5_median").alias("bg_K"),
        "frac",
        F.coalesce("frp_derived_MW", F.lit(0.0)).alias("frp_MW"),
        F.col("frp_max").alias("frp_max_MW"),
        F.col("pixel_area_m2").alias("area_m2"),
        F.col("last_seen").alias("ts"),
        "n_hits", "n_days", "night_frac",
        *(["facility_id"] if "facility_id" in scored.columns else []),
        "facility_name", "facility_sector", "dist_facility_m", "state", "district",
        "severity", "severity_rationale",
        F.col("_story.text").alias("reason"),
        F.col("_story.text").alias("reason_template"),
        F.col("_story.cited_rule").alias("cited_rule"),
        F.col("_supp").alias("offshore_suppressed"),
        evidence_trail(stage_ms, F.col("_score_cls"), F.col("_score_conf")).alias("evidence"),
        "top_features", "diurnal_hist", "diurnal_shape",
        "co2e_rate_tph", "black_carbon_rate_kgph", "co2e_total_t",
        "landcover_class", "landcover_status",
    )
