"""Rule-based classification with an auditable ordered rule table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrogrid import constants as K

NEEDED_CONTEXT = ["dist_facility_m", "facility_sector", "landcover_class"]
BAND = 0.12


def column_or(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else default


def offshore(df: DataFrame) -> Column:
    """Water under the source, or weak and far from every facility."""
    distance = F.coalesce("dist_facility_m", F.lit(math.inf))
    water = F.coalesce(column_or(df, "landcover_water", F.lit(0.0)) == 1.0, F.lit(False))
    power = F.expm1(F.col("log1p_frp_max"))
    alone = (
        column_or(df, "facility_name", F.lit(None)).isNull()
        & (distance > K.OFFSHORE_DISTANCE_M)
        & (power < K.OFFSHORE_POWER_MW)
    )
    return water | F.coalesce(alone, F.lit(False))


def rule_table(df: DataFrame) -> list[tuple[Column, str, float, str]]:
    """(condition, class, confidence, reason) in order; the first match wins."""
    t = F.col("t_fire_K")
    d = F.coalesce("dist_facility_m", F.lit(math.inf))
    sector, cover = F.col("facility_sector"), F.col("landcover_class")
    power = F.expm1("log1p_frp_max")
    night, days, span = F.col("night_frac"), F.col("n_days"), F.col("span_days")
    hour = F.pmod(F.atan2("local_hour_sin", "local_hour_cos") * (24 / (2 * math.pi)), F.lit(24.0))
    shape = F.coalesce(column_or(df, "diurnal_shape", F.lit(None).cast("string")), F.lit("SPARSE"))
    crops = (cover == "cropland") | (column_or(df, "landcover_cropland", F.lit(0.0)) == 1.0)
    return [
        (offshore(df), "UNRESOLVED", 0.10, "unverified/offshore-suppressed"),
        (
            (t >= 450.0) & (night >= 0.5) & (days >= 3) & (F.col("frp_cv") < 1.5) & (d < 5000),
            "FLARE", 0.90, "hot, persistent nighttime source near industrial facility",
        ),
        (
            t.isNull() & (power >= 25.0) & (night >= 0.70) & (d <= 3500) & sector.isin("REFI_GAS", "POWER", "STEEL"),
            "FLARE", 0.60,
            "Dozier unresolved (background_unavailable); classified on radiative power"
            " + nocturnal persistence + facility proximity",
        ),
        (
            t.isNull() & (d < 3000) & sector.isin("REFI_GAS", "FERTILIZER") & (night > 0.5),
            "LEAK", 0.55, "candidate fugitive thermal anomaly - low confidence",
        ),
        (
            (t < 1000) & (span >= 60) & (power < 5) & (F.col("cluster_extent_m") > 1000),
            "COAL", 0.82, "cool, spatially extended long-duration source",
        ),
        (
            crops & ((shape == "EVENING_BURST") | (hour.between(16, 20) & (d > 2000))),
            "WILD", 0.85, "agricultural stubble burning (cropland evening burst)",
        ),
        (
            cover.isin(K.WILD_LANDCOVERS) & (d > 5000) & (span < 30) & hour.between(10, 16),
            "WILD", 0.78, "short-lived daytime vegetation fire away from facilities",
        ),
        (
            (shape == "FLAT_24H") & (d < 5000) & (night >= 0.35),
            "FLARE", 0.88, "persistent 24h flat profile near industrial facility",
        ),
        (
            (shape == "DAYTIME_ONLY") & (d > 5000),
            "WILD", 0.80, "daytime-only vegetation fire pattern away from facilities",
        ),
        (
            (days <= 3) & (power > 20) & (d < 3000),
            "IND_FIRE", 0.84, "high-power short-duration event near facility",
        ),
    ]


def spread_probabilities(cls: Column, conf: Column, names: list[str]) -> Column:
    """Map with ``conf`` on the class and the rest shared evenly by the others."""
    rest = (F.lit(1.0) - conf) / (len(names) - 1)
    return F.map_from_arrays(
        F.array(*[F.lit(c) for c in names]), F.array(*[F.when(cls == c, conf).otherwise(rest) for c in names])
    )


def classify_rules(features: DataFrame) -> DataFrame:
    """Class, confidence, band, reason and key values per feature row."""
    missing = [c for c in NEEDED_CONTEXT if c not in features.columns]
    if missing:
        raise ValueError(f"rule scoring needs the context columns {missing}; pass canonical_frame() output")

    def outcome(cls: str, conf: float, why: str) -> Column:
        return F.struct(F.lit(cls).alias("cls"), F.lit(conf).alias("conf"), F.lit(why).alias("reason"))

    table = rule_table(features)
    verdict = F.when(table[0][0], outcome(*table[0][1:]))
    for condition, cls, conf, why in table[1:]:
        verdict = verdict.when(condition, outcome(cls, conf, why))
    verdict = verdict.otherwise(
        outcome("UNRESOLVED", 0.35, "insufficient evidence for confident attribution")
    )
    df = features.withColumns({"_verdict": verdict, "offshore_suppressed": offshore(features)})
    conf = F.col("_verdict.conf")

    def feature(name: str, value: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"), value.cast("double").alias("value"),
            F.lit(None).cast("double").alias("contribution"),
        )

    distance = F.coalesce("dist_facility_m", F.lit(math.inf))
    return df.withColumns(
        {
            "cls": F.col("_verdict.cls"),
            "conf": conf,
            "probs": spread_probabilities(F.col("_verdict.cls"), conf, K.CLASSES),
            "lo": F.greatest(F.lit(0.0), conf - BAND),
            "hi": F.least(F.lit(1.0), conf + BAND),
            "score_reason": F.col("_verdict.reason"),
            "top_features": F.array(
                feature("t_fire_K", F.coalesce("t_fire_K", F.lit(0.0))),
                feature("night_frac", F.col("night_frac")),
                feature("facility_distance", F.least(distance, F.lit(K.UNKNOWN_DISTANCE_M))),
            ),
        }
    ).drop("_verdict")
