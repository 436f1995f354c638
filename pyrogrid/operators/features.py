"""Feature matrix: facility join, retrieval, land cover, encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrogrid import constants as K
from pyrogrid.functions import geo
from pyrogrid.functions.physics import retrieve_temperature
from pyrogrid.operators.cluster import diurnal_shape
from pyrogrid.operators.landcover import attach_landcover, canonical_class
from pyrogrid.operators.nearest import CandidateIndex, located


def check_leakage(features: list[str] = K.FEATURES) -> None:
    """Raise if a model feature is a coordinate."""
    leaks = sorted(set(features) & set(K.FORBIDDEN_FEATURES))
    if leaks:
        raise ValueError(f"coordinate columns among the features: {leaks}")


def canonical_frame(features: DataFrame) -> DataFrame:
    """Context, features and extras in fixed order; only columns that exist."""
    wanted = K.CONTEXT_COLUMNS + K.FEATURES + ["diurnal_hist", "retrieval_flags"]
    return features.select(*[c for c in dict.fromkeys(wanted) if c in features.columns])


def with_retrieval(sources: DataFrame) -> DataFrame:
    """Add ``retrieval`` (the full outcome struct) from the band medians."""
    have = sources.columns
    area = F.col("pixel_area_m2") if "pixel_area_m2" in have else F.lit(K.DEFAULT_PIXEL_AREA_M2)
    background = F.col("t_bg_K") if "t_bg_K" in have else F.lit(None).cast("double")
    return sources.withColumn(
        "retrieval", retrieve_temperature(F.col("ti4_median"), F.col("ti5_median"), area, background)
    )


def build_features(
    sources: DataFrame,
    facilities: DataFrame,
    landcover: DataFrame | None = None,
    index: CandidateIndex | None = None,
) -> DataFrame:
    """One feature row per source; source columns are kept beside the features.

    Retrieved values already in the sources win over a new retrieval, and sources
    that have their nearest facility are not joined again.
    """
    check_leakage()
    have = set(sources.columns)
    if landcover is not None:
        sources = attach_landcover(sources, landcover)
        have.add("landcover_class")
    df = with_retrieval(located(sources, facilities, index))

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    converged = F.when(F.col("retrieval.converged"), F.col("retrieval.frac"))
    df = df.withColumns(
        {
            "t_fire_K": given("t_fire_K", F.col("retrieval.t_fire_K")),
            "frac": given("frac", converged),
            "frp_derived_MW": given("frp_derived_MW", F.col("retrieval.frp_derived_MW")),
            "retrieval_flags": F.col("retrieval.flags"),
            "_hour": given("local_solar_hour", F.lit(12.0)),
            "landcover_class": canonical_class(F.col("landcover_class"))
            if "landcover_class" in have
            else F.lit("unknown"),
            "landcover_status": given("landcover_status", F.lit("unavailable")),
        }
    )
    one_hot = F.transform(
        F.sequence(F.lit(0), F.lit(23)), lambda h: (h == F.pmod(F.floor("_hour"), F.lit(24))).cast("double")
    )
    if "diurnal_hist" in have:
        hist = F.when(F.size("diurnal_hist") == 24, F.col("diurnal_hist")).otherwise(one_hot)
    else:
        hist = one_hot
    df = df.withColumn("diurnal_hist", hist)
    worked_out = diurnal_shape(
        F.col("diurnal_hist"), given("n_hits", F.lit(1)), given("night_frac", F.lit(0.0))
    )
    if "diurnal_shape" in have:
        shape = F.when(F.col("diurnal_shape").isin(K.DIURNAL_SHAPES), F.col("diurnal_shape")).otherwise(worked_out)
    else:
        shape = worked_out
    angle = F.col("_hour") * (2 * math.pi / 24)
    sector = F.coalesce("facility_sector", F.lit("UNKNOWN"))
    df = df.withColumns(
        {
            "diurnal_shape": shape,
            "block_id": geo.block_id(F.col("centroid_lat"), F.col("centroid_lon")),
            "dT": F.col("dT_median"),
            "ti4_ti5_ratio": F.col("ti4_median") / F.col("ti5_median"),
            "log1p_frp_max": F.log1p(F.greatest(F.lit(0.0), F.col("frp_max"))),
            "local_hour_sin": F.sin(angle),
            "local_hour_cos": F.cos(angle),
            "is_night": (F.col("night_frac") >= 0.5).cast("double"),
            "hits_per_day": F.col("n_hits") / F.greatest(F.lit(1), F.col("n_days")),
            "log1p_dist_nearest_facility_m": F.log1p(
                F.coalesce("dist_facility_m", F.lit(K.UNKNOWN_DISTANCE_M))
            ),
            "dist_nearest_settlement_m": given("dist_nearest_settlement_m", F.lit(K.UNKNOWN_DISTANCE_M)),
        }
    )
    encodings = {f"sector_{x}": (sector == x).cast("double") for x in K.SECTORS}
    encodings |= {f"landcover_{x}": (F.col("landcover_class") == x).cast("double") for x in K.LANDCOVERS}
    encodings |= {f"diurnal_{x}": (F.col("diurnal_shape") == x).cast("double") for x in K.DIURNAL_SHAPES}
    return df.withColumns(encodings).drop("_hour", "retrieval")
