"""Weak labels, negative controls, registry gaps and the labelled-set report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrogrid import constants as K
from pyrogrid.functions import geo
from pyrogrid.functions.physics import lookup
from pyrogrid.functions.quantiles import exact_quantile
from pyrogrid.operators.landcover import attach_landcover
from pyrogrid.operators.nearest import NEAREST_COLUMNS, CandidateIndex, located
from pyrogrid.operators.scoring import column_or

def label_sources(
    sources: DataFrame,
    facilities: DataFrame,
    landcover: DataFrame | None = None,
    max_dist_m: float = K.DEFAULT_MATCH_RADIUS_M,
    index: CandidateIndex | None = None,
    keep_nearest: bool = False,
) -> DataFrame:
    """Add ``label`` and ``label_confidence`` from the nearest facility or wild land cover.

    With ``keep_nearest`` the columns of the nearest facility stay, and the operators
    that take labelled sources need no join of their own.
    """
    df = attach_landcover(sources, landcover) if landcover is not None else sources
    df = located(df, facilities, index)
    reach = F.coalesce("facility_radius_m", F.lit(float(max_dist_m)))
    near = F.col("facility_id").isNotNull() & (F.col("dist_facility_m") <= reach)
    sector = F.upper("facility_sector")
    cover = F.lower(F.trim(column_or(df, "landcover_class", F.lit(""))))
    distance = F.coalesce("dist_facility_m", F.lit(float("inf")))
    wild = (distance > K.WILD_DISTANCE_M) & cover.isin(K.WILD_LANDCOVERS)

    def by_sector(part: int, other: str) -> Column:
        return lookup({s: v[part] for s, v in K.SECTOR_LABELS.items()}, sector, F.lit(other))

    df = df.withColumns(
        {
            "label": F.when(near, by_sector(0, K.UNLABELLED)).when(wild, "WILD").otherwise(F.lit(K.UNLABELLED)),
            "label_confidence": F.when(near, by_sector(1, "none")).when(wild, "high").otherwise(F.lit("none")),
        }
    )
    return df if keep_nearest else df.drop(*[c for c in NEAREST_COLUMNS if c not in sources.columns])


# fixed values: metrics a control point carries in place of measurements
CONTROL_METRICS = {
    "n_hits": 0, "n_days": 0, "n_nights": 0, "night_frac": 0.0, "span_days": 0, "frp_mean": 0.0, "frp_max": 0.0,
    "frp_median": 0.0, "frp_cv": 0.0, "ti4_median": 300.0, "ti4_max": 300.0, "ti5_median": 270.0,
    "dT_median": 30.0, "ti4_std": 0.0, "local_solar_hour": 12.0, "pixel_area_m2": K.DEFAULT_PIXEL_AREA_M2,
    "cluster_extent_m": 0.0, "fill_ratio": 0.0, "recurrence_gap_days": 0.0, "flare_score": 0.0,
}


def _uniform(seed: int, stream: int) -> Column:
    """Repeatable number in [0, 1) from the source, the sample number and a stream."""
    digest = F.xxhash64("source_id", "sample", F.lit(seed), F.lit(stream))
    return digest.bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def sample_negative_controls(
    labelled: DataFrame,
    facilities: DataFrame,
    n_samples: int = 5,
    seed: int = 42,
    index: CandidateIndex | None = None,
) -> DataFrame:
    """Points 8 to 25 km around the facility (or the source) of each FLARE source."""
    flares = located(labelled.filter(F.col("label") == "FLARE"), facilities, index)
    df = flares.select(
        "source_id",
        F.coalesce("facility_lat", "centroid_lat").alias("_lat"),
        F.coalesce("facility_lon", "centroid_lon").alias("_lon"),
        F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("sample"),
    )
    bearing = _uniform(seed, 1) * 360
    radius = F.lit(K.CONTROL_MIN_KM) + _uniform(seed, 2) * (K.CONTROL_MAX_KM - K.CONTROL_MIN_KM)
    lat, lon = geo.destination(F.col("_lat"), F.col("_lon"), bearing, radius)
    metrics = [F.lit(v).alias(k) for k, v in CONTROL_METRICS.items()]
    return df.select(
        F.format_string("CTRL-%s-%04d", "source_id", "sample").alias("source_id"),
        F.round(lat, 6).alias("centroid_lat"),
        F.round(lon, 6).alias("centroid_lon"),
        F.lit(K.UNLABELLED).alias("label"),
        F.lit("none").alias("label_confidence"),
        F.lit(True).alias("is_control"),
        *metrics,
    )


def is_control(df: DataFrame) -> Column:
    return F.coalesce(column_or(df, "is_control", F.lit(False)), F.lit(False))


def registry_gaps(labelled: DataFrame, facilities: DataFrame, index: CandidateIndex | None = None) -> DataFrame:
    """Non-control sources without a facility in reach, or with one beyond 50 km."""
    df = located(labelled.filter(~is_control(labelled)), facilities, index)
    none = F.col("facility_id").isNull()
    return df.filter(none | (F.col("dist_facility_m") > K.GAP_DISTANCE_M)).select(
        "source_id", "centroid_lat", "centroid_lon", "label",
        F.when(none, F.lit(float("inf"))).otherwise(F.col("dist_facility_m")).alias("dist_to_nearest_m"),
    )


def label_report(labelled: DataFrame) -> DataFrame:
    """Rows, controls and share per label, with a total row (label ``TOTAL``)."""
    return (
        labelled.withColumn("_control", is_control(labelled))
        .rollup("label")
        .agg(
            F.grouping_id().alias("_g"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if("_control").alias("n_controls"),
            F.count_if(F.col("label") == K.UNLABELLED).alias("n_unlabelled"),
        )
        .select(
            F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("label")).alias("label"),
            "n_rows",
            "n_controls",
            F.round(F.col("n_unlabelled") * 100.0 / F.col("n_rows"), 1).alias("pct_unlabelled"),
        )
    )


def label_distances(labelled: DataFrame, facilities: DataFrame, index: CandidateIndex | None = None) -> DataFrame:
    """Median distance to the nearest facility per label, controls left out."""
    df = located(labelled.filter(~is_control(labelled)), facilities, index).select("label", "dist_facility_m")
    return exact_quantile(df, "dist_facility_m", 0.5, by=["label"], width=500.0, name="median_m")


def labelled_set(
    sources: DataFrame,
    facilities: DataFrame,
    landcover: DataFrame | None = None,
    n_samples: int = 5,
    seed: int = 42,
    index: CandidateIndex | None = None,
) -> DataFrame:
    """Labelled sources, with their nearest facility, and their negative controls as one table."""
    labelled = label_sources(sources, facilities, landcover, index=index, keep_nearest=True)
    controls = sample_negative_controls(labelled, facilities, n_samples, seed, index)
    return labelled.unionByName(controls, allowMissingColumns=True)


def save_labelled(
    sources: DataFrame,
    facilities: DataFrame,
    root: str,
    landcover: DataFrame | None = None,
    index: CandidateIndex | None = None,
) -> DataFrame:
    """Write the labelled table and the registry gaps; returns the stored table."""
    from pyrogrid.sources import store

    spark = sources.sparkSession
    store.publish(labelled_set(sources, facilities, landcover, index=index), root, "labelled")
    stored = store.read_table(spark, root, "labelled")
    store.publish(registry_gaps(stored, facilities, index), root, "registry_gaps")
    return stored
