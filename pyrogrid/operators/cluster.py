"""Grouping of detections into persistent grid sources."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrogrid import constants as K
from pyrogrid.functions import geo
from pyrogrid.functions.quantiles import exact_quantile

CELL = ["lat_cell", "lon_cell"]
METRES_PER_DEGREE = 111_000


def with_cells(df: DataFrame, cell_deg: float = K.CELL_DEG) -> DataFrame:
    """Add the floor-grid cell of each detection."""
    return df.withColumns(
        {
            "lat_cell": F.floor(F.col("latitude") / cell_deg),
            "lon_cell": F.floor(F.col("longitude") / cell_deg),
        }
    )


def tir_frequencies(df: DataFrame) -> DataFrame:
    """Rows per TIR value, of low-power detections and of all."""
    return df.groupBy("bright_ti5").agg(
        F.count_if(F.col("frp") < 5.0).alias("n_low"), F.count(F.lit(1)).alias("n_all")
    )


def ambient_from_frequencies(freq: DataFrame) -> DataFrame:
    """One row: median TIR of low-power rows, else of all rows.

    Value counts of different batches can be added, so the median stays exact in
    incremental runs without reading old detections again.
    """
    low = F.coalesce(freq.agg(F.sum("n_low").alias("n")).select("n").scalar(), F.lit(0)) > 0
    weighted = freq.select("bright_ti5", F.when(low, F.col("n_low")).otherwise(F.col("n_all")).alias("rows"))
    return exact_quantile(weighted, "bright_ti5", 0.5, weight=F.col("rows"), name="ambient_K")


def regional_ambient(df: DataFrame) -> DataFrame:
    """One row: median TIR of low-power rows, else of all rows."""
    return ambient_from_frequencies(tir_frequencies(df))


def diurnal_histogram(counts: list[Column], total: Column) -> Column:
    """24 hourly shares; the last takes what the others leave, not below zero."""
    first = F.array(*[c / total for c in counts[:-1]])
    rest = F.lit(1.0) - F.aggregate(first, F.lit(0.0), lambda a, x: a + x)
    return F.concat(first, F.array(F.greatest(F.lit(0.0), rest)))


def diurnal_shape(hist: Column, n_hits: Column, night_frac: Column) -> Column:
    """Name of the daily pattern; the first matching rule wins."""

    def total(first_bin: int, bins: int) -> Column:
        return F.aggregate(F.slice(hist, first_bin + 1, bins), F.lit(0.0), lambda a, x: a + x)

    entropy = -F.aggregate(
        hist, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))
    )
    facts = F.struct(
        F.array_max(hist).alias("top"),
        F.array_min(hist).alias("low"),
        (F.array_position(hist, F.array_max(hist)) - 1).alias("hour"),
        (entropy / math.log(24.0)).alias("spread"),
        total(10, 7).alias("day"),
        total(16, 5).alias("evening"),
    )

    def rules(f: Column) -> Column:
        flat = (f.top - f.low < 0.08) | ((f.spread > 0.82) & (night_frac >= 0.25) & (f.top < 0.20))
        evening = (f.evening >= 0.50) | ((f.evening >= 0.35) & f.hour.between(16, 20) & (f.day < 0.50))
        daytime = (f.day >= 0.50) | ((f.day >= 0.35) & f.hour.between(10, 16) & (f.evening < 0.40))
        return (
            F.when(n_hits <= 2, "SPARSE")
            .when(flat, "FLAT_24H")
            .when(evening, "EVENING_BURST")
            .when(daytime, "DAYTIME_ONLY")
            .when(f.top >= 0.25, "SPIKE_DECAY")
            .when((night_frac >= 0.35) & (f.spread > 0.70), "FLAT_24H")
            .otherwise("SPIKE_DECAY")
        )

    return F.element_at(F.transform(F.array(facts), rules), 1)


def recurrence_gap(days: Column) -> Column:
    """Median gap in days between the sorted distinct active days; 0 for one day."""
    gaps = F.array_sort(
        F.zip_with(
            F.slice(days, 2, F.greatest(F.size(days) - 1, F.lit(0))),
            F.slice(days, 1, F.greatest(F.size(days) - 1, F.lit(0))),
            lambda later, earlier: F.datediff(later, earlier).cast("double"),
        )
    )
    n = F.size(gaps)
    middle = (
        F.element_at(gaps, (F.floor((n - 1) / 2) + 1).cast("int"))
        + F.element_at(gaps, (F.floor(n / 2) + 1).cast("int"))
    ) / 2
    return F.when(n > 0, middle).otherwise(F.lit(0.0))


def flare_score(span: Column, days: Column, nights: Column, frp_max: Column, ti4_median: Column) -> Column:
    return (
        span * 0.6
        + days * 3
        + nights * 1.2
        + F.log1p(F.greatest(F.lit(0.0), frp_max)) * 2
        + F.when(ti4_median > 320, 4.0).otherwise(0.0)
    )


def cluster_extent(cells: DataFrame) -> DataFrame:
    """Largest distance between two detections of each cell, in metres.

    Only the outermost longitudes of each latitude can be ends of the diameter, so
    rows are first reduced to those (a combined aggregate on cell and latitude,
    which also spreads a busy cell).  Coordinates carry five decimals, so a cell
    keeps at most 2,001 latitudes however many rows it has.  Points whose farthest
    bounding-box corner is nearer than the widest known spread cannot be an end
    either and are left out before distances are compared.
    """
    rows = cells.groupBy(*CELL, "latitude").agg(
        F.min("longitude").alias("west"),
        F.max("longitude").alias("east"),
        F.count(F.lit(1)).alias("n"),
    )
    per_cell = rows.groupBy(*CELL).agg(
        F.collect_list(F.struct("latitude", "west", "east")).alias("rows"),
        (F.sum(F.col("latitude") * F.col("n")) / F.sum("n")).alias("mean_lat"),
        F.min("latitude").alias("south"),
        F.max("latitude").alias("north"),
        F.min("west").alias("west"),
        F.max("east").alias("east"),
        # Spread along both diagonals bounds the diameter from below.
        (
            F.max(F.col("latitude") + F.col("east")) - F.min(F.col("latitude") + F.col("west"))
        ).alias("rising"),
        (
            F.max(F.col("latitude") - F.col("west")) - F.min(F.col("latitude") - F.col("east"))
        ).alias("falling"),
    )
    k = F.cos(F.radians(F.col("mean_lat")))
    diagonal = F.greatest(F.col("rising"), F.col("falling")) / F.sqrt(1 + 1 / (k * k))
    known = F.greatest(F.col("north") - F.col("south"), (F.col("east") - F.col("west")) * k, diagonal)
    per_cell = per_cell.withColumns({"k": k, "known2": known * known * (1 - 1e-9)})

    def far_corner(lat: Column, lon: Column) -> Column:
        dy = F.greatest(F.col("north") - lat, lat - F.col("south"))
        dx = F.greatest(F.col("east") - lon, lon - F.col("west")) * F.col("k")
        return dy * dy + dx * dx

    ends = F.flatten(
        F.transform(
            "rows",
            lambda r: F.array_distinct(
                F.array(
                    F.struct(r.latitude.alias("lat"), r.west.alias("lon")),
                    F.struct(r.latitude.alias("lat"), r.east.alias("lon")),
                )
            ),
        )
    )
    per_cell = per_cell.withColumn(
        "ends", F.filter(ends, lambda p: far_corner(p.lat, p.lon) >= F.col("known2"))
    )

    def squared(a: Column, b: Column) -> Column:
        dy = (a.lat - b.lat) * METRES_PER_DEGREE
        dx = (a.lon - b.lon) * METRES_PER_DEGREE * F.col("k")
        return dy * dy + dx * dx

    def farthest_from(a: Column) -> Column:
        return F.aggregate("ends", F.lit(0.0), lambda m, b: F.greatest(m, squared(a, b)))

    widest = F.aggregate("ends", F.lit(0.0), lambda m, a: F.greatest(m, farthest_from(a)))
    return per_cell.select(*CELL, F.sqrt(widest).alias("cluster_extent_m"))


def aggregate_cells(cells: DataFrame) -> DataFrame:
    """All per-cell statistics that one grouped pass can give.

    Quantiles are exact; their buffers hold distinct values with counts, are built
    map-side, and so grow with the sensor's value steps, not with the row count.
    """

    def median(name: str) -> Column:
        return F.percentile(name, 0.5)

    hours = [
        F.count_if(F.pmod(F.floor("local_solar_hour"), F.lit(24)) == h).alias(f"_h{h}") for h in range(24)
    ]
    grouped = cells.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.array_sort(F.collect_set("acq_date")).alias("_days"),
        F.count_if(F.col("daynight") == "N").alias("n_nights"),
        F.min("acq_utc").alias("first_seen"),
        F.max("acq_utc").alias("last_seen"),
        F.avg("frp").alias("frp_mean"),
        F.max("frp").alias("frp_max"),
        F.stddev_pop("frp").alias("_frp_std"),
        median("frp").alias("frp_median"),
        median("bright_ti4").alias("ti4_median"),
        F.max("bright_ti4").alias("ti4_max"),
        F.stddev_pop("bright_ti4").alias("ti4_std"),
        F.percentile("bright_ti5", [0.5, 0.05]).alias("_ti5"),
        F.count("bright_ti5").alias("_n_ti5"),
        F.percentile(F.col("bright_ti4") - F.col("bright_ti5"), 0.5).alias("dT_median"),
        median("local_solar_hour").alias("local_solar_hour"),
        median("pixel_area_m2").alias("pixel_area_m2"),
        F.avg("latitude").alias("centroid_lat"),
        F.avg("longitude").alias("centroid_lon"),
        *hours,
    )
    counts = [F.col(f"_h{h}") for h in range(24)]
    total = sum(counts[1:], counts[0])
    return grouped.withColumns(
        {
            "n_days": F.size("_days").cast("long"),
            "night_frac": F.col("n_nights") / F.col("n_hits"),
            "span_days": (F.datediff("last_seen", "first_seen") + 1).cast("long"),
            "frp_cv": F.when(F.col("frp_mean") != 0, F.col("_frp_std") / F.col("frp_mean")).otherwise(
                F.lit(0.0)
            ),
            "ti5_median": F.col("_ti5")[0],
            "recurrence_gap_days": recurrence_gap(F.col("_days")),
            "diurnal_hist": diurnal_histogram(counts, total),
            "fill_ratio": F.lit(1.0),
        }
    )


def with_background(sources: DataFrame, ambient: Column) -> DataFrame:
    """Background temperature: own 5th percentile with three values, else ambient."""
    own = F.col("_n_ti5") >= 3
    return sources.withColumns(
        {
            "t_bg_K": F.when(own, F.col("_ti5")[1]).otherwise(ambient),
            "t_bg_method": F.when(own, "cluster_5th_percentile")
            .when(ambient.isNotNull(), "regional_ambient")
            .otherwise("background_unavailable"),
        }
    )


SOURCE_COLUMNS = [
    "source_id", "n_hits", "n_days", "n_nights", "night_frac", "first_seen", "last_seen", "span_days",
    "frp_mean", "frp_max", "frp_median", "frp_cv", "ti4_median", "ti4_max", "ti5_median", "dT_median",
    "ti4_std", "local_solar_hour", "pixel_area_m2", "cluster_extent_m", "fill_ratio",
    "recurrence_gap_days", "centroid_lat", "centroid_lon", "flare_score", "diurnal_hist",
    "diurnal_shape", "t_bg_K", "t_bg_method",
]


def cluster_sources(
    detections: DataFrame,
    cell_deg: float = K.CELL_DEG,
    ambient: DataFrame | None = None,
    prefix: str = K.SOURCE_ID_PREFIX,
    keep_cells: bool = False,
) -> DataFrame:
    """One row per occupied grid cell with every source column.

    ``detections`` is read three times (cells, extent, ambient), each with its own
    few columns, so pass a stored clean table at scale.  ``ambient`` is a one-row
    table for incremental runs; by default it comes from ``detections``.
    """
    cells = with_cells(detections, cell_deg)
    if ambient is None:
        ambient = regional_ambient(detections)
    sources = with_background(aggregate_cells(cells), ambient.select("ambient_K").scalar())
    sources = sources.join(cluster_extent(cells), CELL, "left")
    sources = sources.withColumns(
        {
            "source_id": geo.source_id(F.col("lat_cell"), F.col("lon_cell"), prefix),
            "diurnal_shape": diurnal_shape(F.col("diurnal_hist"), F.col("n_hits"), F.col("night_frac")),
            "flare_score": flare_score(
                F.col("span_days"), F.col("n_days"), F.col("n_nights"), F.col("frp_max"), F.col("ti4_median")
            ),
        }
    )
    return sources.select(*(CELL if keep_cells else []), *SOURCE_COLUMNS)
