"""Profile of a detection table: dates, outline counts, persistent cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrogrid import constants as K
from pyrogrid.functions import geo
from pyrogrid.functions.text import rounded
from pyrogrid.operators.ingest import NUMERIC_COLUMNS, filter_mainland, to_number
from pyrogrid.operators.nearest import PLATE, attach_nearest, build_index, over_points, with_rank
from pyrogrid.session import stored


def numeric_rows(raw: DataFrame) -> DataFrame:
    """Raw feed with its numeric columns typed."""
    return raw.withColumns({c: to_number(F.col(c)) for c in NUMERIC_COLUMNS if c in raw.columns})


def rows_per_date(df: DataFrame) -> DataFrame:
    return df.groupBy("acq_date").agg(F.count(F.lit(1)).alias("n"))


def outline_counts(df: DataFrame) -> DataFrame:
    """One row: date range, distinct dates, rows inside and outside the outline."""
    inside = geo.in_mainland(F.col("latitude"), F.col("longitude"), boundary=False)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("acq_date").alias("first_date"),
        F.max("acq_date").alias("last_date"),
        F.countDistinct("acq_date").alias("n_dates"),
        F.count_if(inside).alias("n_inside"),
        F.count_if(~inside).alias("n_outside"),
    )


def persistent_cells(df: DataFrame, min_days: int = 2) -> DataFrame:
    """Scored half-even grid cells seen on several days (input inside the outline)."""

    def cell(name: str):
        return F.bround(F.col(name) / K.CELL_DEG) * K.CELL_DEG

    grouped = df.groupBy(cell("latitude").alias("_lat"), cell("longitude").alias("_lon")).agg(
        F.count(F.lit(1)).alias("hits"),
        F.size(F.collect_set("acq_date")).cast("long").alias("days"),
        F.count_if(F.col("daynight") == "N").alias("night_hits"),
        F.percentile("bright_ti4", 0.5).alias("_ti4"),
        F.percentile("bright_ti5", 0.5).alias("_ti5"),
        F.max("frp").alias("_max"),
        F.avg("frp").alias("_mean"),
        F.stddev_pop("bright_ti4").alias("_std"),
    )
    steady = F.when(F.col("hits") > 1, F.lit(1.0) / (F.col("_std") + 1.0)).otherwise(0.0)
    score = (
        F.col("days") * 2.0 + F.col("night_hits") * 1.5 + steady * 10 + F.least(F.col("_max") / 10.0, F.lit(5.0))
    )
    return grouped.filter(F.col("days") >= min_days).withColumn("_score", score)


def locate_cells(cells: DataFrame, ranked: DataFrame) -> DataFrame:
    """Cells with the nearest site; the cell table is stored because it is read twice."""
    cells = stored(cells, "persistent")
    metric = over_points(PLATE, cells, "_lon", "_lat")
    index = build_index(ranked, "lon", "lat", "registry_rank", metric)
    return attach_nearest(cells, index, F.col("_lon"), F.col("_lat"))


def profile_persistent(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Persistent cells with their nearest site, rounded for reporting, best first."""
    ranked = with_rank(sites)
    located = locate_cells(persistent_cells(df), ranked).withColumn("_tie", F.col("nearest.tie"))
    names = ranked.select(F.col("registry_rank").alias("_tie"), F.col("name").alias("nearest_facility"))
    return (
        located.join(names, "_tie", "left")
        .select(
            rounded(F.col("_lat"), 4).alias("latitude"),
            rounded(F.col("_lon"), 4).alias("longitude"),
            "hits", "days", "night_hits",
            rounded(F.col("_ti4"), 2).alias("median_ti4"),
            rounded(F.col("_ti5"), 2).alias("median_ti5"),
            rounded(F.col("_max"), 2).alias("max_frp"),
            rounded(F.col("_mean"), 2).alias("mean_frp"),
            rounded(F.when(F.col("hits") > 1, F.col("_std")).otherwise(0.0), 2).alias("stdev_ti4"),
            "nearest_facility",
            rounded(F.col("nearest.distance"), 1).alias("facility_km"),
            rounded(F.col("_score"), 2).alias("flare_score"),
        )
        .orderBy(F.desc("flare_score"), "latitude", "longitude")
    )


def profile(raw: DataFrame, sites: DataFrame, out: str | None = None) -> dict[str, DataFrame]:
    """All profile tables; with ``out`` the clean and persistent ones are written as CSV."""
    from pyrogrid.sources import store

    rows = numeric_rows(raw)
    inside = filter_mainland(rows, boundary=False)
    tables = {
        "dates": rows_per_date(rows),
        "counts": outline_counts(rows),
        "clean": inside.select(*raw.columns),
        "persistent": profile_persistent(inside, sites),
    }
    if out:
        store.write_csv(tables["clean"].drop("_row_order"), f"{out}/clean")
        store.write_csv(tables["persistent"], f"{out}/persistent")
    return tables


def top_persistent(persistent: DataFrame, n: int = 15) -> DataFrame:
    return persistent.orderBy(F.desc("flare_score"), "latitude", "longitude").limit(n)
