"""Land cover from a pixel table: window join, majority vote, attachment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrogrid import constants as K
from pyrogrid.functions import geo
from pyrogrid.functions.physics import lookup


def pixel_position(lat: Column, lon: Column, tile_pixels: int = K.TILE_PIXELS) -> dict[str, Column]:
    """Tile name, row from the north edge and column from the west edge of a point."""
    north = F.floor(lat / K.TILE_DEG) * K.TILE_DEG + K.TILE_DEG
    west = F.floor(lon / K.TILE_DEG) * K.TILE_DEG
    per_degree = tile_pixels / K.TILE_DEG
    edge = F.lit(tile_pixels - 1)
    return {
        "tile_id": geo.tile_id(lat, lon),
        "row": F.least(F.floor((north - lat) * per_degree), edge).cast("int"),
        "col": F.least(F.floor((lon - west) * per_degree), edge).cast("int"),
    }


def landcover_majority(
    points: DataFrame,
    pixels: DataFrame,
    lat: str = "latitude",
    lon: str = "longitude",
    window: int = 3,
    tile_pixels: int = K.TILE_PIXELS,
) -> DataFrame:
    """Majority class of the pixel window around each distinct point.

    Returns one row per distinct (lat, lon) with ``landcover_class`` and
    ``landcover_status``.  Windows end at the tile edge.  The pixel table is only
    joined on its key (partition it by ``tile_id``), never expanded; votes are
    counted per pixel position, so many points on one pixel share its rows.
    """
    half = max(0, window // 2)
    located = points.select(lat, lon).distinct().withColumns(
        pixel_position(F.col(lat), F.col(lon), tile_pixels)
    )
    span = F.sequence(F.lit(-half), F.lit(max(1, window) - half - 1))
    centres = located.select("tile_id", "row", "col").filter("tile_id is not null").distinct()
    cells = (
        centres.select("*", F.explode(span).alias("dr"))
        .select("*", F.explode(span).alias("dc"))
        .select(
            "tile_id",
            F.col("row").alias("at_row"),
            F.col("col").alias("at_col"),
            (F.col("row") + F.col("dr")).alias("row"),
            (F.col("col") + F.col("dc")).alias("col"),
            ((F.col("dr") + half) * window + F.col("dc") + half).alias("position"),
        )
    )
    named = pixels.select("tile_id", "row", "col", "code").withColumn(
        "class",
        F.when(~F.col("code").isin(K.NODATA_CODES), lookup(K.LANDCOVER_CODES, F.col("code").cast("int"))),
    )
    votes = (
        cells.join(named, ["tile_id", "row", "col"])
        .groupBy("tile_id", "at_row", "at_col", "class")
        .agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"))
        .groupBy("tile_id", "at_row", "at_col")
        .agg(
            F.max_by("class", F.when(F.col("class").isNotNull(), F.struct("n", -F.col("first")))).alias(
                "winner"
            )
        )
        .select(
            "tile_id",
            F.col("at_row").alias("row"),
            F.col("at_col").alias("col"),
            F.coalesce("winner", F.lit("unknown")).alias("landcover_class"),
            F.lit("resolved").alias("landcover_status"),
        )
    )
    return located.join(votes, ["tile_id", "row", "col"], "left").select(
        lat,
        lon,
        F.coalesce("landcover_class", F.lit("unknown")).alias("landcover_class"),
        F.coalesce("landcover_status", F.lit("unavailable")).alias("landcover_status"),
    )


def landcover_at(points: DataFrame, pixels: DataFrame, **options) -> DataFrame:
    """Class of the one pixel under each point."""
    return landcover_majority(points, pixels, window=1, **options)


def annotate_landcover(
    sources: DataFrame, pixels: DataFrame | None = None, tile_pixels: int = K.TILE_PIXELS
) -> DataFrame:
    """Add class and status by centroid; unavailable without a pixel table."""
    if pixels is None:
        return sources.withColumns(
            {"landcover_class": F.lit("unknown"), "landcover_status": F.lit("unavailable")}
        )
    found = landcover_majority(
        sources, pixels, lat="centroid_lat", lon="centroid_lon", tile_pixels=tile_pixels
    ).withColumnsRenamed({"centroid_lat": "_lat", "centroid_lon": "_lon"})
    match = F.col("centroid_lat").eqNullSafe(F.col("_lat")) & F.col("centroid_lon").eqNullSafe(F.col("_lon"))
    return sources.join(found, match, "left").drop("_lat", "_lon").fillna(
        {"landcover_class": "unknown", "landcover_status": "unavailable"}
    )


def is_unknown(name: Column) -> Column:
    return name.isNull() | F.lower(F.trim(name)).isin("unknown", "nan", "none", "")


def canonical_class(name: Column) -> Column:
    """Known class in lower case; anything else is ``other``, nothing is ``unknown``."""
    tidy = F.lower(F.trim(name))
    return (
        F.when(is_unknown(name), "unknown").when(tidy.isin(K.LANDCOVERS), tidy).otherwise(F.lit("other"))
    )


def attach_landcover(sources: DataFrame, lookup_table: DataFrame) -> DataFrame:
    """Fill unknown classes from a table by id, exact point, then rounded point.

    ``lookup_table`` has ``source_id``, ``centroid_lat``, ``centroid_lon`` and
    ``landcover_class``.  Its keys are reduced to one row each before the joins.
    """
    found = lookup_table.select("source_id", "centroid_lat", "centroid_lon", "landcover_class")

    def rounded(name: str) -> Column:
        return F.round(F.col(name), 3)

    def table(keys: dict[str, Column], name: str) -> DataFrame:
        # The last entry of a point wins in a keyed table; ties go to the greatest id.
        columns = [v.alias(k) for k, v in keys.items()]
        return found.groupBy(*columns).agg(F.max_by("landcover_class", "source_id").alias(name))

    exact = {"_a": F.col("centroid_lat"), "_b": F.col("centroid_lon")}
    near = {"_c": rounded("centroid_lat"), "_d": rounded("centroid_lon")}
    if "landcover_class" not in sources.columns:
        sources = sources.withColumn("landcover_class", F.lit(None).cast("string"))
    joined = (
        sources.withColumns({**exact, **near})
        .join(table({"source_id": F.col("source_id")}, "_by_id"), "source_id", "left")
        .join(table(exact, "_by_point"), ["_a", "_b"], "left")
        .join(table(near, "_by_near"), ["_c", "_d"], "left")
    )
    best = F.coalesce(
        F.nullif(F.col("_by_id"), F.lit("")), F.nullif(F.col("_by_point"), F.lit("")), F.col("_by_near")
    )
    return joined.withColumn(
        "landcover_class", F.when(is_unknown(F.col("landcover_class")), best).otherwise(F.col("landcover_class"))
    ).drop("_a", "_b", "_c", "_d", "_by_id", "_by_point", "_by_near")


def tiles_for_bbox(spark: SparkSession, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Names of all tiles that a (west, south, east, north) box touches."""
    west, south, east, north = (math.floor(v / K.TILE_DEG) * K.TILE_DEG for v in bbox)
    rows = spark.range(south, north + 1, K.TILE_DEG).select(
        F.col("id").alias("south"),
        F.explode(F.sequence(F.lit(west), F.lit(east), F.lit(K.TILE_DEG))).alias("west"),
    )
    return rows.select(
        geo.tile_id(F.col("south").cast("double"), F.col("west").cast("double")).alias("tile_id")
    )


def locate_tiles(points: DataFrame, tiles: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Equi-join of points to available tiles; ``has_tile`` tells whether one exists."""
    known = tiles.select("tile_id").distinct().withColumn("has_tile", F.lit(True))
    return (
        points.withColumn("tile_id", geo.tile_id(F.col(lat), F.col(lon)))
        .join(known, "tile_id", "left")
        .fillna({"has_tile": False})
    )
