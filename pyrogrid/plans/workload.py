"""Detection, facility, pixel and request tables derived from the shared test tables.

Every row of the underlying table is used; the formulas only spread it over the
region.  Texts are built from whole numbers, so they are equal in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrogrid import constants as K
from pyrogrid.operators import cluster, features, ingest, labels, landcover, nearest, queries, records, scoring
from pyrogrid.operators.landcover import annotate_landcover
from pyrogrid.session import configure, stored
from pyrogrid.sources.detections import ROW_ORDER

TILE_PIXELS = 30
PIXEL_CODES = [10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 0, 255]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decimal_text(value: Column, scale: int) -> Column:
    """Whole number of hundredths or thousandths as decimal text."""
    digits = len(str(scale)) - 1
    whole = F.floor(value / scale).cast("string")
    return F.concat(whole, F.lit("."), F.lpad((value % scale).cast("string"), digits, "0"))


def site_position(key: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """Latitude and longitude in thousandths of a degree."""
    lat = F.lit(9500) + (key % 25) * 900 + north * 4
    lon = F.lit(74000) + (F.floor(key / 25) % 10) * 2000 + east * 4
    return lat, lon


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw feed of texts as a landed file would give it, from ``events``."""
    return feed_rows(table(spark, sf_dir, "events"))


def feed_rows(events: DataFrame) -> DataFrame:
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e, u = F.col("event_id"), F.col("user_id")
    lat, lon = site_position(u, e % 9, e % 10)
    cents = F.round(F.col("value") * 100).cast("long")
    hour = F.hour("ts")
    night = (hour < 6) | (hour >= 18)
    time = (hour * 100).cast("string")
    return events.select(
        e,
        decimal_text(lat, 1000).alias("latitude"),
        decimal_text(lon, 1000).alias("longitude"),
        F.when(e % 101 == 0, "n/a").otherwise(decimal_text(F.lit(30500) + cents % 6000, 100)).alias("bright_ti4"),
        decimal_text(F.lit(28800) + (e * 7) % 1200, 100).alias("bright_ti5"),
        decimal_text(F.lit(38) + e % 20, 100).alias("scan"),
        decimal_text(F.lit(37) + e % 13, 100).alias("track"),
        F.date_format("ts", "yyyy-MM-dd").alias("acq_date"),
        F.when(e % 5 == 0, F.concat(time, F.lit(".0"))).otherwise(time).alias("acq_time"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("satellite"),
        decimal_text(F.round(F.col("value") * 10).cast("long"), 100).alias("frp"),
        F.when(night, F.when(e % 2 == 0, "night").otherwise("N")).when(e % 7 == 0, "?").otherwise("day").alias("daynight"),
        e.alias(ROW_ORDER),
    )


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.clean_detections(raw_feed(spark, sf_dir))


# Stored tables of this session by name, folder and state of the input files.
_STORED: dict[tuple, DataFrame] = {}


def forget_stored() -> None:
    """Forget all stored tables, so that the next query builds its own."""
    _STORED.clear()
    _INDEXES.clear()


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)]
    return spark.sparkContext.applicationId, sf_dir, tuple(sorted(files))


def _keep(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The stored table of this name, written on first use.

    A deployment stores its clean detections and its sources and runs every other
    query on them; so do the queries here.
    """
    key = (name, _stamp(spark, sf_dir))
    if key not in _STORED:
        _STORED[key] = stored(build(), name)
    return _STORED[key]


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return _keep(spark, sf_dir, "detections", lambda: ingest.normalise(raw_feed(spark, sf_dir)))


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry from ``supplier``."""
    k = F.col("s_suppkey")
    lat, lon = site_position(k, k % 9, k % 10)
    sectors = F.array(*[F.lit(s) for s in K.SECTORS])
    return table(spark, sf_dir, "supplier").select(
        F.format_string("FAC-%05d", k).alias("facility_id"),
        F.col("s_name").alias("name"),
        ((lat + 2) / 1000).alias("lat"),
        ((lon + 1) / 1000).alias("lon"),
        F.element_at(sectors, (F.col("s_nationkey") % 8 + 1).cast("int")).alias("sector"),
        F.lit("").alias("district"),
        F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("state"),
        F.lit("MANUAL").alias("source_of_truth"),
        F.when(k % 3 != 0, 1500.0 + (k % 5) * 500).alias("match_radius_m"),
    )


# Nearest-facility indexes of this session, under the keys of the stored tables.
_INDEXES: dict[tuple, nearest.CandidateIndex] = {}


def site_index(spark: SparkSession, sf_dir: str) -> nearest.CandidateIndex:
    """The registry's index, built on first use and shared by all joins."""
    key = _stamp(spark, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = nearest.facility_index(facilities(spark, sf_dir))
    return _INDEXES[key]


def dense_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry of one site per row of ``orders``, spread over the whole region."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.format_string("ORD-%012d", k).alias("facility_id"),
        F.concat(F.lit("Site "), k.cast("string")).alias("name"),
        ((F.lit(9000) + (k * 7919) % 26000) / 1000).alias("lat"),
        ((F.lit(70000) + (k * 10007) % 25000) / 1000).alias("lon"),
        F.lit("POWER").alias("sector"), F.lit("").alias("district"), F.lit("").alias("state"),
        F.lit("MANUAL").alias("source_of_truth"), F.lit(1e7).alias("match_radius_m"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse land-cover pixels from ``lineitem``.

    Rows are reduced to one per pixel by its number; names are made for pixels, not for rows.
    """
    m = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    codes = F.array(*[F.lit(c) for c in PIXEL_CODES])
    found = (
        table(spark, sf_dir, "lineitem")
        .select((m % (48 * TILE_PIXELS * TILE_PIXELS)).alias("at"), F.element_at(codes, (F.col("l_quantity").cast("int") % 12 + 1)).alias("code"))
        .groupBy("at")
        .agg(F.max("code").alias("code"))
    )
    tile, pixel = F.col("at") % 48, F.floor(F.col("at") / 48)
    lat0, lon0 = 9 + 3 * (tile % 8), 72 + 3 * F.floor(tile / 8)
    return found.select(
        F.format_string("N%02dE%03d", lat0, lon0).alias("tile_id"),
        F.floor(pixel / TILE_PIXELS).cast("int").alias("row"),
        (pixel % TILE_PIXELS).cast("int").alias("col"),
        "code",
    )


def rounded_centres(found: DataFrame) -> DataFrame:
    """Centres to six decimals, so that engines that add in another order agree."""
    return found.withColumns({c: F.round(c, 6) for c in ("centroid_lat", "centroid_lon")})


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keep(
        spark, sf_dir, "sources", lambda: rounded_centres(cluster.cluster_sources(detections(spark, sf_dir)))
    )


def annotated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate_landcover(sources(spark, sf_dir), pixels(spark, sf_dir), TILE_PIXELS)


def covered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored sources with their land cover, which features and labels start from: pixels are read once."""
    return _keep(spark, sf_dir, "covered", lambda: annotated_sources(spark, sf_dir))


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = site_index(spark, sf_dir)
    return features.build_features(covered_sources(spark, sf_dir), facilities(spark, sf_dir), index=index)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.classify_rules(feature_rows(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored labelled sources with their nearest facility, which all label jobs start from."""
    def build() -> DataFrame:
        index = site_index(spark, sf_dir)
        return labels.label_sources(covered_sources(spark, sf_dir), facilities(spark, sf_dir), index=index, keep_nearest=True)

    return _keep(spark, sf_dir, "labelled", build)


def detection_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's detection table, which all reads and roll-ups run on."""
    return _keep(spark, sf_dir, "records", lambda: records.build_records(scored(spark, sf_dir)))
