"""Facility sources: seed, registry CSVs, tracker CSVs and map extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyrogrid import constants as K
from pyrogrid.operators.ingest import to_number
from pyrogrid.sources.detections import ROW_ORDER, canonical_name, first_line, list_files
from pyrogrid.sources import detections as landed

FACILITY_SCHEMA = (
    "facility_id string, name string, lat double, lon double, sector string, district string, "
    "state string, source_of_truth string, match_radius_m double, registry_rank string"
)


def seed_facilities(spark: SparkSession, old_positions: bool = False) -> DataFrame:
    """The built-in registry; its rows rank before every CSV row."""
    rows = []
    for number, (name, lat, lon, sector, radius) in enumerate(K.SEED_FACILITIES, 1):
        if old_positions:
            lat, lon = K.OLD_SEED_POSITIONS.get(name, (lat, lon))
        rows.append((f"FAC-{number:03d}", name, lat, lon, sector, "", "", "MANUAL", radius, f"0/{number:06d}"))
    return spark.createDataFrame(rows, FACILITY_SCHEMA)


def rank_text(order: Column, prefix: str) -> Column:
    """Sortable text of a landing position."""
    return F.concat(
        F.lit(prefix), order["file"], F.lit("/"), F.lpad(order["block"].cast("string"), 19, "0"), F.lit("/"),
        F.lpad(order["line"].cast("string"), 19, "0"),
    )


def first_per_name(facilities: DataFrame) -> DataFrame:
    """First row per name in registry order."""
    first = F.row_number().over(Window.partitionBy("name").orderBy("registry_rank"))
    return facilities.withColumn("_n", first).filter("_n = 1").drop("_n")


def load_facilities(spark: SparkSession, directory: str | None = None) -> DataFrame:
    """Seed rows and every registry CSV of a directory; seed names win."""
    out = seed_facilities(spark)
    extra = landed.read_detections(spark, directory) if directory else None
    if extra is not None:
        kinds = T._parse_datatype_string(FACILITY_SCHEMA)
        columns = []
        for f in kinds.fields:
            if f.name == "registry_rank":
                columns.append(rank_text(F.col(ROW_ORDER), "1/").alias(f.name))
            elif f.name not in extra.columns:
                columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            elif f.dataType == T.DoubleType():
                columns.append(to_number(F.col(f.name)).alias(f.name))
            else:
                columns.append(F.col(f.name).cast(f.dataType).alias(f.name))
        out = out.unionByName(extra.select(*columns))
    return first_per_name(out)


SITE_COLUMNS = ["name", "lat", "lon", "sector", "source", "site_rank"]


def tracker_sites(df: DataFrame, tracker: str, country: str = "india") -> DataFrame:
    """Sites of one country from a tracker table with unknown column names.

    Column names are found by content ("country", "lat", "long", a name column);
    a table without them gives no rows.  The sector is the tracker's name.
    """
    names = [c for c in df.columns if c != ROW_ORDER]
    low = {c: c.lower() for c in names}
    where = next((c for c in names if "country" in low[c]), None)
    lat = next((c for c in names if "lat" in low[c] and "long" not in low[c]), None)
    lon = next((c for c in names if "long" in low[c]), None)
    name = next((c for c in names if low[c] in ("name", "facility_name", "plant_name")), None)
    order = rank_text(F.col(ROW_ORDER), "0/") if ROW_ORDER in df.columns else F.xxhash64(*names).cast("string")
    if None in (where, lat, lon, name):
        empty = "name string, lat double, lon double, sector string, source string, site_rank string"
        return df.sparkSession.createDataFrame([], empty)
    sites = df.filter(F.lower(F.col(f"`{where}`")).contains(country)).select(
        F.trim(F.col(f"`{name}`")).alias("name"),
        to_number(F.col(f"`{lat}`")).alias("lat"),
        to_number(F.col(f"`{lon}`")).alias("lon"),
        F.lit(tracker.upper()).alias("sector"),
        F.lit("GEM").alias("source"),
        order.alias("site_rank"),
    )
    return distinct_sites(sites.na.drop(subset=["lat", "lon"]), ["name"])


def distinct_sites(sites: DataFrame, extra_keys: list[str]) -> DataFrame:
    """First site per position rounded to four decimals (and the extra keys)."""
    keys = [*extra_keys, F.bround("lat", 4), F.bround("lon", 4)]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("site_rank"))
    return sites.withColumn("_n", first).filter("_n = 1").drop("_n")


def read_tracker(spark: SparkSession, path: str, tracker: str, country: str = "india") -> DataFrame:
    """Tracker CSV from a landed file."""
    line = first_line(spark, path) or ""
    return tracker_sites(landed._scan(spark, [path], line), tracker, country)


MAP_SCHEMA = (
    "elements array<struct<type:string,id:bigint,lat:double,lon:double,"
    "center:struct<lat:double,lon:double>,tags:map<string,string>>>"
)


def map_sites(elements: DataFrame) -> DataFrame:
    """Industrial sites from map elements (one row per element)."""
    node = F.col("type") == "node"
    lat = F.when(node, F.col("lat")).when(F.col("type").isin("way", "relation"), F.col("center.lat"))
    lon = F.when(node, F.col("lon")).when(F.col("type").isin("way", "relation"), F.col("center.lon"))

    def tag(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col("tags")[n], F.lit("")) for n in names])

    df = elements.withColumns({"_lat": lat, "_lon": lon}).filter(
        (F.col("_lat") > -60) & (F.col("_lat") < 80) & (F.col("_lon") > 30) & (F.col("_lon") < 160)
    )
    made_up = F.format_string("OSM-%.4f_%.4f", F.bround("_lat", 4), F.bround("_lon", 4))
    sites = df.select(
        F.coalesce(tag("name", "brand", "operator"), made_up).alias("name"),
        F.bround("_lat", 6).alias("lat"),
        F.bround("_lon", 6).alias("lon"),
        F.upper(F.coalesce(tag("industrial", "landuse", "man_made", "power"), F.lit("industrial"))).alias("sector"),
        F.lit("OSM").alias("source"),
        F.col("site_rank") if "site_rank" in elements.columns else F.lit("1/").alias("site_rank"),
    )
    return distinct_sites(sites, [])


def read_map_extract(spark: SparkSession, path: str) -> DataFrame:
    """Map extract: JSON documents with an ``elements`` array."""
    documents = spark.read.schema(MAP_SCHEMA).option("multiLine", True).json(path)
    elements = documents.select(
        F.col("_metadata.file_path").alias("file"), F.posexplode("elements").alias("pos", "e")
    ).select("e.*", F.concat_ws("/", F.lit("1"), "file", F.lpad(F.col("pos").cast("string"), 12, "0")).alias("site_rank"))
    return map_sites(elements)


def seed_sites(spark: SparkSession) -> DataFrame:
    """Seed registry as merge input, at the positions the merge uses."""
    return seed_facilities(spark, old_positions=True).select(
        "name", "lat", "lon", "sector", F.lit("MANUAL").alias("source"),
        F.concat(F.lit("2/"), "registry_rank").alias("site_rank"),
    )
