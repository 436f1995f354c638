"""Cleaning of raw detections: types, time, defaults, outline filter, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyrogrid import constants as K
from pyrogrid.functions import geo
from pyrogrid.sources.detections import ROW_ORDER, canonical_columns, require_columns

NUMERIC_COLUMNS = ["latitude", "longitude", "bright_ti4", "bright_ti5", "scan", "track", "frp"]
# Decimal and exponent notation, and the spellings of infinity; blanks around are ignored.
NUMBER = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf(?:inity)?))\s*$"
DUPLICATE_KEY = ["latitude", "longitude", "acq_utc", "satellite"]


def to_number(column: Column) -> Column:
    """Double, or null where the text is no number (a type suffix as in ``300d`` makes it none)."""
    plain = column.cast("string").rlike(NUMBER)
    return F.when(plain, F.nanvl(column.try_cast("double"), F.lit(None).cast("double")))


def parse_utc(acq_date: Column, acq_time: Column) -> Column:
    """UTC timestamp of a date and an unpadded HHMM text; null if unreadable.

    A trailing ``.0`` is accepted.  Whole-number arithmetic keeps the expression in
    generated code, where a timestamp pattern would be parsed per row.
    """
    time = acq_time.cast("string")
    clock = time.try_cast("double").cast("int")
    day = F.when(F.length(acq_date.cast("string")) >= 8, acq_date.try_cast("date"))
    valid = time.rlike(r"^[0-9]{1,4}(\.0)?$") & (clock < 2400) & (clock % 100 < 60)
    seconds = F.unix_date(day).cast("long") * 86400 + F.floor(clock / 100) * 3600 + (clock % 100) * 60
    return F.when(valid, F.timestamp_seconds(seconds))


def local_solar_hour(acq_utc: Column, longitude: Column) -> Column:
    return F.pmod(F.hour(acq_utc) + F.minute(acq_utc) / 60 + longitude / 15, F.lit(24.0))


def day_or_night(flag: Column) -> Column:
    letter = F.upper(F.substring(flag.cast("string"), 1, 1))
    return F.when(letter.isin("D", "N"), letter).otherwise(F.lit("D"))


def worked_out_once(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows, with ``columns`` passed through a generator of one row.

    Filters on them stay above it.  Otherwise the optimizer moves each filter below the
    projection and repeats there, per condition, the texts and patterns it is made of.
    """
    passed = df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*columns))))
    return passed.select(*df.columns)


def clean_detections(raw: DataFrame) -> DataFrame:
    """Typed rows with time, defaults and derived columns; unusable rows dropped."""
    df = require_columns(canonical_columns(raw))
    have = set(df.columns)
    numbers = {c: to_number(F.col(c)) if c in have else F.lit(None).cast("double") for c in NUMERIC_COLUMNS}
    df = df.withColumns(numbers | {"acq_utc": parse_utc(F.col("acq_date"), F.col("acq_time"))})
    df = worked_out_once(df, [*numbers, "acq_utc"])
    df = df.na.drop(subset=[*NUMERIC_COLUMNS[:4], "acq_utc"])

    def text(name: str, default: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in have else F.lit(default)

    area = F.col("scan") * F.col("track")
    return df.withColumns(
        {
            "acq_date": F.to_date("acq_utc"),
            "satellite": text("satellite", "UNKNOWN"),
            "instrument": text("instrument", "VIIRS"),
            "daynight": day_or_night(F.col("daynight")) if "daynight" in have else F.lit("D"),
            "local_solar_hour": local_solar_hour(F.col("acq_utc"), F.col("longitude")),
            "pixel_area_m2": F.when(area > 0, area * 1_000_000).otherwise(F.lit(K.DEFAULT_PIXEL_AREA_M2)),
        }
    )


def filter_mainland(df: DataFrame, boundary: bool = True) -> DataFrame:
    """Rows inside the mainland outline.

    The bounds test comes first because it reaches a Parquet scan; the outline
    test is a narrow expression on constants, so there is no shuffle or join.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    return df.filter(geo.in_bbox(lat, lon)).filter(geo.in_mainland(lat, lon, boundary))


def drop_duplicates(df: DataFrame, keys: list[str] = DUPLICATE_KEY, order: list | None = None) -> DataFrame:
    """First row per key in landing order.

    Filtering ``row_number() = 1`` lets Spark keep one row per key in each map
    task before the shuffle, so a key with very many copies stays cheap.  Without
    a landing order the remaining columns decide, which is repeatable.
    """
    if order is None:
        order = [ROW_ORDER] if ROW_ORDER in df.columns else sorted(set(df.columns) - set(keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def normalise(raw: DataFrame) -> DataFrame:
    """Raw feed rows to clean mainland detections without duplicates."""
    return drop_duplicates(filter_mainland(clean_detections(raw))).drop(ROW_ORDER)
