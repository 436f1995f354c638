"""Filtered reads and roll-ups over detection records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyrogrid import constants as K


def parse_bbox(text: str | None) -> tuple[float, float, float, float] | None:
    """"west,south,east,north" to four numbers; ``ValueError`` otherwise."""
    if not text:
        return None
    parts = [float(p) for p in text.split(",")]
    if len(parts) != 4:
        raise ValueError("bbox must be minx,miny,maxx,maxy")
    return tuple(parts)


def _now(now: datetime | str | None) -> Column:
    return F.current_timestamp() if now is None else F.lit(now).cast("timestamp")


def detections(
    records: DataFrame,
    bbox: str | tuple | None = None,
    hours: int = 0,
    cls: list[str] | None = None,
    min_conf: float = 0.0,
    limit: int | None = K.QUERY_LIMIT,
    now: datetime | str | None = None,
) -> DataFrame:
    """Newest matching detections; every predicate is plain and reaches the scan."""
    if limit is not None and not 1 <= limit <= 5000:
        raise ValueError("limit must be 1 to 5000")
    df = records
    if hours:
        df = df.filter(F.col("ts") >= _now(now) - F.expr(f"interval {int(hours)} hours"))
    if cls:
        df = df.filter(F.col("cls").isin(list(cls)))
    if min_conf > 0:
        df = df.filter(F.col("conf") >= min_conf)
    bounds = parse_bbox(bbox) if isinstance(bbox, str) else bbox
    if bounds:
        west, south, east, north = bounds
        df = df.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    df = df.orderBy(F.desc("ts"), "id")
    return df if limit is None else df.limit(limit)


def detection_by_id(records: DataFrame, detection_id: str) -> DataFrame:
    return records.filter(F.col("id") == detection_id)


def facilities_by_sector(facilities: DataFrame, sector: str | None = None) -> DataFrame:
    return facilities if not sector else facilities.filter(F.col("sector") == sector)


def attributed_feed(records: DataFrame, limit: int = K.FEED_LIMIT) -> DataFrame:
    """Newest resolved detections at a known facility."""
    known = F.col("facility_name").isNotNull() & (F.col("facility_name") != "")
    return records.filter((F.col("cls") != "UNRESOLVED") & known).orderBy(F.desc("ts"), "id").limit(limit)


def _long(counted: DataFrame, kind: str, names: list[str], prefix: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{prefix}{n}").alias("n")) for n in names])
    return counted.select(F.lit(kind).alias("kind"), F.inline(pairs))


def stats(records: DataFrame) -> DataFrame:
    """One row: total, counts by class and severity (zero-filled), newest time."""
    by_cls = [F.count_if(F.col("cls") == c).alias(f"_c_{c}") for c in K.CLASSES]
    by_sev = [F.count_if(F.col("severity") == s).alias(f"_s_{s}") for s in K.SEVERITY_LEVELS]
    row = records.agg(F.count(F.lit(1)).alias("total_detections"), F.max("ts").alias("last_ingest_utc"), *by_cls, *by_sev)

    def as_map(names: list[str], prefix: str) -> Column:
        return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"{prefix}{n}") for n in names]))

    return row.select(
        "total_detections",
        F.col("total_detections").alias("total_sources"),
        as_map(K.CLASSES, "_c_").alias("by_class"),
        as_map(K.SEVERITY_LEVELS, "_s_").alias("by_severity"),
        "last_ingest_utc",
    )


def stats_counts(records: DataFrame) -> DataFrame:
    """The counts of ``stats`` as rows (kind, name, n)."""
    row = stats(records)
    cls = row.select(F.lit("class").alias("kind"), F.explode("by_class").alias("name", "n"))
    return cls.unionByName(row.select(F.lit("severity").alias("kind"), F.explode("by_severity").alias("name", "n")))


def freshness(records: DataFrame, now: datetime | str | None = None) -> DataFrame:
    """Whole seconds since the newest record; -1 without records."""
    age = F.floor(_now(now).cast("double") - F.max("ts").cast("double")).cast("long")
    return records.agg(F.coalesce(age, F.lit(-1)).alias("ingest_age_s"))


def funnel(records: DataFrame) -> DataFrame:
    """Provenance counts with their share of all sources in percent."""
    named = F.col("facility_name").isNotNull() & ~F.col("facility_name").isin("", "Unknown Facility")
    row = records.agg(
        F.count(F.lit(1)).alias("total_detections"),
        F.countDistinct(F.when(named, F.col("facility_name"))).alias("facilities_matched"),
        F.count_if(named).alias("detections_matched"),
        F.count_if(F.col("cls") == "UNRESOLVED").alias("unresolved_count"),
        F.count_if(F.col("cls") == "FLARE").alias("flares_count"),
        F.count_if(F.col("cls") == "LEAK").alias("leaks_count"),
        F.count("temp_K").alias("retrieved_count"),
    )
    return row.withColumn(
        "retrieved_pct",
        F.when(F.col("total_detections") > 0, F.round(F.col("retrieved_count") * 100.0 / F.col("total_detections"), 1)),
    )


def emission_totals(records: DataFrame) -> DataFrame:
    """Summed rate and total of unsuppressed records that have a rate."""
    active = records.filter(~F.col("offshore_suppressed") & F.col("co2e_rate_tph").isNotNull())
    return active.agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.coalesce(F.sum("co2e_rate_tph"), F.lit(0.0)).alias("co2e_rate_tph"),
        F.coalesce(F.sum("co2e_total_t"), F.lit(0.0)).alias("co2e_total_t"),
    )


def class_distribution(records: DataFrame) -> DataFrame:
    """Count and percent per class; every class is listed."""
    counts = stats_counts(records).filter("kind = 'class'").select(F.col("name").alias("cls"), "n")
    share = F.col("n") * 100.0 / F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1))
    return counts.withColumn("pct", F.round(share, 1))


def temperature_histogram(
    records: DataFrame, low: float = 350.0, high: float = 720.0, bins: int = 10
) -> DataFrame:
    """Counts of retrieved temperatures (300 to 1200 K); hotter ones fill the last bin."""
    width = (high - low) / bins
    usable = records.filter(F.col("temp_K").between(300, 1200))
    slot = F.least(F.floor((F.col("temp_K") - low) / width), F.lit(bins - 1))
    counted = usable.agg(*[F.count_if(slot == b).alias(f"b{b}") for b in range(bins)])
    rows = F.array(
        *[
            F.struct(F.lit(b).alias("bin"), F.lit(low + b * width).alias("low_K"), F.col(f"b{b}").alias("n"))
            for b in range(bins)
        ]
    )
    return counted.select(F.inline(rows))


def distance_range(records: DataFrame) -> DataFrame:
    """Nearest and farthest matched distance."""
    matched = records.filter(F.col("facility_name").isNotNull() & F.col("dist_facility_m").isNotNull())
    return matched.agg(F.min("dist_facility_m").alias("min_m"), F.max("dist_facility_m").alias("max_m"))
