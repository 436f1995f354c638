"""Landed detection files: header checks, canonical names, string scan."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: first header column of a valid feed, and required columns
KNOWN_FIRST_COLUMNS = ["latitude", "country_id", "acq_date"]
FEED_COLUMNS = ["latitude", "longitude", "bright_ti4", "bright_ti5"]
REQUIRED_COLUMNS = FEED_COLUMNS + ["acq_date", "acq_time"]
# Hidden row position, used to keep the first of equal rows.
ROW_ORDER = "_row_order"


def canonical_name(name: str) -> str:
    """Lower case, runs of other characters to one underscore, ends trimmed."""
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename every column to its canonical name."""
    return df.toDF(*[c if c == ROW_ORDER else canonical_name(c) for c in df.columns])


def require_columns(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Raise ``ValueError`` naming every missing column."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"detection table misses required columns: {missing}")
    return df


def list_files(spark: SparkSession, directory: str, suffix: str = ".csv") -> list[str]:
    """Paths in a directory by name, through the Hadoop file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath().toString() for s in fs.listStatus(path) if s.isFile()]
    return sorted(p for p in found if p.endswith(suffix))


def first_line(spark: SparkSession, file: str) -> str | None:
    """First non-blank line of a file without a byte-order mark; None if there is none."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        line = reader.readLine()
        while line is not None and not line.strip("﻿ \t\r\n"):
            line = reader.readLine()
        return None if line is None else line.lstrip("﻿").strip()
    finally:
        reader.close()


def headers(spark: SparkSession, files: list[str]) -> dict[str, str | None]:
    """Header line per file; reads only the start of each file."""
    with ThreadPoolExecutor(max_workers=16) as pool:
        return dict(zip(files, pool.map(lambda f: first_line(spark, f), files)))


def landed_file_report(spark: SparkSession, directory: str) -> DataFrame:
    """One row per landed file: accepted, or quarantined with the reason."""
    rows = []
    for file, line in headers(spark, list_files(spark, directory)).items():
        first = (line or "").split(",", 1)[0].strip().lower()
        status = "empty" if line is None else "accepted" if first in KNOWN_FIRST_COLUMNS else "quarantined"
        rows.append((file, status, line or ""))
    return spark.createDataFrame(rows, "file string, status string, header string")


def _scan(spark: SparkSession, files: list[str], header: str) -> DataFrame:
    names = [c.strip().strip('"') for c in header.split(",")]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(files)
    # Position in the landed data: file, split, then line order inside the split.
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return df.select(*[F.col(f"`{c}`") for c in names], order.alias(ROW_ORDER))


def read_detections(spark: SparkSession, directory: str) -> DataFrame | None:
    """Scan every CSV of a directory as strings, in name order.

    Files with equal headers share one scan; unequal headers are united by name.
    Empty files are skipped.  Returns None when nothing is left.
    """
    groups: dict[str, list[str]] = {}
    for file, line in headers(spark, list_files(spark, directory)).items():
        if line is not None:
            groups.setdefault(line, []).append(file)
    frames = [canonical_columns(_scan(spark, files, line)) for line, files in sorted(groups.items())]
    if not frames:
        return None
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Scan one CSV feed; raise ``ValueError`` unless the four band columns exist."""
    if not path.lower().endswith(".csv"):
        raise ValueError("only .csv feeds are supported")
    line = first_line(spark, path)
    if line is None:
        raise ValueError(f"empty feed: {path}")
    return require_columns(canonical_columns(_scan(spark, [path], line)), FEED_COLUMNS)
