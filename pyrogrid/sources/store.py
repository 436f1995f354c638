"""Parquet store: versioned tables, upserts by block, run history, dispatch receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyrogrid import constants as K
from pyrogrid.sources import files
from pyrogrid.sources.blocks import BlockTable
from pyrogrid.sources.files import exists, remove

VIEW_TABLES = ["detections", "sources", "facilities", "labelled"]


# Hash buckets of a table that is kept by key.
BUCKETS = 64


def _in_blocks(spark: SparkSession, root: str, name: str) -> bool:
    return exists(spark, f"{root}/{name}/manifest")


def versions(spark: SparkSession, root: str, name: str) -> list[tuple[int, str]]:
    """Complete versions of a table, oldest first.  A version counts once committed."""
    inner = "/manifest" if _in_blocks(spark, root, name) else ""
    return files.versions(spark, f"{root}/{name}{inner}")


def publish(df: DataFrame, root: str, name: str, version: int | None = None, partition_by: list[str] | None = None) -> int:
    """Write a whole table as a new version; readers see it only when it is complete.

    Old versions stay readable, so a job may read the table it replaces, and a
    failed or repeated write of one version harms nobody.
    """
    done = versions(df.sparkSession, root, name)
    if version is None:
        version = (done[-1][0] if done else 0) + 1
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/{name}/v={version:012d}")
    return version


def read_table(spark: SparkSession, root: str, name: str, before: int | None = None) -> DataFrame | None:
    """Newest complete version (older than ``before`` if given), or None."""
    if _in_blocks(spark, root, name):
        found = BlockTable(spark, root, name, _block_column(spark, root, name)).read(before=before)
        return None if found is None else found.drop("_bucket")
    done = [path for v, path in versions(spark, root, name) if before is None or v < before]
    return spark.read.parquet(done[-1]) if done else None


def _block_column(spark: SparkSession, root: str, name: str) -> str:
    """The column that a table's data folders are named by."""
    for folder in files.leaves(spark, f"{root}/{name}/data"):
        for leaf in files.leaves(spark, f"{root}/{name}/data/{folder}"):
            if "=" in leaf:
                return leaf.split("=", 1)[0]
    return "block_id"


def drop_old_versions(spark: SparkSession, root: str, name: str, keep: int = 3) -> None:
    """Delete all but the newest versions of one table."""
    if _in_blocks(spark, root, name):
        BlockTable(spark, root, name, _block_column(spark, root, name)).drop_old(keep)
        return
    for _, path in versions(spark, root, name)[:-keep]:
        remove(spark, path)


def latest_per_key(df: DataFrame, key: str | list[str], order: list) -> DataFrame:
    """Row with the greatest order per key."""
    keys = [key] if isinstance(key, str) else list(key)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def merge_rows(old: DataFrame | None, new: DataFrame, key: str, order: list | None = None) -> DataFrame:
    """Insert or replace: new rows win over old ones; ``order`` ranks new rows of one key."""
    fresh = latest_per_key(new, key, order) if order else new
    if old is None:
        return fresh
    kept = old.join(fresh.select(key), key, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def upsert(
    new: DataFrame, root: str, name: str, key: str, order: list | None = None, version: int | None = None, buckets: int = BUCKETS
) -> int:
    """Insert or replace by key into a versioned table, kept in hash buckets of the key.

    Only the buckets of the new keys are read and written again.  With a fixed
    ``version`` (a batch id) a repeated call starts from the same older version and
    gives the same table.
    """
    spark = new.sparkSession
    if version is None:
        done = versions(spark, root, name)
        version = (done[-1][0] if done else 0) + 1
    table = BlockTable(spark, root, name, "_bucket")
    keyed = new.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("string"))
    table.upsert(keyed, version, lambda old, fresh: merge_rows(old, fresh, key, order))
    return version


def upsert_detections(records: DataFrame, root: str, version: int | None = None) -> int:
    return upsert(records, root, "detections", "id", [F.desc("ts")], version)


def upsert_facilities(facilities: DataFrame, root: str, version: int | None = None) -> int:
    return upsert(facilities, root, "facilities", "facility_id", version=version)


def register_views(spark: SparkSession, root: str) -> list[str]:
    """Temp views v_detections, v_sources, v_facilities, v_labelled where tables exist."""
    made = []
    for name in VIEW_TABLES:
        table = read_table(spark, root, name)
        if table is not None:
            table.createOrReplaceTempView(f"v_{name}")
            made.append(f"v_{name}")
    return made


RUN_SCHEMA = (
    "run_id string, ts timestamp, filename string, num_raw long, num_sources long, "
    "stages map<string,long>, status string, total_ms long"
)
LOG_SCHEMA = "ts timestamp, stage string, level string, message string, elapsed_ms long"


def record_runs(runs: DataFrame, root: str) -> int:
    """Insert or replace pipeline runs by run id."""
    return upsert(runs, root, "pipeline_runs", "run_id", [F.desc("ts")], buckets=1)


def newest_runs(runs: DataFrame, limit: int = K.RUN_LIMIT) -> DataFrame:
    return runs.orderBy(F.desc("ts"), "run_id").limit(limit)


def append_log(entries: DataFrame, root: str) -> None:
    entries.write.mode("append").parquet(f"{root}/pipeline_log")


def newest_log(log: DataFrame, limit: int = K.FEED_LIMIT) -> DataFrame:
    return log.orderBy(F.desc("ts")).limit(limit)


def to_payload(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key columns beside the whole row as JSON text."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("payload"))


def from_payload(df: DataFrame, schema: str) -> DataFrame:
    """Typed row of a JSON payload column."""
    return df.select(F.from_json("payload", schema).alias("_row")).select("_row.*")


def dispatch(requests: DataFrame, records: DataFrame, dispatched_at: Column) -> tuple[DataFrame, DataFrame]:
    """(receipts, rejected requests) for a batch of alert requests.

    A request needs an existing detection.  The id comes from the request, so a
    repeated batch gives the same receipts.
    """
    known = records.select(F.col("id").alias("detection_id"))
    sent = F.col("channel") == "mock"
    digest = F.md5(F.concat_ws("|", "detection_id", "authority", "channel", F.coalesce("note", F.lit(""))))
    accepted = requests.join(known, "detection_id", "left_semi").select(
        F.concat(F.lit("DSP-"), F.upper(F.substring(digest, 1, 10))).alias("dispatch_id"),
        "detection_id", "authority", "channel", "note",
        F.when(sent, "sent").otherwise("failed").alias("status"),
        F.when(sent, K.RECEIPT_SENT).otherwise(K.RECEIPT_FAILED).alias("receipt"),
        dispatched_at.alias("dispatched_at"),
    )
    return accepted, requests.join(known, "detection_id", "left_anti")


def write_dispatches(receipts: DataFrame, root: str) -> None:
    """Append receipts as JSON lines and to the alerts table."""
    receipts.write.mode("append").json(f"{root}/dispatches")
    receipts.write.mode("append").parquet(f"{root}/alerts")


def write_sorted(df: DataFrame, path: str, order: list[str]) -> None:
    """Parquet files in global order: ranges of ``order`` are dealt to tasks, and each writes one sorted file."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def file_order(spark: SparkSession, path: str) -> DataFrame:
    """The rows of sorted files with ``position``: their number, from 1, in the order of files and of rows in each."""
    place = [F.col("_metadata.file_name").alias("_file"), (F.col("_metadata.row_index") + 1).alias("_inside")]
    rows = spark.read.parquet(path).select("*", *place)
    # One row per file, so the running sum over all files is small.
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(offsets), "_file").withColumn("position", F.col("_before") + F.col("_inside")).drop("_file", "_inside", "_before")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line."""
    df.write.mode("overwrite").option("header", True).csv(path)
