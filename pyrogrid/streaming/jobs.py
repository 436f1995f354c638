"""Incremental runs: landed files to an up-to-date store, batch by batch."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pyrogrid import constants as K
from pyrogrid.functions import geo
from pyrogrid.operators import cluster, features, ingest, landcover, records, scoring
from pyrogrid.sources import store
from pyrogrid.sources.blocks import BlockTable
from pyrogrid.sources.detections import ROW_ORDER, canonical_columns
from pyrogrid.streaming import events

# Versions of a store table that readers may still be using when a batch ends.
KEEP_VERSIONS = 3
# Batches after which blocks that lie in many pieces are compacted.
COMPACT_EVERY = 16
REWRITTEN = ["sources", "detections", "tir_counts", "pipeline_runs"]


def landing_stream(spark: SparkSession, directory: str, columns: list[str], files_per_batch: int | None = None) -> DataFrame:
    """Stream of landed CSV files as texts, with their landing position."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.readStream.schema(schema).option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(directory).select(
        *columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )


def clean_table(spark: SparkSession, root: str) -> BlockTable:
    """Clean rows by 2-degree block.  A batch appends version 2 (batch + 1); the odd version after it compacts."""
    return BlockTable(spark, root, "clean")


def stored_rows(spark: SparkSession, root: str, blocks: list[str], up_to: int) -> DataFrame | None:
    """Clean rows of the given blocks from batches up to one; only the folders of these blocks are read."""
    return clean_table(spark, root).read(blocks, before=2 * (up_to + 1) + 1)


def ingest_batch(batch: DataFrame, batch_id: int, root: str) -> tuple[int, list[str]]:
    """Append the new clean rows of one batch; returns their number and blocks.

    Rows are kept by 2-degree block.  Repeats of earlier rows are found whatever their
    age: a repeat has the position and time of the first row, so only the batch's own
    blocks and days are read again.  A repeated batch replaces its own data and nothing
    else.
    """
    spark = batch.sparkSession
    raw = canonical_columns(batch.drop("_file", "_block"))
    if "_file" in batch.columns:
        position = F.struct(F.col("_file"), F.col("_block"), F.monotonically_increasing_id().alias("line"))
        raw = canonical_columns(batch.withColumn(ROW_ORDER, position).drop("_file", "_block"))
    rows = ingest.normalise(raw).withColumn("block_id", geo.block_id(F.col("latitude"), F.col("longitude")))
    staging = f"{root}/staging/batch={batch_id}"
    rows.write.mode("overwrite").parquet(staging)
    staged = spark.read.schema(rows.schema).parquet(staging)
    # Block names are few (a block is two degrees wide), so they may be listed.
    found = staged.groupBy("block_id").agg(F.min("acq_date").alias("low"), F.max("acq_date").alias("high")).collect()
    blocks = sorted(r["block_id"] for r in found)
    known = stored_rows(spark, root, blocks, batch_id - 1)
    if known is not None:
        days = F.col("acq_date").between(min(r["low"] for r in found), max(r["high"] for r in found))
        keys = ["block_id", *ingest.DUPLICATE_KEY]
        staged = staged.join(known.filter(days).select(*keys), keys, "left_anti")
    table, version = clean_table(spark, root), 2 * (batch_id + 1)
    table.append(staged.withColumn("batch", F.lit(batch_id)), version)
    store.remove(spark, staging)
    fresh = table.read_version(version)
    counts = fresh.groupBy("block_id").count().collect() if fresh is not None else []
    # Small pieces of a block are put together once there are many.
    if (batch_id + 1) % COMPACT_EVERY == 0:
        table.compact(version + 1, COMPACT_EVERY // 2)
        table.drop_old(2 * KEEP_VERSIONS)
    return sum(r["count"] for r in counts), sorted(r["block_id"] for r in counts)


def start_ingest(stream: DataFrame, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Only the first step of ``start``: clean rows without repeats, batch by batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, root)

    return _run(stream, handle, checkpoint, once)


def process_batch(
    batch: DataFrame,
    batch_id: int,
    root: str,
    facilities: DataFrame,
    pixels: DataFrame | None = None,
    tile_pixels: int = K.TILE_PIXELS,
    cell_deg: float = K.CELL_DEG,
    score: Callable[[DataFrame], DataFrame] = scoring.classify_rules,
) -> None:
    """Fold one batch of raw rows into the store.

    Clean rows are appended by 2-degree block.  Only the cells the batch touches are
    aggregated again, from the blocks they lie in, and only these blocks of the source
    and record tables are written again.  The ambient median is kept exact by adding
    value counts; when it moves, the blocks with sources that rely on it are refreshed
    too.  Every table version is named by the batch, so a repeated batch after a failure
    gives the same store.
    """
    spark = batch.sparkSession
    version = batch_id + 1
    times: dict[str, float] = {}

    def timed(stage: str, work: Callable):
        begin = time.perf_counter()
        out = work()
        times[stage] = times.get(stage, 0.0) + (time.perf_counter() - begin) * 1000
        return out

    n_raw, blocks = timed("VIIRS INGEST", lambda: ingest_batch(batch, batch_id, root))
    if not n_raw:
        _record(spark, root, batch_id, 0, 0, times, "EMPTY")
        return
    fresh = clean_table(spark, root).read_version(2 * version).drop("batch")
    sources_table = BlockTable(spark, root, "sources")

    def cluster_rows() -> None:
        old_freq = store.read_table(spark, root, "tir_counts", before=version)
        freq = cluster.tir_frequencies(fresh)
        if old_freq is not None:
            freq = old_freq.unionByName(freq).groupBy("bright_ti5").agg(
                F.sum("n_low").alias("n_low"), F.sum("n_all").alias("n_all")
            )
        store.publish(freq, root, "tir_counts", version)
        ambient = cluster.ambient_from_frequencies(store.read_table(spark, root, "tir_counts"))
        touched = cluster.with_cells(fresh, cell_deg).select(*cluster.CELL).distinct()
        history = stored_rows(spark, root, blocks, batch_id).drop("batch")
        rows = cluster.with_cells(history, cell_deg).join(touched, cluster.CELL, "left_semi").drop(*cluster.CELL)
        sources = cluster.cluster_sources(rows, cell_deg, ambient=ambient, keep_cells=True).withColumn("changed_in", F.lit(version))
        centre = [(F.col(c) + 0.5) * cell_deg for c in cluster.CELL]
        sources = sources.withColumn("block_id", geo.block_id(*centre)).drop(*cluster.CELL)
        sources = landcover.annotate_landcover(sources, pixels, tile_pixels)
        borrowed = F.col("t_bg_method") == "regional_ambient"
        now = ambient.first()["ambient_K"]
        moved = borrowed & ~F.col("t_bg_K").eqNullSafe(F.lit(now).cast("double"))
        old = sources_table.read(before=version)
        outdated = [] if old is None else [r[0] for r in old.filter(moved).select("block_id").distinct().collect()]
        touched = sorted({*outdated, *(r[0] for r in sources.select("block_id").distinct().collect())})
        merged = store.merge_rows(sources_table.read(touched, before=version), sources, "source_id")
        merged = merged.withColumns(
            {
                "changed_in": F.when(moved, F.lit(version)).otherwise(F.col("changed_in")),
                "t_bg_K": F.when(borrowed, F.lit(now).cast("double")).otherwise(F.col("t_bg_K")),
            }
        )
        sources_table.replace(merged, version, touched)

    timed("SOURCE CLUSTER", cluster_rows)
    changed = sources_table.read_version(version).filter(F.col("changed_in") == version).drop("changed_in")
    placed = changed.select(F.col("source_id").alias("id"), "block_id")
    changed = changed.drop("block_id")
    found = timed("PLANCK RETRIEVAL", lambda: features.build_features(changed, facilities))
    scored = timed("CLASSIFY", lambda: score(found))
    out = records.build_records(scored, {k: int(v) for k, v in times.items()})

    def write_records() -> int:
        store.publish(out.drop("block_id").join(placed, "id"), root, "changes", version)
        # The change table is what subscribers of new detections read.
        changes = spark.read.parquet(f"{root}/changes/v={version:012d}")
        detections = BlockTable(spark, root, "detections")
        detections.upsert(changes, version, lambda old, new: store.merge_rows(old, new, "id"))
        return changes.count()

    n_sources = timed("CLASSIFY", write_records)
    _record(spark, root, batch_id, n_raw, n_sources, times, "SUCCESS")
    events.write_batch(spark.read.parquet(f"{root}/changes/v={version:012d}"), root, batch_id, n_raw, times)
    for name in REWRITTEN:
        store.drop_old_versions(spark, root, name, KEEP_VERSIONS)


def _record(spark, root, batch_id, n_raw, n_sources, times, status) -> None:
    """Run summary and stage log of one batch."""
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    stages = {k: max(1, int(round(v))) for k, v in times.items()}
    run = [(f"RUN-{batch_id:08d}", now, f"batch {batch_id}", n_raw, n_sources, stages, status, sum(stages.values()))]
    store.upsert(
        spark.createDataFrame(run, store.RUN_SCHEMA), root, "pipeline_runs", "run_id", version=batch_id + 1, buckets=1
    )
    log = [(now, stage, "INFO", f"batch {batch_id}: {stage.lower()} done", ms) for stage, ms in stages.items()]
    spark.createDataFrame(log, store.LOG_SCHEMA).write.mode("overwrite").parquet(f"{root}/pipeline_log/batch={batch_id}")


def start(
    stream: DataFrame, root: str, checkpoint: str, facilities: DataFrame, once: bool = False, **options
) -> StreamingQuery:
    """Run ``process_batch`` on a stream: everything landed so far, or every 600 s.

    Backfill is a run with ``once=True``; the polling run then continues from the
    same checkpoint.  A failing batch leaves the last complete store readable.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, root, facilities, **options)

    return _run(stream, handle, checkpoint, once)


def _run(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    trigger = {"availableNow": True} if once else {"processingTime": f"{K.POLL_SECONDS} seconds"}
    return writer.trigger(**trigger).start()
