"""Event-time windows over the stream of clean rows, and the rows that come too late for them.

- ``hourly_power``: hourly count and power per source.
- ``persistence``: sliding count of active days per source.
- ``activity_sessions``: stretches of activity per source, apart by at least a gap.

All are aggregations of Structured Streaming with a watermark.  Hourly and sliding
windows are kept up to date by key; a session is written once the watermark has passed
it.  Rows whose hourly window was closed when they came are written to a table of their
own by a second query over the same files, so windows and late rows together hold every row.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pyrogrid import constants as K
from pyrogrid.functions import geo
from pyrogrid.operators import cluster
from pyrogrid.sources import store

HOUR, SLIDE, SPAN, GAP = "1 hour", "1 day", "3 days", "36 hours"


def located_rows(clean: DataFrame, cell_deg: float = K.CELL_DEG) -> DataFrame:
    """(source_id, acq_utc, acq_date, frp) of clean rows, batch or stream."""
    cells = cluster.with_cells(clean, cell_deg)
    return cells.select(geo.source_id(*[F.col(c) for c in cluster.CELL]).alias("source_id"), "acq_utc", "acq_date", "frp")


def hourly_power(rows: DataFrame) -> DataFrame:
    """(source_id, start, n, power) per hour."""
    found = rows.groupBy("source_id", F.window("acq_utc", HOUR).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("frp").alias("power"))
    return found.select("source_id", F.col("w.start").alias("start"), "n", "power")


def persistence(rows: DataFrame, span: str = SPAN, slide: str = SLIDE) -> DataFrame:
    """(source_id, start, n, active_days) per sliding window; a window has few days, so their set is small."""
    found = rows.groupBy("source_id", F.window("acq_utc", span, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.size(F.collect_set("acq_date")).alias("active_days")
    )
    return found.select("source_id", F.col("w.start").alias("start"), "n", "active_days")


def activity_sessions(rows: DataFrame, gap: str = GAP) -> DataFrame:
    """(source_id, start, end, n, power) per stretch of activity; ``end`` is the last row's time plus the gap."""
    found = rows.groupBy("source_id", F.session_window("acq_utc", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("frp").alias("power"))
    return found.select("source_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "power")


def _trigger(writer, checkpoint: str, once: bool) -> StreamingQuery:
    trigger = {"availableNow": True} if once else {"processingTime": f"{K.POLL_SECONDS} seconds"}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def keep_windows(rows: DataFrame, kind, root: str, name: str, checkpoint: str, delay: timedelta, once: bool = False) -> StreamingQuery:
    """Keep the table ``name`` of ``hourly_power`` or ``persistence`` windows up to date."""

    def write(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumn("key", F.concat_ws("|", "source_id", F.unix_micros(F.col("start").cast("timestamp"))))
        store.upsert(keyed, root, name, "key", version=batch_id + 1)

    watermarked = rows.withWatermark("acq_utc", f"{int(delay.total_seconds())} seconds")
    # Batches without files would close windows that the rule of ``write_late`` holds open; updates do not need them.
    spark, name_ = rows.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name_)
    spark.conf.set(name_, "false")
    try:
        return _trigger(kind(watermarked).writeStream.outputMode("update").foreachBatch(write), checkpoint, once)
    finally:
        spark.conf.set(name_, before)


def write_sessions(rows: DataFrame, root: str, checkpoint: str, delay: timedelta, gap: str = GAP, once: bool = False) -> StreamingQuery:
    """Append each session to the table ``sessions`` once the watermark has passed its end."""
    watermarked = rows.withWatermark("acq_utc", f"{int(delay.total_seconds())} seconds")
    writer = activity_sessions(watermarked, gap).writeStream.outputMode("append").format("parquet").option("path", f"{root}/sessions")
    return _trigger(writer, checkpoint, once)


def write_late(rows: DataFrame, root: str, checkpoint: str, delay: timedelta, once: bool = False) -> StreamingQuery:
    """Write rows whose hourly window had closed when they came to ``late``, one folder per batch.

    The engine drops rows by the watermark of the batch before: the greatest time up to
    two batches ago, less the delay.  ``keep_windows`` over the same files has the same
    batches, so this holds just the rows that it leaves out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, version = batch.sparkSession, batch_id + 1
        marks = {k: store.read_table(spark, root, "marks", before=k) for k in (version - 1, version)}
        mark, newest = (t.first()["mark"] if t is not None else None for t in marks.values())
        top = batch.agg(F.max("acq_utc")).first()[0]
        newest = max((t for t in (newest, top) if t is not None), default=None)
        end = F.expr(f"date_trunc('HOUR', acq_utc) + INTERVAL {HOUR}")
        closed = F.lit(False) if mark is None else end <= F.lit(mark.replace(microsecond=mark.microsecond // 1000 * 1000) - delay)
        batch.filter(closed).write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
        store.publish(spark.createDataFrame([(newest,)], "mark timestamp"), root, "marks", version)

    return _trigger(rows.writeStream.foreachBatch(write), checkpoint, once)


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/late")
