"""Events of the incremental job: what each batch did, and what the engine reports about it.

A batch writes four kinds of events: ``pipeline_stage`` per stage, ``detection`` per new
or changed source, ``ingest`` with the rows read, and ``pipeline_run_completed``.  They
lie in one folder per batch, so a repeated batch leaves them once.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

KINDS = ("pipeline_stage", "detection", "ingest", "pipeline_run_completed")
SCHEMA = "ts timestamp, event string, key string, body string"


def write_batch(changes: DataFrame, root: str, batch_id: int, n_raw: int, times: dict[str, float]) -> None:
    """Write the events of one batch; ``changes`` are the records that it made or changed."""
    spark = changes.sparkSession
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    run = f"RUN-{batch_id:08d}"
    own = [(now, "pipeline_stage", stage, json.dumps({"stage": stage, "ms": round(ms, 3), "run_id": run})) for stage, ms in times.items()]
    own.append((now, "ingest", run, json.dumps({"rows": n_raw})))
    own.append((now, "pipeline_run_completed", run, json.dumps({"run_id": run, "total_ms": round(sum(times.values()), 3)})))
    each = changes.select(
        F.lit(now).alias("ts"), F.lit("detection").alias("event"), F.col("id").alias("key"),
        F.to_json(F.struct("id", "cls", "conf", "severity")).alias("body"),
    )
    spark.createDataFrame(own, SCHEMA).unionByName(each).write.mode("overwrite").parquet(f"{root}/events/batch={batch_id}")


def read_events(spark: SparkSession, root: str, after: int = -1) -> DataFrame:
    """(batch, ts, event, key, body) of the batches after one, as a subscriber would follow them."""
    return spark.read.parquet(f"{root}/events").filter(F.col("batch") > after)


class EngineMetrics(StreamingQueryListener):
    """Keeps the engine's own report of each batch: rows, rows a second, milliseconds by step, watermark.

    Holds the newest ``keep`` reports of one query name; ``table`` gives them as rows.
    """

    def __init__(self, name: str, keep: int = 1000) -> None:
        self.name, self.keep, self.reports = name, keep, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.name:
            marks = dict(p.eventTime or {})
            steps = {k: int(v) for k, v in dict(p.durationMs).items()}
            self.reports.append((p.batchId, int(p.numInputRows), float(p.processedRowsPerSecond or 0.0), steps, marks.get("watermark")))
            del self.reports[: -self.keep]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.reports), "batch long, rows long, rows_per_second double, steps map<string,long>, watermark string")
