"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyrogrid.plans import catalog
from pyrogrid.plans import workload
from pyrogrid.session import local_session

# Queries that start from raw rows build everything they need; the others run on
# the stored detections, sources and records, whose build is timed on its own.
HEADLINE = [
    "clean_detections", "mainland_filter", "dedupe_detections", "cluster_sources", "cluster_extent", "regional_ambient",
    "retrieve_temperature", "nearest_facility", "landcover_majority", "build_features", "classify_rules", "severity",
    "narrative_guard", "detections_query", "stats_by_class", "funnel", "temp_histogram", "facility_profiles", "persistent_cells",
    "weak_labels", "negative_controls", "registry_gaps", "spatial_folds", "conformal_quantile", "upsert_latest", "registry_dedupe",
    "pipeline_end_to_end", "nearest_facility_dense", "landed_scan",
]
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("pyrogrid-bench", os.environ.get("BENCH_CPUS", "8"))
    times: dict[str, float] = {}

    def seconds(work) -> float:
        begin = time.perf_counter()
        work().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    seconds(lambda: spark.range(1000).selectExpr("sum(id)"))
    for name, build in (("store_detections", workload.detections), ("store_sources", workload.sources), ("store_records", workload.detection_records)):
        begin = time.perf_counter()
        build(spark, folder)
        times[name] = round(time.perf_counter() - begin, 3)
    for name in HEADLINE:
        times[name] = round(median(seconds(lambda: catalog.QUERIES[name](spark, folder)) for _ in range(RUNS)), 3)
    total = round(sum(times.values()), 3)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": float(scale)}))


if __name__ == "__main__":
    main()
