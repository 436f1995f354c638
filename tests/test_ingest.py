import pytest
from pyspark.sql import functions as F

from pyrogrid.functions import geo
from pyrogrid.operators import ingest
from pyrogrid.sources import detections as src

HEADER = "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti5,frp,daynight"
ROW = "22.80204,70.89408,334.53,0.44,0.46,2026-09-20,858,N20,VIIRS,n,2.0NRT,295.93,1.83,D"


def write(folder, name, *lines, bom=False):
    text = "\n".join(lines)
    (folder / name).write_text(("﻿" if bom else "") + text, encoding="utf-8")


def test_canonical_names():
    assert src.canonical_name(" Bright Ti4 (K) ") == "bright_ti4_k"


def test_directory_scan_with_ragged_headers_bom_and_empty_file(spark, tmp_path):
    write(tmp_path, "a.csv", HEADER, ROW, bom=True)
    write(tmp_path, "b.csv", "latitude,longitude,bright_ti4,bright_ti5,acq_date,acq_time", "22.9,70.9,330,295,2026-09-20,7.0")
    write(tmp_path, "c.csv", "")
    write(tmp_path, "d.csv", HEADER, ROW, ROW)
    rows = src.read_detections(spark, str(tmp_path))
    assert rows.count() == 4
    clean = ingest.normalise(rows).collect()
    assert len(clean) == 2
    by_lat = {r["latitude"]: r for r in clean}
    assert by_lat[22.9]["satellite"] == "UNKNOWN" and by_lat[22.9]["pixel_area_m2"] == 375.0**2
    assert by_lat[22.9]["acq_utc"].strftime("%H:%M") == "00:07"
    report = {r["file"].rsplit("/", 1)[1]: r["status"] for r in src.landed_file_report(spark, str(tmp_path)).collect()}
    assert report == {"a.csv": "accepted", "b.csv": "accepted", "c.csv": "empty", "d.csv": "accepted"}


def test_quarantine_and_column_gate(spark, tmp_path):
    write(tmp_path, "err.csv", "Invalid MAP_KEY.")
    assert src.landed_file_report(spark, str(tmp_path)).first()["status"] == "quarantined"
    write(tmp_path, "half.csv", "latitude,longitude,bright_ti4", "1,2,3")
    with pytest.raises(ValueError, match="bright_ti5"):
        src.read_feed(spark, str(tmp_path / "half.csv"))
    with pytest.raises(ValueError, match="csv"):
        src.read_feed(spark, str(tmp_path / "x.txt"))


def test_cleaning_edge_rows(spark):
    columns = "latitude string, longitude string, bright_ti4 string, bright_ti5 string, acq_date string, acq_time string, daynight string"
    rows = [
        ("22.8", "70.9", "bad", "295", "2026-09-20", "858", "D"),
        (None, "70.9", "330", "295", "2026-09-20", "858", "D"),
        ("22.8", "70.9", "330", "295", "2026-09-20", "2460", "D"),
        ("22.8", "70.9", "330", "295", "2026-09-20", "00858", "D"),
        ("22.8", "70.9", "330", "nan", "2026-09-20", "858", "D"),
        ("22.8", "70.9", "330", "295", "2026-09-20", "7.0", "night"),
        ("22.8", "70.9", "330", "295", "2026-09-20", "2359", "x"),
        ("7.87", "80.77", "330", "295", "2026-09-20", "1200", "D"),
    ]
    out = ingest.clean_detections(spark.createDataFrame(rows, columns)).orderBy("acq_utc").collect()
    assert [r["acq_utc"].strftime("%H:%M") for r in out] == ["00:07", "12:00", "23:59"]
    assert [r["daynight"] for r in out] == ["N", "D", "D"]
    assert ingest.filter_mainland(ingest.clean_detections(spark.createDataFrame(rows, columns))).count() == 2
    with pytest.raises(ValueError, match="acq_time"):
        ingest.clean_detections(spark.createDataFrame(rows, columns).drop("acq_time"))


def test_outline_matches_ray_casting_and_counts_vertices(spark):
    from pyrogrid.constants import OUTLINE

    points = spark.range(40000).select((F.rand(3) * 30 + 7).alias("lat"), (F.rand(4) * 31 + 67).alias("lon")).toPandas()
    inside = [False] * len(points)
    lat, lon = points["lat"].to_numpy(), points["lon"].to_numpy()
    import numpy as np

    inside = np.zeros(len(points), dtype=bool)
    for (y1, x1), (y2, x2) in zip(OUTLINE, OUTLINE[-1:] + OUTLINE[:-1]):
        if y1 != y2:
            inside ^= ((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
    df = spark.createDataFrame(points)
    got = df.select(geo.in_mainland(F.col("lat"), F.col("lon"), boundary=False).alias("in")).toPandas()["in"].to_numpy()
    assert (got == inside).all()
    vertices = spark.createDataFrame([(float(a), float(b)) for a, b in OUTLINE], "lat double, lon double")
    assert vertices.filter(geo.in_mainland(F.col("lat"), F.col("lon"))).count() == len(OUTLINE)


def test_duplicates_keep_first_landing(spark):
    rows = [(1.0, 2.0, "t", "a", i % 7, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "latitude double, longitude double, acq_utc string, satellite string, x int, _row_order int")
    kept = ingest.drop_duplicates(df.repartition(8))
    assert [r["_row_order"] for r in kept.collect()] == [0]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_tiles_and_blocks(spark):
    df = spark.createDataFrame([(28.6139, 77.2090), (29.53, 78.77), (-1.0, -1.0)], "lat double, lon double")
    lat, lon = F.col("lat"), F.col("lon")
    rows = df.select(geo.tile_id(lat, lon).alias("t"), geo.block_id(lat, lon).alias("b"), geo.tile_bounds(geo.tile_id(lat, lon)).alias("x")).collect()
    assert [r["t"] for r in rows] == ["N27E075", "N27E078", "S03W003"]
    assert rows[0]["b"] == "14_38" and rows[2]["b"] == "-1_-1"
    assert tuple(rows[2]["x"]) == (-3.0, -3.0, 0.0, 0.0)


def test_filters_do_not_repeat_the_parsing(spark):
    names = ["latitude", "longitude", "bright_ti4", "bright_ti5", "scan", "track", "frp"]
    raw = spark.range(100, 140).select(
        *[F.concat(F.lit(v), "id").alias(c) for c, v in zip(names, ("22.80", "70.90", "330.", "295.", "0.4", "0.4", "1."))],
        F.lit("2026-09-20").alias("acq_date"), F.when(F.col("id") % 4 == 0, "2460").otherwise("858").alias("acq_time"), F.lit("D").alias("daynight"),
    )
    clean = ingest.normalise(raw)
    conditions = [line for line in clean._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert conditions and not any("RLIKE" in line for line in conditions)
    assert clean.count() == 30 and [c for c in clean.columns if c in raw.columns] == raw.columns
