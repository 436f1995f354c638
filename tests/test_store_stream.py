from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pyrogrid.operators import cluster, features, ingest, landcover, records, scoring
from pyrogrid.sources import detections as src
from pyrogrid.sources import store
from pyrogrid.sources.registry import seed_facilities
from pyrogrid.sources.blocks import BlockTable
from pyrogrid.streaming import events, jobs, windows

HEADER = ["latitude", "longitude", "bright_ti4", "bright_ti5", "scan", "track", "acq_date", "acq_time", "satellite", "frp", "daynight"]


def rows(day, n, shift=0):
    out = []
    for i in range(n):
        lat, lon = 21.0 + ((i + shift) % 17) * 0.009, 72.6 + ((i + shift) % 5) * 0.011
        out.append(f"{lat:.5f},{lon:.5f},{320 + (i * 7) % 40},{288 + (i * 3) % 9},0.4,0.4,2026-09-{day:02d},{(i * 97) % 24 * 100 + i % 60},N20,{(i * 13) % 90 / 10},{'DN'[i % 2]}")
    return out


def land(folder, name, lines):
    (folder / name).write_text("\n".join([",".join(HEADER)] + lines))


def test_batches_give_the_batch_result_and_may_be_repeated(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "store")
    landing.mkdir()
    land(landing, "a.csv", rows(20, 60))
    land(landing, "b.csv", rows(21, 40, 3) + rows(20, 60)[:10])
    land(landing, "c.csv", ["1.0,2.0,300,290,0.4,0.4,2026-09-21,100,N20,1,D"])
    fac = seed_facilities(spark)
    stream = jobs.landing_stream(spark, str(landing), HEADER, files_per_batch=1)
    jobs.start(stream, root, str(tmp_path / "progress"), fac, once=True).awaitTermination()
    assert len(store.versions(spark, root, "detections")) == 2
    clean = ingest.normalise(src.read_detections(spark, str(landing)))
    found = landcover.annotate_landcover(cluster.cluster_sources(clean))
    want = records.build_records(scoring.classify_rules(features.build_features(found, fac)))
    columns = ["id", "n_hits", "cls", "conf", "severity", "temp_K", "dist_facility_m", "night_frac", "reason"]

    def table(df):
        return {tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()}

    expected = table(want)
    assert table(store.read_table(spark, root, "detections")) == expected
    # A repeated batch leaves the same store.
    again = spark.read.schema(", ".join(f"{c} string" for c in HEADER)).option("header", True).csv(str(landing / "b.csv"))
    jobs.process_batch(again, 1, root, fac)
    assert table(store.read_table(spark, root, "detections")) == expected
    runs = {r["status"] for r in store.newest_runs(store.read_table(spark, root, "pipeline_runs")).collect()}
    assert runs == {"SUCCESS", "EMPTY"}
    assert store.newest_log(spark.read.parquet(f"{root}/pipeline_log")).count() > 3
    assert store.register_views(spark, root) == ["v_detections", "v_sources"]
    assert spark.sql("select count(*) from v_detections").first()[0] == len(expected)


def test_repeats_are_found_whatever_their_age(spark, tmp_path):
    root = str(tmp_path / "store")
    texts = ", ".join(f"{c} string" for c in HEADER)

    def batch(name, lines):
        land(tmp_path, name, lines)
        return spark.read.schema(texts).option("header", True).csv(str(tmp_path / name))

    first, later = rows(2, 20), rows(28, 5, 4)
    assert jobs.ingest_batch(batch("a.csv", first), 0, root)[0] == 20
    assert jobs.ingest_batch(batch("b.csv", later), 1, root)[0] == 5
    assert jobs.ingest_batch(batch("c.csv", first[:7] + later + rows(3, 2)), 2, root)[0] == 2
    # Nothing new, and the same batch again.
    assert jobs.ingest_batch(batch("d.csv", first), 3, root) == (0, [])
    assert jobs.ingest_batch(batch("c.csv", first[:7] + later + rows(3, 2)), 2, root)[0] == 2
    assert store.read_table(spark, root, "clean").count() == 27
    assert not store.exists(spark, f"{root}/staging/batch=2")


def test_upsert_and_old_versions(spark, tmp_path):
    root = str(tmp_path)
    for batch in range(5):
        df = spark.createDataFrame([("a", batch), ("a", batch - 1), (f"k{batch}", batch)], "id string, n int")
        store.upsert(df, root, "t", "id", [F.desc("n")])
    out = {r["id"]: r["n"] for r in store.read_table(spark, root, "t").collect()}
    assert out == {"a": 4, **{f"k{b}": b for b in range(5)}}
    store.drop_old_versions(spark, root, "t", keep=2)
    assert [v for v, _ in store.versions(spark, root, "t")] == [4, 5]
    # A version that was never committed is invisible.
    (tmp_path / "t" / "v=000000000009").mkdir()
    assert store.versions(spark, root, "t")[-1][0] == 5


def test_dispatch(spark, tmp_path):
    records_ = spark.createDataFrame([("A",)], "id string")
    asked = spark.createDataFrame([("A", "X", "mock", None), ("A", "X", "sms", "n"), ("B", "X", "mock", None)], "detection_id string, authority string, channel string, note string")
    receipts, rejected = store.dispatch(asked, records_, F.lit("2026-01-01").cast("timestamp"))
    got = {r["channel"]: r["status"] for r in receipts.collect()}
    assert got == {"mock": "sent", "sms": "failed"} and rejected.count() == 1
    store.write_dispatches(receipts, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/dispatches").count() == 2


def test_a_batch_writes_only_the_blocks_it_touches(spark, tmp_path):
    root, fac = str(tmp_path / "store"), seed_facilities(spark)

    def batch(name, places):
        lines = [f"{a},{b},330,290,0.4,0.4,2026-09-{d:02d},{100 + i},N20,9,D" for i, (a, b, d) in enumerate(places)]
        land(tmp_path, name, lines)
        return spark.read.schema(", ".join(f"{c} string" for c in HEADER)).option("header", True).csv(str(tmp_path / name))

    jobs.process_batch(batch("a.csv", [(21.1, 72.7, 1), (23.1, 72.7, 1), (25.1, 76.7, 1), (25.1, 76.9, 1)]), 0, root, fac)
    # All TIR values are equal, so the ambient median stays where it is.
    jobs.process_batch(batch("b.csv", [(25.1, 76.7, 2)]), 1, root, fac)
    for name in ("sources", "detections"):
        table = BlockTable(spark, root, name)
        first, second = (dict(table.manifest(v)) for v in (2, 3))
        assert len(first) == 3 and {b for b in second if first[b] != second[b]} == {"12_38"} and table._written(2) == ["12_38"]
        assert table.read().count() == 4
    assert {r["n_hits"] for r in store.read_table(spark, root, "sources").filter("block_id = '12_38'").collect()} == {1, 2}
    counts = {(r["batch"], r["event"]): r["n"] for r in events.read_events(spark, root).groupBy("batch", "event").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts[0, "detection"] == 4 and counts[1, "detection"] == 1 and counts[1, "ingest"] == counts[1, "pipeline_run_completed"] == 1
    assert {e for _, e in counts} == set(events.KINDS) and events.read_events(spark, root, after=0).select("batch").distinct().count() == 1


def test_block_table_appends_replaces_compacts_and_forgets(spark, tmp_path):
    table = BlockTable(spark, str(tmp_path), "t", "b")

    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "b string, n int")

    def now(before=None):
        found = table.read(before=before)
        return [] if found is None else sorted((r["b"], r["n"]) for r in found.collect())

    assert now() == [] and table.append(rows(("x", 1), ("y", 2)), 2) == ["x", "y"]
    table.append(rows(("x", 3)), 4)
    table.append(rows(("x", 4)), 4)
    assert now() == [("x", 1), ("x", 4), ("y", 2)] and now(before=4) == [("x", 1), ("y", 2)]
    assert table.compact(5, 1) == ["x"] and table.compact(7, 1) == [] and len(table.manifest()) == 2
    assert now() == [("x", 1), ("x", 4), ("y", 2)]
    table.replace(rows(("y", 9)), 6, ["y"])
    assert now() == [("x", 1), ("x", 4), ("y", 9)] and sorted(r["n"] for r in table.read(["x"]).collect()) == [1, 4]
    table.replace(rows(), 8, ["x"])
    assert now() == [("y", 9)]
    table.drop_old(1)
    assert now() == [("y", 9)] and [v for v, _ in table.versions()] == [8] and not (tmp_path / "t" / "data" / "v=2").exists()


def test_clean_rows_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT_EVERY", 2)
    root = str(tmp_path / "store")
    for k in range(4):
        land(tmp_path, f"{k}.csv", rows(k + 1, 6))
        jobs.ingest_batch(spark.read.schema(", ".join(f"{c} string" for c in HEADER)).option("header", True).csv(str(tmp_path / f"{k}.csv")), k, root)
    table = jobs.clean_table(spark, root)
    assert len(table.manifest()) == len({b for b, _ in table.manifest()}) and table.read().count() == 24
    land(tmp_path, "again.csv", rows(2, 6) + rows(9, 1))
    again = spark.read.schema(", ".join(f"{c} string" for c in HEADER)).option("header", True).csv(str(tmp_path / "again.csv"))
    assert jobs.ingest_batch(again, 4, root)[0] == 1


def located(spark, folder):
    schema = "source_id string, acq_utc timestamp, acq_date date, frp double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_windows_and_late_rows_hold_every_row(spark, tmp_path):
    base, files, rows_ = datetime(2026, 9, 1), str(tmp_path / "in"), []
    for k, hours in enumerate([(0, 1, 30, 31), (50, 51, 2), (53, 20, 49, 100)]):
        part = [("S", base + timedelta(hours=h, minutes=7), (base + timedelta(hours=h)).date(), float(h)) for h in hours]
        rows_ += part
        spark.createDataFrame(part, "source_id string, acq_utc timestamp, acq_date date, frp double").coalesce(1).write.mode("append").parquet(files)
    root, delay = str(tmp_path / "store"), timedelta(hours=10)
    windows.keep_windows(located(spark, files), windows.hourly_power, root, "hourly", f"{root}/p1", delay, once=True).awaitTermination()
    windows.write_late(located(spark, files), root, f"{root}/p2", delay, once=True).awaitTermination()
    kept = {(r["start"], r["n"]) for r in store.read_table(spark, root, "hourly").collect()}
    late = {(r["acq_utc"].replace(minute=0), 1) for r in windows.late_rows(spark, root).collect()}
    assert not kept & late and kept | late == {(r[1].replace(minute=0), 1) for r in rows_} and late == {(base + timedelta(hours=20), 1)}
    windows.write_sessions(located(spark, files), root, f"{root}/p3", delay, "5 hours", once=True).awaitTermination()
    found = {(r["start"], r["n"]) for r in spark.read.parquet(f"{root}/sessions").collect()}
    assert (base + timedelta(minutes=7), 3) in found and (base + timedelta(hours=30, minutes=7), 2) in found
    sliding = {r["start"]: (r["n"], r["active_days"]) for r in windows.persistence(spark.read.parquet(files)).collect()}
    assert sliding[base] == (10, 3) and sliding[base - timedelta(days=2)] == (4, 1)


def test_sorted_export_reads_back_in_order(spark, tmp_path):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.lit("v").alias("v"))
    store.write_sorted(df, str(tmp_path / "out"), ["k"])
    assert all(r["position"] == r["k"] + 1 for r in store.file_order(spark, str(tmp_path / "out")).collect())
    assert store.upsert_facilities(spark.createDataFrame([("F1", 1), ("F2", 2)], "facility_id string, n int"), str(tmp_path)) == 1
    assert store.upsert_facilities(spark.createDataFrame([("F2", 5)], "facility_id string, n int"), str(tmp_path)) == 2
    assert {r["facility_id"]: r["n"] for r in store.read_table(spark, str(tmp_path), "facilities").collect()} == {"F1": 1, "F2": 5}
