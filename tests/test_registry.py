import json
import math

import numpy as np
from pyspark.sql import functions as F

from pyrogrid import constants as K
from pyrogrid.operators import registry
from pyrogrid.sources import registry as sites


def metres(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * K.EARTH_RADIUS_M * math.asin(math.sqrt(x))


def greedy(rows):
    """One sorted pass over all sites, comparing each with every group."""
    ordered = sorted(rows, key=lambda r: (r[1], r[2], K.SOURCE_PRIORITY[r[4]], r[5]))
    groups = []
    for name, lat, lon, sector, source, _ in ordered:
        gaps = [metres(lat, lon, g["lat"], g["lon"]) for g in groups]
        if gaps and min(gaps) <= 500:
            g = groups[gaps.index(min(gaps))]
            n = g["n"]
            g["lat"], g["lon"], g["n"] = (g["lat"] * n + lat) / (n + 1), (g["lon"] * n + lon) / (n + 1), n + 1
            g["sources"].add(source)
            if g["sector"] == "UNKNOWN" and sector not in ("industrial", "UNKNOWN", ""):
                g["sector"] = sector
        else:
            groups.append({"lat": lat, "lon": lon, "n": 1, "name": name, "sources": {source}, "sector": "UNKNOWN" if sector == "industrial" else sector})
    return groups


def test_merge_equals_the_sequential_pass(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        # Chains and dense spots, a third of all sites as copies of one position.
        lat, lon = (22.0, 72.0) if i % 3 == 0 else (22.0 + rng.random() * 0.06, 72.0 + rng.random() * 0.06)
        sector = ["STEEL", "industrial", "UNKNOWN", "POWER"][i % 4]
        rows.append((f"s{i}", float(round(lat, 5)), float(round(lon, 5)), sector, ["GEM", "OSM", "MANUAL"][i % 3], f"{i:05d}"))
    df = spark.createDataFrame(rows, "name string, lat double, lon double, sector string, source string, site_rank string")
    got = registry.build_registry(df).orderBy("facility_id").collect()
    want = greedy(rows)
    assert len(got) == len(want)
    assert [r["facility_id"] for r in got] == [f"FAC-{i + 1:03d}" for i in range(len(want))]
    for r, g in zip(got, want):
        assert r["name"] == g["name"] and r["sector"] == g["sector"] and list(r["sources"]) == sorted(g["sources"])
        assert abs(r["lat"] - g["lat"]) < 2e-6 and abs(r["lon"] - g["lon"]) < 2e-6


def plain_sweep(rows):
    """The sequential pass with only the groups near the current latitude held."""
    reach, held, out = math.degrees(500 / K.EARTH_RADIUS_M) * (1 + 1e-9), [], []
    for name, lat, lon, _, source, _ in sorted(rows, key=lambda r: (r[1], r[2], K.SOURCE_PRIORITY[r[4]], r[5])):
        out += [g for g in held if lat - g[0] > reach]
        held = [g for g in held if lat - g[0] <= reach]
        gaps = [metres(lat, lon, g[0], g[1]) for g in held]
        if gaps and min(gaps) <= 500:
            g = held[gaps.index(min(gaps))]
            g[0], g[1], g[2] = (g[0] * g[2] + lat) / (g[2] + 1), (g[1] * g[2] + lon) / (g[2] + 1), g[2] + 1
            g[4].add(source)
        else:
            held.append([lat, lon, 1, name, {source}])
    return sorted((g[3], round(g[0], 9), round(g[1], 9), tuple(sorted(g[4]))) for g in out + held)


def test_a_chain_of_100000_sites_in_many_bands(spark, monkeypatch):
    monkeypatch.setattr(registry, "BAND_ROWS", 2_000)
    rng = np.random.default_rng(11)
    # One component from end to end: steps north of up to 600 m with some width, 100,000 positions.
    lat = 8.0 + np.cumsum(rng.random(100_000) * 0.0004)
    lon = 77.0 + rng.random(100_000) * 0.02
    rows = [(f"s{i}", float(a), float(b), "STEEL", ["GEM", "OSM", "MANUAL"][i % 3], f"{i:06d}") for i, (a, b) in enumerate(zip(lat, lon))]
    df = spark.createDataFrame(rows, "name string, lat double, lon double, sector string, source string, site_rank string")
    bands = registry.latitude_bands(df)
    assert bands.select("band").distinct().count() >= 50
    got = sorted((r["name"], round(r["lat"], 9), round(r["lon"], 9), tuple(sorted(r["sources"]))) for r in registry.merge_sites(df).collect())
    assert got == plain_sweep(rows)


def test_bands_that_never_forget_agree_in_the_end(spark, monkeypatch):
    """Equal steps keep a wrong start for good, so every band is merged again in turn."""
    monkeypatch.setattr(registry, "BAND_ROWS", 40)
    step = math.degrees(300 / K.EARTH_RADIUS_M)
    rows = [(f"s{i:04d}", 10.0 + i * step, 75.0, "UNKNOWN", "OSM", f"{i:06d}") for i in range(400)] + [("far", 50.0, 179.9999, "STEEL", "GEM", "x"), ("none", None, 1.0, "STEEL", "GEM", "y")]
    df = spark.createDataFrame(rows, "name string, lat double, lon double, sector string, source string, site_rank string")
    got = sorted((r["name"], round(r["lat"], 9), round(r["lon"], 9), tuple(sorted(r["sources"]))) for r in registry.merge_sites(df).collect())
    assert got == plain_sweep(rows[:-1])
    assert registry.merge_sites(df.limit(0)).count() == 0


def test_bands_are_cut_at_gaps(spark, monkeypatch):
    monkeypatch.setattr(registry, "BAND_ROWS", 10)
    lats = [10 + i * 0.001 for i in range(8)] + [10.5 + i * 0.001 for i in range(8)] + [11 + i * 0.001 for i in range(30)]
    found = registry.latitude_bands(spark.createDataFrame([(float(v + 0.0005),) for v in lats], "lat double")).collect()
    first = {}
    for r in sorted(found):
        first.setdefault(r["band"], r["strip"])
    assert [round(v * 0.001, 3) for v in first.values()][:3] == [10.0, 10.5, 11.0] and len(first) == 5
    assert sorted({r["upper"] for r in found})[-1] == math.inf


def test_registry_files_and_seed(spark, tmp_path):
    (tmp_path / "extra.csv").write_text("facility_id,name,lat,lon,sector\nX-1,New Plant,20.0,75.0,STEEL\nX-2,Kandla Port,1.0,1.0,OTHER\n")
    out = {r["name"]: r for r in sites.load_facilities(spark, str(tmp_path)).collect()}
    assert len(out) == 39 and out["Kandla Port"]["lat"] == 23.0 and out["New Plant"]["facility_id"] == "X-1"


def test_tracker_and_map_sources(spark, tmp_path):
    tracker = tmp_path / "steel.csv"
    tracker.write_text("Country/Area,Latitude,Longitude,Name\nIndia,21.1,72.1, A \nINDIA,21.10001,72.10001,A\nChina,1,2,B\nIndia,,72,C\n")
    got = sites.read_tracker(spark, str(tracker), "steel").collect()
    assert [(r["name"], r["sector"], r["source"]) for r in got] == [("A", "STEEL", "GEM")]
    doc = {"elements": [
        {"type": "node", "id": 1, "lat": 21.1, "lon": 72.1, "tags": {"industrial": "oil", "brand": "B"}},
        {"type": "way", "id": 2, "center": {"lat": 22.1, "lon": 73.1}, "tags": {"landuse": "industrial"}},
        {"type": "node", "id": 3, "lat": 22.1, "lon": 10.0, "tags": {}},
        {"type": "way", "id": 4, "tags": {}},
    ]}
    (tmp_path / "map.json").write_text(json.dumps(doc))
    got = {r["name"]: r["sector"] for r in sites.read_map_extract(spark, str(tmp_path / "map.json")).collect()}
    assert got == {"B": "OIL", "OSM-22.1000_73.1000": "INDUSTRIAL"}
    (tmp_path / "empty.json").write_text("{}")
    assert sites.read_map_extract(spark, str(tmp_path / "empty.json")).count() == 0


def test_running_number_is_global(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("v"))
    out = registry.running_number(df, F.floor(F.col("v") / 50), ["v"]).collect()
    assert all(r["number"] == r["v"] + 1 for r in out)
