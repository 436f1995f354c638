import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pyrogrid.functions import geo
from pyrogrid.operators import matches, nearest
from pyrogrid.sources.registry import seed_facilities


def brute(points, fac):
    pp = np.array([geo.project_point(a, b) for a, b in zip(points.lat, points.lon)])
    ff = np.array([geo.project_point(a, b) for a, b in zip(fac.lat, fac.lon)])
    d = np.sqrt(((pp[:, None, :] - ff[None]) ** 2).sum(-1))
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("broadcast", [True, False])
def test_split_index_equals_full_search(spark, monkeypatch, broadcast):
    monkeypatch.setattr(nearest, "MAX_CANDIDATES", 6)
    if not broadcast:
        monkeypatch.setattr(nearest, "BROADCAST_ENTRIES", 0)
    rng = np.random.default_rng(3)
    n = 300
    # A third of the registry stands in one small place, some of it at equal positions.
    lat = np.where(rng.random(n) < 0.35, 22.3 + np.round(rng.random(n) * 0.01, 3), 8 + rng.random(n) * 27)
    lon = np.where(lat < 22.311, 70.0 + np.round(rng.random(n) * 0.01, 3), 68 + rng.random(n) * 28)
    fac = pd.DataFrame({"facility_id": [f"F{i:04d}" for i in range(n)], "name": [f"s{i}" for i in range(n)], "lat": lat, "lon": lon})
    fac["sector"], fac["match_radius_m"] = "STEEL", 1e9
    m = 1500
    points = pd.DataFrame({"id": range(m), "lat": rng.uniform(8, 35, m), "lon": rng.uniform(68, 96, m)})
    points.loc[:400, ["lat", "lon"]] = np.column_stack([22.3 + rng.random(401) * 0.02, 70 + rng.random(401) * 0.02])
    points.loc[401:450, ["lat", "lon"]] = np.column_stack([rng.uniform(-40, 60, 50), rng.uniform(20, 150, 50)])
    sp = spark.createDataFrame(points).union(spark.createDataFrame([(m, None, 70.0)], "id long, lat double, lon double"))
    index = nearest.facility_index(spark.createDataFrame(fac))
    assert len(index.depths) > 1 and index.entries < 60_000
    got = nearest.nearest_facility(sp, spark.createDataFrame(fac), "lat", "lon", index=index).orderBy("id").toPandas()
    assert len(got) == m + 1
    assert pd.isna(got.dist_facility_m.iloc[m]) and got.facility_id.iloc[m] is None
    which, dist = brute(points, fac)
    assert np.allclose(got.dist_facility_m[:m], dist, rtol=1e-9)
    assert (got.facility_id[:m].to_numpy() == fac.facility_id.to_numpy()[which]).all()


def test_scaled_metric_equals_full_search(spark, monkeypatch):
    monkeypatch.setattr(nearest, "MAX_CANDIDATES", 6)
    rng = np.random.default_rng(4)
    sites = pd.DataFrame({"registry_rank": [f"{i:04d}" for i in range(120)], "lat": rng.uniform(8, 35, 120), "lon": rng.uniform(68, 96, 120)})
    points = pd.DataFrame({"id": range(400), "lat": rng.uniform(5, 38, 400), "lon": rng.uniform(60, 99, 400)})
    sp = spark.createDataFrame(points)
    index = nearest.build_index(
        spark.createDataFrame(sites), "lon", "lat", "registry_rank", nearest.over_points(nearest.PLATE, sp, "lon", "lat")
    )
    got = nearest.attach_nearest(sp, index, F.col("lon"), F.col("lat")).orderBy("id").select("nearest.*").toPandas()
    dy = (points.lat.to_numpy()[:, None] - sites.lat.to_numpy()) * 111
    dx = (points.lon.to_numpy()[:, None] - sites.lon.to_numpy()) * 111 * np.cos(np.radians(points.lat.to_numpy()))[:, None]
    d = np.hypot(dx, dy)
    assert np.allclose(got.distance, d.min(1)) and (got.tie == sites.registry_rank.to_numpy()[d.argmin(1)]).all()


def test_radius_rules_and_empty_registry(spark):
    fac = seed_facilities(spark)
    points = spark.createDataFrame([("near", 21.13, 72.6405), ("far", 21.15, 72.6405), ("away", 15.0, 60.0)], "id string, centroid_lat double, centroid_lon double")
    got = {r["id"]: r for r in nearest.nearest_facility(points, fac).collect()}
    assert got["near"]["facility_name"] == "Hazira LNG/Steel" and got["near"]["dist_facility_m"] > 2000
    assert got["far"]["facility_id"] is None and got["far"]["dist_facility_m"] > 3500
    assert got["away"]["facility_id"] is None and got["away"]["dist_facility_m"] > 100_000
    none = nearest.nearest_facility(points, fac.limit(0)).collect()
    assert len(none) == 3 and all(r["dist_facility_m"] is None for r in none)


def test_contained_names_and_matches(spark):
    texts = spark.createDataFrame([("vadinar refinery east",), ("refinery",), ("unknown facility",)], "text string")
    names = spark.createDataFrame([("refinery",), ("vadinar refinery",), ("x",)], "name string")
    got = {tuple(r) for r in matches.contained_names(texts, names).select("text", "name").collect()}
    assert got == {("vadinar refinery east", "refinery"), ("vadinar refinery east", "vadinar refinery"), ("refinery", "refinery")}
    with pytest.raises(LookupError):
        matches.find_facility(seed_facilities(spark), "nowhere")
    assert matches.find_facility(seed_facilities(spark), "kandla port").first()["facility_id"] == "FAC-003"
