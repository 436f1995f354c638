"""All registered queries, each with its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrogrid import constants as K
from pyrogrid.functions import geo, physics, text
from pyrogrid.operators import (
    boosting, checks, cluster, features, ingest, labels, landcover, matches, nearest, profiler, queries as reads, records,
    registry, severity as severities, training,
)
from pyrogrid.plans import oracles, workload as W
from pyrogrid.session import scratch_path
from pyrogrid.sources import registry as sites, store
from pyrogrid.sources.detections import list_files, read_detections
from pyrogrid.streaming import events, jobs, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = oracles.sql(sql)
        return function

    return add


def r(name: str, digits: int, alias: str | None = None) -> Column:
    return F.round(F.col(name), digits).alias(alias or name)


# --- scan, cleaning, outline, duplicates -------------------------------------


@query(
    """SELECT event_id, latitude, longitude, bright_ti4, bright_ti5, frp, acq_utc::varchar AS acq_utc, acq_date::varchar AS acq_date,
       satellite, instrument, daynight, round(local_solar_hour, 4) AS local_solar_hour, round(pixel_area_m2, 1) AS pixel_area_m2 FROM clean"""
)
def clean_detections(spark, sf):
    return W.clean(spark, sf).select(
        "event_id", "latitude", "longitude", "bright_ti4", "bright_ti5", "frp", F.col("acq_utc").cast("string").alias("acq_utc"),
        F.col("acq_date").cast("string").alias("acq_date"), "satellite", "instrument", "daynight", r("local_solar_hour", 4),
        r("pixel_area_m2", 1),
    )


@query("SELECT c.event_id, c.latitude, c.longitude FROM clean c JOIN tested t USING (event_id) WHERE t.odd OR t.touch")
def mainland_filter(spark, sf):
    return ingest.filter_mainland(W.clean(spark, sf)).select("event_id", "latitude", "longitude")


@query("SELECT c.event_id FROM clean c JOIN tested t USING (event_id) WHERE t.odd")
def mainland_filter_strict(spark, sf):
    return ingest.filter_mainland(W.clean(spark, sf), boundary=False).select("event_id")


@query("SELECT event_id, satellite, acq_utc::varchar AS acq_utc FROM det")
def dedupe_detections(spark, sf):
    """The feed landed twice in overlapping files; the first landing is kept."""
    feed = W.raw_feed(spark, sf)
    order = W.ROW_ORDER
    first = feed.withColumn(order, F.struct(F.lit(0).alias("file"), F.col(order).alias("line")))
    again = feed.withColumn(order, F.struct(F.lit(1).alias("file"), F.col(order).alias("line")))
    united = first.unionByName(again.withColumn("event_id", F.col("event_id") + 1_000_000_000_000))
    return ingest.normalise(united).select("event_id", "satellite", F.col("acq_utc").cast("string").alias("acq_utc"))


# --- grid sources -------------------------------------------------------------


@query(
    """SELECT source_id, n_hits, n_days, n_nights, round(night_frac, 4) AS night_frac, first_seen::varchar AS first_seen,
       last_seen::varchar AS last_seen, span_days, round(frp_mean, 9) AS frp_mean, frp_max, round(frp_median, 4) AS frp_median,
       round(frp_cv, 4) AS frp_cv, round(ti4_median, 4) AS ti4_median, ti4_max, round(ti4_std, 4) AS ti4_std,
       round(ti5_median, 4) AS ti5_median, round(dT_median, 4) AS d_t_median, round(local_solar_hour, 4) AS local_solar_hour,
       round(pixel_area_m2, 1) AS pixel_area_m2, round(centroid_lat, 6) AS centroid_lat, round(centroid_lon, 6) AS centroid_lon,
       fill_ratio, round(flare_score, 4) AS flare_score FROM sources"""
)
def cluster_sources(spark, sf):
    return cluster.cluster_sources(W.detections(spark, sf)).select(
        "source_id", "n_hits", "n_days", "n_nights", r("night_frac", 4), F.col("first_seen").cast("string").alias("first_seen"),
        F.col("last_seen").cast("string").alias("last_seen"), "span_days", r("frp_mean", 9), "frp_max", r("frp_median", 4),
        r("frp_cv", 4), r("ti4_median", 4), "ti4_max", r("ti4_std", 4), r("ti5_median", 4), r("dT_median", 4, "d_t_median"),
        r("local_solar_hour", 4), r("pixel_area_m2", 1), r("centroid_lat", 6), r("centroid_lon", 6), "fill_ratio",
        r("flare_score", 4),
    )


@query("SELECT s.source_id, h.hour, round(h.share, 6) AS share FROM hist h JOIN sources s USING (lat_cell, lon_cell)")
def diurnal_hist(spark, sf):
    return W.sources(spark, sf).select("source_id", F.posexplode("diurnal_hist").alias("hour", "share")).select(
        "source_id", "hour", r("share", 6)
    )


@query("SELECT source_id, diurnal_shape FROM sources")
def diurnal_shape(spark, sf):
    return W.sources(spark, sf).select("source_id", "diurnal_shape")


@query("SELECT lat_cell, lon_cell, recurrence_gap_days FROM gaps")
def recurrence_gap(spark, sf):
    cells = cluster.with_cells(W.detections(spark, sf))
    days = cells.groupBy(*cluster.CELL).agg(F.array_sort(F.collect_set("acq_date")).alias("days"))
    return days.select(*cluster.CELL, cluster.recurrence_gap(F.col("days")).alias("recurrence_gap_days"))


@query("SELECT lat_cell, lon_cell, round(cluster_extent_m, 3) AS cluster_extent_m FROM extent")
def cluster_extent(spark, sf):
    return cluster.cluster_extent(cluster.with_cells(W.detections(spark, sf))).select(*cluster.CELL, r("cluster_extent_m", 3))


@query("SELECT round(ambient_K, 4) AS ambient_k FROM ambient")
def regional_ambient(spark, sf):
    return cluster.regional_ambient(W.detections(spark, sf)).select(r("ambient_K", 4, "ambient_k"))


@query("SELECT source_id, round(t_bg_K, 4) AS t_bg_k, t_bg_method FROM sources")
def background_temp(spark, sf):
    return W.sources(spark, sf).select("source_id", r("t_bg_K", 4, "t_bg_k"), "t_bg_method")


# --- geodesy and physics --------------------------------------------------------

_x, _y = oracles._project("latitude", "longitude")


@query(
    f"""SELECT event_id, round({_x}, 2) AS x, round({_y}, 2) AS y,
        round({oracles._haversine('latitude', 'longitude', '21.1055::double', '72.6405::double')}, 2) AS metres,
        printf('N%02dE%03d', floor(latitude / 3)::int * 3, floor(longitude / 3)::int * 3) AS tile_id,
        floor(latitude / 2)::int || '_' || floor(longitude / 2)::int AS block_id FROM clean"""
)
def geo_functions(spark, sf):
    lat, lon = F.col("latitude"), F.col("longitude")
    x, y = geo.project(lat, lon)
    metres = geo.haversine_m(lat, lon, F.lit(21.1055), F.lit(72.6405))
    return W.clean(spark, sf).select(
        "event_id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"), F.round(metres, 2).alias("metres"),
        geo.tile_id(lat, lon).alias("tile_id"), geo.block_id(lat, lon).alias("block_id"),
    )


@query(
    f"""SELECT event_id, round({oracles._planck(K.LAM_MIR, 'bright_ti4')}, 8) AS mir, round({oracles._planck(K.LAM_TIR, 'bright_ti5')}, 6) AS tir,
        round(bright_ti4, 6) AS back_k, round(frp * 3.6 * 0.55, 4) AS flare_co2e, round(frp * 3.6 * 0.85, 4) AS fire_bc FROM clean"""
)
def radiance_and_emissions(spark, sf):
    mir = physics.planck_radiance(K.LAM_MIR, F.col("bright_ti4"))
    co2e, _ = physics.emission_rates(F.lit("FLARE"), F.col("frp"))
    _, carbon = physics.emission_rates(F.lit("IND_FIRE"), F.col("frp"))
    return W.clean(spark, sf).select(
        "event_id", F.round(mir, 8).alias("mir"), F.round(physics.planck_radiance(K.LAM_TIR, F.col("bright_ti5")), 6).alias("tir"),
        F.round(physics.brightness_temp(K.LAM_MIR, mir), 6).alias("back_k"), F.round(co2e, 4).alias("flare_co2e"),
        F.round(carbon, 4).alias("fire_bc"),
    )


@query(
    """SELECT source_id, round(t_fire_K, 3) AS t_fire_k, round(frac, 7) AS frac, round(frp_derived_MW, 4) AS frp_derived_mw, flag FROM retrieval"""
)
def retrieve_temperature(spark, sf):
    out = features.with_retrieval(W.sources(spark, sf))
    converged = F.col("retrieval.converged")
    return out.select(
        "source_id", F.round("retrieval.t_fire_K", 3).alias("t_fire_k"),
        F.when(converged, F.round("retrieval.frac", 7)).alias("frac"),
        F.round("retrieval.frp_derived_MW", 4).alias("frp_derived_mw"), F.array_join("retrieval.flags", "").alias("flag"),
    )


# --- facilities and land cover -----------------------------------------------------


@query("SELECT source_id, round(dist_facility_m, 2) AS dist_facility_m, facility_id, facility_name, facility_sector, state FROM near")
def nearest_facility(spark, sf):
    return nearest.nearest_facility(W.sources(spark, sf), W.facilities(spark, sf), index=W.site_index(spark, sf)).select(
        "source_id", r("dist_facility_m", 2), "facility_id", "facility_name", "facility_sector", "state"
    )


@query(
    f"""SELECT s.source_id, round(min(sqrt(pow(f.x - {oracles._cx}, 2) + pow(f.y - {oracles._cy}, 2))), 2) AS dist_m,
        arg_min(f.facility_id, (sqrt(pow(f.x - {oracles._cx}, 2) + pow(f.y - {oracles._cy}, 2)), f.facility_id)) AS facility_id
        FROM sources s CROSS JOIN dense f GROUP BY s.source_id"""
)
def nearest_facility_dense(spark, sf):
    """Nearest of all ``orders`` as sites: many split cells, in one index."""
    found = nearest.nearest_facility(W.sources(spark, sf), W.dense_registry(spark, sf))
    return found.select("source_id", r("dist_facility_m", 2, "dist_m"), "facility_id")


@query("SELECT facility_id, id FROM records WHERE facility_id IS NOT NULL")
def facility_matches(spark, sf):
    return matches.facility_matches(W.detection_records(spark, sf), W.facilities(spark, sf), index=W.site_index(spark, sf))


_pairs = f"""
  SELECT f.facility_id, r.id, r.cls, r.temp_K, CASE WHEN r.frp_MW > 0 THEN r.frp_MW ELSE r.frp_max_MW END AS power
  FROM records r CROSS JOIN fac f
  WHERE r.facility_id = f.facility_id OR contains(lower(coalesce(r.facility_name, 'Unknown Facility')), lower(f.name))
    OR ({oracles._haversine('r.lat', 'r.lon', 'f.lat', 'f.lon')} <= coalesce(f.match_radius_m, 2000) AND r.cls <> 'UNRESOLVED')"""


@query(
    f"""SELECT f.facility_id, f.name, count(p.id) AS n_matches, count(*) FILTER (WHERE p.cls = 'FLARE') AS n_flares,
        count(*) FILTER (WHERE p.cls = 'LEAK') AS n_leaks, round(coalesce(max(p.power), 0), 3) AS max_power_mw,
        round(coalesce(max(p.temp_K), 0), 2) AS max_temp_k FROM fac f LEFT JOIN ({_pairs}) p ON p.facility_id = f.facility_id GROUP BY ALL"""
)
def facility_profiles(spark, sf):
    return matches.facility_profiles(W.detection_records(spark, sf), W.facilities(spark, sf)).select(
        "facility_id", "name", "n_matches", "n_flares", "n_leaks", r("max_power_MW", 3, "max_power_mw"),
        r("max_temp_K", 2, "max_temp_k"),
    )


@query(
    """SELECT f.facility_id, count(r.id) AS n_detections FROM fac f LEFT JOIN records r
       ON contains(lower(coalesce(r.facility_name, 'Unknown Facility')), lower(f.name))
       OR contains(lower(f.name), lower(coalesce(r.facility_name, 'Unknown Facility'))) GROUP BY ALL"""
)
def facility_directory(spark, sf):
    return matches.facility_directory(W.detection_records(spark, sf), W.facilities(spark, sf))


@query("SELECT sector, count(*) AS n FROM fac GROUP BY ALL")
def facilities_by_sector(spark, sf):
    return registry.sector_distribution(reads.facilities_by_sector(W.facilities(spark, sf)))


@query("SELECT source_id, landcover_class, landcover_status FROM cover")
def landcover_majority(spark, sf):
    return W.annotated_sources(spark, sf).select("source_id", "landcover_class", "landcover_status")


@query(
    """SELECT p.source_id, coalesce({c}, 'unknown') AS landcover_class FROM placed p
       LEFT JOIN pixels px ON px.tile_id = p.tile_id AND px.row = p.r0 AND px.col = p.c0""".replace(
        "{c}", oracles._case(K.LANDCOVER_CODES, "px.code")
    )
)
def landcover_at(spark, sf):
    points = W.sources(spark, sf)
    found = landcover.landcover_at(
        points, W.pixels(spark, sf), lat="centroid_lat", lon="centroid_lon", tile_pixels=W.TILE_PIXELS
    )
    return points.join(found, ["centroid_lat", "centroid_lon"]).select("source_id", "landcover_class")


@query("SELECT source_id, landcover_class FROM cover")
def landcover_attach(spark, sf):
    found = W.annotated_sources(spark, sf).select("source_id", "centroid_lat", "centroid_lon", "landcover_class")
    return landcover.attach_landcover(W.sources(spark, sf), found).select("source_id", "landcover_class")


@query(
    """SELECT c.event_id, c.tile_id, t.tile_id IS NOT NULL AS has_tile FROM (SELECT event_id,
       printf('N%02dE%03d', floor(latitude / 3)::int * 3, floor(longitude / 3)::int * 3) AS tile_id FROM clean) c
       LEFT JOIN (SELECT DISTINCT tile_id FROM pixels) t USING (tile_id)"""
)
def tile_lookup(spark, sf):
    return landcover.locate_tiles(W.clean(spark, sf), W.pixels(spark, sf)).select("event_id", "tile_id", "has_tile")


_sea = (
    "(lat < 8.4 AND (lon < 77.6 OR lon > 78.0)) OR lat < 8.35 OR (lat < 10 AND lon < 75.6) OR (lat >= 10 AND lat < 15 AND lon < 73.6)"
    " OR (lat >= 15 AND lat < 19 AND lon < 72.6) OR (lat >= 19 AND lat < 21 AND lon < 72.3) OR (lat >= 21 AND lat < 24 AND lon < 68.6)"
    " OR (lat < 12 AND lon > 80.2) OR (lat >= 12 AND lat < 16 AND lon > 80.6) OR (lat >= 16 AND lat < 20 AND lon > 82.8)"
    " OR (lat >= 20 AND lat < 22.5 AND lon > 87.2) OR (lat BETWEEN 19.55 AND 19.95 AND lon BETWEEN 85.15 AND 85.65)"
    " OR (lat BETWEEN 22.5 AND 22.9 AND lon BETWEEN 69.3 AND 70.1)"
)


@query(
    f"""SELECT event_id, CASE WHEN {_sea} OR NOT (odd OR touch) THEN 'water'
        WHEN (lat BETWEEN 8.5 AND 16 AND lon BETWEEN 74.8 AND 77) OR (lat BETWEEN 18.5 AND 23.5 AND lon BETWEEN 80.5 AND 84.5)
          OR (lat BETWEEN 23.5 AND 28.5 AND lon BETWEEN 91.5 AND 96.5) OR (lat BETWEEN 29.8 AND 33.5 AND lon BETWEEN 76.5 AND 80.5) THEN 'forest'
        WHEN lat BETWEEN 24.5 AND 29.5 AND lon BETWEEN 69.5 AND 73.5 THEN 'shrub' ELSE 'cropland' END AS cover
        FROM (SELECT c.event_id, c.latitude AS lat, c.longitude AS lon, t.odd, t.touch FROM clean c JOIN tested t USING (event_id))"""
)
def coarse_landcover(spark, sf):
    return W.clean(spark, sf).select("event_id", geo.coarse_landcover(F.col("latitude"), F.col("longitude")).alias("cover"))


# --- features, rules, records ---------------------------------------------------------

_hot = ", ".join(
    [f"(coalesce(facility_sector, 'UNKNOWN') = '{x}')::double AS sector_{x}" for x in K.SECTORS]
    + [f"(landcover_class = '{x}')::double AS landcover_{x}" for x in K.LANDCOVERS]
    + [f"(diurnal_shape = '{x}')::double AS diurnal_{x}" for x in K.DIURNAL_SHAPES]
)


@query(
    f"""SELECT source_id, block_id, round(t_fire_K, 2) AS t_fire_k, round(frac, 6) AS frac, round(frp_derived_MW, 3) AS frp_derived_mw,
        round(dT_median, 4) AS d_t, round(ti4_median / ti5_median, 6) AS ti4_ti5_ratio, round(ln(1 + frp_max), 6) AS log1p_frp_max,
        round(sin(2 * pi() * local_solar_hour / 24), 6) AS local_hour_sin, round(cos(2 * pi() * local_solar_hour / 24), 6) AS local_hour_cos,
        (night_frac >= 0.5)::double AS is_night, n_days, n_nights, round(night_frac, 4) AS night_frac, span_days,
        round(n_hits::double / n_days, 4) AS hits_per_day, recurrence_gap_days, round(frp_cv, 4) AS frp_cv, round(ti4_std, 4) AS ti4_std,
        round(cluster_extent_m, 2) AS cluster_extent_m, fill_ratio, round(ln(1 + dist_facility_m), 5) AS log1p_dist_nearest_facility_m,
        1000000.0::double AS dist_nearest_settlement_m, diurnal_shape, {_hot} FROM feat"""
)
def build_features(spark, sf):
    exact = ["source_id", "block_id", "is_night", "n_days", "n_nights", "span_days", "recurrence_gap_days", "fill_ratio",
             "dist_nearest_settlement_m", "diurnal_shape"]
    hot = [c for c in K.FEATURES if c.startswith(("sector_", "landcover_", "diurnal_")) and c != "diurnal_shape"]
    return W.feature_rows(spark, sf).select(
        *exact, r("t_fire_K", 2, "t_fire_k"), r("frac", 6), r("frp_derived_MW", 3, "frp_derived_mw"), r("dT", 4, "d_t"),
        r("ti4_ti5_ratio", 6), r("log1p_frp_max", 6), r("local_hour_sin", 6), r("local_hour_cos", 6), r("night_frac", 4),
        r("hits_per_day", 4), r("frp_cv", 4), r("ti4_std", 4), r("cluster_extent_m", 2), r("log1p_dist_nearest_facility_m", 5), *hot,
    )


@query("SELECT source_id, rule_cls AS cls, rule_conf AS conf, round(lo, 4) AS lo, round(hi, 4) AS hi, off AS offshore_suppressed FROM scored")
def classify_rules(spark, sf):
    return W.scored(spark, sf).select("source_id", "cls", "conf", r("lo", 4), r("hi", 4), "offshore_suppressed")


@query(
    """SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, cls, conf, round(lo, 4) AS lo, round(hi, 4) AS hi, round(temp_K, 2) AS temp_k,
       round(bg_K, 4) AS bg_k, round(frp_MW, 3) AS frp_mw, frp_max_MW AS frp_max_mw, ts::varchar AS ts, n_hits, n_days, facility_name,
       facility_sector, state, severity, offshore_suppressed, diurnal_shape, landcover_class, landcover_status FROM records"""
)
def detection_records(spark, sf):
    return W.detection_records(spark, sf).select(
        "id", r("lat", 6), r("lon", 6), "cls", "conf", r("lo", 4), r("hi", 4), r("temp_K", 2, "temp_k"), r("bg_K", 4, "bg_k"),
        r("frp_MW", 3, "frp_mw"), F.col("frp_max_MW").alias("frp_max_mw"), F.col("ts").cast("string").alias("ts"), "n_hits", "n_days",
        "facility_name", "facility_sector", "state", "severity", "offshore_suppressed", "diurnal_shape", "landcover_class",
        "landcover_status",
    )


@query(
    """SELECT id, u.c AS cls, round(CASE WHEN u.c = r.cls THEN r.conf ELSE (1 - r.conf) / 5 END, 3) AS p
       FROM records r CROSS JOIN (SELECT unnest(['FLARE', 'IND_FIRE', 'COAL', 'WILD', 'LEAK', 'UNRESOLVED']) AS c) u"""
)
def class_probabilities(spark, sf):
    return W.detection_records(spark, sf).select("id", F.explode("probs").alias("cls", "p")).select("id", "cls", r("p", 3))


_level = "['LOW', 'MODERATE', 'HIGH', 'CRITICAL']"


@query(
    f"""SELECT event_id, severity, CASE WHEN off THEN '{severities.SUPPRESSED_TEXT}' ELSE 'Base hazard for ' || cls || ': ' || {_level}[base + 1]
          || CASE WHEN step = 2 THEN '; High thermal intensity (FRP ' || printf('%.1f', frp) || ' MW >= ' || hi || ' MW: +2)'
                  WHEN step = 1 THEN '; Elevated thermal intensity (FRP ' || printf('%.1f', frp) || ' MW >= ' || lo || ' MW: +1)' ELSE '' END
          || CASE WHEN z >= 5 THEN '; Severe baseline departure (z=' || printf('%.1f', z) || ' >= 5.0: +2)'
                  WHEN z >= 3 THEN '; Significant baseline departure (z=' || printf('%.1f', z) || ' >= 3.0: +1)' ELSE '' END
          || CASE WHEN people > 10000 THEN '; High population exposure (' || format('{{:,}}', people) || ' persons in impact radius: +1)' ELSE '' END
        END AS rationale
        FROM (SELECT *, CASE WHEN off THEN 'LOW' ELSE {_level}[1 + least(3, base + step + CASE WHEN z >= 5 THEN 2 WHEN z >= 3 THEN 1 ELSE 0 END
               + CASE WHEN people > 10000 THEN 1 ELSE 0 END)] END AS severity
             FROM (SELECT event_id, frp, z, people, off, cls, hi, lo, {oracles._case(K.BASE_SEVERITY, 'cls', '1')} AS base,
                     CASE WHEN frp >= hi THEN 2 WHEN frp >= lo THEN 1 ELSE 0 END AS step
                   FROM (SELECT event_id, frp, (event_id % 13) / 2.0::double AS z, (event_id * 7) % 20000 AS people, event_id % 11 = 0 AS off,
                           ['FLARE', 'IND_FIRE', 'COAL', 'WILD', 'LEAK', 'UNRESOLVED'][event_id % 6 + 1] AS cls,
                           CASE WHEN event_id % 6 = 0 THEN 150 ELSE 50 END AS hi, CASE WHEN event_id % 6 = 0 THEN 80 ELSE 20 END AS lo FROM clean)))"""
)
def severity(spark, sf):
    e = F.col("event_id")
    cls = F.element_at(F.array(*[F.lit(c) for c in K.CLASSES]), (e % 6 + 1).cast("int"))
    level, why = severities.severity(cls, F.col("frp"), e % 11 == 0, (e % 13) / 2, (e * 7) % 20000)
    return W.clean(spark, sf).select("event_id", level.alias("severity"), why.alias("rationale"))


@query(
    """SELECT id, round(co2e_rate_tph, 3) AS co2e_rate_tph, round(black_carbon_rate_kgph, 3) AS black_carbon_rate_kgph,
       round(co2e_total_t, 0) AS co2e_total_t FROM records"""
)
def emissions(spark, sf):
    return W.detection_records(spark, sf).select(
        "id", r("co2e_rate_tph", 3), r("black_carbon_rate_kgph", 3), r("co2e_total_t", 0)
    )


def _phrase_sql() -> dict[str, str]:
    return {
        "temperature": "CASE WHEN temp_K > 0 THEN 'retrieved temperature of ' || printf('%.0f', round(temp_K, 1)) || ' K' END",
        "distance": "CASE WHEN dist_facility_m IS NOT NULL THEN 'facility proximity of ' || printf('%.0f', round(dist_facility_m, 1)) || ' m to '"
        " || coalesce(facility_name, facility_sector, 'industrial site') END",
        "days": "CASE WHEN n_days > 1 THEN 'persistent recurrence over ' || n_days || ' days' END",
        "night": "CASE WHEN round(night_frac, 4) >= 0.5 THEN 'high nocturnal fraction of ' || printf('%.2f', round(night_frac, 4)) END",
        "power": "CASE WHEN frp_max_MW > 0 THEN 'peak radiative power of ' || printf('%.1f', frp_max_MW) || ' MW' END",
        "co2e": "CASE WHEN co2e_rate_tph > 0 THEN 'estimated emission rate of ' || printf('%.2f', co2e_rate_tph) || ' t/h CO2e' END",
        "diurnal": "diurnal_shape || ' diurnal cycle'",
        "landcover": "landcover_class || ' landcover classification'",
    }


def _narrative_sql() -> str:
    phrases = _phrase_sql()

    def pool(names):
        return "list_filter([" + ", ".join(phrases[n] for n in names) + "], lambda x: x IS NOT NULL)"

    pools = "CASE cls " + " ".join(f"WHEN '{c}' THEN {pool(n)}" for c, n in K.EVIDENCE_ORDER.items()) + f" ELSE {pool(K.DEFAULT_EVIDENCE_ORDER)} END"

    def rule(i):
        body = " ".join(f"WHEN cls = '{c}' THEN '{v[i]}'" for c, v in K.STATUTORY_RULES.items())
        return (
            f"CASE WHEN offshore_suppressed THEN '{K.SUPPRESSED_RULE[i]}' WHEN cls = 'WILD' AND landcover_class = 'forest' THEN '{K.FOREST_RULE[i]}' "
            f"{body} ELSE '{K.GENERAL_RULE[i]}' END"
        )

    band = "printf('%.2f', conf)"
    limits = "'[' || printf('%.2f', lo) || '-' || printf('%.2f', hi) || ']'"
    return f"""
      SELECT id, {rule(0)} AS cited_rule,
        CASE WHEN offshore_suppressed THEN cls || ' alert suppressed with ' || {band} || ' confidence ' || {limits}
               || ' driven by marine water landcover and zero inland facility proximity'
             WHEN cls = 'LEAK' THEN 'candidate fugitive thermal anomaly - low confidence (' || {band} || ') ' || {limits}
               || ' driven by ' || coalesce(e[1], 'satellite radiative retrieval') || ' and ' || coalesce(e[2], 'satellite radiative retrieval')
             ELSE cls || ' alert confirmed with ' || {band} || ' confidence ' || {limits} || ' driven by '
               || coalesce(e[1], 'satellite radiative retrieval') || ' and ' || coalesce(e[2], 'satellite radiative retrieval') END
          || '; implicates ' || {rule(1)} || '; ' || {rule(2)} || '.' AS reason
      FROM (SELECT *, {pools} AS e FROM records)"""


@query(_narrative_sql())
def narrative(spark, sf):
    return W.detection_records(spark, sf).select("id", "cited_rule", "reason")


@query("SELECT id, TRUE AS grounded FROM records")
def narrative_is_grounded(spark, sf):
    """Every generated sentence passes the number check against its own evidence."""
    df = W.detection_records(spark, sf)
    names = ["cls", "conf", "lo", "hi", "facility_name", "facility_sector", "dist_facility_m", "n_days", "night_frac", "co2e_rate_tph"]
    facts = {n: F.col(n) for n in names} | {"t_fire_K": F.col("temp_K"), "frp_max": F.col("frp_max_MW")}
    # Names and sites may hold digits of their own; they are quoted, not claimed.
    plain = F.replace("reason", F.coalesce("facility_name", F.lit("\u0000")), F.lit("site"))
    plain = F.regexp_replace(plain, "CO2e|FLAT_24H", "")
    allowed = text.allowed_numbers(text.evidence(facts))
    return df.select("id", text.is_grounded(plain, allowed).alias("grounded"))


def _guard_sql() -> str:
    facts = {
        "conf": "(doc_id % 100) / 100.0::double", "lo": "0.1::double", "hi": "0.9::double", "dist_facility_m": "n_chars::double",
        "t_fire_K": "300.0::double + doc_id % 700", "frp_max": "(doc_id % 50) / 2.0::double", "n_days": "(doc_id % 10)::double",
        "night_frac": "0.5::double", "co2e_rate_tph": "n_chars / 10.0::double",
    }
    forms = ["0.0::double", "1.0::double"]
    for name, v in facts.items():
        forms += [f"round_even({v}, {d})" for d in (4, 3, 2, 1, 0)]
        forms += [f"CASE WHEN {v} BETWEEN 0 AND 1 THEN round_even(({v}) * 100, {d}) END" for d in (2, 1, 0)]
        if name == "dist_facility_m":
            forms += [f"CASE WHEN {v} > 0 THEN round_even(({v}) / 1000, {d}) END" for d in (3, 2, 1, 0)]
        if name == "t_fire_K":
            forms += [f"round_even(({v}) - 273.15, {d})" for d in (1, 0)]
    allowed = "list_filter(list_distinct([" + ", ".join(forms) + "]), lambda x: x IS NOT NULL)"
    plain = r"regexp_replace(text, '[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}\p{M}]', 'a', 'g')"
    return rf"""
      SELECT doc_id, len(tokens) AS n_numbers, length(text) > 0 AND len(list_filter(tokens, lambda t: len(list_filter(allowed, lambda a:
               abs(t::double - a) < 0.001 OR (a <> 0 AND abs(t::double - a) / abs(a) < 0.001))) = 0)) = 0 AS grounded
      FROM (SELECT doc_id, text, regexp_extract_all({plain}, '\b\d+(?:\.\d+)?\b') AS tokens, {allowed} AS allowed FROM documents)"""


@query(_guard_sql())
def narrative_guard(spark, sf):
    """Number check of whole documents against evidence drawn from their own row."""
    docs = W.table(spark, sf, "documents")
    d, n = F.col("doc_id"), F.col("n_chars")
    facts = {
        "conf": (d % 100) / 100, "lo": F.lit(0.1), "hi": F.lit(0.9), "dist_facility_m": n.cast("double"),
        "t_fire_K": F.lit(300.0) + d % 700, "frp_max": (d % 50) / 2, "n_days": d % 10, "night_frac": F.lit(0.5),
        "co2e_rate_tph": n / 10,
    }
    allowed = text.allowed_numbers(text.evidence(facts))
    return docs.select(
        "doc_id", F.size(text.number_tokens(F.col("text"))).cast("long").alias("n_numbers"),
        text.is_grounded(F.col("text"), allowed).alias("grounded"),
    )


_trail = [
    "n_hits || ' detections'", "'centroid inside mainland'", "n_days || ' days / ' || n_hits || ' hits'",
    "coalesce('T=' || printf('%.0f', temp_K) || ' K', 'retrieval unresolved')",
    "coalesce(facility_name, 'no facility within 10 km')", "rule_cls || ' conf=' || printf('%.2f', rule_conf)",
]


@query(
    " UNION ALL ".join(
        f"SELECT id, {i} AS stage, '{label}' AS label, {v} AS detail, CASE WHEN {i} IN (4, 5) AND contains({v}, 'no ') THEN 'warn' ELSE 'ok' END AS status FROM records"
        for i, (label, v) in enumerate(zip(K.STAGES, _trail), 1)
    )
)
def evidence_trail(spark, sf):
    return W.detection_records(spark, sf).select("id", F.inline("evidence")).select("id", "stage", "label", "detail", "status")


# --- reads and roll-ups -------------------------------------------------------------------


@query(
    """SELECT id, cls, conf FROM records WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 48 HOUR AND cls IN ('FLARE', 'WILD', 'UNRESOLVED')
       AND conf >= 0.3 AND lon BETWEEN 70 AND 86 AND lat BETWEEN 8 AND 30 ORDER BY ts DESC, id LIMIT 500"""
)
def detections_query(spark, sf):
    return reads.detections(
        W.detection_records(spark, sf), bbox="70,8,86,30", hours=48, cls=["FLARE", "WILD", "UNRESOLVED"], min_conf=0.3,
        now="2024-01-31 00:00:00",
    ).select("id", "cls", "conf")


@query("SELECT id, cls FROM records WHERE id = (SELECT min(id) FROM records)")
def detection_by_id(spark, sf):
    df = W.detection_records(spark, sf)
    wanted = df.agg(F.min("id").alias("id")).select("id").scalar()
    return reads.detection_by_id(df, wanted).select("id", "cls")


@query(
    "SELECT id, cls, facility_name FROM records WHERE cls <> 'UNRESOLVED' AND facility_name IS NOT NULL ORDER BY ts DESC, id LIMIT 200"
)
def attributed_feed(spark, sf):
    return reads.attributed_feed(W.detection_records(spark, sf)).select("id", "cls", "facility_name")


@query(
    """SELECT 'class' AS kind, c.c AS name, count(r.id) AS n FROM (SELECT unnest(['FLARE', 'IND_FIRE', 'COAL', 'WILD', 'LEAK', 'UNRESOLVED']) AS c) c
       LEFT JOIN records r ON r.cls = c.c GROUP BY ALL
       UNION ALL SELECT 'severity', c.c, count(r.id) FROM (SELECT unnest(['LOW', 'MODERATE', 'HIGH', 'CRITICAL']) AS c) c
       LEFT JOIN records r ON r.severity = c.c GROUP BY ALL"""
)
def stats_by_class(spark, sf):
    return reads.stats_counts(W.detection_records(spark, sf))


@query("SELECT date_diff('second', max(ts), TIMESTAMP '2024-02-01 00:00:00') AS ingest_age_s FROM records")
def freshness(spark, sf):
    return reads.freshness(W.detection_records(spark, sf), now="2024-02-01 00:00:00")


@query(
    """SELECT count(*) AS total_detections, count(DISTINCT facility_name) AS facilities_matched, count(facility_name) AS detections_matched,
       count(*) FILTER (WHERE cls = 'UNRESOLVED') AS unresolved_count, count(*) FILTER (WHERE cls = 'FLARE') AS flares_count,
       count(*) FILTER (WHERE cls = 'LEAK') AS leaks_count, count(temp_K) AS retrieved_count,
       round(count(temp_K) * 100.0 / count(*), 1)::double AS retrieved_pct FROM records"""
)
def funnel(spark, sf):
    return reads.funnel(W.detection_records(spark, sf))


@query(
    """SELECT count(*) AS n_sources, round(sum(co2e_rate_tph), 1) AS co2e_rate_tph, round(sum(co2e_total_t), -1) AS co2e_total_t
       FROM records WHERE NOT offshore_suppressed AND co2e_rate_tph IS NOT NULL"""
)
def emission_totals(spark, sf):
    return reads.emission_totals(W.detection_records(spark, sf)).select("n_sources", r("co2e_rate_tph", 1), r("co2e_total_t", -1))


@query(
    """SELECT c.c AS cls, count(r.id) AS n, round(count(r.id) * 100.0 / (SELECT count(*) FROM records), 1)::double AS pct
       FROM (SELECT unnest(['FLARE', 'IND_FIRE', 'COAL', 'WILD', 'LEAK', 'UNRESOLVED']) AS c) c LEFT JOIN records r ON r.cls = c.c GROUP BY ALL"""
)
def class_distribution(spark, sf):
    return reads.class_distribution(W.detection_records(spark, sf))


@query(
    """SELECT b.b AS bin, count(r.id) AS n FROM (SELECT unnest(range(10)) AS b) b LEFT JOIN records r ON r.temp_K BETWEEN 300 AND 1200
       AND least(floor((r.temp_K - 350) / 37.0::double), 9) = b.b GROUP BY ALL"""
)
def temp_histogram(spark, sf):
    return reads.temperature_histogram(W.detection_records(spark, sf)).select("bin", "n")


@query("SELECT round(min(dist_facility_m), 2) AS min_m, round(max(dist_facility_m), 2) AS max_m FROM records WHERE facility_name IS NOT NULL")
def distance_range(spark, sf):
    return reads.distance_range(W.detection_records(spark, sf)).select(r("min_m", 2), r("max_m", 2))


@query(
    f"""SELECT r.source_id, round(CASE WHEN std > 0 THEN (power - mean) / std END, 4) AS deviation_z FROM (
        SELECT source_id, acq_date, power, avg(power) OVER w AS mean, stddev_pop(power) OVER w AS std,
          row_number() OVER (PARTITION BY source_id ORDER BY acq_date DESC) AS rn
        FROM (SELECT s.source_id, d.acq_date, avg(d.frp) AS power FROM det d JOIN sources s USING (lat_cell, lon_cell) GROUP BY ALL)
        WINDOW w AS (PARTITION BY source_id ORDER BY acq_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) r WHERE rn = 1"""
)
def deviation_from_history(spark, sf):
    cells = cluster.with_cells(W.detections(spark, sf))
    daily = records.daily_power(cells, cluster.CELL).withColumn("source_id", geo.source_id(F.col("lat_cell"), F.col("lon_cell")))
    return records.deviation_from_history(daily).select("source_id", r("deviation_z", 4))


# --- profiler ---------------------------------------------------------------------------------


@query("SELECT acq_date, count(*) AS n FROM raw GROUP BY ALL")
def profile_dates(spark, sf):
    return profiler.rows_per_date(W.raw_feed(spark, sf))


@query(
    """SELECT count(*) AS n_rows, min(acq_date)::varchar AS first_date, max(acq_date)::varchar AS last_date, count(DISTINCT acq_date) AS n_dates,
       count(*) FILTER (WHERE odd) AS n_inside, count(*) FILTER (WHERE NOT odd) AS n_outside FROM clean JOIN tested USING (event_id)"""
)
def profile_counts(spark, sf):
    return profiler.outline_counts(W.clean(spark, sf)).withColumns(
        {"first_date": F.col("first_date").cast("string"), "last_date": F.col("last_date").cast("string")}
    )


@query(
    """SELECT round(c.la, 2) AS latitude, round(c.lo, 2) AS longitude, hits, days, night_hits, round(max_frp, 2) AS max_frp,
         round(days * 2.0 + night_hits * 1.5 + CASE WHEN hits > 1 THEN 10 / (1 + std) ELSE 0 END + least(max_frp / 10, 5), 3) AS score,
         round((SELECT min(sqrt(pow((c.la - f.lat) * 111, 2) + pow((c.lo - f.lon) * 111 * cos(radians(c.la)), 2))) FROM fac f), 3) AS facility_km
       FROM (SELECT round_even(latitude / 0.02::double, 0) * 0.02::double AS la, round_even(longitude / 0.02::double, 0) * 0.02::double AS lo,
               count(*) AS hits, count(DISTINCT acq_date) AS days, count(*) FILTER (WHERE daynight = 'N') AS night_hits, max(frp) AS max_frp,
               stddev_pop(bright_ti4) AS std FROM mainland GROUP BY ALL HAVING count(DISTINCT acq_date) >= 2) c"""
)
def persistent_cells(spark, sf):
    inside = ingest.filter_mainland(W.clean(spark, sf))
    ranked = nearest.with_rank(W.facilities(spark, sf))
    cells = profiler.locate_cells(profiler.persistent_cells(inside), ranked)
    return cells.select(
        F.round("_lat", 2).alias("latitude"), F.round("_lon", 2).alias("longitude"), "hits", "days", "night_hits",
        F.round("_max", 2).alias("max_frp"), F.round("_score", 3).alias("score"), F.round("nearest.distance", 3).alias("facility_km"),
    )


def _exact(x: str, digits: int) -> str:
    """Rounded on the exact value of the double."""
    return f"printf('%.{digits}f', ({x})::double)::double"


@query(
    """, cells_p AS (SELECT round_even(latitude / 0.02::double, 0) * 0.02::double AS la, round_even(longitude / 0.02::double, 0) * 0.02::double AS lo,
           count(*) AS hits, count(DISTINCT acq_date) AS days, count(*) FILTER (WHERE daynight = 'N') AS night_hits,
           quantile_cont(bright_ti4, 0.5) AS m4, quantile_cont(bright_ti5, 0.5) AS m5, max(frp) AS top, avg(frp) AS mean, stddev_pop(bright_ti4) AS std
         FROM clean JOIN tested USING (event_id) WHERE odd GROUP BY ALL HAVING count(DISTINCT acq_date) >= 2),
       located AS (SELECT c.*, f.name, sqrt(pow((c.la - f.lat) * 111, 2) + pow((c.lo - f.lon) * 111 * cos(radians(c.la)), 2)) AS km
         FROM cells_p c CROSS JOIN fac f QUALIFY row_number() OVER (PARTITION BY la, lo ORDER BY km, facility_id) = 1)
       SELECT {x4} AS latitude, {y4} AS longitude, hits, days, night_hits, {m4} AS median_ti4, {m5} AS median_ti5, {top} AS max_frp,
         {mean} AS mean_frp, {std} AS stdev_ti4, name AS nearest_facility, {km} AS facility_km, {score} AS flare_score
       FROM located ORDER BY flare_score DESC, latitude, longitude LIMIT 15""".format(
        x4=_exact("la", 4), y4=_exact("lo", 4), m4=_exact("m4", 2), m5=_exact("m5", 2), top=_exact("top", 2), mean=_exact("mean", 2),
        std=_exact("CASE WHEN hits > 1 THEN std ELSE 0 END", 2), km=_exact("km", 1),
        score=_exact("days * 2.0 + night_hits * 1.5 + CASE WHEN hits > 1 THEN 10 / (1 + std) ELSE 0 END + least(top / 10, 5)", 2),
    )
)
def profile_persistent(spark, sf):
    return profiler.top_persistent(
        profiler.profile_persistent(ingest.filter_mainland(W.clean(spark, sf), boundary=False), W.facilities(spark, sf))
    )


@query("SELECT facility_id, name FROM fac WHERE sector = 'STEEL'")
def facilities_of_sector(spark, sf):
    return reads.facilities_by_sector(W.facilities(spark, sf), "STEEL").select("facility_id", "name")


@query("SELECT source_id, row_number() OVER (ORDER BY lat_cell, lon_cell) AS position FROM sources")
def sorted_export(spark, sf):
    """Sources exported in cell order, with each row's place in the files."""
    cells = cluster.with_cells(W.detections(spark, sf)).select(*cluster.CELL).distinct()
    placed = cells.withColumn("source_id", geo.source_id(*[F.col(c) for c in cluster.CELL]))
    path = scratch_path(spark, "export")
    store.write_sorted(W.sources(spark, sf).join(placed, "source_id"), path, cluster.CELL)
    return store.file_order(spark, path).select("source_id", "position")


# --- registry ----------------------------------------------------------------------------------


def _site_tables(spark, sf) -> list[DataFrame]:
    """Tracker, map and manual sites from ``customer`` and ``supplier``."""
    c, k = F.col("c_custkey"), F.col("s_suppkey")
    lat, lon = W.site_position(c, c % 9, c % 10)
    customer = W.table(spark, sf, "customer")
    trackers = customer.filter(c % 2 == 0).select(
        F.lit("India").alias("Country"), ((lat + c % 4) / 1000).alias("Latitude"), (lon / 1000).alias("Longitude"),
        F.col("c_name").alias("Name"),
        F.struct(F.lit("trackers").alias("file"), F.lit(0).alias("block"), c.alias("line")).alias(W.ROW_ORDER),
    )
    elements = customer.filter(c % 2 == 1).select(
        F.lit("node").alias("type"), c.alias("id"), ((lat + c % 4 + 1) / 1000).alias("lat"), ((lon + 1) / 1000).alias("lon"),
        F.lit(None).cast("struct<lat:double,lon:double>").alias("center"),
        F.create_map(F.lit("name"), F.col("c_name"), F.lit("industrial"), F.col("c_mktsegment")).alias("tags"),
        F.format_string("1/%012d", c).alias("site_rank"),
    )
    manual = W.facilities(spark, sf).select(
        "name", "lat", "lon", "sector", F.lit("MANUAL").alias("source"), F.concat(F.lit("2/"), "facility_id").alias("site_rank")
    )
    return [sites.tracker_sites(trackers, "steel"), sites.map_sites(elements), manual]


# The merge as a recursion over the positions in (lat, lon) order that carries the groups still within reach.
MERGE_SQL = """, places AS (
    SELECT c_custkey AS k, c_name AS name, upper(c_mktsegment) AS segment, c_custkey % 2 AS odd,
      9500 + (c_custkey % 25) * 900 + (c_custkey % 10) * 4 + c_custkey % 4 + c_custkey % 2 AS la,
      74000 + ((c_custkey // 25) % 10) * 2000 + (c_custkey % 9) * 4 + c_custkey % 2 AS lo FROM customer),
  sites_m AS (
    SELECT name, la / 1000.0::double AS lat, lo / 1000.0::double AS lon, 'STEEL' AS sector, 'GEM' AS source,
      '0/' || printf('%020d', k) AS rnk FROM places WHERE odd = 0
    UNION ALL
    SELECT name, la / 1000.0::double, lo / 1000.0::double, segment, 'OSM', '1/' || printf('%020d', k) FROM places WHERE odd = 1
      QUALIFY row_number() OVER (PARTITION BY la, lo ORDER BY k) = 1
    UNION ALL
    SELECT name, lat, lon, sector, 'MANUAL', '2/' || facility_id FROM fac),
  positions AS (
    SELECT lat, lon, count(*) AS n, arg_min(name, rnk) AS name, arg_min(CASE WHEN sector = 'industrial' THEN 'UNKNOWN' ELSE sector END, rnk) AS sector,
      arg_min(sector, rnk) FILTER (WHERE sector NOT IN ('industrial', 'UNKNOWN', '')) AS known, list(DISTINCT source) AS sources,
      row_number() OVER (ORDER BY lat, lon) AS rk FROM sites_m GROUP BY lat, lon),
  sweep AS (
    SELECT 0::bigint AS rk, []::STRUCT(lat DOUBLE, lon DOUBLE, n BIGINT, name VARCHAR, sector VARCHAR, sources VARCHAR[], rk BIGINT)[] AS held,
      []::STRUCT(lat DOUBLE, lon DOUBLE, n BIGINT, name VARCHAR, sector VARCHAR, sources VARCHAR[], rk BIGINT)[] AS closed
    UNION ALL
    SELECT rk, CASE WHEN list_min(apart) <= 500 THEN list_transform(near, lambda g, i: CASE WHEN i = list_position(apart, list_min(apart)) THEN
          struct_pack(lat := (g.lat * g.n + lat * n) / (g.n + n), lon := (g.lon * g.n + lon * n) / (g.n + n), n := g.n + n, name := g.name,
            sector := CASE WHEN g.sector = 'UNKNOWN' THEN coalesce(known, 'UNKNOWN') ELSE g.sector END, sources := list_concat(g.sources, sources), rk := g.rk)
          ELSE g END)
        ELSE list_append(near, struct_pack(lat := lat, lon := lon, n := n, name := name,
          sector := CASE WHEN sector = 'UNKNOWN' THEN coalesce(known, 'UNKNOWN') ELSE sector END, sources := sources, rk := rk)) END, gone
    FROM (SELECT *, list_transform(near, lambda g: {metres}) AS apart
      FROM (SELECT s.*, list_filter(p.held, lambda g: s.lat - g.lat <= {reach}) AS near, list_filter(p.held, lambda g: s.lat - g.lat > {reach}) AS gone
        FROM sweep p JOIN positions s ON s.rk = p.rk + 1))),
  merged AS (
    SELECT unnest(closed) AS g FROM sweep
    UNION ALL SELECT unnest(held) FROM sweep WHERE rk = (SELECT max(rk) FROM sweep)),
  registered AS (
    SELECT printf('FAC-%03d', row_number() OVER (ORDER BY g.rk)) AS facility_id, g.name AS name, round_even(g.lat, 6) AS lat, round_even(g.lon, 6) AS lon,
      coalesce(g.sector, 'UNKNOWN') AS sector, list_sort(list_distinct(g.sources)) AS sources FROM merged)
""".format(
    metres=oracles._haversine("lat", "lon", "g.lat", "g.lon"),
    # Latitude steps of 500 m and a little more: what lies farther back can never be met again.
    reach="degrees(500 / 6371000.0::double) * 1.000000001::double",
)


@query(MERGE_SQL + "SELECT facility_id, name, lat, lon, sector, array_to_string(sources, ',') AS sources FROM registered")
def registry_dedupe(spark, sf):
    built = registry.build_registry(*_site_tables(spark, sf))
    return built.select("facility_id", "name", "lat", "lon", "sector", F.array_join("sources", ",").alias("sources"))


@query(
    MERGE_SQL
    + """SELECT 'sector' AS kind, sector AS name, count(*) AS n FROM registered GROUP BY ALL
       UNION ALL SELECT 'source', s, count(*) FROM (SELECT unnest(sources) AS s FROM registered) GROUP BY ALL"""
)
def registry_distributions(spark, sf):
    built = registry.build_registry(*_site_tables(spark, sf))
    by_sector = registry.sector_distribution(built).select(F.lit("sector").alias("kind"), F.col("sector").alias("name"), "n")
    return by_sector.unionByName(
        registry.source_distribution(built).select(F.lit("source").alias("kind"), F.col("source").alias("name"), "n")
    )


@query(
    """SELECT c_name AS name, (9500 + (c_custkey % 25) * 900 + (c_custkey % 10) * 4 + c_custkey % 4) / 1000.0::double AS lat, 'STEEL' AS sector
       FROM customer WHERE c_custkey % 2 = 0"""
)
def tracker_sites(spark, sf):
    return _site_tables(spark, sf)[0].select("name", "lat", "sector")


@query(
    """SELECT name, lat, sector FROM (SELECT *, row_number() OVER (PARTITION BY la, lo ORDER BY c_custkey) AS rn FROM (
         SELECT c_custkey, c_name AS name, upper(c_mktsegment) AS sector,
           (9500 + (c_custkey % 25) * 900 + (c_custkey % 10) * 4 + c_custkey % 4 + 1) / 1000.0::double AS lat,
           9500 + (c_custkey % 25) * 900 + (c_custkey % 10) * 4 + c_custkey % 4 + 1 AS la,
           74000 + ((c_custkey // 25) % 10) * 2000 + (c_custkey % 9) * 4 + 1 AS lo FROM customer WHERE c_custkey % 2 = 1)) WHERE rn = 1"""
)
def map_sites(spark, sf):
    return _site_tables(spark, sf)[1].select("name", "lat", "sector")


# --- labels and training ---------------------------------------------------------------------------


@query("SELECT source_id, label, label_confidence FROM labels_w")
def weak_labels(spark, sf):
    found = labels.label_sources(W.annotated_sources(spark, sf), W.facilities(spark, sf), index=W.site_index(spark, sf))
    return found.select("source_id", "label", "label_confidence")


def _labelled(spark, sf) -> DataFrame:
    return W.labelled(spark, sf)


@query("SELECT source_id, 5 AS n_controls, 5 AS n_in_annulus FROM labels_w WHERE label = 'FLARE'")
def negative_controls(spark, sf):
    """Controls per flare source, and how many lie 8 to 25 km from its facility."""
    labelled, fac = _labelled(spark, sf), W.facilities(spark, sf)
    controls = labels.sample_negative_controls(labelled, fac)
    anchors = labelled.filter("label = 'FLARE'").select(F.col("source_id").alias("of"), "facility_lat", "facility_lon")
    pairs = controls.withColumn("of", F.regexp_extract("source_id", "^CTRL-(.*)-[0-9]+$", 1)).join(anchors, "of")
    apart = geo.haversine_m(F.col("centroid_lat"), F.col("centroid_lon"), F.col("facility_lat"), F.col("facility_lon"))
    return pairs.groupBy(F.col("of").alias("source_id")).agg(
        F.count(F.lit(1)).alias("n_controls"), F.count_if(apart.between(7999.0, 25001.0)).alias("n_in_annulus")
    )


@query(
    """SELECT source_id, label, CASE WHEN facility_id IS NULL THEN 'none' ELSE 'far' END AS gap FROM labels_w
       WHERE facility_id IS NULL OR dist_facility_m > 50000"""
)
def registry_gaps(spark, sf):
    gaps = labels.registry_gaps(_labelled(spark, sf), W.facilities(spark, sf))
    return gaps.select("source_id", "label", F.when(F.col("dist_to_nearest_m") == float("inf"), "none").otherwise("far").alias("gap"))


@query(
    """SELECT coalesce(label, 'TOTAL') AS label, count(*) AS n_rows, 0 AS n_controls,
       round(count(*) FILTER (WHERE label = 'UNLABELLED') * 100.0 / count(*), 1)::double AS pct_unlabelled FROM labels_w GROUP BY ROLLUP (label)"""
)
def label_report(spark, sf):
    return labels.label_report(_labelled(spark, sf))


@query("SELECT label, round(quantile_cont(dist_facility_m, 0.5), 2) AS median_m FROM labels_w GROUP BY ALL")
def label_distances(spark, sf):
    return labels.label_distances(_labelled(spark, sf), W.facilities(spark, sf)).select("label", r("median_m", 2))


@query("SELECT source_id, label AS cls, block_id FROM labels_w WHERE label <> 'UNLABELLED'")
def training_table(spark, sf):
    return training.materialise(_labelled(spark, sf), W.facilities(spark, sf)).select("source_id", "cls", "block_id")


@query(
    """, blocks AS (SELECT block_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, block_id) AS rk FROM labels_w
         WHERE label <> 'UNLABELLED' GROUP BY block_id),
       packed AS (SELECT 0::bigint AS rk, list_transform(range(least(5, (SELECT count(*) FROM blocks))), lambda x: 0::bigint) AS loads, -1::bigint AS fold, '' AS block_id, 0::bigint AS n
         UNION ALL SELECT b.rk, list_transform(p.loads, lambda v, i: CASE WHEN i = list_position(p.loads, list_min(p.loads)) THEN v + b.n ELSE v END),
           list_position(p.loads, list_min(p.loads)) - 1, b.block_id, b.n FROM packed p JOIN blocks b ON b.rk = p.rk + 1)
       SELECT block_id, n, fold FROM packed WHERE rk > 0"""
)
def spatial_folds(spark, sf):
    return training.spatial_folds(training.labelled_blocks(_labelled(spark, sf)))


def _predictions(spark, sf) -> DataFrame:
    """Rule classes against weak labels, as model predictions would be judged."""
    scored = W.scored(spark, sf)
    labelled = labels.label_sources(scored.drop("label"), W.facilities(spark, sf)).filter(F.col("label") != K.UNLABELLED)
    return labelled.select(
        "source_id", F.col("label"), F.col("cls").alias("predicted"), "conf", F.element_at("probs", F.col("label")).alias("p_true")
    ).withColumnRenamed("label", "cls")


@query("SELECT round(quantile_cont(1 - p_true, 0.9), 4) AS q FROM predicted")
def conformal_quantile(spark, sf):
    return training.conformal_quantile(_predictions(spark, sf)).select(r("q", 4))


@query(
    """SELECT round(avg((conf BETWEEN greatest(0, conf - 0.2) AND least(1, conf + 0.2))::int), 4) AS band_coverage,
       round(avg((1 - p_true <= 0.2)::int), 4) AS true_coverage FROM predicted"""
)
def coverage(spark, sf):
    return training.coverage(_predictions(spark, sf), 0.2).select(r("band_coverage", 4), r("true_coverage", 4))


@query(
    """SELECT c.cls, coalesce(a.n, 0) AS n_actual, coalesce(p.n, 0) AS n_predicted, coalesce(h.n, 0) AS n_hit,
         round(coalesce(h.n, 0) * 2.0::double / (coalesce(a.n, 0) + coalesce(p.n, 0)), 6) AS f1
       FROM (SELECT cls FROM predicted UNION SELECT predicted FROM predicted) c
       LEFT JOIN (SELECT cls, count(*) AS n FROM predicted GROUP BY ALL) a USING (cls)
       LEFT JOIN (SELECT predicted AS cls, count(*) AS n FROM predicted GROUP BY ALL) p USING (cls)
       LEFT JOIN (SELECT cls, count(*) AS n FROM predicted WHERE cls = predicted GROUP BY ALL) h USING (cls)"""
)
def classification_metrics(spark, sf):
    return training.classification_metrics(_predictions(spark, sf)).select("cls", "n_actual", "n_predicted", "n_hit", r("f1", 6))


@query("SELECT round(avg((cls = predicted)::int), 6) AS accuracy, round(avg(-ln(p_true)), 5) AS log_loss FROM predicted")
def overall_metrics(spark, sf):
    return training.overall_metrics(_predictions(spark, sf)).select(r("accuracy", 6), r("log_loss", 5))


@query("SELECT count(*) AS n_samples, count(DISTINCT block_id) AS n_blocks, count(*) AS n_real, 0 AS n_synthetic FROM labels_w")
def block_summary(spark, sf):
    df = _labelled(spark, sf)
    return training.block_summary(df.withColumn("block_id", geo.block_id(F.col("centroid_lat"), F.col("centroid_lon"))))


@query(
    """SELECT source_id, label, FALSE AS is_control FROM labels_w
       UNION ALL SELECT printf('CTRL-%s-%04d', source_id, k), 'UNLABELLED', TRUE FROM labels_w, range(5) t(k) WHERE label = 'FLARE'"""
)
def labelled_set(spark, sf):
    """The labelled table as it is stored: sources and negative controls."""
    root = scratch_path(spark, "labelled")
    table = labels.save_labelled(W.annotated_sources(spark, sf), W.facilities(spark, sf), root, index=W.site_index(spark, sf))
    return table.select("source_id", "label", labels.is_control(table).alias("is_control"))


@query(
    """, whole_l AS (SELECT source_id, label, FALSE AS control FROM labels_w
         UNION ALL SELECT source_id || k, 'UNLABELLED', TRUE FROM labels_w, range(5) t(k) WHERE label = 'FLARE')
       SELECT coalesce(label, 'TOTAL') AS label, count(*) AS n_rows, count(*) FILTER (control) AS n_controls,
         round(count(*) FILTER (WHERE label = 'UNLABELLED') * 100.0 / count(*), 1)::double AS pct_unlabelled FROM whole_l GROUP BY ROLLUP (label)"""
)
def labelled_set_report(spark, sf):
    """Rows, controls and share without label of the labelled table with its negative controls."""
    labelled, fac = _labelled(spark, sf), W.facilities(spark, sf)
    controls = labels.sample_negative_controls(labelled, fac, index=W.site_index(spark, sf))
    return labels.label_report(labelled.unionByName(controls, allowMissingColumns=True))


@query(
    """SELECT count(*) AS n_samples, count(DISTINCT block_id) AS n_blocks, count(*) FILTER (origin = 'real') AS n_real, count(*) FILTER (origin = 'synthetic') AS n_synthetic
       FROM (SELECT l.block_id, 'real' AS origin FROM labels_w l JOIN sources s USING (source_id) WHERE s.n_hits % 3 <> 0
             UNION ALL SELECT l.block_id, 'synthetic' FROM labels_w l JOIN sources s USING (source_id) WHERE s.n_hits > 5)"""
)
def synthetic_replaced(spark, sf):
    """A labelled table whose synthetic rows are replaced by new ones, and what it then holds."""
    rows = _labelled(spark, sf).withColumn("block_id", geo.block_id(F.col("centroid_lat"), F.col("centroid_lon")))
    table = rows.withColumn("origin", F.when(F.col("n_hits") % 3 == 0, "synthetic").otherwise("real"))
    fresh = rows.filter("n_hits > 5").withColumns({"origin": F.lit("synthetic"), "source_id": F.concat(F.lit("SYN-"), "source_id")})
    return training.block_summary(training.replace_synthetic(table, fresh))


# Features of the small boosting queries: whole numbers and hundredths, so that sums agree in any engine.
PLAIN_FEATURES = ["n_hits", "n_days", "n_nights", "span_days", "frp_max", "ti4_max"]


def _plain_rows(spark, sf) -> DataFrame:
    rows = W.labelled(spark, sf).filter(F.col("label") != K.UNLABELLED)
    return rows.select("source_id", *[F.col(c).cast("double").alias(f"x_{c}") for c in PLAIN_FEATURES], F.col("label").alias("cls"), F.lit(1.0).alias("weight"))


# The first cut of each class, by trying every cut of every feature on the slopes of equal chances.
FIRST_CUTS = """, rows_b AS (
    SELECT l.source_id, l.label AS cls, s.n_hits, s.n_days, s.n_nights, s.span_days, s.frp_max, s.ti4_max FROM labels_w l JOIN sources s USING (source_id)
    WHERE l.label <> 'UNLABELLED'),
  long_b AS (
    SELECT source_id, cls, f.i AS f, f.name, CASE f.name {cases} END::double AS x FROM rows_b, (VALUES {names}) f(i, name)),
  ranked_b AS (SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) AS r, count(*) OVER (PARTITION BY f) AS n, max(x) OVER (PARTITION BY f) AS top FROM long_b),
  cuts_b AS (SELECT DISTINCT f, x AS cut FROM ranked_b, range(1, 32) p(i) WHERE r = ceil(p.i * n / 32.0::double) AND x < top),
  classes_b AS (SELECT cls AS c, (SELECT count(DISTINCT cls) FROM rows_b) AS k FROM rows_b GROUP BY cls),
  sums_b AS (
    SELECT c, f, cut, sum(g) FILTER (x <= cut) AS gl, sum(h) FILTER (x <= cut) AS hl, sum(g) AS g, sum(h) AS h FROM (
      SELECT c, l.f, cut, x, 1.0::double / k - (cls = c)::int AS g, 2 * (1.0::double / k) * (1 - 1.0::double / k) AS h
      FROM long_b l JOIN cuts_b q ON q.f = l.f, classes_b) GROUP BY c, f, cut),
  gains_b AS (
    SELECT *, round(gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1), 9) AS gain FROM sums_b WHERE hl >= 1 AND h - hl >= 1),
  first_b AS (SELECT * FROM gains_b WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY c ORDER BY gain DESC, f, cut) = 1)
""".format(
    cases=" ".join(f"WHEN '{c}' THEN {c}" for c in PLAIN_FEATURES), names=", ".join(f"({i}, '{c}')" for i, c in enumerate(PLAIN_FEATURES))
)


@query(
    FIRST_CUTS
    + """SELECT c AS cls, ['n_hits', 'n_days', 'n_nights', 'span_days', 'frp_max', 'ti4_max'][f + 1] AS feature, round(cut, 4) AS cut,
           round(-0.3::double * g / (h + 1), 9) AS root_value, round(-0.3::double * gl / (hl + 1), 9) AS left_value,
           round(-0.3::double * (g - gl) / (h - hl + 1), 9) AS right_value FROM first_b"""
)
def boosted_first_cuts(spark, sf):
    """The first tree of each class: its cut, and the values of its root and leaves."""
    model = boosting.boost(_plain_rows(spark, sf), PLAIN_FEATURES, rounds=1, depth=1, rate=0.3)
    nodes = spark.createDataFrame(list(model.nodes()), "round int, cls string, node int, feature string, cut double, value double")

    def value(node: int) -> Column:
        return F.round(F.max(F.when(F.col("node") == node, F.col("value"))), 9)

    found = nodes.groupBy("cls").agg(
        F.max("feature").alias("feature"), F.round(F.max("cut"), 4).alias("cut"), value(1).alias("root_value"), value(2).alias("left_value"), value(3).alias("right_value")
    )
    return found.filter("feature is not null")


@query(
    FIRST_CUTS
    + """SELECT s.source_id, q.c AS cls, round(-0.3::double * CASE WHEN s.x <= q.cut THEN q.gl / (q.hl + 1) ELSE (q.g - q.gl) / (q.h - q.hl + 1) END, 9) AS raw,
           q.name AS feature FROM (SELECT a.*, b.name FROM first_b a JOIN (SELECT DISTINCT f, name FROM long_b) b USING (f)) q
         JOIN (SELECT source_id, f.i AS f, CASE f.name {cases} END::double AS x FROM sources, (VALUES {names}) f(i, name)) s ON s.f = q.f""".format(
        cases=" ".join(f"WHEN '{c}' THEN {c}" for c in PLAIN_FEATURES), names=", ".join(f"({i}, '{c}')" for i, c in enumerate(PLAIN_FEATURES))
    )
)
def boosted_contributions(spark, sf):
    """Score of every source and class after one round, as base plus what its one cut adds, and the feature that adds it."""
    model = boosting.boost(_plain_rows(spark, sf), PLAIN_FEATURES, rounds=1, depth=1, rate=0.3)
    rows = W.sources(spark, sf).select("source_id", *[F.col(c).cast("double").alias(f"x_{c}") for c in PLAIN_FEATURES])
    each = training.contributions_of(model, rows).groupBy("source_id", "cls").agg(
        (F.first("base") + F.sum("contribution")).alias("raw"), F.max(F.when(F.col("contribution") != 0, F.col("feature"))).alias("feature")
    )
    return each.filter("feature is not null").select("source_id", "cls", r("raw", 9), "feature")


@query("SELECT s.id AS source_id, l.label AS cls, 0.0::double AS gap FROM records s, (SELECT DISTINCT label FROM labels_w WHERE label <> 'UNLABELLED') l")
def boosted_attribution(spark, sf):
    """Trees over all features: raw score less base and contributions, for every source and class."""
    table = training.training_rows(training.materialise(_labelled(spark, sf), W.facilities(spark, sf)))
    model = training.fit_trees(training.numeric_features(table), "boosted", 6, 4, 0.3)
    found = training.attribution(model, W.feature_rows(spark, sf)).groupBy("source_id", "cls").agg(
        (F.first("raw") - F.first("base") - F.sum("contribution")).alias("gap")
    )
    return found.select("source_id", "cls", (F.round("gap", 6) + 0.0).alias("gap"))


@query()
def forest_scores(spark, sf):
    """Forest trained on the weak labels, scoring every source."""
    return _forest(spark, sf).select("source_id", "cls", "conf", "lo", "hi", "offshore_suppressed")


def _forest(spark, sf, **size) -> DataFrame:
    table = training.materialise(_labelled(spark, sf), W.facilities(spark, sf))
    size = size or {"trees": 20, "depth": 5, "folds": 3}
    return training.train(table, kind="forest", **size).score(W.feature_rows(spark, sf))


@query(
    """SELECT id AS source_id, offshore_suppressed, CASE WHEN offshore_suppressed THEN 'UNRESOLVED' ELSE 'learned' END AS class_from,
         TRUE AS sums_to_one, TRUE AS conf_of_class, TRUE AS interval_clipped, CASE WHEN offshore_suppressed THEN 0.1::double ELSE 1.0::double END AS conf_bound,
         TRUE AS conf_in_bound, 3 AS n_top, TRUE AS top_in_order FROM records"""
)
def forest_facts(spark, sf):
    """What holds for every source scored by a forest, and which sources it suppresses."""
    learned = _labelled(spark, sf).filter(F.col("label") != K.UNLABELLED).agg(F.collect_set("label")).scalar()
    found = _forest(spark, sf)
    off, conf = F.col("offshore_suppressed"), F.col("conf")
    sizes = F.transform("top_features", lambda t: F.abs(t["contribution"]))
    bound = F.when(off, 0.1).otherwise(1.0)
    clipped = (F.col("lo") >= 0) & (F.col("hi") <= 1) & conf.between(F.col("lo"), F.col("hi"))
    return found.select(
        "source_id", off,
        F.when(off, F.col("cls")).when(F.array_contains(learned, F.col("cls")), "learned").alias("class_from"),
        (F.abs(F.aggregate(F.map_values("probs"), F.lit(0.0), lambda a, b: a + b) - 1) < 1e-9).alias("sums_to_one"),
        (F.abs(F.element_at("probs", F.col("cls")) - conf) < 1e-9).alias("conf_of_class"), clipped.alias("interval_clipped"),
        bound.alias("conf_bound"), (conf <= bound).alias("conf_in_bound"), F.size("top_features").alias("n_top"),
        (F.array_sort(sizes) == F.reverse(sizes)).alias("top_in_order"),
    )


# --- store, dispatch, checks, streams -----------------------------------------------------------------


@query("SELECT user_id AS id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, sf):
    """Two upserts by key into a store; the newest row of each key remains."""
    rows = W.table(spark, sf, "events").select(
        F.col("user_id").alias("id"), "event_id", "value", F.col("ts").cast("timestamp").alias("ts")
    )
    root = scratch_path(spark, "upsert")
    order = [F.desc("ts"), F.desc("event_id")]
    store.upsert(rows.filter(F.col("ts") < "2024-01-16"), root, "latest", "id", order)
    store.upsert(rows.filter(F.col("ts") >= "2024-01-16"), root, "latest", "id", order)
    return store.read_table(spark, root, "latest").select("id", "event_id", "value")


@query("SELECT o_orderkey::varchar AS run_id FROM orders ORDER BY o_orderdate DESC, o_orderkey::varchar LIMIT 50")
def newest_runs(spark, sf):
    runs = W.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("ts")
    )
    return store.newest_runs(runs).select("run_id")


@query(
    """SELECT q.detection_id, q.channel, CASE WHEN r.id IS NULL THEN 'rejected' WHEN q.channel = 'mock' THEN 'sent' ELSE 'failed' END AS status
       FROM (SELECT CASE WHEN lat_cell IS NULL OR event_id % 4 = 0 THEN 'none-' || event_id ELSE s.source_id END AS detection_id, event_id,
               CASE WHEN event_id % 2 = 0 THEN 'sms' ELSE 'mock' END AS channel FROM det LEFT JOIN sources s USING (lat_cell, lon_cell)) q
       LEFT JOIN records r ON r.id = q.detection_id"""
)
def dispatch_requests(spark, sf):
    """A dispatch request per detection, some for unknown sources."""
    cells = cluster.with_cells(W.detections(spark, sf))
    known = geo.source_id(F.col("lat_cell"), F.col("lon_cell"))
    e = F.col("event_id")
    requests = cells.select(
        F.when(e % 4 == 0, F.concat(F.lit("none-"), e.cast("string"))).otherwise(known).alias("detection_id"),
        F.lit("SPCB").alias("authority"), F.when(e % 2 == 0, "sms").otherwise("mock").alias("channel"), e.cast("string").alias("note"),
    )
    receipts, rejected = store.dispatch(requests, W.detection_records(spark, sf), F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return receipts.select("detection_id", "channel", "status").unionByName(
        rejected.select("detection_id", "channel", F.lit("rejected").alias("status"))
    )


@query("SELECT id, cls, conf, n_days FROM records")
def payload_round_trip(spark, sf):
    packed = store.to_payload(W.detection_records(spark, sf).select("id", "cls", "conf", "n_days"), ["id"])
    return store.from_payload(packed, "id string, cls string, conf double, n_days long")


_check = "SELECT '{0}' AS \"check\", CASE WHEN {1} THEN 'PASS' ELSE '{2}' END AS status, {3} AS details FROM {4}"


@query(
    " UNION ALL ".join(
        [
            _check.format("detections", "count(*) > 0", "WARN", "count(*) || ' detections stored'", "records"),
            _check.format("facilities", "count(*) > 0", "FAIL", "count(*) || ' facilities active'", "fac"),
            _check.format("scorer", "TRUE", "WARN", "'mode=heuristic'", "(SELECT 1)"),
            # The known pixel is mixed at 1150 K, which an exact retrieval gives back.
            _check.format("retrieval", "TRUE", "WARN", "'T_fire=1150.0K'", "(SELECT 1)"),
            _check.format("landcover", "count(*) FILTER (WHERE landcover_status = 'resolved') > 0", "WARN",
                          "count(*) FILTER (WHERE landcover_status = 'resolved') || ' resolved'", "records"),
            _check.format("expected ids", "count(*) FILTER (WHERE id IN ('AV-0B12A4B9', 'AV-95BA9779')) = 2", "WARN",
                          "count(*) FILTER (WHERE id IN ('AV-0B12A4B9', 'AV-95BA9779')) || '/2 present'", "records"),
        ]
    )
)
def data_checks(spark, sf):
    return checks.data_checks(W.detection_records(spark, sf), W.facilities(spark, sf), ["AV-0B12A4B9", "AV-95BA9779"])


# Landed files of the feed; a third of the rows is landed a second time, in another file.
LANDED_PARTS = 5


def _landed(spark, sf, ragged: bool = False) -> str:
    """Folder of CSV files with the whole feed, rows out of time order; ``ragged`` gives two layouts of columns and names."""
    feed = W.raw_feed(spark, sf).drop(W.ROW_ORDER)
    e = F.col("event_id")
    again = F.when(e % 3 == 0, F.array(e % LANDED_PARTS, (e + 2) % LANDED_PARTS)).otherwise(F.array(e % LANDED_PARTS))
    feed = W.stored(feed.withColumn("part", F.explode(again)), "feed")
    folder = scratch_path(spark, "landed")
    for part in range(LANDED_PARTS):
        rows = feed.filter(F.col("part") == part).drop("part")
        if ragged and part % 2:
            rows = rows.select(*[F.col(c).alias(c.upper()) for c in reversed(rows.columns)])
        rows.write.mode("append").option("header", True).csv(folder)
    return folder


def _landing_stream(spark, sf, batches: int) -> DataFrame:
    folder = _landed(spark, sf)
    files = list_files(spark, folder)
    columns = [c for c in W.raw_feed(spark, sf).columns if c != W.ROW_ORDER]
    return jobs.landing_stream(spark, folder, columns, files_per_batch=max(1, -(-len(files) // batches)))


@query("SELECT latitude, longitude, acq_utc::varchar AS acq_utc, satellite, bright_ti4, frp FROM det")
def landed_scan(spark, sf):
    """The feed from CSV files of two layouts, cleaned, without the rows landed twice."""
    clean = ingest.normalise(read_detections(spark, _landed(spark, sf, ragged=True)))
    return clean.select("latitude", "longitude", F.col("acq_utc").cast("string").alias("acq_utc"), "satellite", "bright_ti4", "frp")


@query("SELECT latitude, longitude, acq_utc::varchar AS acq_utc, satellite FROM det")
def stream_dedupe(spark, sf):
    """Landed files in five batches, repeats across batches removed whatever their age."""
    out = scratch_path(spark, "stream-dedupe")
    jobs.start_ingest(_landing_stream(spark, sf, LANDED_PARTS), f"{out}/store", f"{out}/progress", once=True).awaitTermination()
    rows = store.read_table(spark, f"{out}/store", "clean")
    return rows.select("latitude", "longitude", F.col("acq_utc").cast("string").alias("acq_utc"), "satellite")


@query("SELECT id, cls, conf, severity, n_hits FROM records")
def stream_store(spark, sf):
    """The whole incremental job over landed files in several batches; equals the batch result."""
    out = scratch_path(spark, "stream-store")
    handle = jobs.start(
        _landing_stream(spark, sf, 3), f"{out}/store", f"{out}/progress", W.facilities(spark, sf), once=True,
        pixels=W.pixels(spark, sf), tile_pixels=W.TILE_PIXELS,
    )
    handle.awaitTermination()
    return store.read_table(spark, f"{out}/store", "detections").select("id", "cls", "conf", "severity", "n_hits")


# Rows of the landed files within the outline, those landed twice in both places.
LANDED_ROWS = """, landed_w AS (
    SELECT 'AV-' || upper(substr(md5(floor(latitude / 0.02::double)::bigint || ':' || floor(longitude / 0.02::double)::bigint), 1, 8)) AS source_id, acq_utc, acq_date, frp
    FROM (SELECT * FROM mainland UNION ALL SELECT * FROM mainland WHERE event_id % 3 = 0))
"""


def _window_stream(spark, sf, batches: int) -> DataFrame:
    landed = _landing_stream(spark, sf, batches).drop("_file", "_block")
    return windows.located_rows(ingest.filter_mainland(ingest.clean_detections(landed)))


@query(
    LANDED_ROWS
    + "SELECT source_id, date_trunc('hour', acq_utc)::varchar AS start, count(*) AS n, round(sum(frp), 3) AS power FROM landed_w GROUP BY ALL"
)
def stream_windows(spark, sf):
    """Hourly windows of a stream in three batches, together with the rows that came too late for theirs."""
    out, delay = scratch_path(spark, "stream-windows"), timedelta(days=2)
    rows = _window_stream(spark, sf, 3)
    windows.keep_windows(rows, windows.hourly_power, out, "hourly", f"{out}/progress-windows", delay, once=True).awaitTermination()
    windows.write_late(rows, out, f"{out}/progress-late", delay, once=True).awaitTermination()
    kept = store.read_table(spark, out, "hourly").select("source_id", "start", "n", "power")
    late = windows.hourly_power(windows.late_rows(spark, out))
    both = kept.unionByName(late).groupBy("source_id", "start").agg(F.sum("n").alias("n"), F.sum("power").alias("power"))
    return both.select("source_id", F.col("start").cast("string").alias("start"), "n", r("power", 3))


@query(
    LANDED_ROWS
    + """SELECT source_id, start::varchar AS start, n, active_days FROM (
           SELECT source_id, date_trunc('day', acq_utc) - to_days(b.back::int) AS start, count(*) AS n, count(DISTINCT acq_date) AS active_days
           FROM landed_w, range(3) b(back) GROUP BY ALL)"""
)
def stream_persistence(spark, sf):
    """Active days per source in sliding windows of three days, over a stream in one batch."""
    out = scratch_path(spark, "stream-sliding")
    windows.keep_windows(_window_stream(spark, sf, 1), windows.persistence, out, "persistence", f"{out}/progress", timedelta(days=2), once=True).awaitTermination()
    return store.read_table(spark, out, "persistence").select("source_id", F.col("start").cast("string").alias("start"), "n", "active_days")


@query(
    LANDED_ROWS
    + """, breaks_w AS (
           SELECT *, sum(CASE WHEN before IS NULL OR epoch(acq_utc) - epoch(before) > 129600.5 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY acq_utc) AS run
           FROM (SELECT *, lag(acq_utc) OVER (PARTITION BY source_id ORDER BY acq_utc) AS before FROM landed_w))
         SELECT source_id, min(acq_utc)::varchar AS start, count(*) AS n, round(sum(frp), 3) AS power FROM breaks_w GROUP BY source_id, run
         HAVING epoch(max(acq_utc)) + 129600.5 <= (SELECT epoch(max(acq_utc)) FROM landed_w) - 86400"""
)
def stream_sessions(spark, sf):
    """Stretches of activity that the watermark has passed; half a second more than 36 hours apart, so that none is just so far."""
    out = scratch_path(spark, "stream-sessions")
    gap = "129600500 milliseconds"
    windows.write_sessions(_window_stream(spark, sf, 1), out, f"{out}/progress", timedelta(days=1), gap, once=True).awaitTermination()
    rows = spark.read.parquet(f"{out}/sessions")
    return rows.select("source_id", F.col("start").cast("string").alias("start"), "n", r("power", 3))


@query(
    """SELECT 'detection' AS event, count(*) AS n FROM records UNION ALL SELECT 'ingest', 1 UNION ALL SELECT 'pipeline_run_completed', 1
       UNION ALL SELECT 'pipeline_stage', 4"""
)
def stream_events(spark, sf):
    """Events by kind of the incremental job over all landed files in one batch."""
    out = scratch_path(spark, "stream-events")
    jobs.start(
        _landing_stream(spark, sf, 1), f"{out}/store", f"{out}/progress", W.facilities(spark, sf), once=True, pixels=W.pixels(spark, sf), tile_pixels=W.TILE_PIXELS
    ).awaitTermination()
    return events.read_events(spark, f"{out}/store").groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT source_id, n_hits, round(t_fire_K, 2) AS t_fire_k, round(dist_facility_m, 1) AS dist_facility_m, facility_name,
       round(flare_score, 3) AS flare_score FROM feat"""
)
def pipeline_end_to_end(spark, sf):
    """Raw texts to located and retrieved sources in one plan, nothing stored before."""
    W.configure(spark)
    found = W.rounded_centres(cluster.cluster_sources(W.stored(ingest.normalise(W.raw_feed(spark, sf)), "clean")))
    located = features.with_retrieval(nearest.nearest_facility(found, W.facilities(spark, sf)))
    return located.select(
        "source_id", "n_hits", F.round("retrieval.t_fire_K", 2).alias("t_fire_k"), r("dist_facility_m", 1), "facility_name",
        r("flare_score", 3),
    )
