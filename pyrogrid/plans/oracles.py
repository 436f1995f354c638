"""The same queries as plain SQL over the shared test tables.

Each named block is a common table expression; ``sql`` puts the ones a query
needs in front of it.  The formulas are written out independently of the Spark
expressions (plain halving instead of false position, full pairwise distances
instead of indexes), so they check the results and not the method.
"""

from __future__ import annotations

import re

from pyrogrid import constants as K
from pyrogrid.plans import workload as W


def _values(rows, columns: str) -> str:
    def cell(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}::double" if isinstance(v, float) else str(v)

    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


def _dec(x: str, scale: int) -> str:
    digits = len(str(scale)) - 1
    return f"(({x}) // {scale})::varchar || '.' || lpad((({x}) % {scale})::varchar, {digits}, '0')"


def _planck(lam: float, t: str) -> str:
    # exp(x) - 1 is exact enough here: the exponents are well above one.
    return f"({K.C1 / lam ** 5!r}::double / (exp({K.C2 / lam!r}::double / ({t})) - 1))"


def _haversine(a: str, b: str, c: str, d: str) -> str:
    return (
        f"(2 * 6371000.0::double * asin(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * "
        f"cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))"
    )


def _project(lat: str, lon: str) -> tuple[str, str]:
    # Eccentricity, cone constant, scaled radius and radius at the origin of the national conic, worked out apart.
    ecc, n, scale, rho0 = 0.08181919084262149, 0.4066567058743961, 16736292.894709574, 14057213.876556948
    es = f"({ecc!r}::double * sin(radians({lat})))"
    t = f"(tan(pi() / 4 - radians({lat}) / 2) / pow((1 - {es}) / (1 + {es}), {ecc / 2!r}::double))"
    rho = f"({scale!r}::double * pow({t}, {n!r}::double))"
    theta = f"({n!r}::double * radians({lon} - 80.0::double))"
    return f"({rho} * sin({theta}) + 4000000.0::double)", f"({rho0 + 4_000_000.0!r}::double - {rho} * cos({theta}))"


_ring = [(a[1], a[0], b[1], b[0]) for a, b in zip(K.OUTLINE, K.OUTLINE[-1:] + K.OUTLINE[:-1])]
_lat = "9500 + ({k} % 25) * 900 + ({n} % 10) * 4"
_lon = "74000 + (({k} // 25) % 10) * 2000 + ({n} % 9) * 4"
_cents = "cast(round(value * 100) as bigint)"


def _edge_tests(table: str) -> str:
    return f"""
      SELECT d.event_id,
        sum(CASE WHEN (e.y1 > d.latitude) <> (e.y2 > d.latitude)
                  AND d.longitude < (e.x2 - e.x1) * (d.latitude - e.y1) / (e.y2 - e.y1) + e.x1 THEN 1 ELSE 0 END) % 2 = 1 AS odd,
        bool_or((e.x2 - e.x1) * (d.latitude - e.y1) - (e.y2 - e.y1) * (d.longitude - e.x1) = 0
                AND d.latitude BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)
                AND d.longitude BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)) AS touch
      FROM {table} d CROSS JOIN ring e GROUP BY d.event_id"""


_sectors = "[" + ", ".join(f"'{s}'" for s in K.SECTORS) + "]"
_codes = "[" + ", ".join(map(str, W.PIXEL_CODES)) + "]"
_cx, _cy = _project("s.centroid_lat", "s.centroid_lon")
_fx, _fy = _project("lat", "lon")


def _case(table: dict, key: str, default: str = "NULL") -> str:
    def show(v):
        return f"'{v}'" if isinstance(v, str) else f"{v!r}::double" if isinstance(v, float) else str(v)

    return f"CASE {key} " + " ".join(f"WHEN {show(k)} THEN {show(v)}" for k, v in table.items()) + f" ELSE {default} END"


def _let_fmt(x: str, d: int) -> str:
    return f"printf('%.{d}f', ({x})::double)"


CTES: dict[str, str] = {
    "ring": _values(_ring, "x1, y1, x2, y2"),
    "raw": f"""
      SELECT event_id, {_dec(_lat.format(k='user_id', n='event_id'), 1000)} AS latitude,
        {_dec(_lon.format(k='user_id', n='event_id'), 1000)} AS longitude,
        CASE WHEN event_id % 101 = 0 THEN 'n/a' ELSE {_dec(f'30500 + {_cents} % 6000', 100)} END AS bright_ti4,
        {_dec('28800 + (event_id * 7) % 1200', 100)} AS bright_ti5,
        {_dec('38 + event_id % 20', 100)} AS scan, {_dec('37 + event_id % 13', 100)} AS track,
        strftime(ts, '%Y-%m-%d') AS acq_date,
        (hour(ts) * 100)::varchar || CASE WHEN event_id % 5 = 0 THEN '.0' ELSE '' END AS acq_time,
        CASE WHEN event_type <> 'error' THEN event_type END AS satellite,
        {_dec('cast(round(value * 10) as bigint)', 100)} AS frp,
        CASE WHEN hour(ts) < 6 OR hour(ts) >= 18 THEN CASE WHEN event_id % 2 = 0 THEN 'night' ELSE 'N' END
             WHEN event_id % 7 = 0 THEN '?' ELSE 'day' END AS daynight
      FROM events""",
    "clean": """
      SELECT *, (hour(acq_utc) + minute(acq_utc) / 60.0::double + longitude / 15.0::double) % 24 AS local_solar_hour,
        CASE WHEN scan * track > 0 THEN scan * track * 1000000 ELSE 140625.0::double END AS pixel_area_m2
      FROM (SELECT event_id, try_cast(latitude AS double) AS latitude, try_cast(longitude AS double) AS longitude,
              try_cast(bright_ti4 AS double) AS bright_ti4, try_cast(bright_ti5 AS double) AS bright_ti5,
              try_cast(scan AS double) AS scan, try_cast(track AS double) AS track, try_cast(frp AS double) AS frp,
              acq_time, try_strptime(acq_date || ' ' || lpad(regexp_replace(acq_time, '\\.0$', ''), 4, '0'), '%Y-%m-%d %H%M') AS acq_utc,
              acq_date::date AS acq_date, coalesce(satellite, 'UNKNOWN') AS satellite, 'VIIRS' AS instrument,
              CASE WHEN upper(daynight[1]) IN ('D', 'N') THEN upper(daynight[1]) ELSE 'D' END AS daynight
            FROM raw) c
      WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND bright_ti4 IS NOT NULL AND bright_ti5 IS NOT NULL
        AND acq_utc IS NOT NULL""",
    "tested": _edge_tests("clean"),
    "mainland": "SELECT c.* FROM clean c JOIN tested t USING (event_id) WHERE t.odd OR t.touch",
    "det": """
      SELECT * EXCLUDE (rn), floor(latitude / 0.02::double)::bigint AS lat_cell, floor(longitude / 0.02::double)::bigint AS lon_cell
      FROM (SELECT *, row_number() OVER (PARTITION BY latitude, longitude, acq_utc, satellite ORDER BY event_id) AS rn FROM mainland)
      WHERE rn = 1""",
    "ambient": """
      SELECT coalesce(quantile_cont(bright_ti5, 0.5) FILTER (WHERE frp < 5), quantile_cont(bright_ti5, 0.5)) AS ambient_K FROM det""",
    "extent": """
      SELECT a.lat_cell, a.lon_cell, max(sqrt(pow((a.latitude - b.latitude) * 111000, 2)
          + pow((a.longitude - b.longitude) * 111000 * cos(radians(m.lat)), 2))) AS cluster_extent_m
      FROM det a JOIN det b USING (lat_cell, lon_cell)
      JOIN (SELECT lat_cell, lon_cell, avg(latitude) AS lat FROM det GROUP BY ALL) m USING (lat_cell, lon_cell)
      GROUP BY a.lat_cell, a.lon_cell""",
    "gaps": """
      SELECT lat_cell, lon_cell, coalesce(quantile_cont(gap, 0.5), 0) AS recurrence_gap_days FROM (
        SELECT lat_cell, lon_cell, (acq_date - lag(acq_date) OVER (PARTITION BY lat_cell, lon_cell ORDER BY acq_date))::double AS gap
        FROM (SELECT DISTINCT lat_cell, lon_cell, acq_date FROM det)) GROUP BY ALL""",
    "hours": """
      SELECT lat_cell, lon_cell, floor(local_solar_hour)::int % 24 AS hour, count(*) AS n FROM det GROUP BY ALL""",
    "hist_raw": """
      SELECT c.lat_cell, c.lon_cell, list(coalesce(o.n, 0)::double / c.total ORDER BY h.hour) AS shares
      FROM (SELECT lat_cell, lon_cell, count(*) AS total FROM det GROUP BY ALL) c
      CROSS JOIN (SELECT unnest(range(24)) AS hour) h
      LEFT JOIN hours o ON o.lat_cell = c.lat_cell AND o.lon_cell = c.lon_cell AND o.hour = h.hour
      GROUP BY c.lat_cell, c.lon_cell""",
    # The last bin takes what the others leave, summed in order.
    "hist_list": """
      SELECT lat_cell, lon_cell, list_append(shares[1:23], greatest(0, 1 - list_reduce(shares[1:23], lambda a, b: a + b))) AS p FROM hist_raw""",
    "hist": "SELECT lat_cell, lon_cell, generate_subscripts(p, 1) - 1 AS hour, unnest(p) AS share FROM hist_list",
    "shape_facts": """
      SELECT lat_cell, lon_cell, list_max(p) AS top, list_min(p) AS low, list_position(p, list_max(p)) - 1 AS peak,
        -list_reduce(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END), lambda a, b: a + b) / ln(24) AS spread,
        list_reduce(p[11:17], lambda a, b: a + b) AS day, list_reduce(p[17:21], lambda a, b: a + b) AS evening FROM hist_list""",
    "cells": """
      SELECT lat_cell, lon_cell, count(*) AS n_hits, count(DISTINCT acq_date) AS n_days,
        count(*) FILTER (WHERE daynight = 'N') AS n_nights, min(acq_utc) AS first_seen, max(acq_utc) AS last_seen,
        avg(frp) AS frp_mean, max(frp) AS frp_max, stddev_pop(frp) AS frp_std, quantile_cont(frp, 0.5) AS frp_median,
        quantile_cont(bright_ti4, 0.5) AS ti4_median, max(bright_ti4) AS ti4_max, stddev_pop(bright_ti4) AS ti4_std,
        quantile_cont(bright_ti5, 0.5) AS ti5_median, quantile_cont(bright_ti5, 0.05) AS ti5_low,
        quantile_cont(bright_ti4 - bright_ti5, 0.5) AS dT_median, quantile_cont(local_solar_hour, 0.5) AS local_solar_hour,
        quantile_cont(pixel_area_m2, 0.5) AS pixel_area_m2, round(avg(latitude), 6) AS centroid_lat, round(avg(longitude), 6) AS centroid_lon
      FROM det GROUP BY lat_cell, lon_cell""",
    "sources": """
      SELECT 'AV-' || upper(substr(md5(lat_cell || ':' || lon_cell), 1, 8)) AS source_id, c.*,
        n_nights::double / n_hits AS night_frac, (last_seen::date - first_seen::date) + 1 AS span_days,
        CASE WHEN frp_mean <> 0 THEN frp_std / frp_mean ELSE 0 END AS frp_cv, 1.0::double AS fill_ratio,
        e.cluster_extent_m, g.recurrence_gap_days,
        CASE WHEN n_hits >= 3 THEN ti5_low ELSE (SELECT ambient_K FROM ambient) END AS t_bg_K,
        CASE WHEN n_hits >= 3 THEN 'cluster_5th_percentile' ELSE 'regional_ambient' END AS t_bg_method,
        ((last_seen::date - first_seen::date) + 1) * 0.6::double + n_days * 3 + n_nights * 1.2::double
          + ln(1 + greatest(0, frp_max)) * 2 + CASE WHEN ti4_median > 320 THEN 4 ELSE 0 END AS flare_score,
        CASE WHEN n_hits <= 2 THEN 'SPARSE'
          WHEN top - low < 0.08 OR (spread > 0.82 AND n_nights::double / n_hits >= 0.25 AND top < 0.20) THEN 'FLAT_24H'
          WHEN evening >= 0.5 OR (evening >= 0.35 AND peak BETWEEN 16 AND 20 AND day < 0.5) THEN 'EVENING_BURST'
          WHEN day >= 0.5 OR (day >= 0.35 AND peak BETWEEN 10 AND 16 AND evening < 0.4) THEN 'DAYTIME_ONLY'
          WHEN top >= 0.25 THEN 'SPIKE_DECAY'
          WHEN n_nights::double / n_hits >= 0.35 AND spread > 0.70 THEN 'FLAT_24H' ELSE 'SPIKE_DECAY' END AS diurnal_shape
      FROM cells c JOIN extent e USING (lat_cell, lon_cell) JOIN gaps g USING (lat_cell, lon_cell)
      JOIN shape_facts f USING (lat_cell, lon_cell)""",
    "fac": f"""
      SELECT *, {_fx} AS x, {_fy} AS y, coalesce(match_radius_m, 2000) AS reach FROM (
        SELECT printf('FAC-%05d', s_suppkey) AS facility_id, s_name AS name,
          ({_lat.format(k='s_suppkey', n='s_suppkey')} + 2) / 1000.0::double AS lat,
          ({_lon.format(k='s_suppkey', n='s_suppkey')} + 1) / 1000.0::double AS lon,
          {_sectors}[s_nationkey % 8 + 1] AS sector, 'S' || s_nationkey AS state,
          CASE WHEN s_suppkey % 3 <> 0 THEN 1500.0::double + (s_suppkey % 5) * 500 END AS match_radius_m FROM supplier)""",
    "dense": f"""
      SELECT *, {_fx} AS x, {_fy} AS y FROM (
        SELECT printf('ORD-%012d', o_orderkey) AS facility_id, (9000 + (o_orderkey * 7919) % 26000) / 1000.0::double AS lat,
          (70000 + (o_orderkey * 10007) % 25000) / 1000.0::double AS lon FROM orders)""",
    "near": f"""
      SELECT source_id, d AS dist_facility_m, CASE WHEN d <= reach THEN facility_id END AS facility_id,
        CASE WHEN d <= reach THEN name END AS facility_name, CASE WHEN d <= reach THEN sector END AS facility_sector,
        CASE WHEN d <= reach THEN state END AS state, CASE WHEN d <= reach THEN match_radius_m END AS facility_radius_m
      FROM (SELECT s.source_id, f.*, sqrt(pow(f.x - {_cx}, 2) + pow(f.y - {_cy}, 2)) AS d FROM sources s CROSS JOIN fac f)
      QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY d, facility_id) = 1""",
    "dozier": f"""
      SELECT source_id, ti4_median, ti5_median, pixel_area_m2, t_bg_K IS NULL OR t_bg_K >= ti5_median AS own,
        CASE WHEN t_bg_K IS NULL OR t_bg_K >= ti5_median THEN ti5_median ELSE t_bg_K END AS bg,
        {_planck(K.LAM_MIR, 'ti4_median')} AS l4, {_planck(K.LAM_TIR, 'ti5_median')} AS l5,
        {_planck(K.LAM_MIR, 'bg')} AS b4, {_planck(K.LAM_TIR, 'bg')} AS b5,
        bg + 0.5 AS first_k, bg + 0.5 + 0.5 * floor((3000.01 - (bg + 0.5)) / 0.5) AS last_k
      FROM sources""",
    "halving": f"""
      SELECT source_id, l4, l5, b4, b5, first_k::double AS lo, last_k::double AS hi, 0 AS step,
        (l4 - b4) * ({_planck(K.LAM_TIR, 'first_k')} - b5) - (l5 - b5) * ({_planck(K.LAM_MIR, 'first_k')} - b4) AS g_lo,
        (l4 - b4) * ({_planck(K.LAM_TIR, 'last_k')} - b5) - (l5 - b5) * ({_planck(K.LAM_MIR, 'last_k')} - b4) AS g_hi
      FROM dozier WHERE NOT own AND l4 > b4 * 1.0001 AND l5 > b5
      UNION ALL
      SELECT source_id, l4, l5, b4, b5, CASE WHEN g_lo * g > 0 THEN mid ELSE lo END, CASE WHEN g_lo * g > 0 THEN hi ELSE mid END,
        step + 1, g_lo, g_hi
      FROM (SELECT *, (lo + hi) / 2 AS mid,
              (l4 - b4) * ({_planck(K.LAM_TIR, '(lo + hi) / 2')} - b5) - (l5 - b5) * ({_planck(K.LAM_MIR, '(lo + hi) / 2')} - b4) AS g
            FROM halving WHERE step < 50 AND g_lo * g_hi < 0)""",
    "retrieval": f"""
      SELECT d.source_id, d.bg AS t_bg_used, h.t AS t_fire_K,
        CASE WHEN h.t IS NOT NULL THEN least(1, (d.l4 - d.b4) / ({_planck(K.LAM_MIR, 'h.t')} - d.b4)) END AS frac,
        least(1, (d.l4 - d.b4) / ({_planck(K.LAM_MIR, 'h.t')} - d.b4)) * d.pixel_area_m2 * {K.SIGMA!r}::double * pow(h.t, 4) / 1e6 AS frp_derived_MW,
        CASE WHEN d.l4 <= d.b4 * 1.0001 THEN 'NO_MIR_EXCESS' WHEN d.own THEN 'BACKGROUND_UNAVAILABLE'
             WHEN d.l5 <= d.b5 THEN 'NO_TIR_EXCESS' WHEN h.t IS NULL THEN 'NO_ROOT'
             WHEN (d.l4 - d.b4) / ({_planck(K.LAM_MIR, 'h.t')} - d.b4) > 1 THEN 'P_CLIPPED' ELSE '' END AS flag
      FROM dozier d LEFT JOIN (SELECT source_id, (lo + hi) / 2 AS t FROM halving WHERE step = 50) h USING (source_id)""",
    "pixels": f"""
      SELECT printf('N%02dE%03d', 9 + 3 * (t % 8), 72 + 3 * (t // 8)) AS tile_id, p // {W.TILE_PIXELS} AS row, p % {W.TILE_PIXELS} AS col,
        max({_codes}[l_quantity::int % 12 + 1]) AS code
      FROM (SELECT *, (l_orderkey * 8 + l_linenumber) % 48 AS t, ((l_orderkey * 8 + l_linenumber) // 48) % {W.TILE_PIXELS ** 2} AS p FROM lineitem)
      GROUP BY ALL""",
    "placed": f"""
      SELECT source_id, centroid_lat, centroid_lon,
        printf('N%02dE%03d', floor(centroid_lat / 3)::int * 3, floor(centroid_lon / 3)::int * 3) AS tile_id,
        least(floor((floor(centroid_lat / 3) * 3 + 3 - centroid_lat) * {W.TILE_PIXELS // 3}), {W.TILE_PIXELS - 1})::int AS r0,
        least(floor((centroid_lon - floor(centroid_lon / 3) * 3) * {W.TILE_PIXELS // 3}), {W.TILE_PIXELS - 1})::int AS c0 FROM sources""",
    "window_px": """
      SELECT p.source_id, (px.row - p.r0 + 1) * 3 + px.col - p.c0 + 1 AS pos, px.code,
        {classes} AS class
      FROM placed p JOIN pixels px ON px.tile_id = p.tile_id AND px.row BETWEEN p.r0 - 1 AND p.r0 + 1 AND px.col BETWEEN p.c0 - 1 AND p.c0 + 1
    """.replace("{classes}", _case(K.LANDCOVER_CODES, "px.code")),
    "cover": """
      SELECT p.source_id, coalesce(v.class, 'unknown') AS landcover_class,
        CASE WHEN e.source_id IS NULL THEN 'unavailable' ELSE 'resolved' END AS landcover_status
      FROM placed p LEFT JOIN (SELECT DISTINCT source_id FROM window_px) e USING (source_id)
      LEFT JOIN (SELECT source_id, class FROM (SELECT source_id, class, count(*) AS n, min(pos) AS first FROM window_px
                   WHERE class IS NOT NULL GROUP BY ALL)
                 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n DESC, first) = 1) v USING (source_id)""",
    "feat": """
      SELECT s.*, n.dist_facility_m, n.facility_id, n.facility_name, n.facility_sector, n.state, n.facility_radius_m,
        r.t_fire_K, r.frac, r.frp_derived_MW, r.flag, c.landcover_class, c.landcover_status,
        floor(centroid_lat / 2)::int || '_' || floor(centroid_lon / 2)::int AS block_id,
        (atan2(sin(2 * pi() * local_solar_hour / 24), cos(2 * pi() * local_solar_hour / 24)) * 24 / (2 * pi()) + 24) % 24 AS hour
      FROM sources s JOIN near n USING (source_id) JOIN retrieval r USING (source_id) JOIN cover c USING (source_id)""",
    "score": """
      SELECT *, landcover_class = 'water' OR (facility_name IS NULL AND dist_facility_m > 25000 AND frp_max < 5) AS off,
        CASE WHEN landcover_class = 'water' OR (facility_name IS NULL AND dist_facility_m > 25000 AND frp_max < 5) THEN 1
          WHEN t_fire_K >= 450 AND night_frac >= 0.5 AND n_days >= 3 AND frp_cv < 1.5 AND dist_facility_m < 5000 THEN 2
          WHEN t_fire_K IS NULL AND frp_max >= 25 AND night_frac >= 0.7 AND dist_facility_m <= 3500 AND facility_sector IN ('REFI_GAS', 'POWER', 'STEEL') THEN 3
          WHEN t_fire_K IS NULL AND dist_facility_m < 3000 AND facility_sector IN ('REFI_GAS', 'FERTILIZER') AND night_frac > 0.5 THEN 4
          WHEN t_fire_K < 1000 AND span_days >= 60 AND frp_max < 5 AND cluster_extent_m > 1000 THEN 5
          WHEN landcover_class = 'cropland' AND (diurnal_shape = 'EVENING_BURST' OR (hour BETWEEN 16 AND 20 AND dist_facility_m > 2000)) THEN 6
          WHEN landcover_class IN ('forest', 'grassland', 'shrub') AND dist_facility_m > 5000 AND span_days < 30 AND hour BETWEEN 10 AND 16 THEN 7
          WHEN diurnal_shape = 'FLAT_24H' AND dist_facility_m < 5000 AND night_frac >= 0.35 THEN 8
          WHEN diurnal_shape = 'DAYTIME_ONLY' AND dist_facility_m > 5000 THEN 9
          WHEN n_days <= 3 AND frp_max > 20 AND dist_facility_m < 3000 THEN 10 ELSE 11 END AS rule FROM feat""",
    "rules": _values(
        [
            (1, "UNRESOLVED", 0.10), (2, "FLARE", 0.90), (3, "FLARE", 0.60), (4, "LEAK", 0.55), (5, "COAL", 0.82),
            (6, "WILD", 0.85), (7, "WILD", 0.78), (8, "FLARE", 0.88), (9, "WILD", 0.80), (10, "IND_FIRE", 0.84),
            (11, "UNRESOLVED", 0.35),
        ],
        "rule, rule_cls, rule_conf",
    ),
    "scored": """
      SELECT s.*, r.rule_cls, r.rule_conf, greatest(0, r.rule_conf - 0.12::double) AS lo, least(1, r.rule_conf + 0.12::double) AS hi
      FROM score s JOIN rules r USING (rule)""",
    "rec": f"""
      SELECT *, {_case({c: f[0] for c, f in K.EMISSION_FACTORS.items()}, 'cls', '0.825::double')} * power * 3.6 AS co2e_raw,
        {_case({c: f[1] for c, f in K.EMISSION_FACTORS.items()}, 'cls', '0.3::double')} * power * 3.6 AS bc_raw,
        ['LOW', 'MODERATE', 'HIGH', 'CRITICAL'][1 + CASE WHEN off THEN 0 ELSE least(3, base + step) END] AS severity
      FROM (SELECT *, {_case(K.BASE_SEVERITY, 'cls', '1')} AS base,
              CASE WHEN frp_max >= CASE WHEN cls = 'FLARE' THEN 150 ELSE 50 END THEN 2
                   WHEN frp_max >= CASE WHEN cls = 'FLARE' THEN 80 ELSE 20 END THEN 1 ELSE 0 END AS step,
              CASE WHEN frp_derived_MW > 0 THEN frp_derived_MW ELSE frp_max END AS power
            FROM (SELECT *, CASE WHEN off OR down THEN 'UNRESOLVED' ELSE rule_cls END AS cls,
                    CASE WHEN off THEN least(rule_conf, 0.1) WHEN down THEN least(rule_conf, 0.35) ELSE rule_conf END AS conf
                  FROM (SELECT *, rule_cls = 'IND_FIRE' AND dist_facility_m > 25000 AS down FROM scored)))""",
    "records": """
      SELECT source_id AS id, centroid_lat AS lat, centroid_lon AS lon, cls, conf, lo, hi, t_fire_K AS temp_K, ti5_median AS bg_K, frac,
        coalesce(frp_derived_MW, 0) AS frp_MW, frp_max AS frp_max_MW, last_seen AS ts, n_hits, n_days, night_frac, facility_id,
        facility_name, facility_sector, dist_facility_m, state, severity, off AS offshore_suppressed, diurnal_shape,
        landcover_class, landcover_status, rule_cls, rule_conf, frp_max, t_fire_K,
        CASE WHEN NOT off THEN round(co2e_raw, 4) END AS co2e_rate_tph, CASE WHEN NOT off THEN round(bc_raw, 4) END AS black_carbon_rate_kgph,
        CASE WHEN NOT off THEN round(round(co2e_raw, 4) * greatest(1, span_days) * 24, 3) END AS co2e_total_t
      FROM rec""",
    "labels_w": """
      SELECT source_id, centroid_lat, centroid_lon, block_id, dist_facility_m, facility_id, rule_cls, rule_conf,
        CASE WHEN facility_id IS NOT NULL AND dist_facility_m <= coalesce(facility_radius_m, 2000) THEN {lab}
             WHEN dist_facility_m > 5000 AND landcover_class IN ('forest', 'grassland', 'shrub') THEN 'WILD' ELSE 'UNLABELLED' END AS label,
        CASE WHEN facility_id IS NOT NULL AND dist_facility_m <= coalesce(facility_radius_m, 2000) THEN {con}
             WHEN dist_facility_m > 5000 AND landcover_class IN ('forest', 'grassland', 'shrub') THEN 'high' ELSE 'none' END AS label_confidence
      FROM scored""".replace("{lab}", _case({k: v[0] for k, v in K.SECTOR_LABELS.items()}, "facility_sector", "'UNLABELLED'")).replace(
        "{con}", _case({k: v[1] for k, v in K.SECTOR_LABELS.items()}, "facility_sector", "'none'")
    ),
    "predicted": """
      SELECT source_id, label AS cls, rule_cls AS predicted, rule_conf AS conf,
        CASE WHEN label = rule_cls THEN rule_conf ELSE (1 - rule_conf) / 5 END AS p_true
      FROM labels_w WHERE label <> 'UNLABELLED'""",
}


def sql(query: str) -> str:
    """The query with every block it needs, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"[A-Za-z_]\w*", text)):
            if word in CTES and word not in needed and word not in REAL_TABLES:
                needed.add(word)
                visit(CTES[word])

    visit(query)
    blocks = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in CTES if n in needed)
    if not blocks:
        return query
    # A query that starts with a comma brings further blocks of its own.
    return f"WITH RECURSIVE {blocks}\n{query}"


REAL_TABLES: set[str] = set()
