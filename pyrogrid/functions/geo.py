"""Geodesy as Column expressions: polygon test, projection, distances, ids."""

from __future__ import annotations

import json
import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pyrogrid import constants as K

# The outline is looked up through a lattice of cells of this size.  Cells that
# no edge touches are decided by one array access; only the few percent that an
# edge crosses evaluate the edges of their latitude strip.
LATTICE_DEG = 0.25
OUTSIDE, INSIDE, CROSSED = "0", "1", "2"


def _ring() -> np.ndarray:
    """Edges as rows (lon1, lat1, lon2, lat2)."""
    points = np.array([(lon, lat) for lat, lon in K.OUTLINE])
    return np.hstack([points, np.roll(points, 1, axis=0)])


@lru_cache(maxsize=1)
def outline_lattice() -> tuple[int, int, int, int, str, str]:
    """(first column, first row, columns, rows, cell states, strip edges as JSON)."""
    edges = _ring()
    lons, lats = edges[:, [0, 2]], edges[:, [1, 3]]
    col0, row0 = math.floor(lons.min() / LATTICE_DEG), math.floor(lats.min() / LATTICE_DEG)
    cols = math.floor(lons.max() / LATTICE_DEG) - col0 + 1
    rows = math.floor(lats.max() / LATTICE_DEG) - row0 + 1
    margin = 1e-9
    west = (np.arange(cols) + col0) * LATTICE_DEG - margin
    south = (np.arange(rows) + row0) * LATTICE_DEG - margin
    east, north = west + LATTICE_DEG + 2 * margin, south + LATTICE_DEG + 2 * margin

    # An edge touches a box when their bounds overlap and the box corners do not
    # all lie strictly on one side of the edge's line.
    crossed = np.zeros((rows, cols), dtype=bool)
    inside = np.zeros((rows, cols), dtype=bool)
    mid_lon, mid_lat = (west + east) / 2, ((south + north) / 2)[:, None]
    for x1, y1, x2, y2 in edges:
        overlap = ((south <= max(y1, y2)) & (north >= min(y1, y2)))[:, None] & (
            (west <= max(x1, x2)) & (east >= min(x1, x2))
        )
        sides = [
            (x2 - x1) * (corner_y[:, None] - y1) - (y2 - y1) * (corner_x - x1)
            for corner_x in (west, east)
            for corner_y in (south, north)
        ]
        one_side = np.all([s > 0 for s in sides], axis=0) | np.all([s < 0 for s in sides], axis=0)
        crossed |= overlap & ~one_side
        if y1 != y2:
            straddles = (y1 > mid_lat) != (y2 > mid_lat)
            inside ^= straddles & (mid_lon < (x2 - x1) * (mid_lat - y1) / (y2 - y1) + x1)
    states = np.where(crossed, CROSSED, np.where(inside, INSIDE, OUTSIDE))

    strips = []
    for lo, hi in zip(south, north):
        hit = (lats.min(axis=1) <= hi) & (lats.max(axis=1) >= lo)
        strips.append([dict(zip(("x1", "y1", "x2", "y2"), map(float, e))) for e in edges[hit]])
    return col0, row0, cols, rows, ",".join(states.ravel()), json.dumps(strips)


def in_mainland(lat: Column, lon: Column, boundary: bool = True) -> Column:
    """True inside the mainland outline; points on the outline count if ``boundary``.

    The point is bound once, so a costly coordinate expression is not repeated for
    every edge when the optimizer moves the filter below the projection.
    """
    col0, row0, cols, rows, states, strips = outline_lattice()
    edge_type = "array<array<struct<x1:double,y1:double,x2:double,y2:double>>>"

    def test(p: Column) -> Column:
        y, x = p["y"], p["x"]
        col, row = F.floor(x / LATTICE_DEG) - col0, F.floor(y / LATTICE_DEG) - row0
        in_lattice = (col >= 0) & (col < cols) & (row >= 0) & (row < rows)
        # Both tables are constants, folded once into array literals.
        state = F.element_at(F.split(F.lit(states), ","), (row * cols + col + 1).cast("int"))
        edges = F.element_at(F.from_json(F.lit(strips), edge_type), (row + 1).cast("int"))

        def crosses(e: Column) -> Column:
            return ((e.y1 > y) != (e.y2 > y)) & (x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1)

        def touches(e: Column) -> Column:
            return (
                ((e.x2 - e.x1) * (y - e.y1) - (e.y2 - e.y1) * (x - e.x1) == 0)
                & y.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2))
                & x.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2))
            )

        parity = F.aggregate(edges, F.lit(False), lambda acc, e: acc != F.coalesce(crosses(e), F.lit(False)))
        exact = (parity | F.exists(edges, touches)) if boundary else parity
        return (
            F.when(~in_lattice, F.lit(False)).when(state == CROSSED, exact).otherwise(state == INSIDE)
        )

    point = F.struct(lat.alias("y"), lon.alias("x"))
    return F.element_at(F.transform(F.array(point), test), 1)


def in_bbox(lat: Column, lon: Column, bbox: tuple[float, float, float, float] = K.REGION_BBOX) -> Column:
    """Plain bounds predicate, (west, south, east, north); reaches the Parquet scan."""
    west, south, east, north = bbox
    return lon.between(west, east) & lat.between(south, north)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on the mean sphere."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * K.EARTH_RADIUS_M)


@lru_cache(maxsize=1)
def _conic() -> tuple[float, float, float, float]:
    """(eccentricity, cone constant, scale, radius at the origin) of EPSG:7755."""
    major, flattening = 6378137.0, 1 / 298.257223563
    ecc = math.sqrt(2 * flattening - flattening ** 2)

    def m(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - (ecc * math.sin(phi)) ** 2)

    def t(phi: float) -> float:
        es = ecc * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - es) / (1 + es)) ** (ecc / 2)

    lower, upper, origin = (math.radians(v) for v in (12.472955, 35.1728044444444, 24.0))
    n = (math.log(m(lower)) - math.log(m(upper))) / (math.log(t(lower)) - math.log(t(upper)))
    scale = major * m(lower) / (n * t(lower) ** n)
    return ecc, n, scale, scale * t(origin) ** n


def project(lat: Column, lon: Column) -> tuple[Column, Column]:
    """EPSG:7755 easting and northing in metres (Lambert conic, two parallels)."""
    ecc, n, scale, rho0 = _conic()
    phi = F.radians(lat)
    es = F.sin(phi) * ecc
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(ecc / 2))
    rho = F.pow(t, F.lit(n)) * scale
    theta = F.radians(lon - 80.0) * n
    return F.sin(theta) * rho + 4_000_000.0, F.lit(rho0 + 4_000_000.0) - F.cos(theta) * rho


def project_point(lat: float, lon: float) -> tuple[float, float]:
    """``project`` for one pair of numbers on the driver."""
    ecc, n, scale, rho0 = _conic()
    phi = math.radians(lat)
    es = ecc * math.sin(phi)
    rho = scale * (math.tan(math.pi / 4 - phi / 2) / ((1 - es) / (1 + es)) ** (ecc / 2)) ** n
    theta = n * math.radians(lon - 80.0)
    return rho * math.sin(theta) + 4_000_000.0, rho0 + 4_000_000.0 - rho * math.cos(theta)


def destination(lat: Column, lon: Column, bearing_deg: Column, radius_km: Column) -> tuple[Column, Column]:
    """Point at a bearing and great-circle distance, in degrees."""
    phi, lam, b = F.radians(lat), F.radians(lon), F.radians(bearing_deg)
    d = radius_km / (K.EARTH_RADIUS_M / 1000)
    sin_phi2 = F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(b)
    lon2 = lam + F.atan2(F.sin(b) * F.sin(d) * F.cos(phi), F.cos(d) - F.sin(phi) * sin_phi2)
    return F.degrees(F.asin(sin_phi2)), F.degrees(lon2)


def tile_id(lat: Column, lon: Column) -> Column:
    """Name of the 3x3 degree tile by its lower-left corner, such as N27E075."""
    lat0 = (F.floor(lat / K.TILE_DEG) * K.TILE_DEG).cast("int")
    lon0 = (F.floor(lon / K.TILE_DEG) * K.TILE_DEG).cast("int")
    return F.concat(
        F.when(lat0 >= 0, "N").otherwise("S"),
        F.lpad(F.abs(lat0).cast("string"), 2, "0"),
        F.when(lon0 >= 0, "E").otherwise("W"),
        F.lpad(F.abs(lon0).cast("string"), 3, "0"),
    )


def tile_bounds(tile: Column) -> Column:
    """struct(min_lon, min_lat, max_lon, max_lat) of a tile name; null if malformed."""
    pattern = r"^([NS])(\d{2})([EW])(\d{3})$"
    sign_lat = F.when(F.regexp_extract(tile, pattern, 1) == "S", -1.0).otherwise(1.0)
    sign_lon = F.when(F.regexp_extract(tile, pattern, 3) == "W", -1.0).otherwise(1.0)
    lat0 = sign_lat * F.regexp_extract(tile, pattern, 2).cast("double")
    lon0 = sign_lon * F.regexp_extract(tile, pattern, 4).cast("double")
    return F.when(
        tile.rlike(pattern),
        F.struct(
            lon0.alias("min_lon"),
            lat0.alias("min_lat"),
            (lon0 + float(K.TILE_DEG)).alias("max_lon"),
            (lat0 + float(K.TILE_DEG)).alias("max_lat"),
        ),
    )


def block_id(lat: Column, lon: Column, size_deg: float = 2.0) -> Column:
    """Spatial block name used for grouped folds and store partitions."""
    return F.concat_ws(
        "_", F.floor(lat / size_deg).cast("string"), F.floor(lon / size_deg).cast("string")
    )


def source_id(lat_cell: Column, lon_cell: Column, prefix: str = K.SOURCE_ID_PREFIX) -> Column:
    """Stable id of a grid cell."""
    digest = F.md5(F.concat_ws(":", lat_cell.cast("string"), lon_cell.cast("string")))
    return F.concat(F.lit(prefix), F.upper(F.substring(digest, 1, 8)))


def coarse_landcover(lat: Column, lon: Column) -> Column:
    """Optional box-rule land cover, used only where no pixel table exists."""
    # fixed values: (class, south, north, west, east), first match wins; open
    # ends are infinite, north and east are exclusive for the sea boxes.
    inf = math.inf
    sea = [
        (-inf, 8.4, -inf, 77.6), (-inf, 8.4, 78.0, inf), (-inf, 8.35, -inf, inf),
        (-inf, 10.0, -inf, 75.6), (10.0, 15.0, -inf, 73.6), (15.0, 19.0, -inf, 72.6),
        (19.0, 21.0, -inf, 72.3), (21.0, 24.0, -inf, 68.6), (-inf, 12.0, 80.2, inf),
        (12.0, 16.0, 80.6, inf), (16.0, 20.0, 82.8, inf), (20.0, 22.5, 87.2, inf),
    ]
    lakes = [(19.55, 19.95, 85.15, 85.65), (22.5, 22.9, 69.3, 70.1)]
    forests = [(8.5, 16.0, 74.8, 77.0), (18.5, 23.5, 80.5, 84.5), (23.5, 28.5, 91.5, 96.5), (29.8, 33.5, 76.5, 80.5)]
    arid = [(24.5, 29.5, 69.5, 73.5)]

    def any_of(boxes: list[tuple], closed: bool) -> Column:
        test = F.lit(False)
        for south, north, west, east in boxes:
            if closed:
                box = lat.between(south, north) & lon.between(west, east)
            else:
                box = (lat >= south) & (lat < north) & ((lon < east) if west == -inf else (lon > west))
                if west == -inf and east == inf:
                    box = (lat >= south) & (lat < north)
            test = test | box
        return test

    return (
        F.when(any_of(sea, closed=False) | any_of(lakes, closed=True) | ~in_mainland(lat, lon), "water")
        .when(any_of(forests, closed=True), "forest")
        .when(any_of(arid, closed=True), "shrub")
        .otherwise("cropland")
    )
