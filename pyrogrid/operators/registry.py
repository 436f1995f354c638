"""Registry build: union of sources, merge within 500 m, numbering, distributions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyrogrid import constants as K
from pyrogrid.functions.physics import lookup
from pyrogrid.session import stored

GROUP = "lat double, lon double, name string, sector string, sources array<string>, first_lat double, first_lon double, first_rank string"
# Positions that one task merges at a time, and the latitude steps that they are counted by.
BAND_ROWS = 20_000
STRIP_DEG = 0.001
# A little more than the latitude step that the merge distance spans.
REACH_DEG = math.degrees(K.DEDUPE_METERS / K.EARTH_RADIUS_M) * (1 + 1e-9)


def _metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * K.EARTH_RADIUS_M * math.asin(math.sqrt(a))


class _Open:
    """Groups by longitude cell, so that a site looks only at those that can be within the merge distance."""

    def __init__(self, top: float) -> None:
        width = REACH_DEG * 1.01 / max(math.cos(math.radians(min(top + 2 * REACH_DEG, 90.0))), 1e-9)
        self.cells = max(1, int(360 / width))
        self.held: dict[int, list[dict]] = {}

    def _cell(self, lon: float) -> int:
        return int((lon % 360.0) / 360.0 * self.cells) % self.cells

    def put(self, group: dict) -> None:
        group["cell"] = self._cell(group["lon"])
        self.held.setdefault(group["cell"], []).append(group)

    def move(self, group: dict) -> None:
        if self._cell(group["lon"]) != group["cell"]:
            self.held[group["cell"]].remove(group)
            self.put(group)

    def nearest(self, lat: float, lon: float, closed: list[dict]) -> dict | None:
        """The nearest group within the merge distance; of equally near ones the first opened."""
        own, best, found = self._cell(lon), None, None
        for cell in {(own + d) % self.cells for d in (-1, 0, 1)}:
            groups = self.held.get(cell)
            if not groups:
                continue
            if any(lat - g["lat"] > REACH_DEG for g in groups):
                # Sites come by latitude, so groups left behind can never change again.
                closed += [g for g in groups if lat - g["lat"] > REACH_DEG]
                groups[:] = [g for g in groups if lat - g["lat"] <= REACH_DEG]
            for g in groups:
                apart = (_metres(lat, lon, g["lat"], g["lon"]), g["first_lat"], g["first_lon"])
                if apart[0] <= K.DEDUPE_METERS and (best is None or apart < best):
                    best, found = apart, g
        return found


BAND_GROUP = f"band int, open boolean, n long, {GROUP}"


def _merge_band(key: tuple, sites: pd.DataFrame, incoming: pd.DataFrame) -> pd.DataFrame:
    """Merge the sites of a latitude band in (lat, lon) order into running centres.

    ``incoming`` are the groups that the band below left open.  Groups that the band
    above can still reach are handed on as open.
    """
    columns = [c.split()[0] for c in BAND_GROUP.split(", ")]
    if not len(sites):
        return pd.DataFrame(columns=columns)
    groups, closed = _Open(float(sites["lat"].abs().max())), []
    for g in incoming.to_dict("records"):
        groups.put({**g, "sources": set(g["sources"])})
    for s in sites.sort_values(["lat", "lon"]).to_dict("records"):
        known = s["known_sector"] if isinstance(s["known_sector"], str) else None
        g = groups.nearest(s["lat"], s["lon"], closed)
        if g is None:
            sector = known if s["first_sector"] == "UNKNOWN" and known else s["first_sector"]
            groups.put(
                {
                    "lat": s["lat"], "lon": s["lon"], "n": s["n"], "name": s["name"], "sector": sector, "sources": set(s["sources"]),
                    "first_lat": s["lat"], "first_lon": s["lon"], "first_rank": s["first_rank"],
                }
            )
            continue
        n = g["n"]
        g["lat"], g["lon"] = ((g[c] * n + s[c] * s["n"]) / (n + s["n"]) for c in ("lat", "lon"))
        g["n"] = n + s["n"]
        g["sources"] |= set(s["sources"])
        if g["sector"] == "UNKNOWN" and known:
            g["sector"] = known
        groups.move(g)
    upper = float(sites["upper"].iloc[0])
    rows = [(g, False) for g in closed] + [(g, upper - g["lat"] <= REACH_DEG) for own in groups.held.values() for g in own]
    out = pd.DataFrame([{**g, "band": key[0], "open": still, "sources": sorted(g["sources"])} for g, still in rows], columns=columns)
    return out.sort_values(["first_lat", "first_lon"])


def latitude_bands(positions: DataFrame) -> DataFrame:
    """(strip, band, upper): bands of about BAND_ROWS positions, cut where latitudes leave a gap if there is one.

    There are at most 180,001 strips, whatever the number of positions.
    """
    counts = positions.groupBy(F.floor(F.col("lat") / STRIP_DEG).alias("strip")).agg(F.count(F.lit(1)).alias("n")).collect()
    rows, band, held, last = [], 0, 0, None
    for strip, n in sorted(counts):
        gap = last is not None and (strip - last - 1) * STRIP_DEG > REACH_DEG
        if held and (held + n > BAND_ROWS or (gap and 2 * held > BAND_ROWS)):
            band, held = band + 1, 0
        rows.append([strip, band])
        held, last = held + n, strip
    starts = {}
    for strip, band in reversed(rows):
        starts[band] = strip
    upper = {band: starts[band + 1] * STRIP_DEG if band + 1 in starts else math.inf for band in starts}
    return positions.sparkSession.createDataFrame([(s, b, upper[b]) for s, b in rows], "strip long, band int, upper double")


def merge_bands(positions: DataFrame) -> DataFrame:
    """The sequential merge of ``positions`` in (lat, lon) order, with all latitude bands at work at once.

    First every band is merged as if nothing came from below.  Then the bands whose
    neighbour below left other groups open than they had assumed are merged again,
    until all agree; by then each band has seen just what the sequential order gives
    it.  A wrong start is mostly forgotten within a few kilometres, so few rounds do;
    bands cut at gaps need none.
    """
    bands = latitude_bands(positions)
    count = (bands.agg(F.max("band")).first()[0] or 0) + 1
    strip = F.floor(F.col("lat") / STRIP_DEG).alias("strip")
    sites = stored(positions.select("*", strip).join(F.broadcast(bands), "strip").drop("strip"), "sites")
    spark = positions.sparkSession
    incoming = spark.createDataFrame([], BAND_GROUP)
    todo, states, rounds, latest = list(range(count)), {}, [], {}
    while todo:
        wanted = F.broadcast(spark.createDataFrame([(b,) for b in todo], "band int"))
        own, below = (t.join(wanted, "band", "left_semi").groupBy("band") for t in (sites, incoming))
        merged = stored(own.cogroup(below).applyInPandas(_merge_band, BAND_GROUP), "merged")
        latest |= dict.fromkeys(todo, len(rounds))
        rounds.append(merged)
        state = F.sum(F.xxhash64(*[c for c in merged.columns if c not in ("band", "open")]).cast("decimal(20,0)"))
        found = dict(merged.filter("open").groupBy("band").agg(state).collect())
        changed = [b for b in todo if found.get(b) != states.get(b)]
        states |= {b: found.get(b) for b in todo}
        if changed:
            sent = F.broadcast(spark.createDataFrame([(b,) for b in changed], "band int"))
            incoming = merged.filter("open").join(sent, "band", "left_semi").withColumn("band", F.col("band") + 1)
        todo = [b + 1 for b in changed if b + 1 < count]
    final = spark.createDataFrame(list(latest.items()), "band int, round int")
    out = None
    for number, merged in enumerate(rounds):
        kept = merged.filter("not open").join(F.broadcast(final.filter(F.col("round") == number)), "band", "left_semi")
        out = kept if out is None else out.unionByName(kept)
    return out.drop("band", "open", "n")


def merge_sites(sites: DataFrame) -> DataFrame:
    """Greedy merge within 500 m in (lat, lon, priority) order, as one row per group.

    ``sites`` has name, lat, lon, sector, source and site_rank; those without
    coordinates are left out.  Copies at one position always end in one group, so they
    are combined before anything else; the positions are merged by ``merge_bands``.
    """
    priority = lookup(K.SOURCE_PRIORITY, F.col("source"), F.lit(K.OTHER_PRIORITY))
    order = F.struct(priority.alias("p"), F.col("site_rank").alias("r"))
    plain = F.when(F.col("sector") == "industrial", "UNKNOWN").otherwise(F.col("sector"))
    known = F.when(~F.col("sector").isin("industrial", "UNKNOWN", ""), F.col("sector"))
    positions = sites.filter("lat is not null and lon is not null").groupBy("lat", "lon").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("name", order).alias("name"),
        F.min_by(plain, order).alias("first_sector"),
        F.min_by(known, F.when(known.isNotNull(), order)).alias("known_sector"),
        F.collect_set("source").alias("sources"),
        F.min(order).alias("_o"),
    ).withColumn("first_rank", F.concat(F.format_string("%02d", "_o.p"), F.lit("/"), F.col("_o.r"))).drop("_o")
    return merge_bands(stored(positions, "positions"))


def running_number(df: DataFrame, band: Column, order: list) -> Column | DataFrame:
    """Add ``number`` = 1..n in global order without sorting all rows in one task.

    ``band`` must grow with the order.  Counts per band give each band's offset,
    and rows are numbered inside their band.
    """
    df = df.withColumn("_band", band)
    before = Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy("_band")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy("_band").orderBy(*order))
    return (
        df.withColumn("_inside", inside)
        .join(offsets, "_band")
        .withColumn("number", F.col("_offset") + F.col("_inside"))
        .drop("_band", "_inside", "_offset")
    )


def build_registry(*sources: DataFrame) -> DataFrame:
    """Union the site tables, merge them and number the facilities."""
    united = sources[0]
    for other in sources[1:]:
        united = united.unionByName(other, allowMissingColumns=True)
    merged = merge_sites(united)
    numbered = running_number(
        merged, F.floor(F.col("first_lat") * 100), ["first_lat", "first_lon", "first_rank"]
    )
    return numbered.select(
        F.format_string("FAC-%03d", F.col("number")).alias("facility_id"),
        "name",
        F.bround("lat", 6).alias("lat"),
        F.bround("lon", 6).alias("lon"),
        F.coalesce("sector", F.lit("UNKNOWN")).alias("sector"),
        F.lit("").alias("district"),
        F.lit("").alias("state"),
        "sources",
    )


def sector_distribution(registry: DataFrame) -> DataFrame:
    return registry.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


def source_distribution(registry: DataFrame) -> DataFrame:
    return registry.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
