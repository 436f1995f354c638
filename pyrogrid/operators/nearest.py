"""Exact nearest-facility search through a candidate grid refined by distance bounds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyrogrid import constants as K
from pyrogrid.functions import geo
from pyrogrid.session import cut_lineage

# A cell is split while more facilities than this may be the nearest one of some
# point in it, and each split cuts a cell into FAN x FAN.
MAX_CANDIDATES = 64
FAN_BITS = 2
FAN = 1 << FAN_BITS
# Cells of the last depth are a millimetre wide in a region of 4,000 km.
MAX_DEPTH = 16
# Candidate entries (about 40 bytes each) up to which the index is broadcast.
BROADCAST_ENTRIES = 500_000


@dataclass(frozen=True)
class Metric:
    """A distance with bounds over a box.

    ``box`` is the (west, south, east, north) that most points lie in, ``scale``
    gives the factor of the x difference for a point's y, and ``scale_range`` the
    smallest and largest factor for y between two values; both in SQL.
    """

    box: tuple[float, float, float, float]
    unit: float = 1.0
    scale: Callable[[str], str] = lambda y: "1D"
    scale_range: Callable[[str, str], tuple[str, str]] = lambda lo, hi: ("1D", "1D")


def _projected_region() -> tuple[float, float, float, float]:
    west, south, east, north = K.REGION_BBOX
    steps = [i / 16 for i in range(17)]
    edge = [(south + t * (north - south), lon) for t in steps for lon in (west, east)]
    edge += [(lat, west + t * (east - west)) for t in steps for lat in (south, north)]
    xs, ys = zip(*[geo.project_point(lat, lon) for lat, lon in edge])
    return min(xs), min(ys), max(xs), max(ys)


def _cos_range(lo: str, hi: str) -> tuple[str, str]:
    low, high = (f"greatest(-90D, least(90D, {v}))" for v in (lo, hi))
    ends = f"cos(radians({low})), cos(radians({high}))"
    return f"least({ends})", f"if({low} <= 0 and {high} >= 0, 1D, greatest({ends}))"


# Projected metres.
PLANAR = Metric(box=_projected_region())
# Degrees of 111 km each, longitudes shortened by the cosine of the point's latitude.
PLATE = Metric(
    box=(-180.0, -90.0, 180.0, 90.0), unit=111.0, scale=lambda y: f"cos(radians({y}))", scale_range=_cos_range
)


def over_points(metric: Metric, points: DataFrame, x: str, y: str) -> Metric:
    """The metric with its box around a table of points (one pass over two columns)."""
    e = points.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    return metric if e[0] is None else replace(metric, box=(e[0], e[1], e[2], e[3]))


# Entries for points beyond the root have depths -1 to -8, one for each side and corner,
# and are kept under SALTS keys each; points without coordinates have a depth of their own.
SALTS, NOWHERE = 8, -9


@dataclass(frozen=True)
class CandidateIndex:
    table: DataFrame | None
    depths: tuple[int, ...]
    entries: int
    root: tuple[float, float, float]
    metric: Metric


def _cell_at(depth: int) -> tuple[Column, Column]:
    """Grid cell of a facility at a depth, from its cell at the last depth."""
    shift = FAN_BITS * (MAX_DEPTH - depth)
    return F.shiftright("gx", shift).alias("cx"), F.shiftright("gy", shift).alias("cy")


def _possible(pairs: DataFrame, root: tuple[float, float, float], metric: Metric) -> DataFrame:
    """The pairs of a cell (dq, qx, qy) and a box x0..x1, y0..y1 that may hold the nearest facility of a point in the cell.

    Each box names one of its facilities, (rx, ry).  The difference of two squared
    distances is linear across a cell, so a facility that is nearer to each corner of
    the cell than any place of a box is nearer to every point of the cell than all that
    the box holds.  Tried as such are the named facilities nearest to the corners and the
    centre.  Adds ``apart``, the squared distance from cell to box in units of the cell's side.
    """
    west0, south0, size = root
    kept = [c for c in pairs.columns if c != "apart"]
    cells = pairs.selectExpr(*kept, f"{size!r}D / pow({FAN}D, dq) AS _e").selectExpr(*kept, "_e", f"qx * _e + {west0!r}D AS _w", f"qy * _e + {south0!r}D AS _s")
    scales = metric.scale_range("_s", "_s + _e")
    cells = cells.selectExpr("*", *[f"{k} AS _k{i}" for i, k in enumerate(scales)])
    used = [1] if metric.scale_range is Metric.scale_range else [0, 1]
    # The corners of a cell.
    corners = [(k, x, y) for k in used for x in ("_w", "(_w + _e)") for y in ("_s", "(_s + _e)")]

    def squared(k: int, dx: str, dy: str) -> str:
        return f"pow(({dx}) * _k{k}, 2) + pow({dy}, 2)"

    near = [squared(k, f"greatest(0D, x0 - {x}, {x} - x1)", f"greatest(0D, y0 - {y}, {y} - y1)") for k, x, y in corners]
    named = [squared(k, f"rx - {x}", f"ry - {y}") for k, x, y in corners]
    centre = squared(1, "rx - _w - _e / 2", "ry - _s - _e / 2")
    apart = squared(0, "greatest(0D, x0 - _w - _e, _w - x1)", "greatest(0D, y0 - _s - _e, _s - y1)")
    numbers = range(len(corners))
    measured = cells.selectExpr(
        *kept, f"({apart}) / (_e * _e) AS apart", *[f"{v} AS _m{i}" for i, v in enumerate(near)], f"struct({', '.join(named)}) AS _r", f"{centre} AS _c"
    )
    spots = [f"_r.col{i + 1}" for i in numbers][-4:] + ["_c"]
    winners = [f"min_by(_r, {spot}) OVER (PARTITION BY dq, qx, qy) AS _v{j}" for j, spot in enumerate(spots)]

    # Room for rounding.
    def nearer(j: int, i: int) -> str:
        return f"_m{i} - _v{j}.col{i + 1} > (_m{i} + _v{j}.col{i + 1}) * 1e-10D"

    beaten = " OR ".join("(" + " AND ".join(nearer(j, i) for i in numbers) + ")" for j in range(len(spots)))
    return measured.selectExpr("*", *winners).filter(f"NOT ({beaten})").selectExpr(*kept, "apart")


def build_index(facilities: DataFrame, x: str, y: str, tie: str, metric: Metric = PLANAR) -> CandidateIndex:
    """Cells with every facility that is nearest to some point of the cell.

    The root is a square around the region and all facilities.  Cells of points and
    occupied cells of facilities are refined together, level by level: a pair of them
    stays while distances allow that one holds the nearest facility of a point in the
    other (``_possible``), so a level costs some pairs per cell, not rows per facility.
    A cell is split while its pairs hold many facilities and some of them are near; a
    crowded place seen from afar is refined without splitting the cells that see it.
    Of facilities at one position only the first by ``tie`` can win, so copies are
    dropped first.  For PLATE pass a box around the points (``over_points``) unless
    there are few sites.

    The way from a point beyond the root to its nearest facility crosses the root's
    edge at a spot that has the same nearest facility.  So the candidates of the cells
    along the sides that face it together serve such a point.  That needs a metric
    without scale; the box of a scaled one must hold every point.
    """
    distinct = (
        facilities.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.col(x).cast("double").alias("fx"), F.col(y).cast("double").alias("fy"))
        .agg(F.min(tie).alias("tie"))
    )
    distinct = cut_lineage(distinct)
    extent = distinct.agg(F.min("fx"), F.min("fy"), F.max("fx"), F.max("fy"), F.count(F.lit(1))).first()
    if not extent[4]:
        return CandidateIndex(None, (), 0, (0.0, 0.0, 1.0), metric)
    west0, south0 = min(metric.box[0], extent[0]), min(metric.box[1], extent[1])
    east0, north0 = max(metric.box[2], extent[2]), max(metric.box[3], extent[3])
    size = max(east0 - west0, north0 - south0) * (1 + 1e-6) + 1e-6
    root = (west0, south0, size)
    finest = FAN**MAX_DEPTH

    def grid(value: str, low: float) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(finest - 1), F.floor((F.col(value) - low) / size * finest))).cast("long")

    sites = distinct.withColumns({"gx": grid("fx", west0), "gy": grid("fy", south0)})

    def occupied(depth: int) -> DataFrame:
        boxes = [F.min("fx").alias("x0"), F.max("fx").alias("x1"), F.min("fy").alias("y0"), F.max("fy").alias("y1")]
        named = F.min(F.struct("fx", "fy")).alias("_f")
        found = sites.groupBy(*_cell_at(depth)).agg(*boxes, F.count(F.lit(1)).alias("n"), named)
        return found.withColumns({"rx": F.col("_f.fx"), "ry": F.col("_f.fy")}).drop("_f")

    cell = ["dq", "qx", "qy"]
    corner = F.lit(0).cast("long")
    count = int(extent[4])
    pairs = occupied(0).select(F.lit(0).alias("dq"), corner.alias("qx"), corner.alias("qy"), "*", F.lit(0.0).alias("apart"))
    pairs = pairs.withColumns({"near": F.lit(True), "open": F.lit(count > MAX_CANDIDATES)})
    leaves, left = [], count > MAX_CANDIDATES
    for depth in range(MAX_DEPTH + 1):
        closed = pairs.filter(~F.col("open")) if left else pairs
        at = closed.select(*cell, "cx", "cy").join(sites.select(*_cell_at(depth), "fx", "fy", "tie"), ["cx", "cy"])
        boxes = {"x0": "fx", "x1": "fx", "y0": "fy", "y1": "fy", "rx": "fx", "ry": "fy"}
        kept = _possible(at.withColumns({k: F.col(v) for k, v in boxes.items()}), root, metric)
        leaves.append(kept.select(F.col("dq").alias("depth"), F.col("qx").alias("ix"), F.col("qy").alias("iy"), "fx", "fy", "tie"))
        if not left:
            break
        # A cell with a near box is cut into FAN x FAN; one whose boxes are all far stays whole.
        below = F.sequence(F.lit(0), F.when(F.col("near"), FAN * FAN - 1).otherwise(0))
        c, near = F.col("c"), F.col("near")
        split = pairs.filter("open").select("*", F.explode(below).alias("c")).withColumns(
            {
                "qx": F.when(near, F.col("qx") * FAN + c % FAN).otherwise(F.col("qx")),
                "qy": F.when(near, F.col("qy") * FAN + F.floor(c / FAN)).otherwise(F.col("qy")),
                "dq": F.col("dq") + F.when(near, 1).otherwise(0),
            }
        )
        split = _possible(split, root, metric).select(*cell, F.col("cx").alias("px"), F.col("cy").alias("py"))
        inner = occupied(depth + 1).withColumns({"px": F.shiftright("cx", FAN_BITS), "py": F.shiftright("cy", FAN_BITS)})
        pairs = _possible(split.join(inner, ["px", "py"]).drop("px", "py"), root, metric)
        whole = Window.partitionBy(*cell)
        near = F.min("apart").over(whole) < 1
        more = (F.sum("n").over(whole) > MAX_CANDIDATES) & (near | (F.max("n").over(whole) > 1))
        pairs = pairs.withColumns({"near": near, "open": more if depth + 1 < MAX_DEPTH else F.lit(False)})
        # Every level is checkpointed: it is read several times, and plans stay short.
        pairs = cut_lineage(pairs)
        left = not pairs.filter("open").isEmpty()
    table = leaves[0]
    for leaf in leaves[1:]:
        table = table.unionByName(leaf)
    table = cut_lineage(table)
    depths = sorted(r[0] for r in table.select("depth").distinct().collect())
    reach = F.pow(F.lit(float(FAN)), F.col("depth")) - 1
    on_side = {"x": [F.lit(False), F.col("ix") == 0, F.col("ix") == reach], "y": [F.lit(False), F.col("iy") == 0, F.col("iy") == reach]}
    facing = [F.when(on_side["x"][k % 3] | on_side["y"][k // 3], F.lit(-k)) for k in range(1, 9)]
    beyond = (
        table.filter(on_side["x"][1] | on_side["x"][2] | on_side["y"][1] | on_side["y"][2])
        .select(F.explode(F.array_compact(F.array(*facing))).alias("depth"), "fx", "fy", "tie").distinct()
        .select("depth", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("ix"), corner.alias("iy"), "fx", "fy", "tie")
    )
    table = cut_lineage(
        table.unionByName(beyond)
        .groupBy("depth", "ix", "iy")
        .agg(F.collect_list(F.struct("tie", "fx", "fy")).alias("candidates"))
    )
    entries = table.agg(F.sum(F.size("candidates"))).first()[0] or 0
    return CandidateIndex(table, tuple(depths), int(entries), root, metric)


def attach_nearest(points: DataFrame, index: CandidateIndex, x: Column, y: Column) -> DataFrame:
    """Add ``nearest`` = struct(distance, tie) of the nearest facility, null if none.

    Each point looks up its cell at the few depths that hold cells; exactly one
    exists.  The lookup is an equi-join: a broadcast one when the index was counted
    to be small, a shuffled one with skew handling otherwise.
    """
    if index.table is None:
        return points.withColumn("nearest", F.lit(None).cast("struct<distance:double,tie:string>"))
    metric, (west0, south0, size) = index.metric, index.root
    points = points.withColumns({"_x": x, "_y": y})
    usable = F.col("_x").isNotNull() & F.col("_y").isNotNull()

    def third(value: str, low: float) -> Column:
        return F.when(F.col(value) < low, 1).when(F.col(value) >= low + size, 2).otherwise(0)

    facing = third("_x", west0) + 3 * third("_y", south0)
    points = points.withColumn("_out", F.when(usable, -facing).otherwise(NOWHERE))
    tries = F.when(F.col("_out") == 0, F.array(*[F.lit(d) for d in index.depths])).otherwise(F.array("_out"))
    keyed = points.withColumn("depth", F.explode(tries))
    side = F.lit(size) / F.pow(F.lit(float(FAN)), F.col("depth"))
    spread = F.monotonically_increasing_id()
    within = F.col("depth") >= 0
    cell = {
        "ix": F.when(within, F.floor((F.col("_x") - west0) / side)).when(F.col("depth") == NOWHERE, spread).otherwise(spread % SALTS),
        "iy": F.when(within, F.floor((F.col("_y") - south0) / side)).otherwise(F.lit(0).cast("long")),
    }
    keyed = keyed.withColumns(cell)
    table = F.broadcast(index.table) if index.entries <= BROADCAST_ENTRIES else index.table
    # A point beyond the root or without coordinates has one try and must stay without a hit.
    located = keyed.join(table, ["depth", "ix", "iy"], "left")
    located = located.filter(F.col("candidates").isNotNull() | (F.col("depth") < 0))
    k = F.expr(metric.scale("_y"))

    def entry(c: Column) -> Column:
        dx, dy = (c.fx - F.col("_x")) * k, c.fy - F.col("_y")
        return F.struct((dx * dx + dy * dy).alias("d2"), c.tie.alias("tie"))

    best = F.when(usable, F.array_min(F.transform("candidates", entry)))
    return (
        located.withColumn("_best", best)
        .withColumn(
            "nearest",
            F.when(
                F.col("_best").isNotNull(),
                F.struct(
                    (F.sqrt("_best.d2") * metric.unit).alias("distance"), F.col("_best.tie").alias("tie")
                ),
            ),
        )
        .drop("depth", "ix", "iy", "candidates", "_best", "_x", "_y", "_out")
    )


FACILITY_FIELDS = ["facility_id", "name", "sector", "district", "state", "match_radius_m", "lat", "lon"]


def with_rank(facilities: DataFrame) -> DataFrame:
    """Registry with its order column; by facility id where none is given."""
    if "registry_rank" in facilities.columns:
        return facilities
    return facilities.withColumn("registry_rank", F.col("facility_id").cast("string"))


def facility_index(facilities: DataFrame) -> CandidateIndex:
    """Planar index of a registry; build once and pass to several joins."""
    ranked = with_rank(facilities)
    x, y = geo.project(F.col("lat"), F.col("lon"))
    return build_index(ranked.withColumns({"_fx": x, "_fy": y}), "_fx", "_fy", "registry_rank", PLANAR)


# What the join adds to a table of sources.
NEAREST_COLUMNS = [
    "facility_id", "facility_name", "facility_sector", "district", "state", "facility_radius_m",
    "facility_lat", "facility_lon", "dist_facility_m",
]


def located(points: DataFrame, facilities: DataFrame, index: CandidateIndex | None = None) -> DataFrame:
    """``points`` with the columns of the nearest facility; as they are where a join has added them before."""
    if set(NEAREST_COLUMNS) <= set(points.columns):
        return points
    return nearest_facility(points, facilities, index=index)


def nearest_facility(
    points: DataFrame,
    facilities: DataFrame,
    lat: str = "centroid_lat",
    lon: str = "centroid_lon",
    max_dist_m: float | None = None,
    index: CandidateIndex | None = None,
) -> DataFrame:
    """Attach the nearest registry facility by projected distance.

    ``dist_facility_m`` is always the distance to the nearest one; the facility
    columns are null where it lies beyond its own radius (or the given or default
    one).  Equal distances go to the first registry row.
    """
    ranked = with_rank(facilities)
    index = index or facility_index(ranked)
    x, y = geo.project(F.col(lat), F.col(lon))
    located = attach_nearest(points, index, x, y)
    fields = [c for c in FACILITY_FIELDS if c in ranked.columns]
    details = ranked.select(
        F.col("registry_rank").alias("_tie"), F.struct(*fields).alias("_facility")
    )
    located = located.withColumn("_tie", F.col("nearest.tie")).join(details, "_tie", "left")
    default = K.DEFAULT_MATCH_RADIUS_M if max_dist_m is None else float(max_dist_m)
    own = F.col("_facility.match_radius_m") if "match_radius_m" in fields else F.lit(None).cast("double")
    distance = F.col("nearest.distance")
    within = distance <= F.coalesce(own, F.lit(default))

    def pick(name: str, kind: str = "string") -> Column:
        return F.when(within, F.col(f"_facility.{name}") if name in fields else F.lit(None)).cast(kind)

    return located.withColumns(
        {
            "facility_id": pick("facility_id"),
            "facility_name": pick("name"),
            "facility_sector": pick("sector"),
            "district": F.nullif(pick("district"), F.lit("")),
            "state": F.nullif(pick("state"), F.lit("")),
            "facility_radius_m": pick("match_radius_m", "double"),
            "facility_lat": pick("lat", "double"),
            "facility_lon": pick("lon", "double"),
            "dist_facility_m": distance,
        }
    ).drop("nearest", "_tie", "_facility")
