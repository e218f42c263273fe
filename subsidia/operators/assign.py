"""Assignment of points to buildings, and other joins by distance, over grid cells.

Two sides that can only match within a distance are put on a grid: buildings
go to every cell that their box, grown by the distance, touches, and points to
their own cell.  The join is then an equality on cells; the exact predicate
follows.  No pair further apart than a cell and the distance is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subsidia.functions.geo import box_distance, range_offset, rings_box, rings_gap
from subsidia.functions.geodesy import metres_per_degree
from subsidia.operators.measure import with_distances
from subsidia.session import dealt, task_count

CELL = 50.0
#: Buildings, and points, whose cells and pairs are one task's work.
BUILDINGS, POINTS = 20_000, 50_000


def _cell(x: Column, cell: float) -> Column:
    return F.floor(x / cell)


def with_cells(rows: DataFrame, low_x: Column, low_y: Column, high_x: Column, high_y: Column, cell: float = CELL) -> DataFrame:
    """One row for each cell that the box of a row touches."""
    out = rows.withColumn("cell_x", F.explode(F.sequence(_cell(low_x, cell), _cell(high_x, cell))))
    return out.withColumn("cell_y", F.explode(F.sequence(_cell(low_y, cell), _cell(high_y, cell))))


def met_in_cells(points: DataFrame, cells: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """Points joined with what lies in their cell; both are dealt by cell, since cells are many more bytes than the table they are made from."""
    return dealt(points, *keys, tasks=tasks).join(dealt(cells, *keys, tasks=tasks).hint("merge"), keys)


def near_buildings(buildings: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """Buildings whose box lies within ``reach`` of the box of all points; one row of bounds reaches the driver."""
    box = points.agg(*[f(c) for c in ("x_m", "y_m") for f in (F.min, F.max)]).first()
    if box[0] is None:
        return buildings.limit(0)
    apart = lambda c, h, low, high: (F.col(c) + F.col(h) < low - reach) | (F.col(c) - F.col(h) > high + reach)
    return buildings.where(~(apart("cx", "hw", box[0], box[1]) | apart("cy", "hh", box[2], box[3])))


def with_boxes(buildings: DataFrame) -> DataFrame:
    """Buildings given by ``rings`` with the box (cx, cy, hw, hh) around them; those without a ring are dropped."""
    box = buildings.where(F.size("rings") > 0).withColumn("box", rings_box(F.col("rings")))
    half = lambda a, b: (F.col(f"box.{b}") - F.col(f"box.{a}")) / 2
    middle = lambda a, b: (F.col(f"box.{b}") + F.col(f"box.{a}")) / 2
    return box.withColumns({"cx": middle("x0", "x1"), "cy": middle("y0", "y1"), "hw": half("x0", "x1"), "hh": half("y0", "y1")}).drop("box")


def assign_buildings(points: DataFrame, buildings: DataFrame, tracks: DataFrame, *, max_distance: float = 15.0, slack: float = 2.0, low: float = 3.0, high: float = 30.0, multiplier: float = 1.0) -> DataFrame:
    """At most one building for each point.

    Candidates by priority: buildings that cover the point (0); those within
    ``slack`` of it or of the point shifted back by the roof's range offset
    (1); those within ``max_distance`` (2).  Then the nearest, then the smaller
    building id.  Points come with code, track, x_m, y_m and incidence_angle;
    buildings with a box (cx, cy, hw, hh) and height, and, where they are
    polygons, with ``rings`` inside the box; tracks with the range vector and
    default incidence.  Points without a candidate have nulls.  Cells are found
    by the box; the rings are measured only for pairs that the box allows.
    """
    reach = F.lit(max(high + slack, max_distance))
    cells = with_cells(buildings, F.col("cx") - F.col("hw") - reach, F.col("cy") - F.col("hh") - reach, F.col("cx") + F.col("hw") + reach, F.col("cy") + F.col("hh") + reach)
    rings = ["rings"] if "rings" in buildings.columns else []
    cells = cells.select("cell_x", "cell_y", F.col("building_id").alias("candidate"), "cx", "cy", "hw", "hh", F.col("height").alias("building_height"), *rings)
    rows = points.drop("building_id").join(F.broadcast(tracks.select("track", "default_incidence_deg", "range_dx", "range_dy")), "track")
    placed = rows.withColumns({"cell_x": _cell(F.col("x_m"), CELL), "cell_y": _cell(F.col("y_m"), CELL)})
    offset = range_offset(F.col("building_height"), F.coalesce("incidence_angle", "default_incidence_deg"), multiplier=multiplier, low=low, high=high)
    met = met_in_cells(placed, cells, ["cell_x", "cell_y"], max(task_count(buildings, BUILDINGS), task_count(points, POINTS))) if rings else placed.join(cells, ["cell_x", "cell_y"])
    pairs = met.withColumn("range_offset_m", offset)
    pairs = pairs.withColumns({"back_x": F.col("x_m") - F.col("range_dx") * F.col("range_offset_m"), "back_y": F.col("y_m") - F.col("range_dy") * F.col("range_offset_m")})
    apart = lambda x, y: box_distance(F.col(x), F.col(y), F.col("cx"), F.col("cy"), F.col("hw"), F.col("hh"))
    pairs = pairs.withColumns({"distance_m": apart("x_m", "y_m"), "shifted_m": apart("back_x", "back_y")})
    if rings:
        # A polygon is never nearer than its box.
        pairs = pairs.where((F.col("distance_m") <= max_distance) | (F.col("shifted_m") <= slack))
        back = lambda c: F.when(F.col("shifted_m") <= slack, F.col(c)).alias(c)
        pairs = pairs.select("code", "track", "candidate", "range_offset_m", "building_height", "cx", "cy", "x_m", "y_m", back("back_x"), back("back_y"), "rings")
        pairs = with_distances(pairs, {"distance_m": ("x_m", "y_m"), "shifted_m": ("back_x", "back_y")})
    priority = F.when(F.col("distance_m") == 0, 0).when((F.col("distance_m") <= slack) | (F.col("shifted_m") <= slack), 1).when(F.col("distance_m") <= max_distance, 2)
    pairs = pairs.withColumn("priority", priority).where("priority IS NOT NULL")
    best = pairs.groupBy("code", "track").agg(F.min(F.struct("priority", "distance_m", "candidate", "range_offset_m", "building_height", "cx", "cy")).alias("b"))
    method = F.element_at(F.array(F.lit("within"), F.lit("directional_buffer"), F.lit("nearest")), F.col("b.priority") + 1)
    buffer = F.when(F.col("b.priority") == 1, F.col("b.range_offset_m") + slack).when(F.col("b.priority") == 2, F.lit(max_distance))
    best = best.select("code", "track", F.col("b.candidate").alias("building_id"), F.when(F.col("b.priority").isNotNull(), method).alias("method"), F.col("b.distance_m").alias("distance_m"), buffer.alias("buffer_m"), F.col("b.range_offset_m").alias("range_offset_m"), F.col("b.cx").alias("building_x"), F.col("b.cy").alias("building_y"))
    return rows.drop("method", "default_incidence_deg", "range_dx", "range_dy").join(best, ["code", "track"], "left")


def box_gap(a: str, b: str) -> Column:
    """Distance between two boxes."""
    gap = lambda c, h: F.greatest(F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) - F.col(f"{a}.{h}") - F.col(f"{b}.{h}"), F.lit(0.0))
    return F.sqrt(gap("cx", "hw") ** 2 + gap("cy", "hh") ** 2)


def adjacent_buildings(buildings: DataFrame, distance: float = 5.0) -> DataFrame:
    """Pairs (a, b), a < b, of one area's buildings at most ``distance`` apart.

    Where buildings have ``rings``, these are measured, for the pairs whose
    boxes are near enough.
    """
    reach = distance / 2
    cells = with_cells(buildings, F.col("cx") - F.col("hw") - reach, F.col("cy") - F.col("hh") - reach, F.col("cx") + F.col("hw") + reach, F.col("cy") + F.col("hh") + reach)
    pairs = cells.alias("l").join(cells.alias("r"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("cell_x", "cell_y", "area_id")]).where("l.building_id < r.building_id")
    near = pairs.where(box_gap("l", "r") <= distance)
    rings = ["rings"] if "rings" in buildings.columns else []
    # A pair meets in several cells; it is measured in the first that both touch.
    first = lambda c, h: _cell(F.greatest(F.col(f"l.{c}") - F.col(f"l.{h}"), F.col(f"r.{c}") - F.col(f"r.{h}")) - reach, CELL)
    once = near.where((F.col("l.cell_x") == first("cx", "hw")) & (F.col("l.cell_y") == first("cy", "hh")))
    if rings:
        once = once.where(rings_gap(F.col("l.rings"), F.col("r.rings")) <= distance)
    return once.select(F.col("l.area_id").alias("area_id"), F.col("l.building_id").alias("a"), F.col("r.building_id").alias("b"))


def _band_width(band: Column, height: float, reach: float) -> Column:
    """Width in degrees of the cells of a band of latitude: ``reach`` metres at its side towards the pole."""
    edge = F.least(F.greatest(F.abs(band * height), F.abs((band + 1) * height)), F.lit(89.9))
    return F.lit(reach) / metres_per_degree(edge)[0]


def assign_geography(points: DataFrame, buildings: DataFrame, max_distance: float = 15.0) -> DataFrame:
    """(code, track, building_id, distance_m): the nearest building of each point within a distance on the spheroid.

    Points have lon and lat, buildings ``rings`` in degrees.  Cells are bands
    of latitude, each divided into widths that follow its latitude, at least
    ``max_distance`` metres; a building goes to all cells that its box, grown
    by the distance, touches.  Ties go to the smaller id; points without a
    building in reach are left out.
    """
    height = max_distance / 110_000
    band = lambda lat: F.floor(lat / height)
    tasks = max(task_count(buildings, BUILDINGS), task_count(points, POINTS))
    box = buildings.where(F.size("rings") > 0).withColumn("box", rings_box(F.col("rings")))
    rows = box.withColumn("cell_y", F.explode(F.sequence(band(F.col("box.y0") - height), band(F.col("box.y1") + height))))
    width = _band_width(F.col("cell_y"), height, max_distance)
    # The distance is less than a cell's width anywhere in the band, so a cell on either side is enough.
    rows = rows.withColumn("cell_x", F.explode(F.sequence(F.floor(F.col("box.x0") / width) - 1, F.floor(F.col("box.x1") / width) + 1)))
    rows = rows.select("cell_x", "cell_y", F.col("building_id").alias("candidate"), "box", "rings")
    kx, ky = metres_per_degree(F.col("lat"))
    placed = points.select("code", "track", "lon", "lat", kx.alias("kx"), ky.alias("ky"), band(F.col("lat")).alias("cell_y")).withColumn("cell_x", F.floor(F.col("lon") / _band_width(F.col("cell_y"), height, max_distance)))
    # A polygon is never nearer than its box, in the same measure.
    off = lambda c, low, high, k: F.greatest(F.col(low) - F.col(c), F.col(c) - F.col(high), F.lit(0.0)) * F.col(k) <= max_distance + 1e-6
    near = met_in_cells(placed, rows, ["cell_x", "cell_y"], tasks).where(off("lon", "box.x0", "box.x1", "kx") & off("lat", "box.y0", "box.y1", "ky"))
    met = with_distances(near.select("code", "track", "candidate", "lon", "lat", "kx", "ky", "rings"), {"distance_m": ("lon", "lat", "kx", "ky")}).where(F.col("distance_m") <= max_distance)
    return met.groupBy("code", "track").agg(F.min(F.struct("distance_m", "candidate")).alias("b")).select("code", "track", F.col("b.candidate").alias("building_id"), "b.distance_m")


def neighbour_candidates(buildings: DataFrame, radius: float = 25.0, most: int = 8) -> DataFrame:
    """Up to ``most`` other buildings within ``radius`` of each one's position, nearest first, then by id."""
    tasks = task_count(buildings, BUILDINGS)
    own = buildings.select(F.col("building_id"), F.col("cx").alias("x"), F.col("cy").alias("y"), _cell(F.col("cx"), radius).alias("cell_x"), _cell(F.col("cy"), radius).alias("cell_y"))
    around = with_cells(buildings.select(F.col("building_id").alias("neighbour_id"), F.col("cx").alias("nx"), F.col("cy").alias("ny")), F.col("nx") - radius, F.col("ny") - radius, F.col("nx") + radius, F.col("ny") + radius, radius)
    own, around = (dealt(df, "cell_x", "cell_y", tasks=tasks) for df in (own, around))
    near = own.join(around.hint("merge"), ["cell_x", "cell_y"]).where("building_id <> neighbour_id").withColumn("distance_m", F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))).where(F.col("distance_m") <= radius)
    ranked = dealt(near, "building_id", tasks=tasks).withColumn("rank", F.row_number().over(Window.partitionBy("building_id").orderBy("distance_m", "neighbour_id")))
    return ranked.where(F.col("rank") <= most).select("building_id", "neighbour_id", "distance_m", "rank")
