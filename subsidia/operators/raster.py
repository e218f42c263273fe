"""Polygons on a raster: every cell that a polygon touches, and statistics of the cells by polygon.

Cells are squares, counted from a corner in the north-west: column
``floor((x - x0) / cell)``, row ``floor((y0 - y) / cell)``.  A cell holds its
western and northern border and not the others.  A polygon touches the cells
its edges pass through, those of holes included, and the cells inside, whose
middle lies in it by even-odd parity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsidia.functions.geo import ring_edges
from subsidia.session import dealt, task_count

#: Shapes whose cells are one task's work, as a rule some hundred thousand.
SHAPES = 10_000


def _spans(edges: DataFrame) -> DataFrame:
    """(zone, order, row, low, high): the columns that an edge (ax, ay, bx, by), in cells, passes through in each of its rows."""
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = edges.withColumn("row", F.explode(F.sequence(F.floor(low), F.floor(high))))
    flat = F.col("ay") == F.col("by")

    def at(y: Column) -> Column:
        """x of the edge at a height, held to its ends so that rounding leaves no cell."""
        x = F.col("ax") + (y - F.col("ay")) / F.when(flat, F.lit(1.0)).otherwise(F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
        return F.greatest(F.least("ax", "bx"), F.least(F.greatest("ax", "bx"), x))

    first, last = at(F.greatest(low, F.col("row").cast("double"))), at(F.least(high, F.col("row") + 1.0))
    left = F.when(flat, F.least("ax", "bx")).otherwise(F.least(first, last))
    right = F.when(flat, F.greatest("ax", "bx")).otherwise(F.greatest(first, last))
    return rows.select("zone", "order", "row", F.floor(left).alias("low"), F.floor(right).alias("high"))


def _filled(edges: DataFrame) -> DataFrame:
    """(zone, order, row, low, high): the columns whose middles lie inside, row by row.

    Edges that cross the middle of a row bound its spans by turns, holes too.
    """
    first = F.ceil(F.least("ay", "by") - 0.5)
    last = F.ceil(F.greatest("ay", "by") - 0.5) - 1
    rows = edges.where(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    x = F.col("ax") + (F.col("row") + 0.5 - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    crossed = rows.select("zone", "order", "row", x.alias("x")).groupBy("zone", "order", "row").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    spans = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda k: F.struct(F.ceil(F.get("xs", 2 * k) - 0.5).alias("low"), (F.ceil(F.get("xs", 2 * k + 1) - 0.5) - 1).alias("high")))
    return crossed.where(F.size("xs") >= 2).select("zone", "order", "row", F.explode(spans).alias("s")).select("zone", "order", "row", "s.low", "s.high").where("low <= high")


def touched_cells(shapes: DataFrame, x0: float, y0: float, cell: float, *, order: str | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """(row, col, zone): for each cell that polygons touch the last of them by ``order``, or else by ``zone``.

    ``shapes`` has zone and ``polygons``, an array of polygons of rings, or
    ``rings``, those of one.  ``size`` (rows, columns) cuts off what lies
    outside the raster.  Shapes without a ring touch nothing.  Edges are rows,
    and so are their cells row by row, so a large polygon is many tasks' work.
    Shapes are dealt before they become cells, by their number, and cells after
    it, so no task's table of cells grows with the input.
    """
    polygons = F.col("polygons") if "polygons" in shapes.columns else F.array("rings")
    tasks = task_count(shapes, SHAPES)
    rings = dealt(shapes.select("zone", F.col(order or "zone").alias("order"), polygons.alias("polygons")), "zone", tasks=tasks)
    rings = rings.select("zone", "order", F.explode(F.flatten("polygons")).alias("ring")).where(F.size("ring") > 0)
    place = lambda p: ((p["x"] - x0) / cell, (y0 - p["y"]) / cell)
    edges = rings.select("zone", "order", F.explode(ring_edges(F.col("ring"))).alias("e"))
    (ax, ay), (bx, by) = place(F.col("e.a")), place(F.col("e.b"))
    edges = edges.select("zone", "order", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    spans = _spans(edges).unionByName(_filled(edges))
    if size is not None:
        spans = spans.where(F.col("row").between(0, size[0] - 1)).withColumns({"low": F.greatest("low", F.lit(0)), "high": F.least("high", F.lit(size[1] - 1))}).where("low <= high")
    cells = spans.select("row", F.explode(F.sequence("low", "high")).alias("col"), F.struct("order", "zone").alias("last"))
    return dealt(cells, "row", "col", tasks=tasks).groupBy("row", "col").agg(F.max("last").alias("last")).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "last.zone")


def terrain_of_zones(shapes: DataFrame, grid: DataFrame, x0: float, y0: float, cell: float, values: dict[str, list[str]], *, order: str | None = None) -> DataFrame:
    """Shapes with statistics of the raster cells they touch, and those without a cell with the value at their inner point.

    ``values`` names for each column of ``grid`` (row, col and values) the
    statistics wanted: mean, min, max, range.  Both sides of each join grow with
    the input, so none goes through the driver.  Results are ``<value>_<name>``;
    a shape that meets no cell with a value takes the value of the cell that
    holds (inner_x, inner_y), for range 0.
    """
    of = {"mean": F.avg, "min": F.min, "max": F.max, "range": lambda c: F.max(c) - F.min(c)}
    cells = touched_cells(shapes, x0, y0, cell, order=order)
    first = next(iter(values))
    stats = cells.join(grid.where(F.col(first).isNotNull()).hint("merge"), ["row", "col"]).groupBy("zone").agg(*[of[n](v).alias(f"{v}_{n}") for v, ns in values.items() for n in ns])
    here = shapes.select("zone", F.floor((F.col("inner_x") - x0) / cell).cast("int").alias("col"), F.floor((y0 - F.col("inner_y")) / cell).cast("int").alias("row"))
    here = here.join(grid.hint("merge"), ["row", "col"], "left").select("zone", *[F.col(v).alias(f"here_{v}") for v in values])
    met = shapes.join(stats.hint("merge"), "zone", "left").join(here.hint("merge"), "zone", "left")
    return met.withColumns({f"{v}_{n}": F.coalesce(f"{v}_{n}", F.lit(0.0) if n == "range" else F.col(f"here_{v}")) for v, ns in values.items() for n in ns}).drop(*[f"here_{v}" for v in values])
