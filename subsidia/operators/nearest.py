"""Distances to the nearest points of the same group, without pairs of all its points.

A group's box is halved again and again into cells.  A place looks at the
finest level at which its own cell holds more points than it needs: these are
at most a cell's diagonal away, so all nearest ones lie within two cells around
it, and only those are joined.  A small group is one cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsidia.session import materialize

#: Groups of so many places are one cell.
SMALL = 32


def nearest_mean(points: DataFrame, group: list[str], k: int) -> DataFrame:
    """(group, x_m, y_m, mean_distance): of each place the mean distance to the ``k`` nearest other points of its group, or to all if fewer.

    Points at one place count each, at distance 0 from one another.  A point
    alone in its group has no mean.  Rows without a group or position are left
    out.
    """
    known = points.dropna(subset=[*group, "x_m", "y_m"])
    places = materialize(known.groupBy(*group, "x_m", "y_m").agg(F.count("*").alias("m")), "places")
    boxes = places.groupBy(*group).agg(F.count("*").alias("places"), F.sum("m").alias("points"), *[f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in ("x_m", "y_m")])
    side = F.greatest(F.col("high_x_m") - F.col("low_x_m"), F.col("high_y_m") - F.col("low_y_m")) * (1 + 1e-9) + 1e-9
    deepest = F.when(F.col("places") <= SMALL, F.lit(0)).otherwise(F.ceil(F.log2(F.col("places").cast("double")) / 2).cast("int") + 4)
    rows = places.join(boxes.select(*group, "points", side.alias("side"), F.col("low_x_m").alias("x0"), F.col("low_y_m").alias("y0"), deepest.alias("deepest")), group)
    cell = lambda c, low: F.floor((F.col(c) - F.col(low)) / F.col("side") * F.pow(F.lit(2.0), F.col("level"))).cast("int")
    levels = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("deepest")))).withColumns({"cx": cell("x_m", "x0"), "cy": cell("y_m", "y0")})
    at = [*group, "level", "cx", "cy"]
    # A level where the own cell holds fewer points than needed is too fine; the whole group is the coarsest.
    full = levels.where("level > 0").groupBy(*at).agg(F.sum("m").alias("held")).where(F.col("held") > k)
    finest = levels.join(full, at).groupBy(*group, "x_m", "y_m").agg(F.max("level").alias("level"))
    chosen = rows.join(finest, [*group, "x_m", "y_m"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    chosen = chosen.withColumns({"cx": cell("x_m", "x0"), "cy": cell("y_m", "y0"), "last": F.pow(F.lit(2.0), F.col("level")).cast("int") - 1})
    around = lambda c: F.explode(F.sequence(F.greatest(F.col(c) - 2, F.lit(0)), F.least(F.col(c) + 2, F.col("last"))))
    asking = chosen.select(*group, "level", F.col("x_m").alias("x"), F.col("y_m").alias("y"), around("cx").alias("cx"), "cy", "last").withColumn("cy", around("cy"))
    near = asking.join(levels.select(*at, "x_m", "y_m", "m"), at).withColumn("d", F.hypot(F.col("x") - F.col("x_m"), F.col("y") - F.col("y_m")))
    near = near.withColumn("m", F.when((F.col("x") == F.col("x_m")) & (F.col("y") == F.col("y_m")), F.col("m") - 1).otherwise(F.col("m"))).where("m > 0")
    best = near.groupBy(*group, F.col("x").alias("x_m"), F.col("y").alias("y_m")).agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "m"))), 1, k).alias("best"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("bigint").alias("n"))

    def add(s, b):
        taken = F.least(b["m"], F.lit(k) - s["n"])
        return F.struct((s["sum"] + b["d"] * taken).alias("sum"), (s["n"] + taken).alias("n"))

    return best.select(*group, "x_m", "y_m", F.aggregate("best", start, add, lambda s: s["sum"] / s["n"]).alias("mean_distance"))
