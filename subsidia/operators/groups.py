"""Features of a point within its building and track, gates, and the fallback for small groups.

Input rows have building_id, track, code and the measures; a group is the rows
of one building and track.  ``tasks`` is the number of tasks among which groups
are dealt, where it is known; else the rows are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subsidia.operators.nearest import nearest_mean
from subsidia.session import dealt

GROUP = ["building_id", "track"]


def height_ranks(points: DataFrame, *, tasks: int | None = None) -> DataFrame:
    """Rank of height in the group from 0 to 1, ties by code; 0.5 where the height is missing or alone."""
    known = F.col("height").isNotNull()
    by_height = Window.partitionBy(*GROUP, known).orderBy("height", "code")
    n = F.count("height").over(Window.partitionBy(*GROUP))
    rank = (F.row_number().over(by_height) - 1) / F.greatest(n - 1, F.lit(1))
    return dealt(points, *GROUP, tasks=tasks).withColumn("height_rank", F.when(known & (n >= 2), rank).otherwise(F.lit(0.5)))


def local_density(points: DataFrame) -> DataFrame:
    """exp(-d / 6) for the mean distance d to the three nearest points of the group; 0 for a point alone."""
    mean = nearest_mean(points, GROUP, 3)
    met = points.join(mean, [*GROUP, "x_m", "y_m"], "left")
    return met.withColumn("local_density", F.coalesce(F.exp(-F.col("mean_distance") / 6), F.lit(0.0))).drop("mean_distance")


def step_support(points: DataFrame, stats: DataFrame, *, tasks: int | None = None) -> DataFrame:
    """Share of the group's other points with a like step: same sign, index at most one apart, 0.75 of the track's p90.

    Counted by a range window over step indexes, so no pairs are made.  A step
    below the p90 needs no support (1); without others or a step it has none.
    """
    rows = dealt(points, *GROUP, tasks=tasks).join(F.broadcast(stats.select("track", "step_p90")), "track")
    strong = F.col("step_index").isNotNull() & (F.col("step_abs") >= 0.75 * F.col("step_p90"))
    rows = rows.withColumn("strong", strong)
    near = Window.partitionBy(*GROUP, "step_sign").orderBy("step_index").rangeBetween(-1, 1)
    matches = F.sum(F.col("strong").cast("int")).over(near) - F.col("strong").cast("int")
    n = F.count("*").over(Window.partitionBy(*GROUP))
    support = F.when(F.col("step_abs") < F.col("step_p90"), F.lit(1.0)).when((n <= 1) | F.col("step_index").isNull(), F.lit(0.0)).otherwise(matches / F.greatest(n - 1, F.lit(1)))
    return rows.withColumn("step_support", support).drop("strong", "step_p90")


def _robust(rows: DataFrame, names: list[str]) -> DataFrame:
    """Median and scaled median absolute deviation of columns by group, as ``<name>_median`` and ``<name>_mad``."""
    group = Window.partitionBy(*GROUP)
    rows = rows.withColumns({f"{n}_median": F.median(n).over(group) for n in names})
    return rows.withColumns({f"{n}_mad": 1.4826 * F.median(F.abs(F.col(n) - F.col(f"{n}_median"))).over(group) for n in names})


def local_deviation(points: DataFrame) -> DataFrame:
    """How far a point lies from its group: the largest of its robust deviations, height edge and coherence gap, in 0..1."""
    parts = {"velocity": (3.5, 0.5), "acceleration": (3.5, 0.5), "step_abs": (3.0, 0.75), "along_m": (4.0, 0.5), "cross_m": (4.0, 0.5)}
    rows = _robust(points.withColumn("acceleration", F.coalesce("acceleration", F.lit(0.0))), list(parts))
    z = [F.abs(F.col(n) - F.col(f"{n}_median")) / F.greatest(F.col(f"{n}_mad"), F.lit(floor)) / scale for n, (scale, floor) in parts.items()]
    edge = F.abs(F.col("height_rank") - 0.5) * 1.4
    gap = F.greatest(F.lit(0.0), (0.65 - F.coalesce("coherence", F.lit(0.65))) / 0.65)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(*z, edge, gap)))
    return rows.withColumn("local_deviation", score).drop(*[f"{n}_{k}" for n in parts for k in ("median", "mad")])


def gate_reasons(*, min_epochs: int = 24, min_ratio: float = 0.50, coherence_floor: float = 0.45) -> Column:
    """Ordered reasons for which a point is excluded; needs building_id, epochs, total_dates, coherence and coherence_p05."""
    return F.array_compact(F.array(
        F.when(F.col("building_id").isNull(), "no_building_assignment"),
        F.when(F.col("epochs") < min_epochs, "too_few_valid_epochs"),
        F.when(F.col("epochs") / F.greatest("total_dates", F.lit(1)) < min_ratio, "too_sparse_timeseries"),
        F.when(F.coalesce("coherence", F.lit(0.0)) < F.greatest(F.lit(coherence_floor), F.col("coherence_p05")), "low_coherence"),
    ))


def apply_gates(points: DataFrame, stats: DataFrame, *, tasks: int | None = None, **limits) -> DataFrame:
    """Points with their reasons, the first one, and the share of their group that is kept.

    Points without a building have no group: nothing of it is kept, and they are in no window and in no shuffle.
    """
    grouped = group_gates(points.where("building_id IS NOT NULL"), stats, tasks=tasks, **limits)
    return grouped.unionByName(lone_gates(points.where("building_id IS NULL"), stats, **limits))


def _gated(points: DataFrame, stats: DataFrame, **limits) -> DataFrame:
    rows = points.join(F.broadcast(stats.select("track", "coherence_p05")), "track").withColumn("reasons", gate_reasons(**limits))
    return rows.withColumns({"excluded": F.size("reasons") > 0, "degraded_reason": F.get("reasons", F.lit(0))}).drop("coherence_p05")


def group_gates(points: DataFrame, stats: DataFrame, *, tasks: int | None = None, **limits) -> DataFrame:
    """``apply_gates`` of points that have a building; points that are dealt by group already are not moved."""
    rows, group = _gated(dealt(points, *GROUP, tasks=tasks), stats, **limits), Window.partitionBy(*GROUP)
    kept = F.sum((~F.col("excluded")).cast("int")).over(group)
    return rows.withColumns({"kept_points": kept, "kept_ratio": kept / F.count("*").over(group)})


def lone_gates(points: DataFrame, stats: DataFrame, **limits) -> DataFrame:
    """``apply_gates`` of points without a building."""
    return _gated(points, stats, **limits).withColumns({"kept_points": F.lit(0).cast("bigint"), "kept_ratio": F.lit(0.0)})


def small_group_roles(points: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Roles of kept points in groups of up to five, by local deviation.

    Groups of one or two lack support.  In groups of three to five, points up
    to the threshold are core, or else the one of least deviation (ties by
    code); core points have probability 1 - s within 0.05..0.95.
    """
    group = Window.partitionBy(*GROUP)
    n, least = F.count("*").over(group), F.row_number().over(group.orderBy("local_deviation", "code")) == 1
    none = F.min("local_deviation").over(group) > threshold
    rows = points.withColumns({"kept_points": n, "forced": least & none})
    small = F.col("kept_points") < 3
    core = (F.col("local_deviation") <= threshold) | F.col("forced")
    prefix = F.concat("building_id", F.lit(":t"), F.col("track").cast("string"))
    return rows.where("kept_points <= 5").withColumns({
        "role": F.when(small, "insufficient_support").when(core, "core").otherwise("noise"),
        "cluster_id": F.when(small, F.concat(prefix, F.lit(":insufficient_support"))).when(core, F.concat(prefix, F.lit(":cluster_0"))).otherwise(F.concat(prefix, F.lit(":noise"))),
        "probability": F.when(small, F.lit(0.5)).when(core, F.greatest(F.lit(0.05), F.least(F.lit(0.95), 1 - F.col("local_deviation")))).otherwise(F.lit(0.05)),
        "outlier": F.col("local_deviation"),
    }).drop("forced")
