"""Bootstrap stability of medians, and convex hulls, by group."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsidia.functions.classify import building_stability_band, stability_band
from subsidia.operators.batches import group_starts, in_groups
from subsidia.session import materialize

#: Draws and seed; a group's seed adds the code points of its key.
DRAWS, SEED = 500, 17
#: Points of a group that one task takes at a time.
PER_PART = 100_000
#: Numbers drawn at a time, and points of a group up to which it is drawn with others.
HELD, SMALL = 2_000_000, 64

# What is kept of a building's draws, in Arrow and for Spark.
_SPREAD = pa.struct([(c, pa.float64()) for c in ("mean", "median", "p05", "p95", "ci_width")])
_TRACK = pa.struct([("points", pa.int64()), ("support", pa.float64()), ("width", pa.float64())])
_DRAWN = pa.schema([("building_id", pa.string()), ("tracks", pa.int64()), ("of_tracks", pa.list_(_TRACK)), ("motion_draws", _SPREAD), ("agreement_draws", _SPREAD)])
_SPREAD_SQL = "struct<mean:double,median:double,p05:double,p95:double,ci_width:double>"
_DRAWN_SQL = f"building_id string, tracks long, of_tracks array<struct<points:long,support:double,width:double>>, motion_draws {_SPREAD_SQL}, agreement_draws {_SPREAD_SQL}"


def key_seed(key: str, base: int = SEED) -> int:
    return base + sum(map(ord, key))


def bootstrap_medians(values: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Medians of samples with replacement of the same size; of a long array some draws are made at a time."""
    rng, n = np.random.default_rng(seed), len(values)
    step = max(1, HELD // n)
    return np.concatenate([np.median(values[rng.integers(0, n, size=(min(step, draws - i), n))], axis=1) for i in range(0, draws, step)])


@lru_cache(512)
def _drawn(n: int, draws: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, n, size=(draws, n)).astype(np.int16)


def medians_of_groups(values: np.ndarray, starts: np.ndarray, draws: int, seeds: list[int]) -> np.ndarray:
    """``bootstrap_medians`` of each group of ``values``, a row for each; small groups of one size go together."""
    sizes = np.diff(starts)
    out = np.empty((len(sizes), draws))
    for n in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == n)
        if n > SMALL:
            for g in of:
                out[g] = bootstrap_medians(values[starts[g] : starts[g + 1]], draws, seeds[g])
            continue
        for i in range(0, len(of), step := max(1, HELD // (n * draws))):
            some = of[i : i + step]
            own = values[starts[some][:, None] + np.arange(n)]
            drawn = np.stack([_drawn(n, draws, seeds[g]) for g in some])
            out[some] = np.median(np.take_along_axis(own[:, None, :], drawn.astype(np.intp), axis=2), axis=2)
    return out


def bootstrap_summary(rows: DataFrame, key: str, value: str, order: str, draws: int = DRAWS) -> DataFrame:
    """mean, median, std, p05, p95 and width of the bootstrap distribution of each group's median.

    Values are taken in the order of ``order``, so the result does not depend on
    how rows arrive.  Groups are the points of one cluster.
    """

    def summary(table: pa.Table, starts: np.ndarray) -> pa.Table:
        names = ["None" if k is None else k for k in table["k"].take(starts[:-1]).to_pylist()]
        m = medians_of_groups(table["v"].to_numpy(), starts, draws, [key_seed(k) for k in names])
        low, high = np.percentile(m, [5, 95], axis=1)
        return pa.table({"key": pa.array(names, pa.string()), "n": np.diff(starts).astype(np.int64), "mean": m.mean(1), "median": np.median(m, axis=1), "std": m.std(1), "p05": low, "p95": high, "ci_width": high - low})

    chosen = rows.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v"), F.col(order).alias("o"))
    return in_groups(chosen, ["k"], ["o"], summary, "key string, n long, mean double, median double, std double, p05 double, p95 double, ci_width double")


def _at(ordered: Column, q: float) -> Column:
    """Percentile of a sorted array by linear interpolation."""
    place = q * (F.size(ordered) - 1)
    low, high = F.get(ordered, F.floor(place).cast("int")), F.get(ordered, F.ceil(place).cast("int"))
    return low + (high - low) * (place - F.floor(place))


def distribution(values: Column) -> Column:
    """mean, median, p05, p95 and ci_width of an array; null if it is empty."""
    ordered = F.array_sort(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)
    return F.when(F.size(values) > 0, F.struct(mean.alias("mean"), _at(ordered, 0.5).alias("median"), _at(ordered, 0.05).alias("p05"), _at(ordered, 0.95).alias("p95"), (_at(ordered, 0.95) - _at(ordered, 0.05)).alias("ci_width")))


def building_distributions(draws: DataFrame, key: str, allowed: Column) -> DataFrame:
    """Motion and agreement of buildings from the bootstrap draws of their tracks, taken draw by draw.

    ``draws`` has one row for each key and track with an array of draws, all
    equally long.  A building's motion in a draw is the mean of its tracks';
    its agreement falls with their range over ``allowed`` (a quarter at least)
    and is there only for two tracks and more.
    """
    return _distributions(draws.groupBy(key).agg(F.collect_list("draws").alias("of_tracks"), F.count("*").alias("tracks")), key, allowed)


def _distributions(several: DataFrame, key: str, allowed: Column) -> DataFrame:
    each = F.transform(F.sequence(F.lit(0), F.size(F.get("of_tracks", F.lit(0))) - 1), lambda i: F.transform("of_tracks", lambda d: F.get(d, i)))
    rows = several.withColumn("by_draw", each)
    mean = F.transform("by_draw", lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v))
    agreement = F.transform("by_draw", lambda v: F.exp(-(F.array_max(v) - F.array_min(v)) / F.greatest(allowed, F.lit(0.25))))
    none = F.array().cast("array<double>")
    return rows.select(key, "tracks", distribution(mean).alias("motion"), distribution(F.when(F.col("tracks") >= 2, agreement).otherwise(none)).alias("agreement"))


def _spread(m: np.ndarray) -> dict[str, np.ndarray]:
    """``distribution`` of each row of ``m``."""
    ordered, n = np.sort(m, axis=1), m.shape[1]

    def at(q: float) -> np.ndarray:
        place = q * (n - 1)
        low, high = ordered[:, int(np.floor(place))], ordered[:, int(np.ceil(place))]
        return low + (high - low) * (place - np.floor(place))

    low, high = at(0.05), at(0.95)
    return {"mean": np.cumsum(m, axis=1)[:, -1] / n, "median": at(0.5), "p05": low, "p95": high, "ci_width": high - low}


def _drawn_buildings(table: pa.Table, starts: np.ndarray, draws: int) -> pa.Table:
    """What a building's draws come to: its tracks' points, support and width, and the spread of its motion and agreement."""
    valid = pc.is_valid(table["v"]).to_numpy()
    of_track = group_starts(table, ["building_id", "track"])[:-1]
    count = np.add.reduceat(valid.astype(np.int64), of_track)
    some = np.flatnonzero(count)
    if not len(some):
        return _DRAWN.empty_table()
    support = np.fmax.reduceat(table["support"].to_numpy(), of_track)[some]
    first = table.select(["building_id", "track", "allowed"]).take(of_track[some])
    seeds = [key_seed(f"{b}:{t}") for b, t in zip(first["building_id"].to_pylist(), first["track"].to_pylist())]
    m = medians_of_groups(table["v"].filter(pa.array(valid)).to_numpy(), np.append(0, np.cumsum(count[some])), draws, seeds)
    owner = np.searchsorted(starts, of_track[some], "right")
    at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    tracks = np.diff(np.append(at, len(owner)))
    several = tracks >= 2
    allowed = first["allowed"].to_numpy()[at]
    agreement = np.exp(-(np.maximum.reduceat(m, at) - np.minimum.reduceat(m, at))[several] / allowed[several, None])
    widths = pa.StructArray.from_arrays([pa.array(count[some]), pa.array(support, from_pandas=True), pa.array(_spread(m)["ci_width"])], fields=list(_TRACK))
    spread = lambda m: pa.StructArray.from_arrays([pa.array(v) for v in _spread(m).values()], fields=list(_SPREAD))
    found = spread(agreement).take(pa.array(np.where(several, np.cumsum(several) - 1, 0), mask=~several)) if several.any() else pa.nulls(len(at), _SPREAD)
    columns = [first["building_id"].take(at), pa.array(tracks), pa.ListArray.from_arrays(pa.array(np.append(at, len(owner)).astype(np.int32)), widths), spread(np.add.reduceat(m, at) / tracks[:, None]), found]
    return pa.Table.from_arrays(columns, schema=_DRAWN)


def building_stability(points: DataFrame, buildings: DataFrame, draws: int = DRAWS) -> DataFrame:
    """Stability of buildings under resampling of their main clusters' points.

    ``points`` are those of main clusters with building_id, track, code,
    vertical and ``support``, their share of the track's kept points;
    ``buildings`` has status, motion, agreement, reliability, differential,
    reliable clusters and the allowed difference.  Notes name what does not fit
    together.
    """
    rows = points.join(buildings.select("building_id", F.greatest("allowed", F.lit(0.25)).alias("allowed")), "building_id")
    rows = rows.select(F.col("building_id").cast("string").alias("building_id"), "track", F.col("vertical").cast("double").alias("v"), F.col("support").cast("double").alias("support"), "allowed", F.col("code").alias("o"))
    drawn = in_groups(rows, ["building_id"], ["track", "o"], lambda table, starts: _drawn_buildings(table, starts, draws), _DRAWN_SQL)
    bands = F.sort_array(F.transform("of_tracks", lambda t: stability_band(t["points"], t["support"], t["width"])))
    out = drawn.withColumn("bands", bands).join(buildings, "building_id")
    width, high = F.col("motion_draws.ci_width"), F.col("reliability") >= 0.75
    error = F.abs(F.col("motion_draws.median") - F.col("motion"))
    notes = F.array_compact(F.array(
        F.when(error > 0.35, F.format_string("Bootstrap median is %.2f mm a year from the stored motion.", error)),
        F.when(high & (width > 1.0), "High reliability with a wide bootstrap interval."),
        F.when(high & F.array_contains("bands", "unstable"), "High reliability with an unstable track."),
        F.when((F.col("agreement") < 0.25) & (F.col("status") == "ok"), "Status ok at very low agreement of tracks."),
        F.when(F.col("status").isin("small_n", "insufficient_support"), "Small sample: bootstrap values are diagnostic only."),
        F.when(F.col("differential") & (F.col("reliable_clusters") < 3), "Differential motion from few reliable clusters."),
    ))
    return out.select("building_id", "tracks", "bands", "motion_draws", "agreement_draws", building_stability_band(F.col("bands"), width, F.col("agreement_draws.ci_width")).alias("band"), notes.alias("notes"))


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Hull from the lowest left point, counter-clockwise."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def cluster_hulls(points: DataFrame, keys: list[str]) -> DataFrame:
    """Number of points and hull vertices of each group.

    The hull of a large group is that of the hulls of its parts, each of about
    ``PER_PART`` points, so no task holds such a group whole.
    """

    types, vertex = dict(points.dtypes), pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def hull(table: pa.Table, starts: np.ndarray) -> pa.Table:
        x, y, at = table["x_m"].to_pylist(), table["y_m"].to_pylist(), starts.tolist()
        found = [[{"x": x, "y": y} for x, y in convex_hull(list(zip(x[a:b], y[a:b])))] for a, b in zip(at, at[1:])]
        n = np.add.reduceat(table["n"].to_numpy(), starts[:-1])
        return table.select([*keys, "part"]).take(starts[:-1]).append_column("points", pa.array(n, pa.int64())).append_column("hull", pa.array(found, vertex))

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", part long, points long, hull array<struct<x:double,y:double>>"
    rows = points.dropna(subset=keys).select(*keys, F.col("x_m").cast("double").alias("x_m"), F.col("y_m").cast("double").alias("y_m"), F.lit(1).cast("long").alias("n"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("points"))
    large = counts.where(F.col("points") > PER_PART).select(*keys, F.ceil(F.col("points") / PER_PART).alias("parts"))
    rows = rows.join(F.broadcast(large), keys, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("x_m", "y_m"), F.col("parts")), F.lit(-1).cast("long"))).drop("parts")
    parts = materialize(in_groups(rows, [*keys, "part"], [], hull, schema), "hulls")
    # A part's count goes with the first vertex of its hull.
    corners = parts.where("part >= 0").select(*keys, F.lit(-1).cast("long").alias("part"), "points", F.posexplode("hull").alias("at", "h"))
    corners = corners.select(*keys, "part", F.col("h.x").alias("x_m"), F.col("h.y").alias("y_m"), F.when(F.col("at") == 0, F.col("points")).otherwise(F.lit(0)).cast("long").alias("n"))
    return parts.where("part < 0").unionByName(in_groups(corners, [*keys, "part"], [], hull, schema)).select(*keys, "points", "hull")
