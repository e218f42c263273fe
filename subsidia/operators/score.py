"""Scores, labels and explanations of points, pair scores of clusters, and a run's metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsidia.functions.classify import quality_label

#: Least scales of the cluster fit by feature, and the features' weights.
FIT = {"vertical": (0.75, 0.40), "along_m": (0.50, 0.20), "cross_m": (0.50, 0.15), "height_rank": (0.10, 0.10), "step_abs": (0.75, 0.15)}


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _reasons() -> list[tuple[str, Column, Column, float | None]]:
    """Rules as (key, test, severity, weight); the severities of assignment rules are their penalty."""
    over = lambda x, p, floor: F.least(F.lit(1.0), (F.col(x) - F.col(p)) / F.greatest(F.col(p), F.lit(floor)))
    return [
        ("nearest_assignment", F.col("method") == "nearest", F.lit(0.20), None),
        ("directional_assignment", F.col("method") == "directional_buffer", F.lit(0.05), None),
        ("high_velocity_std", (F.col("velocity_std_p95") > 1e-9) & (F.coalesce("velocity_std", F.lit(0.0)) > F.col("velocity_std_p95")), over("velocity_std", "velocity_std_p95", 0.25), 0.20),
        ("unstable_amplitude", F.col("amp_cv").isNotNull() & (F.col("amp_cv_p95") > 1e-9) & (F.col("amp_cv") > F.col("amp_cv_p95")), over("amp_cv", "amp_cv_p95", 0.2), 0.12),
        ("unsupported_step", (F.col("step_abs") > F.col("step_p90")) & (F.col("step_support") < 0.25), F.least(F.lit(1.0), F.col("step_abs") / F.greatest("step_p95", F.lit(1.0))), 0.20),
        ("weak_local_support", F.col("kept_ratio") < 0.5, 1 - F.col("kept_ratio"), 0.15),
        ("cross_track_mismatch", F.col("agreement") < 0.6, F.least(F.lit(1.0), (0.6 - F.col("agreement")) / 0.6), 0.18),
    ]


def score_points(points: DataFrame, stats: DataFrame, *, normal: float = 0.70, outlier: float = 0.40) -> DataFrame:
    """penalty, anomaly, quality, label and the four gravest reasons of each point.

    Points have role, excluded, outlier, local_deviation, coherence, amp_cv,
    velocity_std, step_abs, step_support, kept_ratio, method and the building's
    ``agreement``; ``stats`` are the track percentiles.
    """
    rows = points.join(F.broadcast(stats), "track")
    rules = _reasons()
    penalty = sum((F.when(test, severity if weight is None else severity * weight).otherwise(F.lit(0.0)) for _, test, severity, weight in rules), F.lit(0.0))
    found = F.array_compact(F.array(*[F.when(test, F.struct((-severity).alias("neg"), F.lit(i).alias("at"), F.lit(key).alias("key"))) for i, (key, test, severity, _) in enumerate(rules)]))
    signal = _clip(0.70 * _clip(F.coalesce("coherence", F.lit(0.45))) + 0.30 * (1 - _clip(F.coalesce("amp_cv", F.lit(0.0)) / (F.greatest("amp_cv_p95", F.lit(0.20)) * 1.5))))
    rows = rows.withColumns({"penalty": _clip(penalty), "signal": signal, "reasons_top": F.transform(F.slice(F.array_sort(found), 1, 4), lambda r: F.struct(r["key"].alias("key"), (-r["neg"]).alias("severity")))})
    base = 0.60 * _clip(F.col("outlier")) + 0.25 * _clip(F.col("local_deviation"))
    kept = F.when(F.col("role") == "noise", F.greatest(_clip(base + 0.15 * F.col("penalty")), F.lit(0.80))).otherwise(_clip(base + 0.15 * F.col("penalty")))
    rows = rows.withColumn("anomaly", F.when(F.col("excluded"), F.greatest(F.lit(0.90), base + 0.15)).otherwise(kept))
    good = _clip(0.45 * (1 - F.col("anomaly")) + 0.25 * F.coalesce("agreement", F.lit(0.5)) + 0.20 * F.col("kept_ratio") + 0.10 * F.col("signal"))
    good = F.when(F.col("role") == "insufficient_support", F.least(good, F.lit(0.65))).otherwise(good)
    rows = rows.withColumn("quality", F.when(F.col("excluded"), F.least(F.lit(0.15), 0.45 * (1 - F.col("anomaly")) + 0.10 * F.col("signal"))).otherwise(good))
    label = F.when(F.col("excluded") | (F.col("role") == "noise"), "outlier").when(F.col("role") == "insufficient_support", "suspect").otherwise(quality_label(F.col("quality"), normal, outlier))
    return rows.withColumn("label", label)


def pair_consistency(motion_a: Column, motion_b: Column, reliability_a: Column, reliability_b: Column) -> Column:
    """How well the motions of two clusters agree, weighted by their reliability; 0 for opposite signs, null if anything is missing."""
    scale = F.greatest(F.lit(1.5), 0.20 * F.greatest(F.abs(motion_a), F.abs(motion_b), F.lit(1.0)))
    score = F.exp(-F.abs(motion_a - motion_b) / scale) * F.sqrt(F.greatest(reliability_a, F.lit(0.0)) * F.greatest(reliability_b, F.lit(0.0)))
    missing = motion_a.isNull() | motion_b.isNull() | reliability_a.isNull() | reliability_b.isNull()
    return F.when(missing, None).when(F.signum(motion_a) != F.signum(motion_b), F.lit(0.0)).otherwise(_clip(score))


def fit_profiles(points: DataFrame) -> DataFrame:
    """Median and scale of the fit features of each cluster."""
    keys = ["building_id", "track", "cluster_id"]
    medians = points.groupBy(*keys).agg(*[F.median(n).alias(f"{n}_median") for n in FIT])
    mads = points.join(medians, keys).groupBy(*keys).agg(*[F.greatest(1.4826 * F.median(F.abs(F.col(n) - F.col(f"{n}_median"))), F.lit(floor)).alias(f"{n}_scale") for n, (floor, _) in FIT.items()])
    return medians.join(mads, keys)


def fit_score(reliability: Column) -> Column:
    """How well a point fits a cluster's profile."""
    cost = sum((weight * F.abs(F.col(n) - F.col(f"{n}_median")) / F.col(f"{n}_scale") for n, (_, weight) in FIT.items()), F.lit(0.0))
    return _clip(F.exp(-cost) * (0.70 + 0.30 * F.coalesce(reliability, F.lit(0.0))))


def run_metrics(points: DataFrame, buildings: DataFrame) -> DataFrame:
    """The run's seventeen metrics as (metric, value); an empty run has zeros."""
    n = lambda test: F.coalesce(F.sum(F.when(test, 1.0)), F.lit(0.0))
    assigned = F.col("building_id").isNotNull()
    full = buildings.where("full_support").select("building_id", F.lit(True).alias("full"))
    p = points.join(full, "building_id", "left").agg(
        F.count("*").cast("double").alias("total_points"), n(assigned).alias("assigned_points"), F.count_distinct("building_id").cast("double").alias("assigned_buildings"), n(~F.col("excluded")).alias("kept_points"), n(F.col("excluded")).alias("gate_excluded_points"),
        *[n(F.col("label") == x).alias(f"{x}_points") for x in ("normal", "suspect", "outlier")], n(F.col("role") == "noise").alias("noise_points"), n(F.col("full") & ~F.col("excluded") & (F.col("role") != "noise")).alias("full_cross_track_points"),
    )
    diff = lambda c: F.coalesce(F.median(F.when(F.col("full_support"), F.col(c))), F.lit(0.0))
    b = buildings.agg(
        n(F.col("cluster_count") > 0).alias("buildings_with_clusters"), n(F.col("reliable_count") > 1).alias("multi_cluster_buildings"), n(F.col("status") == "small_n").alias("small_n_buildings"), n(F.col("full_support")).alias("buildings_with_full_track_support"),
        diff("before_diff").alias("median_cross_track_diff_before"), diff("after_diff").alias("median_cross_track_diff_after"),
    )
    b = b.withColumn("cross_track_improvement", F.col("median_cross_track_diff_before") - F.col("median_cross_track_diff_after"))
    entry = lambda frame: frame.unpivot([], frame.columns, "metric", "value")
    return entry(p).unionByName(entry(b))
