"""Roll-ups of clustered points to clusters, tracks and buildings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subsidia.functions.classify import capped_band, reliability_band

#: The ascending and descending track that are compared.
PAIR = (44, 95)
_ROLES = ("core", "insufficient_support", "noise", "excluded")


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def cluster_rollup(points: DataFrame) -> DataFrame:
    """One row per building, track and cluster of kept points, with the cluster's rank and its distance in motion from the main one.

    Points have role, cluster_id, vertical (projected velocity), coherence,
    height_rank, method, x_m and y_m.  The main cluster is the core cluster of
    two points or more with most points, then the highest median coherence and
    height rank, then the smaller id.
    """
    core = F.col("role") == "core"
    out = points.groupBy("building_id", "track", "cluster_id").agg(
        F.min("role").alias("role"), F.count("*").alias("point_count"), F.median("velocity").alias("median_velocity"), F.median("vertical").alias("median_vertical"), F.median("coherence").alias("median_coherence"),
        F.median("height_rank").alias("median_height_rank"), F.avg((F.col("method") != "nearest").cast("double")).alias("assignment_quality"),
        F.median(F.when(core, F.col("x_m"))).alias("centroid_x"), F.median(F.when(core, F.col("y_m"))).alias("centroid_y"),
    )
    score = 0.45 * F.least(F.col("point_count") / 4, F.lit(1.0)) + 0.35 * _clip(F.coalesce("median_coherence", F.lit(0.0))) + 0.20 * F.col("assignment_quality")
    out = out.withColumns({"reliability": F.when(core, _clip(score)), "reliable": core & (F.col("point_count") >= 2)})
    keys = [F.desc("point_count"), F.desc(F.coalesce("median_coherence", F.lit(-1.0))), F.desc(F.coalesce("median_height_rank", F.lit(-1.0))), F.col("cluster_id")]
    track = Window.partitionBy("building_id", "track")
    out = out.withColumn("is_main", F.col("reliable") & (F.row_number().over(track.orderBy(F.desc("reliable"), *keys)) == 1))
    role = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in _ROLES]), F.col("role")), F.lit(9))
    main = F.max(F.when(F.col("is_main"), F.col("median_vertical"))).over(track)
    return out.withColumns({"rank": F.row_number().over(track.orderBy(F.desc("is_main"), role, *keys)), "delta_to_main": F.abs(F.col("median_vertical") - main)})


def track_rollup(clusters: DataFrame) -> DataFrame:
    """Facts of the main cluster of each building and track."""
    main = lambda c: F.max(F.when(F.col("is_main"), F.col(c)))
    return clusters.groupBy("building_id", "track").agg(
        main("cluster_id").alias("main_cluster_id"), main("median_vertical").alias("motion"), F.coalesce(main("point_count"), F.lit(0)).alias("support"), F.when(main("cluster_id").isNotNull(), F.coalesce(main("median_coherence"), F.lit(0.0))).alias("signal"),
        main("assignment_quality").alias("assignment"), F.count("*").alias("cluster_count"), F.sum(F.col("reliable").cast("int")).alias("reliable_count"), F.max(F.when(F.col("reliable") & ~F.col("is_main"), F.col("delta_to_main"))).alias("largest_delta"),
        F.sum("point_count").alias("kept_points"), F.coalesce(F.sum(F.when(F.col("role") == "noise", F.col("point_count"))), F.lit(0)).alias("noise_points"),
    )


def building_rollup(clusters: DataFrame, slopes: DataFrame, *, pair: tuple[int, int] = PAIR) -> DataFrame:
    """Status, motion, agreement of tracks and reliability of each building.

    ``slopes`` has building_id and slope_mean_deg.  ``before`` compares all kept
    points of the two tracks by their clusters' medians weighted alike.
    """
    tracks = track_rollup(clusters)
    main = F.col("main_cluster_id").isNotNull()
    of = lambda t, c: F.max(F.when(F.col("track") == t, F.col(c)))
    b = tracks.groupBy("building_id").agg(
        F.sum("kept_points").alias("kept_points"), F.sum("noise_points").alias("noise_points"), F.sum("cluster_count").alias("cluster_count"), F.sum("reliable_count").alias("reliable_count"),
        F.sum(main.cast("int")).alias("main_tracks"), F.sum("support").alias("support"), F.avg("motion").alias("motion"), F.avg("signal").alias("signal"), F.avg(F.when(main, F.col("assignment"))).alias("assignment"),
        F.sum((main & (F.col("support") < 3)).cast("int")).alias("weak_tracks"), F.max(F.when(main & (F.col("reliable_count") >= 2), F.col("largest_delta"))).alias("largest_delta"),
        of(pair[0], "motion").alias("motion_a"), of(pair[1], "motion").alias("motion_b"), of(pair[0], "support").alias("support_a"), of(pair[1], "support").alias("support_b"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("motion").isNotNull(), F.struct(F.col("track").cast("string"), "motion"))))).alias("track_motions"),
    )
    b = b.join(slopes.groupBy("building_id").agg(F.max("slope_mean_deg").alias("slope")), "building_id", "left")
    b = b.withColumn("allowed_diff", 1.0 + 0.15 * F.coalesce("slope", F.lit(0.0)))
    b = b.withColumn("after_diff", F.abs(F.col("motion_a") - F.col("motion_b")))
    b = b.withColumn("agreement", F.exp(-F.col("after_diff") / F.col("allowed_diff")))
    noisy = F.col("noise_points") > F.col("kept_points") * 0.5
    status = (
        F.when((F.col("kept_points") < 3) | (F.col("main_tracks") == 0), "insufficient_support").when(noisy, "noise_dominated")
        .when(F.col("support") < 4, "small_n").when(F.col("main_tracks") == 1, "single_track_only").otherwise("ok")
    )
    b = b.withColumns({
        "status": status, "differential": F.coalesce(F.col("largest_delta") >= F.greatest(F.lit(1.5), F.col("allowed_diff")), F.lit(False)),
        "full_support": F.coalesce((F.col("support_a") >= 2) & (F.col("support_b") >= 2), F.lit(False)),
        "weak_secondary": (F.col("main_tracks") >= 2) & (F.col("weak_tracks") > 0), "tension": F.coalesce(F.col("agreement") < 0.25, F.lit(False)),
    })
    off = lambda test, x: F.when(test, F.lit(x)).otherwise(F.lit(0.0))
    score = (
        0.35 * F.least(F.col("support") / 6, F.lit(1.0)) + 0.25 * F.coalesce("signal", F.lit(0.0)) + 0.20 * F.coalesce("assignment", F.lit(0.0)) + 0.20 * F.coalesce("agreement", F.lit(0.5))
        - off(F.col("main_tracks") == 1, 0.15) - off(F.col("support") < 4, 0.10) - off(noisy, 0.15) - off(F.col("differential"), 0.15) - off(F.col("weak_tracks") > 0, 0.10) - off(F.col("tension"), 0.10)
    )
    b = b.withColumn("reliability", F.when(F.col("status") != "insufficient_support", _clip(score)))
    capped = capped_band(reliability_band(F.col("reliability")), F.when(F.col("weak_secondary"), "medium"))
    low = (F.col("status") == "ok") & (F.col("main_tracks") >= 2) & F.coalesce(F.col("agreement") < 0.10, F.lit(False))
    penalties = F.array_compact(F.array(F.when(F.col("weak_tracks") > 0, "weak_main_cluster_support"), F.when(F.col("weak_secondary"), "weak_secondary_track_band_cap"), F.when(F.col("tension"), "low_track_agreement"), F.when(low, "very_low_track_agreement_band_cap")))
    return b.withColumns({"band": capped_band(capped, F.when(low, "low")), "penalties": penalties}).drop("slope", "largest_delta")
