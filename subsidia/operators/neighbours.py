"""Neighbourhood pass: do nearby buildings move alike, and would a point fit a neighbour's cluster better?

Additive: it marks buildings and points and moves none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsidia.operators.score import fit_profiles, fit_score, pair_consistency

# Least scores of a supporting pair and of a better neighbour, greatest own score, least difference.
PAIR_SUPPORT, NEIGHBOUR_FIT, OWN_WEAK, FIT_DELTA = 0.60, 0.60, 0.45, 0.15


def _eligible(clusters: DataFrame) -> DataFrame:
    """Clusters that can support or attract: core, two points or more, with a reliability."""
    return clusters.where("reliable AND reliability IS NOT NULL").select(F.col("building_id").alias("neighbour_id"), "track", F.col("cluster_id").alias("their_cluster"), F.col("median_vertical").alias("their_motion"), F.col("reliability").alias("their_reliability"))


def neighbour_support(clusters: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each building with candidates: whether there is context, its supporters, their tracks and mean score, and the event score.

    A neighbour supports by its best cluster, over all tracks with a main
    cluster; scores are compared to nine digits, then cluster and track decide.
    """
    main = clusters.where("is_main").select("building_id", "track", F.col("median_vertical").alias("motion"), F.col("reliability").alias("own_reliability"))
    near = candidates.select("building_id", "neighbour_id")
    pairs = near.join(main, "building_id").join(_eligible(clusters), ["neighbour_id", "track"])
    pairs = pairs.withColumn("score", pair_consistency(F.col("motion"), F.col("their_motion"), F.col("own_reliability"), F.col("their_reliability"))).where(F.col("score") >= PAIR_SUPPORT)
    best = pairs.groupBy("building_id", "neighbour_id").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "their_cluster", "track", "score")).alias("b"))
    support = best.groupBy("building_id").agg(F.count("*").alias("supporters"), F.count_distinct("b.track").alias("support_tracks"), F.avg("b.score").alias("mean_score"))
    own_tracks = clusters.select("building_id", "track").distinct()
    context = near.join(own_tracks, "building_id").join(_eligible(clusters).select("neighbour_id", "track").distinct(), ["neighbour_id", "track"], "left_semi").select("building_id").distinct()
    rows = near.groupBy("building_id").agg(F.count("*").alias("candidates")).join(context.withColumn("context", F.lit(True)), "building_id", "left").join(support, "building_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    rows = rows.select("building_id", "candidates", F.coalesce("context", F.lit(False)).alias("context"), zero("supporters").alias("supporters"), zero("support_tracks").alias("support_tracks"), F.when(F.col("context"), F.coalesce("mean_score", F.lit(0.0))).alias("consistency"))
    return rows.withColumn("event_score", F.col("consistency") * F.least(F.col("supporters") / 2, F.lit(1.0)))


def neighbour_fit(points: DataFrame, clusters: DataFrame, candidates: DataFrame) -> DataFrame:
    """Kept points with the fit to their own cluster, the best fit to a neighbour's, and whether they seem misassigned.

    A point's own cluster is its core cluster, else the track's main one.
    """
    profiles = fit_profiles(points.where("role = 'core'"))
    rated = clusters.select("building_id", "track", "cluster_id", "reliability", "is_main", "reliable")
    main = rated.where("is_main").select("building_id", "track", F.col("cluster_id").alias("main_id"))
    rows = points.join(main, ["building_id", "track"], "left").withColumn("own_id", F.when(F.col("role") == "core", F.col("cluster_id")).otherwise(F.col("main_id")))
    own = profiles.join(rated.select("building_id", "track", "cluster_id", "reliability"), ["building_id", "track", "cluster_id"]).withColumnRenamed("cluster_id", "own_id")
    fitted = rows.join(own, ["building_id", "track", "own_id"], "left").withColumn("own_fit", F.when(F.col("vertical_median").isNotNull(), fit_score(F.col("reliability"))))
    fitted = fitted.select(*points.columns, "own_fit")
    theirs = profiles.join(rated.where("reliable").select("building_id", "track", "cluster_id", "reliability"), ["building_id", "track", "cluster_id"])
    theirs = theirs.withColumnsRenamed({"building_id": "neighbour_id", "cluster_id": "neighbour_cluster"})
    pairs = points.join(candidates.select("building_id", "neighbour_id"), "building_id").join(theirs, ["neighbour_id", "track"]).withColumn("fit", fit_score(F.col("reliability")))
    best = pairs.groupBy("code", "track").agg(F.min(F.struct((-F.round("fit", 9)).alias("s"), "neighbour_id", "neighbour_cluster", "fit")).alias("b"))
    out = fitted.join(best.select("code", "track", F.col("b.neighbour_id").alias("neighbour_id"), F.col("b.neighbour_cluster").alias("neighbour_cluster"), F.col("b.fit").alias("neighbour_fit")), ["code", "track"], "left")
    weak = F.col("own_fit").isNull() | (F.col("own_fit") < OWN_WEAK)
    delta = F.col("neighbour_fit") - F.coalesce("own_fit", F.lit(0.0))
    return out.withColumn("misassigned", F.coalesce((F.col("neighbour_fit") >= NEIGHBOUR_FIT) & weak & (delta >= FIT_DELTA), F.lit(False)))


def neighbour_events(support: DataFrame, fits: DataFrame) -> DataFrame:
    """Support with the share of misassigned points and whether the building moves with its neighbours."""
    shares = fits.groupBy("building_id").agg(F.sum(F.col("misassigned").cast("long")).alias("misassigned_points"), F.avg(F.col("misassigned").cast("double")).alias("misassigned_share"))
    rows = support.join(shares, "building_id", "left")
    return rows.withColumn("event", F.coalesce((F.col("supporters") >= 2) & (F.col("event_score") >= PAIR_SUPPORT) & (F.col("misassigned_share") < 0.5), F.lit(False)))

