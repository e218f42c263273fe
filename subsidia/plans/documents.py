"""Results as documents: rows with their meta text, a building's detail and its context on the map, and stability under resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subsidia.functions.geo import ring_area, rings_box, rings_cover
from subsidia.operators import areas, resample, rollup
from subsidia.plans import features
from subsidia.plans.catalog import query
from subsidia.plans.layers import polygons
from subsidia.session import materialize, shared_path
from subsidia.sources import adapters
from subsidia.sources.commits import Store
from subsidia.sources.tracks import track_geometry

#: Points that a building's detail names.
TOP = 8
# Names in the meta text of a result row, those of the roll-ups in it, and what is read of each row.
CLUSTER_META = "cluster_id string, track int, cluster_rank int, point_count bigint, median_vertical_proxy_mm_a double, cluster_reliability_score double, is_main_cluster boolean"
BUILDING_META = (
    "building_status string, building_motion_mm_a double, building_reliability_score double, building_reliability_band string, track_agreement_score double,"
    " cluster_count bigint, reliable_cluster_count bigint, differential_motion_flag boolean, reliability_penalties array<string>"
)
ROW_META = "cluster struct<cluster_role:string,cluster_rank:int>, cluster_rollup string, building_rollup string, visual_context struct<gate_excluded:boolean,assignment_method:string>"


def result_rows(points: DataFrame, clusters: DataFrame, buildings: DataFrame, run_id: str) -> DataFrame:
    """Rows of the table of point results: scored points with their cluster's and building's roll-ups in the meta text."""
    as_ = lambda **cs: F.struct(*[(c if isinstance(c, Column) else F.col(c)).alias(k) for k, c in cs.items()])
    c = clusters.select("building_id", "track", "cluster_id", as_(cluster_id="cluster_id", track=F.col("track").cast("int"), cluster_rank="rank", point_count="point_count", median_vertical_proxy_mm_a="median_vertical", cluster_reliability_score="reliability", is_main_cluster="is_main").alias("cluster_rollup"))
    b = buildings.select("building_id", as_(building_status="status", building_motion_mm_a="motion", building_reliability_score="reliability", building_reliability_band="band", track_agreement_score="agreement", cluster_count="cluster_count", reliable_cluster_count="reliable_count", differential_motion_flag="differential", reliability_penalties="penalties").alias("building_rollup"))
    rows = points.join(c, ["building_id", "track", "cluster_id"], "left").join(b, "building_id", "left")
    cluster = as_(cluster_role="role", cluster_probability="probability", is_main_cluster=F.coalesce("cluster_rollup.is_main_cluster", F.lit(False)), cluster_rank="cluster_rollup.cluster_rank")
    visual = as_(gate_excluded="excluded", gate_reasons="reasons", kept_for_scoring=~F.col("excluded"), assignment_method="method")
    meta = F.struct(F.lit("local").alias("method"), as_(assignment_method="method").alias("feature_flags"), cluster.alias("cluster"), "cluster_rollup", "building_rollup", visual.alias("visual_context"))
    return rows.select(
        F.lit(run_id).alias("run_id"), "area_id", "dataset_id", "code", "track", "cluster_id", F.when(F.col("building_id").isNotNull(), "gba").alias("building_source"), "building_id", "distance_m",
        F.col("quality").alias("score"), F.col("anomaly").alias("anomaly_score"), F.col("quality").alias("quality_score"), "label", F.to_json(meta).alias("meta"),
    )


_KEY = ["run_id", "area_id", "building_source", "building_id"]


def _counts(rows: DataFrame, value: Column, name: str) -> DataFrame:
    n = rows.groupBy(*_KEY, value.cast("string").alias("k")).agg(F.count("*").alias("n"))
    return n.groupBy(*_KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias(name))


def building_details(results: DataFrame) -> DataFrame:
    """One document for each building of stored results (run, area, source, building, ``document``).

    Counts by track, label and method, means of the scores, the building's
    roll-up, its clusters by rank, track and id, and the ``TOP`` points of
    least quality, by code and track where they are equal.  Roll-ups, which
    all points of a building or cluster repeat, stay text until one is chosen.
    """
    rows = materialize(results.where("building_id IS NOT NULL").withColumn("m", F.from_json("meta", ROW_META)).drop("meta"), "detail-rows")
    excluded, role = F.coalesce("m.visual_context.gate_excluded", F.lit(False)), F.col("m.cluster.cluster_role")
    n = lambda test: F.count(F.when(test, 1))
    order = [F.col("quality_score").asc_nulls_last(), F.col("anomaly_score").desc_nulls_last(), F.col("code"), F.col("track")]
    out = rows.groupBy(*_KEY).agg(
        F.count("*").alias("point_count"), n(~excluded).alias("kept_point_count"), n(role == "noise").alias("noise_point_count"), n(excluded).alias("excluded_point_count"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("quality_score", "anomaly_score", "distance_m")],
        F.min_by("m.building_rollup", F.struct(F.coalesce("m.cluster.cluster_rank", F.lit(999)), "track", "code")).alias("rollup"),
    ).withColumn("rollup", F.from_json("rollup", BUILDING_META))
    for name, value in (("track_counts", F.col("track")), ("label_counts", F.coalesce("label", F.lit("unlabeled"))), ("assignment_methods", F.coalesce("m.visual_context.assignment_method", F.lit("unknown")))):
        out = out.join(_counts(rows, value, name), _KEY)
    own = rows.where(F.get_json_object("m.cluster_rollup", "$.cluster_id").isNotNull()).groupBy(*_KEY, "track", "cluster_id").agg(F.first("m.cluster_rollup").alias("c"))
    own = own.withColumn("c", F.from_json("c", CLUSTER_META))
    placed = F.struct(F.coalesce("c.cluster_rank", F.lit(999)).alias("rank"), "track", "cluster_id", "c")
    clusters = own.groupBy(*_KEY).agg(F.transform(F.sort_array(F.collect_list(placed)), lambda x: x["c"]).alias("clusters"))
    top = rows.withColumn("at", F.row_number().over(Window.partitionBy(*_KEY).orderBy(*order))).where(F.col("at") <= TOP)
    point = F.struct("at", F.struct("area_id", "dataset_id", "code", "track", "cluster_id", role.alias("cluster_role"), "label", "quality_score", "anomaly_score", "distance_m", excluded.alias("gate_excluded")).alias("p"))
    tops = top.select(*_KEY, point.alias("x")).groupBy(*_KEY).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["p"]).alias("top_points"))
    out = out.join(clusters, _KEY, "left").join(tops, _KEY)
    return out.select(*_KEY, F.to_json(F.struct(*[c for c in out.columns if c not in _KEY])).alias("document"))


def _geometry(rings: Column, place) -> Column:
    """Even-odd rings, holes turned the other way, as a GeoJSON geometry: each outer ring a polygon with the holes in it."""
    closed = lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), place)
    outers, holes = F.filter(rings, lambda r: ring_area(r) > 0), F.filter(rings, lambda r: ring_area(r) < 0)
    held = lambda o: F.filter(holes, lambda h: rings_cover(F.get(h, F.lit(0))["x"], F.get(h, F.lit(0))["y"], F.array(o)))
    polygons_ = F.transform(outers, lambda o: F.concat(F.array(closed(o)), F.transform(held(o), closed)))
    return F.struct(F.lit("MultiPolygon").alias("type"), polygons_.alias("coordinates"))


def _collection(features_: Column) -> Column:
    return F.struct(F.lit("FeatureCollection").alias("type"), F.coalesce(features_, F.array()).alias("features"))


def building_contexts(points: DataFrame, buildings: DataFrame, rolled: DataFrame, tracks: DataFrame, place) -> DataFrame:
    """(building_id, document): a building on the map with its bounds, candidate areas by track, hulls of its core clusters and a summary.

    ``points`` are those of the buildings with role, cluster_id, excluded,
    x_m, y_m and incidence_angle; ``buildings`` have height and ``rings``;
    ``rolled`` are building roll-ups; ``place`` turns a vertex into (lon, lat).
    An area takes the middle incidence of the building's points on the track.
    """
    feature = lambda geometry, *properties: F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    incidence = points.where("building_id IS NOT NULL").groupBy("building_id", "track").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY incidence_angle)").alias("incidence_deg"))
    found = areas.candidate_areas(buildings, tracks, incidence=incidence).join(F.broadcast(tracks.drop("default_incidence_deg")), "track")
    candidates = found.select("building_id", F.struct("track", feature(_geometry(F.col("area"), place), "track", "look_bearing_deg", "range_dx", "range_dy", "range_offset_m", F.col("shift_x_m").alias("range_shift_x_m"), F.col("shift_y_m").alias("range_shift_y_m")).alias("f")).alias("x"))
    candidates = candidates.groupBy("building_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["f"]).alias("candidates"))
    core = points.where("role = 'core' AND NOT excluded AND building_id IS NOT NULL")
    hulls = resample.cluster_hulls(core, ["building_id", "track", "cluster_id"])
    ring = F.transform(F.concat("hull", F.slice("hull", 1, 1)), place)
    shape = F.when(F.size("hull") > 2, F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    hulls = hulls.select("building_id", F.struct((-F.col("points")).alias("order"), "cluster_id", feature(shape, "cluster_id", "track", F.col("points").alias("point_count")).alias("f")).alias("x"))
    hulls = hulls.groupBy("building_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["f"]).alias("hulls"))
    box = rings_box(F.col("rings"))
    corners = F.concat(place(F.struct(box["x0"].alias("x"), box["y0"].alias("y"))), place(F.struct(box["x1"].alias("x"), box["y1"].alias("y"))))
    own = F.struct(F.lit("Polygon").alias("type"), F.transform("rings", lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), place)).alias("coordinates"))
    rows = buildings.select("building_id", corners.alias("bounds"), feature(own, "building_id", F.col("height").alias("height_m")).alias("building"))
    summary = rolled.select("building_id", F.struct(F.col("kept_points").alias("kept_point_count"), F.col("noise_points").alias("noise_point_count"), "cluster_count", F.col("reliable_count").alias("reliable_cluster_count"), F.col("motion").alias("building_motion_mm_a"), F.col("reliability").alias("building_reliability_score"), F.col("band").alias("building_reliability_band"), F.col("agreement").alias("track_agreement_score"), F.col("status").alias("building_status"), F.col("penalties").alias("reliability_penalties")).alias("summary"))
    met = rows.join(candidates, "building_id", "left").join(hulls, "building_id", "left").join(summary, "building_id", "left")
    return met.select("building_id", F.to_json(F.struct("bounds", "building", _collection(F.col("candidates")).alias("candidate_areas"), _collection(F.col("hulls")).alias("cluster_hulls"), "summary")).alias("document"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with roles by arithmetic, so that documents can be held against SQL; those with few epochs are excluded."""
    p = features._clustered(spark, sf_dir)
    short = F.col("epochs") < 24
    return p.withColumns({"excluded": short, "reasons": F.when(short, F.array(F.lit("too_few_valid_epochs"))).otherwise(F.array().cast("array<string>")), "probability": F.lit(0.5), "anomaly": F.abs("velocity") / 10, "quality": F.col("coherence"), "label": F.when(F.col("coherence") >= 0.7, "normal").when(F.col("coherence") < 0.4, "outlier"), "distance_m": F.col("step_abs")})


@query("building_details", f"""
WITH {features._RANKS}, {features._CLUSTERED}, {features._BUILDINGS},
t AS (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY coherence ASC NULLS LAST, abs(velocity) / 10 DESC, code, track) AS pos FROM u),
c AS (SELECT building_id, string_agg(cluster_id, ',' ORDER BY rank, track, cluster_id) AS clusters FROM y GROUP BY building_id),
k1 AS (SELECT building_id, string_agg(track || ':' || n, ',' ORDER BY track) AS tracks FROM (SELECT building_id, track, count(*) AS n FROM u GROUP BY building_id, track) x GROUP BY building_id),
k2 AS (SELECT building_id, string_agg(label || ':' || n, ',' ORDER BY label) AS labels FROM (SELECT building_id, CASE WHEN coherence >= 0.7 THEN 'normal' WHEN coherence < 0.4 THEN 'outlier' ELSE 'unlabeled' END AS label, count(*) AS n FROM u GROUP BY 1, 2) x GROUP BY building_id)
SELECT t.building_id, count(*) AS points, sum((epochs < 24)::INT)::BIGINT AS excluded, sum((role = 'noise')::INT)::BIGINT AS noise, any_value(tracks) AS tracks, any_value(labels) AS labels, any_value(clusters) AS clusters, string_agg(code, ',' ORDER BY pos) FILTER (WHERE pos <= 8) AS top_points,
  round(avg(coherence), 9) AS mean_quality, any_value(n.status) AS status, round(any_value(n.motion), 6) AS motion
FROM t JOIN c ON c.building_id = t.building_id JOIN k1 ON k1.building_id = t.building_id JOIN k2 ON k2.building_id = t.building_id JOIN n ON n.building_id = t.building_id GROUP BY t.building_id""")
def building_details_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of all buildings: results are stored with their meta text, read again, and gathered; here the documents' values as columns."""
    points, clusters = _scored(spark, sf_dir), materialize(rollup.cluster_rollup(features._clustered(spark, sf_dir)), "clusters")
    store = Store(spark, shared_path(spark, "documents"))
    with store.begin() as change:
        change.append("point_results", result_rows(points, clusters, rollup.building_rollup(clusters, adapters.buildings(spark, sf_dir)), "r"), "r")
    kind = "point_count bigint, excluded_point_count bigint, noise_point_count bigint, track_counts map<string,bigint>, label_counts map<string,bigint>, mean_quality_score double, clusters array<struct<cluster_id:string>>, top_points array<struct<code:string>>, rollup struct<building_status:string,building_motion_mm_a:double>"
    d = building_details(store.read("point_results")).withColumn("d", F.from_json("document", kind))
    pairs = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    r = lambda c: F.round(c, 6)
    return d.select(
        "building_id", F.col("d.point_count").alias("points"), F.col("d.excluded_point_count").alias("excluded"), F.col("d.noise_point_count").alias("noise"), pairs("d.track_counts").alias("tracks"), pairs("d.label_counts").alias("labels"),
        F.array_join(F.transform("d.clusters", lambda c: c["cluster_id"]), ",").alias("clusters"), F.array_join(F.transform("d.top_points", lambda p: p["code"]), ",").alias("top_points"), F.round("d.mean_quality_score", 9).alias("mean_quality"), F.col("d.rollup.building_status").alias("status"), r("d.rollup.building_motion_mm_a").alias("motion"),
    )


@query("building_contexts", f"""
WITH {features._RANKS}, {features._CLUSTERED}, {features._BUILDINGS},
ci AS (SELECT building_id, track, quantile_disc(incidence_angle, 0.5) AS inc FROM v_points GROUP BY building_id, track),
co AS (SELECT b.building_id, g.track, greatest(3, least(30, coalesce(b.height, 12) * tan(radians(coalesce(ci.inc, g.inc0))))) AS off FROM v_buildings b JOIN (VALUES (44, 38.81), (95, 38.48)) g(track, inc0) ON true LEFT JOIN ci ON ci.building_id = b.building_id AND ci.track = g.track),
ca AS (SELECT building_id, string_agg(track || ':' || CAST(round(off, 3) AS DECIMAL(9, 3)), ',' ORDER BY track) AS offsets FROM co GROUP BY building_id),
cl AS (SELECT building_id, cluster_id, count(*) AS n FROM u WHERE role = 'core' AND epochs >= 24 GROUP BY building_id, cluster_id),
ch AS (SELECT building_id, string_agg(cluster_id || '=' || n, ',' ORDER BY n DESC, cluster_id) AS hulls FROM cl GROUP BY building_id)
SELECT b.building_id, round(13 + (cx - hw - 350000) / 75000, 7) AS west, round(47.7 + (cy + hh - 5290000) / 111000, 7) AS north, ca.offsets, coalesce(ch.hulls, '') AS hulls, CAST(n.kept AS BIGINT) AS kept_points, n.status
FROM v_buildings b JOIN ca ON ca.building_id = b.building_id LEFT JOIN ch ON ch.building_id = b.building_id LEFT JOIN n ON n.building_id = b.building_id""")
def building_contexts_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of all buildings; here the documents' values as columns."""
    tracks = track_geometry(spark).where("dataset_id = 'salzburg_snt'").select("track", "default_incidence_deg", "look_bearing_deg", "range_dx", "range_dy")
    place = lambda p: F.array(13 + (p["x"] - 350000) / 75000, 47.7 + (p["y"] - 5290000) / 111000)
    rolled = rollup.building_rollup(rollup.cluster_rollup(features._clustered(spark, sf_dir)), adapters.buildings(spark, sf_dir))
    found = building_contexts(_scored(spark, sf_dir), polygons(spark, sf_dir), rolled, tracks, place)
    kind = "bounds array<double>, candidate_areas struct<features:array<struct<geometry:struct<type:string>,properties:struct<track:int,range_offset_m:double>>>>, cluster_hulls struct<features:array<struct<properties:struct<cluster_id:string,point_count:bigint>>>>, summary struct<kept_point_count:bigint,building_status:string>"
    d = found.withColumn("d", F.from_json("document", kind))
    offset = lambda f: F.concat(f["properties"]["track"].cast("string"), F.lit(":"), F.round(f["properties"]["range_offset_m"], 3).cast("decimal(9,3)").cast("string"))
    hull = lambda f: F.concat(f["properties"]["cluster_id"], F.lit("="), f["properties"]["point_count"].cast("string"))
    return d.select("building_id", F.round(F.get("d.bounds", F.lit(0)), 7).alias("west"), F.round(F.get("d.bounds", F.lit(3)), 7).alias("north"), F.array_join(F.transform("d.candidate_areas.features", offset), ",").alias("offsets"), F.array_join(F.transform("d.cluster_hulls.features", hull), ",").alias("hulls"), F.col("d.summary.kept_point_count").alias("kept_points"), F.col("d.summary.building_status").alias("status"))


@query("building_stability")
def building_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability of the buildings of a run under resampling of their main clusters' points."""
    points = features._clustered(spark, sf_dir)
    clusters = materialize(rollup.cluster_rollup(points), "clusters")
    kept = Window.partitionBy("building_id", "track")
    main = clusters.withColumn("support", F.col("point_count") / F.sum("point_count").over(kept)).where("is_main").select("building_id", "track", "cluster_id", "support")
    b = rollup.building_rollup(clusters, adapters.buildings(spark, sf_dir)).select("building_id", "status", "motion", "agreement", "reliability", "differential", F.col("reliable_count").cast("int").alias("reliable_clusters"), F.col("allowed_diff").alias("allowed"))
    return resample.building_stability(points.join(main, ["building_id", "track", "cluster_id"]), b)
