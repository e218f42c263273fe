"""Lookup and listing queries over points, series, buildings and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subsidia.functions.geo import geojson_point, in_box
from subsidia.plans.catalog import query
from subsidia.sources import adapters


def filter_points(points: DataFrame, *, box: tuple[float, float, float, float] | None = None, dataset_id: str | None = None, track: int | None = None, velocity: tuple[float | None, float | None] = (None, None), min_coherence: float | None = None) -> DataFrame:
    """Points under the conditions that are given; a missing value fails a range."""
    tests: list[Column] = []
    if box is not None:
        tests.append(in_box(F.col("x_m"), F.col("y_m"), box))
    if dataset_id is not None:
        tests.append(F.col("dataset_id") == dataset_id)
    if track is not None:
        tests.append(F.col("track") == track)
    if velocity[0] is not None:
        tests.append(F.col("velocity") >= velocity[0])
    if velocity[1] is not None:
        tests.append(F.col("velocity") <= velocity[1])
    if min_coherence is not None:
        tests.append(F.col("coherence") >= min_coherence)
    for test in tests:
        points = points.where(test)
    return points


@query("points_query", """
SELECT code, track, area_id, x_m, y_m, velocity, coherence FROM v_points
WHERE x_m BETWEEN 350000 AND 350500 AND y_m BETWEEN 5289000 AND 5292000 AND dataset_id = 'ds_a' AND track = 44 AND velocity >= -8 AND velocity <= 8 AND coherence >= 0.3
ORDER BY velocity, code LIMIT 5000""")
def points_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a box by velocity, the first 5,000: the limit is the listing's own."""
    found = filter_points(adapters.points(spark, sf_dir), box=(350000, 5289000, 350500, 5292000), dataset_id="ds_a", track=44, velocity=(-8, 8), min_coherence=0.3)
    return found.orderBy("velocity", "code").limit(5000).select("code", "track", "area_id", "x_m", "y_m", "velocity", "coherence")


@query("point_detail", """
SELECT p.code, p.track, p.velocity, b.height AS building_height, b.slope_mean_deg
FROM v_points p LEFT JOIN v_buildings b ON p.building_id = b.building_id AND p.area_id = b.area_id
WHERE p.velocity IS NOT NULL""")
def point_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with their building's context, where there is one."""
    b = adapters.buildings(spark, sf_dir).select("building_id", "area_id", F.col("height").alias("building_height"), "slope_mean_deg")
    return adapters.points(spark, sf_dir).where("velocity IS NOT NULL").join(b, ["building_id", "area_id"], "left").select("code", "track", "velocity", "building_height", "slope_mean_deg")


@query("timeseries_full_outer", """
WITH d AS (SELECT code, date, displacement FROM v_lines WHERE displacement > -10),
a AS (SELECT code, date, amplitude FROM v_lines WHERE amplitude > 10)
SELECT coalesce(d.code, a.code) AS code, coalesce(d.date, a.date) AS date, round(d.displacement, 6) AS displacement, round(a.amplitude, 6) AS amplitude
FROM d FULL OUTER JOIN a ON d.code = a.code AND d.date = a.date""")
def timeseries_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacement and amplitude of each point and date, either of which may be missing."""
    lines = adapters.lines(spark, sf_dir)
    d = lines.where("displacement > -10").select("code", "date", "displacement")
    a = lines.where("amplitude > 10").select("code", "date", "amplitude")
    return d.join(a, ["code", "date"], "full").select("code", "date", F.round("displacement", 6).alias("displacement"), F.round("amplitude", 6).alias("amplitude"))


@query("buildings_union", """
SELECT 'gba' AS source, CAST(c_custkey AS VARCHAR) AS building_id, c_name AS name FROM customer
UNION ALL SELECT 'osm', CAST(s_suppkey AS VARCHAR), s_name FROM supplier""")
def buildings_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings of both sources in one relation."""
    of = lambda t, source, key, name: adapters.table(spark, sf_dir, t).select(F.lit(source).alias("source"), F.col(key).cast("string").alias("building_id"), F.col(name).alias("name"))
    return of("customer", "gba", "c_custkey", "c_name").unionByName(of("supplier", "osm", "s_suppkey", "s_name"))


@query("assigned_buildings", """
SELECT b.building_id, b.area_id, b.height FROM v_buildings b WHERE EXISTS (SELECT 1 FROM v_points p WHERE p.building_id = b.building_id AND p.coherence >= 0.5)""")
def assigned_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings that have a coherent point."""
    return adapters.buildings(spark, sf_dir).join(adapters.points(spark, sf_dir).where("coherence >= 0.5"), "building_id", "left_semi").select("building_id", "area_id", "height")


@query("building_track_incidence", """
WITH m AS (SELECT building_id, track, quantile_disc(incidence_angle, 0.5) AS inc FROM v_points WHERE incidence_angle IS NOT NULL GROUP BY building_id, track),
t(track, default_inc) AS (VALUES (44, 38.81), (95, 38.48))
SELECT b.building_id, t.track, coalesce(m.inc, t.default_inc, 38.5) AS incidence_deg,
       round(greatest(3, least(30, coalesce(b.height, 12) * tan(radians(coalesce(m.inc, t.default_inc, 38.5))))), 6) AS range_offset_m
FROM v_buildings b CROSS JOIN t LEFT JOIN m ON m.building_id = b.building_id AND m.track = t.track""")
def building_track_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each building and track, the median incidence of its points or else the track's default, and the range offset."""
    p = adapters.points(spark, sf_dir).where("incidence_angle IS NOT NULL")
    m = p.groupBy("building_id", "track").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY incidence_angle)").alias("inc"))
    each = F.explode(F.array(F.struct(F.lit(44).alias("track"), F.lit(38.81).alias("default_inc")), F.struct(F.lit(95).alias("track"), F.lit(38.48).alias("default_inc"))))
    b = adapters.buildings(spark, sf_dir).select("building_id", "height", each.alias("t")).select("building_id", "height", "t.*")
    inc = F.coalesce("inc", "default_inc", F.lit(38.5))
    offset = F.greatest(F.lit(3.0), F.least(F.lit(30.0), F.coalesce("height", F.lit(12.0)) * F.tan(F.radians(inc))))
    return b.join(m, ["building_id", "track"], "left").select("building_id", "track", inc.alias("incidence_deg"), F.round(offset, 6).alias("range_offset_m"))


@query("first_rollup_by_building", """
SELECT building_id, code, velocity FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY coherence DESC NULLS LAST, code) AS k FROM v_points) s WHERE k = 1""")
def first_rollup_by_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each building in a given order, by a mergeable minimum and not a sort."""
    order = F.struct(-F.coalesce("coherence", F.lit(-1.0)), "code")
    return adapters.points(spark, sf_dir).groupBy("building_id").agg(F.min_by(F.struct("code", "velocity"), order).alias("m")).select("building_id", "m.*")


@query("status_counts", """
SELECT status, count(*) AS n, round(avg(value), 4) AS mean_value, round(median(value), 4) AS median_value FROM v_runs GROUP BY status""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.runs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.median("value"), 4).alias("median_value"))


@query("runs_latest", "SELECT run_id, status, created, value FROM v_runs ORDER BY created DESC, run_id LIMIT 50")
def runs_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 50 runs."""
    return adapters.runs(spark, sf_dir).orderBy(F.desc("created"), "run_id").limit(50).select("run_id", "status", "created", "value")


@query("run_current_status", """
SELECT pipeline, arg_max(status, (created, run_id)) AS status, max(created) AS last_event, count(*) AS events FROM v_runs GROUP BY pipeline""")
def run_current_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current state of each pipeline from its appended events."""
    return adapters.runs(spark, sf_dir).groupBy("pipeline").agg(F.max_by("status", F.struct("created", "run_id")).alias("status"), F.max("created").alias("last_event"), F.count("*").alias("events"))


@query("runs_repaired", """
SELECT run_id, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('queued', 'running') THEN DATE '2000-01-01' ELSE created END AS finished,
       CASE WHEN status IN ('queued', 'running') THEN 'interrupted' END AS error FROM v_runs""")
def runs_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with those that never ended marked as failed."""
    open_ = F.col("status").isin("queued", "running")
    return adapters.runs(spark, sf_dir).select("run_id", F.when(open_, "failed").otherwise(F.col("status")).alias("status"), F.when(open_, F.lit("2000-01-01").cast("date")).otherwise(F.col("created")).alias("finished"), F.when(open_, "interrupted").alias("error"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` added, in place of those with the same key."""
    return old.join(new, keys, "left_anti").unionByName(new)


@query("metrics_upsert", """
WITH o AS (SELECT run_id, 'value' AS metric, value FROM v_runs),
n AS (SELECT CAST(l_orderkey AS VARCHAR) AS run_id, 'value' AS metric, CAST(max(l_extendedprice) AS DOUBLE) AS value FROM lineitem GROUP BY l_orderkey UNION ALL SELECT run_id, 'lines', 1.0::DOUBLE FROM v_runs)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.run_id = o.run_id AND n.metric = o.metric)""")
def metrics_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of all runs, in place of them those measured anew from their lines, and a further one for each."""
    runs = adapters.runs(spark, sf_dir)
    old = runs.select("run_id", F.lit("value").alias("metric"), "value")
    measured = adapters.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("run_id")).agg(F.max("l_extendedprice").cast("double").alias("value")).select("run_id", F.lit("value").alias("metric"), "value")
    return upserted(old, measured.unionByName(runs.select("run_id", F.lit("lines").alias("metric"), F.lit(1.0).alias("value"))), ["run_id", "metric"])


@query("run_metrics_map", """
SELECT pipeline, CAST(max(CASE WHEN status = 'succeeded' THEN value END) AS DOUBLE) AS best, count(DISTINCT status) AS states, string_agg(DISTINCT status, ',' ORDER BY status) AS seen FROM v_runs GROUP BY pipeline""")
def run_metrics_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a run gathered under their names, read back from the map."""
    best = adapters.runs(spark, sf_dir).groupBy("pipeline", "status").agg(F.max("value").alias("value"))
    maps = best.groupBy("pipeline").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "value")))).alias("m"))
    return maps.select("pipeline", F.try_element_at("m", F.lit("succeeded")).alias("best"), F.size("m").cast("long").alias("states"), F.array_join(F.map_keys("m"), ",").alias("seen"))


@query("event_props", """
SELECT event_type, count(*) AS n, count(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS with_k, sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS sum_k,
       count(*) FILTER (WHERE coalesce(json_extract_string(props, '$.k'), '') = '1') AS ones
FROM events GROUP BY event_type""")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed reads from JSON, with invalid or missing parts as null."""
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    e = adapters.table(spark, sf_dir, "events").select("event_type", v.alias("k"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("text"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("with_k"), F.sum("k").alias("sum_k"), F.count(F.when(F.col("text") == "1", 1)).alias("ones"))


@query("building_clusters_top8", """
SELECT building_id, code, k FROM (SELECT building_id, code, row_number() OVER (PARTITION BY building_id ORDER BY coalesce(nullif(step_index, 0), 999), code) AS k FROM v_points) s WHERE k <= 8""")
def building_clusters_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight rows of each building by rank, where a rank of 0 or none comes last."""
    rank = F.coalesce(F.nullif("step_index", F.lit(0)), F.lit(999))
    k = F.row_number().over(Window.partitionBy("building_id").orderBy(rank, "code"))
    return adapters.points(spark, sf_dir).select("building_id", "code", k.alias("k")).where("k <= 8")


@query("map_filter", """
SELECT code, track FROM v_points WHERE ((dataset_id = 'ds_a' AND track = 44) OR (dataset_id = 'ds_b' AND track = 95)) AND area_id = 'area_a' AND velocity BETWEEN -10 AND 10 AND coherence >= 0.6""")
def map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of the chosen dataset tracks, in the area, in range."""
    chosen = [("ds_a", 44), ("ds_b", 95)]
    any_of = F.lit(False)
    for dataset, track in chosen:
        any_of = any_of | ((F.col("dataset_id") == dataset) & (F.col("track") == track))
    return adapters.points(spark, sf_dir).where(any_of & (F.col("area_id") == "area_a") & F.col("velocity").between(-10, 10) & (F.col("coherence") >= 0.6)).select("code", "track")


@query("focus_partition", """
SELECT CASE WHEN epochs < 24 THEN 'excluded' WHEN method = 'nearest' THEN 'noise' ELSE 'core' END AS part, track, count(*) AS n FROM v_points GROUP BY 1, 2""")
def focus_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("epochs") < 24, "excluded").when(F.col("method") == "nearest", "noise").otherwise("core")
    return adapters.points(spark, sf_dir).groupBy(part.alias("part"), "track").agg(F.count("*").alias("n"))


@query("points_geojson", """
SELECT code, '{"type":"Point","coordinates":[' || (13 + CAST(CAST(code AS BIGINT) % 8 AS DOUBLE) / 8) || ',' || (47 + CAST(CAST(code AS BIGINT) % 4 AS DOUBLE) / 4) || ']}' AS geometry FROM v_points""")
def points_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("code").cast("long")
    return adapters.points(spark, sf_dir).select("code", geojson_point(13 + n % 8 / 8, 47 + n % 4 / 4).alias("geometry"))


@query("nearest_feature", """
SELECT code, building_id FROM (
  SELECT p.code, b.building_id, row_number() OVER (PARTITION BY p.code ORDER BY sqrt(power(p.x_m - b.cx, 2) + power(p.y_m - b.cy, 2)), b.building_id) AS k
  FROM v_points p JOIN v_buildings b ON abs(p.x_m - b.cx) <= 15 AND abs(p.y_m - b.cy) <= 15) s WHERE k = 1""")
def nearest_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The building centre nearest to each point within reach, over grid cells."""
    from subsidia.operators.assign import with_cells

    b = with_cells(adapters.buildings(spark, sf_dir).select(F.col("building_id").alias("b"), "cx", "cy"), F.col("cx") - 15, F.col("cy") - 15, F.col("cx") + 15, F.col("cy") + 15)
    p = adapters.points(spark, sf_dir).select("code", "x_m", "y_m", F.floor(F.col("x_m") / 50.0).alias("cell_x"), F.floor(F.col("y_m") / 50.0).alias("cell_y"))
    near = p.join(b, ["cell_x", "cell_y"]).where((F.abs(F.col("x_m") - F.col("cx")) <= 15) & (F.abs(F.col("y_m") - F.col("cy")) <= 15))
    return near.groupBy("code").agg(F.min(F.struct(F.hypot(F.col("x_m") - F.col("cx"), F.col("y_m") - F.col("cy")), "b")).alias("m")).select("code", F.col("m.b").alias("building_id"))
