"""Series features, group features, gates, assignment and roll-ups as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subsidia.functions.geo import along_cross, vertical_proxy
from subsidia.operators import assign, groups, neighbours, rollup, score, series
from subsidia.operators.cluster import cluster_points
from subsidia.operators.coloring import color_buildings
from subsidia.plans.catalog import query
from subsidia.session import materialize, task_count
from subsidia.sources import adapters
from subsidia.sources.tracks import track_geometry


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query("series_features", """
WITH s AS (
  SELECT *, CAST(date_diff('day', first_value(date) OVER w, date) AS DOUBLE) AS day, displacement - lag(displacement) OVER w AS diff, row_number() OVER w - 2 AS pos FROM v_series WINDOW w AS (PARTITION BY code, track ORDER BY date)),
f AS (SELECT code, track, count(*) AS n_dates, regr_slope(displacement, day) * 365.25 AS slope_per_year,
             sqrt(greatest(regr_syy(displacement, day) - CASE WHEN regr_sxx(displacement, day) > 0 THEN power(regr_sxy(displacement, day), 2) / regr_sxx(displacement, day) ELSE 0 END, 0) / count(*)) AS residual_std,
             avg(abs(diff)) AS roughness, max(abs(diff)) AS step_abs FROM s GROUP BY code, track),
m AS (SELECT s.code, s.track, min(s.pos) AS step_index, arg_min(sign(s.diff), s.pos) AS step_sign FROM s JOIN f ON s.code = f.code AND s.track = f.track AND abs(s.diff) = f.step_abs GROUP BY s.code, s.track)
SELECT f.code, f.track, n_dates, round(coalesce(slope_per_year, 0), 9) AS slope_per_year, round(coalesce(residual_std, 0), 9) AS residual_std, round(coalesce(roughness, 0), 9) AS roughness,
       round(coalesce(step_abs, 0), 9) AS step_abs, CAST(step_index AS INTEGER) AS step_index, CAST(coalesce(step_sign, 0) AS INTEGER) AS step_sign
FROM f LEFT JOIN m ON f.code = m.code AND f.track = m.track""")
def series_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.displacement_features(adapters.series(spark, sf_dir), ["code", "track"]), 9)


@query("missing_rates", """
WITH t AS (SELECT track, count(DISTINCT date) AS total FROM v_series GROUP BY track), n AS (SELECT code, track, count(*) AS n FROM v_series GROUP BY code, track)
SELECT code, n.track, n AS n_dates, total AS total_dates, round(greatest(0, 1 - n / total), 6) AS missing_rate FROM n JOIN t ON n.track = t.track""")
def missing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.series(spark, sf_dir)
    counts = rows.groupBy("code", "track").agg(F.count("*").alias("n_dates"))
    return series.missing_rate(counts, rows).select("code", "track", "n_dates", "total_dates", F.round("missing_rate", 6).alias("missing_rate"))


@query("amplitude_features", """
WITH m AS (SELECT code, avg(amplitude) AS amp_mean, stddev_pop(amplitude) AS amp_std FROM v_lines GROUP BY code)
SELECT l.code, round(min(amp_mean), 6) AS amp_mean, round(min(amp_std), 6) AS amp_std, round(min(amp_std) / greatest(abs(min(amp_mean)), 0.5), 6) AS amp_cv,
       round(avg(CASE WHEN abs(amplitude - amp_mean) > 2 * greatest(amp_std, 0.5) THEN 1.0 ELSE 0.0 END), 6) AS spike_rate
FROM v_lines l JOIN m ON l.code = m.code GROUP BY l.code""")
def amplitude_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.amplitude_features(adapters.lines(spark, sf_dir), ["code"]))


_STATS = """t AS (SELECT track, coalesce(quantile_cont(coherence, 0.05), 0.45) AS coherence_p05, quantile_cont(coalesce(velocity_std, 0), 0.95) AS velocity_std_p95, quantile_cont(coalesce(amp_cv, 0), 0.95) AS amp_cv_p95,
  quantile_cont(step_abs, 0.9) AS step_p90, quantile_cont(step_abs, 0.95) AS step_p95 FROM v_points GROUP BY track)"""


@query("track_stats", f"WITH {_STATS} SELECT track, round(coherence_p05, 6) AS coherence_p05, round(velocity_std_p95, 6) AS velocity_std_p95, round(amp_cv_p95, 6) AS amp_cv_p95, round(step_p90, 6) AS step_p90, round(step_p95, 6) AS step_p95 FROM t")
def track_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.track_stats(adapters.points(spark, sf_dir)))


_RANKS = """h AS (
  SELECT *, CASE WHEN height IS NOT NULL AND count(height) OVER (PARTITION BY building_id, track) >= 2
    THEN CAST(row_number() OVER (PARTITION BY building_id, track, height IS NOT NULL ORDER BY height, code) - 1 AS DOUBLE) / greatest(count(height) OVER (PARTITION BY building_id, track) - 1, 1) ELSE 0.5 END AS height_rank
  FROM v_points)"""


@query("height_ranks", f"WITH {_RANKS} SELECT code, round(height_rank, 6) AS height_rank, CASE WHEN height_rank <= 0.33 THEN 'lower' WHEN height_rank <= 0.66 THEN 'middle' ELSE 'upper' END AS bucket FROM h")
def height_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from subsidia.functions.classify import height_bucket

    return groups.height_ranks(adapters.points(spark, sf_dir)).select("code", F.round("height_rank", 6).alias("height_rank"), height_bucket(F.col("height_rank")).alias("bucket"))


@query("local_density", """
WITH d AS (SELECT p.code, sqrt(power(p.x_m - q.x_m, 2) + power(p.y_m - q.y_m, 2)) AS d, q.code AS other FROM v_points p JOIN v_points q ON p.building_id = q.building_id AND p.track = q.track AND p.code <> q.code),
n AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d, other) AS k FROM d), m AS (SELECT code, avg(d) AS d FROM n WHERE k <= 3 GROUP BY code)
SELECT p.code, round(coalesce(exp(-m.d / 6), 0), 6) AS local_density FROM v_points p LEFT JOIN m ON p.code = m.code""")
def local_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.local_density(adapters.points(spark, sf_dir)).select("code", F.round("local_density", 6).alias("local_density"))


@query("step_support", f"""
WITH {_STATS},
m AS (SELECT p.code, count(q.code) AS matches FROM v_points p JOIN t ON p.track = t.track LEFT JOIN v_points q ON p.building_id = q.building_id AND p.track = q.track AND p.code <> q.code
        AND q.step_abs >= 0.75 * t.step_p90 AND q.step_sign = p.step_sign AND abs(q.step_index - p.step_index) <= 1 GROUP BY p.code),
n AS (SELECT *, count(*) OVER (PARTITION BY building_id, track) AS n FROM v_points)
SELECT n.code, round(CASE WHEN n.step_abs < t.step_p90 THEN 1.0 WHEN n.n <= 1 OR n.step_index IS NULL THEN 0.0 ELSE CAST(m.matches AS DOUBLE) / greatest(n.n - 1, 1) END, 6) AS step_support
FROM n JOIN m ON n.code = m.code JOIN t ON n.track = t.track""")
def step_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.points(spark, sf_dir)
    return groups.step_support(p, series.track_stats(p)).select("code", F.round("step_support", 6).alias("step_support"))


def _placed(points: DataFrame, buildings: DataFrame) -> DataFrame:
    """Points with offsets along and across the look direction from their building's centre."""
    look = F.when(F.col("track") == 44, F.lit(81.4)).otherwise(F.lit(281.5))
    rows = points.join(buildings.select("building_id", F.col("cx").alias("bx"), F.col("cy").alias("by")), "building_id")
    along, cross = along_cross(F.col("x_m") - F.col("bx"), F.col("y_m") - F.col("by"), look)
    return rows.withColumns({"along_m": along, "cross_m": cross}).drop("bx", "by")


_OFFSETS = """o AS (
  SELECT h.*, (h.x_m - b.cx) * sin(radians(l)) + (h.y_m - b.cy) * cos(radians(l)) AS along_m, (h.y_m - b.cy) * sin(radians(l)) - (h.x_m - b.cx) * cos(radians(l)) AS cross_m
  FROM (SELECT *, CASE WHEN track = 44 THEN 81.4 ELSE 281.5 END AS l FROM h) h JOIN v_buildings b ON h.building_id = b.building_id)"""
_DEVIATION = f"""{_RANKS}, {_OFFSETS},
g AS (SELECT building_id, track, median(velocity) AS mv, median(acceleration) AS ma, median(step_abs) AS ms, median(along_m) AS ml, median(cross_m) AS mc FROM o GROUP BY building_id, track),
s AS (SELECT o.building_id, o.track, 1.4826 * median(abs(velocity - mv)) AS sv, 1.4826 * median(abs(acceleration - ma)) AS sa, 1.4826 * median(abs(step_abs - ms)) AS ss, 1.4826 * median(abs(along_m - ml)) AS sl, 1.4826 * median(abs(cross_m - mc)) AS sc
  FROM o JOIN g ON o.building_id = g.building_id AND o.track = g.track GROUP BY o.building_id, o.track),
e AS (SELECT o.*, greatest(0, least(1, greatest(abs(velocity - mv) / greatest(sv, 0.5) / 3.5, abs(acceleration - ma) / greatest(sa, 0.5) / 3.5, abs(step_abs - ms) / greatest(ss, 0.75) / 3.0, abs(along_m - ml) / greatest(sl, 0.5) / 4.0,
  abs(cross_m - mc) / greatest(sc, 0.5) / 4.0, abs(height_rank - 0.5) * 1.4, greatest(0, (0.65 - coalesce(coherence, 0.65)) / 0.65)))) AS local_deviation
  FROM o JOIN g ON o.building_id = g.building_id AND o.track = g.track JOIN s ON o.building_id = s.building_id AND o.track = s.track)"""


def _deviating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.local_deviation(groups.height_ranks(_placed(adapters.points(spark, sf_dir), adapters.buildings(spark, sf_dir))))


@query("robust_deviation", f"WITH {_DEVIATION} SELECT code, round(along_m, 6) AS along_m, round(cross_m, 6) AS cross_m, round(local_deviation, 6) AS local_deviation FROM e")
def robust_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_deviating(spark, sf_dir).select("code", "along_m", "cross_m", "local_deviation"))


_GATES = """r AS (
  SELECT e.*, list_filter([CASE WHEN epochs < 24 THEN 'too_few_valid_epochs' END, CASE WHEN epochs / total_dates < 0.5 THEN 'too_sparse_timeseries' END, CASE WHEN coalesce(coherence, 0) < greatest(0.45, t.coherence_p05) THEN 'low_coherence' END], lambda x: x IS NOT NULL) AS reasons
  FROM {source} e JOIN t ON e.track = t.track)"""


@query("gates", f"""
WITH {_STATS}, {_GATES.format(source='v_points')}
SELECT code, array_to_string(reasons, ',') AS reasons, reasons[1] AS degraded_reason, len(reasons) > 0 AS excluded, sum(CASE WHEN len(reasons) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY building_id, track)::BIGINT AS kept_points FROM r""")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.points(spark, sf_dir)
    return groups.apply_gates(p, series.track_stats(p)).select("code", F.array_join("reasons", ",").alias("reasons"), "degraded_reason", "excluded", "kept_points")


@query("small_groups", f"""
WITH {_STATS}, {_DEVIATION}, {_GATES.format(source='e')},
k AS (SELECT *, count(*) OVER w AS n, min(local_deviation) OVER w > 0.8 AS none, row_number() OVER (PARTITION BY building_id, track ORDER BY local_deviation, code) = 1 AS least FROM r WHERE len(reasons) = 0 WINDOW w AS (PARTITION BY building_id, track)),
c AS (SELECT *, local_deviation <= 0.8 OR (none AND least) AS core FROM k WHERE n <= 5)
SELECT code, CASE WHEN n < 3 THEN 'insufficient_support' WHEN core THEN 'core' ELSE 'noise' END AS role,
       building_id || ':t' || track || ':' || CASE WHEN n < 3 THEN 'insufficient_support' WHEN core THEN 'cluster_0' ELSE 'noise' END AS cluster_id,
       round(CASE WHEN n < 3 THEN 0.5 WHEN core THEN greatest(0.05, least(0.95, 1 - local_deviation)) ELSE 0.05 END, 6) AS probability
FROM c""")
def small_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _deviating(spark, sf_dir)
    kept = groups.apply_gates(rows, series.track_stats(rows)).where("NOT excluded")
    return groups.small_group_roles(kept).select("code", "role", "cluster_id", F.round("probability", 6).alias("probability"))


_ASSIGN = """
WITH g(track, inc0, dx, dy) AS (VALUES (44, 38.81, sin(radians(261.4)), cos(radians(261.4))), (95, 38.48, sin(radians(101.5)), cos(radians(101.5)))),
c AS (SELECT p.code, b.building_id, p.x_m, p.y_m, b.cx, b.cy, b.hw, b.hh, g.dx, g.dy, greatest(3, least(30, coalesce(b.height, 12) * tan(radians(coalesce(p.incidence_angle, g.inc0))))) AS off
      FROM v_points p JOIN g ON p.track = g.track JOIN v_buildings b ON abs(p.x_m - b.cx) <= 50 AND abs(p.y_m - b.cy) <= 50),
d AS (SELECT *, sqrt(power(greatest(abs(x_m - cx) - hw, 0), 2) + power(greatest(abs(y_m - cy) - hh, 0), 2)) AS d, sqrt(power(greatest(abs(x_m - dx * off - cx) - hw, 0), 2) + power(greatest(abs(y_m - dy * off - cy) - hh, 0), 2)) AS s FROM c),
r AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN d <= 2 OR s <= 2 THEN 1 WHEN d <= 15 THEN 2 END AS p FROM d),
b AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY p, d, building_id) AS k FROM r WHERE p IS NOT NULL)
SELECT q.code, b.building_id, CASE b.p WHEN 0 THEN 'within' WHEN 1 THEN 'directional_buffer' WHEN 2 THEN 'nearest' END AS method, round(b.d, 4) AS distance_m, round(CASE b.p WHEN 1 THEN off + 2 WHEN 2 THEN 15 END, 4) AS buffer_m
FROM v_points q LEFT JOIN b ON q.code = b.code AND b.k = 1"""


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = track_geometry(spark).where("dataset_id = 'salzburg_snt'")
    return assign.assign_buildings(adapters.points(spark, sf_dir), adapters.buildings(spark, sf_dir), tracks)


@query("building_assignment", _ASSIGN)
def building_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("code", "building_id", "method", F.round("distance_m", 4).alias("distance_m"), F.round("buffer_m", 4).alias("buffer_m"))


@query("adjacent_buildings", """
SELECT a.area_id, a.building_id AS a, b.building_id AS b FROM v_buildings a JOIN v_buildings b ON a.area_id = b.area_id AND a.building_id < b.building_id
 AND sqrt(power(greatest(abs(a.cx - b.cx) - a.hw - b.hw, 0), 2) + power(greatest(abs(a.cy - b.cy) - a.hh - b.hh, 0), 2)) <= 25""")
def adjacent_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.adjacent_buildings(adapters.buildings(spark, sf_dir), 25.0)


@query("neighbour_candidates", """
WITH n AS (SELECT a.building_id, b.building_id AS neighbour_id, sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)) AS d FROM v_buildings a JOIN v_buildings b ON a.building_id <> b.building_id AND abs(a.cx - b.cx) <= 25 AND abs(a.cy - b.cy) <= 25),
r AS (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY d, neighbour_id) AS rank FROM n WHERE d <= 25)
SELECT building_id, neighbour_id, round(d, 6) AS distance_m, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def neighbour_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(assign.neighbour_candidates(adapters.buildings(spark, sf_dir)))


@query("building_colors")
def building_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = adapters.buildings(spark, sf_dir)
    return color_buildings(b.select(F.col("building_id").alias("key")), assign.adjacent_buildings(b, 25.0))


#: Roles by arithmetic, so that the roll-ups can be held against SQL.
_CLUSTERED = """u AS (
  SELECT h.*, CASE WHEN CAST(code AS BIGINT) % 5 = 4 THEN 'noise' ELSE 'core' END AS role, building_id || ':t' || track || CASE WHEN CAST(code AS BIGINT) % 5 = 4 THEN ':noise' ELSE ':cluster_' || (CAST(code AS BIGINT) % 2) END AS cluster_id,
         velocity / greatest(cos(radians(coalesce(incidence_angle, CASE WHEN track = 44 THEN 38.81 ELSE 38.48 END))), 0.30) AS vertical FROM h),
v AS (SELECT building_id, track, cluster_id, min(role) AS role, count(*) AS point_count, median(velocity) AS median_velocity, median(vertical) AS median_vertical, median(coherence) AS median_coherence, median(height_rank) AS median_height_rank,
        avg(CASE WHEN method <> 'nearest' THEN 1.0 ELSE 0.0 END) AS assignment_quality FROM u GROUP BY building_id, track, cluster_id),
w AS (SELECT *, role = 'core' AND point_count >= 2 AS reliable, CASE WHEN role = 'core' THEN greatest(0, least(1, 0.45 * least(point_count / 4, 1) + 0.35 * greatest(0, least(1, coalesce(median_coherence, 0))) + 0.2 * assignment_quality)) END AS reliability FROM v),
x AS (SELECT *, reliable AND row_number() OVER (PARTITION BY building_id, track ORDER BY reliable DESC, point_count DESC, coalesce(median_coherence, -1) DESC, coalesce(median_height_rank, -1) DESC, cluster_id) = 1 AS is_main FROM w),
y AS (SELECT *, row_number() OVER (PARTITION BY building_id, track ORDER BY is_main DESC, CASE role WHEN 'core' THEN 1 WHEN 'insufficient_support' THEN 2 WHEN 'noise' THEN 3 ELSE 9 END, point_count DESC, coalesce(median_coherence, -1) DESC, coalesce(median_height_rank, -1) DESC, cluster_id) AS rank,
        abs(median_vertical - max(CASE WHEN is_main THEN median_vertical END) OVER (PARTITION BY building_id, track)) AS delta_to_main FROM x)"""


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("code").cast("long")
    noise = n % 5 == 4
    inc = F.coalesce("incidence_angle", F.when(F.col("track") == 44, F.lit(38.81)).otherwise(F.lit(38.48)))
    cluster = F.concat("building_id", F.lit(":t"), F.col("track").cast("string"), F.when(noise, ":noise").otherwise(F.concat(F.lit(":cluster_"), (n % 2).cast("string"))))
    rows = groups.height_ranks(adapters.points(spark, sf_dir))
    return rows.withColumns({"role": F.when(noise, "noise").otherwise("core"), "cluster_id": cluster, "vertical": vertical_proxy(F.col("velocity"), inc)})


@query("cluster_rollup", f"""
WITH {_RANKS}, {_CLUSTERED}
SELECT building_id, track, cluster_id, role, point_count, round(median_velocity, 6) AS median_velocity, round(median_vertical, 6) AS median_vertical, round(median_coherence, 6) AS median_coherence, round(median_height_rank, 6) AS median_height_rank,
       round(assignment_quality, 6) AS assignment_quality, round(reliability, 6) AS reliability, reliable, is_main, CAST(rank AS INTEGER) AS rank, round(delta_to_main, 6) AS delta_to_main FROM y""")
def cluster_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rollup.cluster_rollup(_clustered(spark, sf_dir)).drop("centroid_x", "centroid_y"))


_BUILDINGS = """z AS (
  SELECT building_id, track, max(CASE WHEN is_main THEN cluster_id END) AS main_id, max(CASE WHEN is_main THEN median_vertical END) AS motion, coalesce(max(CASE WHEN is_main THEN point_count END), 0) AS support, max(CASE WHEN is_main THEN coalesce(median_coherence, 0) END) AS signal,
    max(CASE WHEN is_main THEN assignment_quality END) AS assignment, sum(CASE WHEN reliable THEN 1 ELSE 0 END) AS reliable_count, max(CASE WHEN reliable AND NOT is_main THEN delta_to_main END) AS largest, sum(point_count) AS kept, sum(CASE WHEN role = 'noise' THEN point_count ELSE 0 END) AS noise FROM y GROUP BY building_id, track),
p AS (
  SELECT building_id, sum(kept) AS kept, sum(noise) AS noise, sum(CASE WHEN main_id IS NOT NULL THEN 1 ELSE 0 END) AS main_tracks, sum(support) AS support, avg(motion) AS motion, avg(signal) AS signal, avg(assignment) AS assignment, sum(CASE WHEN main_id IS NOT NULL AND support < 3 THEN 1 ELSE 0 END) AS weak,
    max(CASE WHEN main_id IS NOT NULL AND reliable_count >= 2 THEN largest END) AS largest, max(CASE WHEN track = 44 THEN motion END) AS ma, max(CASE WHEN track = 95 THEN motion END) AS mb FROM z GROUP BY building_id),
q AS (SELECT p.*, 1.0 + 0.15 * coalesce(b.slope_mean_deg, 0) AS allowed, abs(ma - mb) AS after_diff, exp(-abs(ma - mb) / (1.0 + 0.15 * coalesce(b.slope_mean_deg, 0))) AS agreement FROM p LEFT JOIN v_buildings b ON p.building_id = b.building_id),
r AS (SELECT *, CASE WHEN kept < 3 OR main_tracks = 0 THEN 'insufficient_support' WHEN noise > kept * 0.5 THEN 'noise_dominated' WHEN support < 4 THEN 'small_n' WHEN main_tracks = 1 THEN 'single_track_only' ELSE 'ok' END AS status, coalesce(largest >= greatest(1.5, allowed), false) AS differential FROM q),
k AS (SELECT *, CASE WHEN status <> 'insufficient_support' THEN greatest(0, least(1, 0.35 * least(support / 6, 1) + 0.25 * coalesce(signal, 0) + 0.2 * coalesce(assignment, 0) + 0.2 * coalesce(agreement, 0.5) - CASE WHEN main_tracks = 1 THEN 0.15 ELSE 0 END - CASE WHEN support < 4 THEN 0.1 ELSE 0 END
   - CASE WHEN noise > kept * 0.5 THEN 0.15 ELSE 0 END - CASE WHEN differential THEN 0.15 ELSE 0 END - CASE WHEN weak > 0 THEN 0.1 ELSE 0 END - CASE WHEN agreement < 0.25 THEN 0.1 ELSE 0 END)) END AS reliability FROM r),
n AS (SELECT *, CASE WHEN reliability IS NULL THEN NULL WHEN reliability >= 0.75 THEN 3 WHEN reliability >= 0.45 THEN 2 ELSE 1 END AS b1 FROM k)"""


@query("building_rollup", f"""
WITH {_RANKS}, {_CLUSTERED}, {_BUILDINGS}
SELECT building_id, status, CAST(kept AS BIGINT) AS kept_points, CAST(noise AS BIGINT) AS noise_points, CAST(main_tracks AS BIGINT) AS main_tracks, CAST(support AS BIGINT) AS support, round(motion, 6) AS motion, round(after_diff, 6) AS after_diff, round(agreement, 6) AS agreement, differential, round(reliability, 6) AS reliability,
  CASE WHEN b1 IS NULL THEN NULL ELSE ['low', 'medium', 'high'][CAST(least(b1, CASE WHEN main_tracks >= 2 AND weak > 0 THEN 2 ELSE 3 END, CASE WHEN status = 'ok' AND main_tracks >= 2 AND agreement < 0.1 THEN 1 ELSE 3 END) AS INTEGER)] END AS band FROM n""")
def building_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = rollup.building_rollup(rollup.cluster_rollup(_clustered(spark, sf_dir)), adapters.buildings(spark, sf_dir))
    return _rounded(b.select("building_id", "status", "kept_points", "noise_points", "main_tracks", "support", "motion", "after_diff", "agreement", "differential", "reliability", "band"))


@query("pair_consistency", f"""
WITH {_RANKS}, {_CLUSTERED},
m AS (SELECT * FROM y WHERE is_main),
n AS (SELECT a.building_id, b.building_id AS neighbour_id FROM v_buildings a JOIN v_buildings b ON a.building_id <> b.building_id AND sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)) <= 21)
SELECT n.building_id, n.neighbour_id, a.track, round(CASE WHEN sign(a.median_vertical) <> sign(b.median_vertical) THEN 0 ELSE
  greatest(0, least(1, exp(-abs(a.median_vertical - b.median_vertical) / greatest(1.5, 0.2 * greatest(abs(a.median_vertical), abs(b.median_vertical), 1))) * sqrt(a.reliability * b.reliability))) END, 6) AS score
FROM n JOIN m a ON n.building_id = a.building_id JOIN m b ON n.neighbour_id = b.building_id AND a.track = b.track""")
def pair_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main clusters of neighbouring buildings on one track, scored for consistent motion."""
    main = rollup.cluster_rollup(_clustered(spark, sf_dir)).where("is_main").select("building_id", "track", F.col("median_vertical").alias("motion"), "reliability")
    near = assign.neighbour_candidates(adapters.buildings(spark, sf_dir), 21.0).select("building_id", "neighbour_id")
    other = main.withColumnsRenamed({"building_id": "neighbour_id", "motion": "their_motion", "reliability": "their_reliability"})
    joined = near.join(main.hint("merge"), "building_id").join(other.hint("merge"), ["neighbour_id", "track"])
    return joined.select("building_id", "neighbour_id", "track", F.round(score.pair_consistency(F.col("motion"), F.col("their_motion"), F.col("reliability"), F.col("their_reliability")), 6).alias("score"))


@query("neighbour_support", f"""
WITH {_RANKS}, {_CLUSTERED},
n AS (SELECT a.building_id, b.building_id AS neighbour_id FROM v_buildings a JOIN v_buildings b ON a.building_id <> b.building_id AND sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)) <= 21),
e AS (SELECT * FROM y WHERE reliable AND reliability IS NOT NULL),
p AS (SELECT n.building_id, n.neighbour_id, a.track, b.cluster_id, CASE WHEN sign(a.median_vertical) <> sign(b.median_vertical) THEN 0 ELSE
  greatest(0, least(1, exp(-abs(a.median_vertical - b.median_vertical) / greatest(1.5, 0.2 * greatest(abs(a.median_vertical), abs(b.median_vertical), 1))) * sqrt(a.reliability * b.reliability))) END AS score
  FROM n JOIN y a ON n.building_id = a.building_id AND a.is_main JOIN e b ON n.neighbour_id = b.building_id AND a.track = b.track),
k AS (SELECT *, row_number() OVER (PARTITION BY building_id, neighbour_id ORDER BY round(score, 9) DESC, cluster_id, track) AS k FROM p WHERE score >= 0.6),
s AS (SELECT building_id, count(*) AS supporters, count(DISTINCT track) AS tracks, avg(score) AS mean FROM k WHERE k = 1 GROUP BY building_id),
c AS (SELECT DISTINCT n.building_id FROM n JOIN y o ON n.building_id = o.building_id JOIN e ON n.neighbour_id = e.building_id AND o.track = e.track),
b AS (SELECT building_id, count(*) AS candidates FROM n GROUP BY building_id)
SELECT b.building_id, b.candidates, c.building_id IS NOT NULL AS context, coalesce(supporters, 0) AS supporters, coalesce(tracks, 0) AS support_tracks,
  round(CASE WHEN c.building_id IS NOT NULL THEN coalesce(mean, 0) END, 6) AS consistency, round(CASE WHEN c.building_id IS NOT NULL THEN coalesce(mean, 0) * least(coalesce(supporters, 0) / 2, 1) END, 6) AS event_score
FROM b LEFT JOIN c ON b.building_id = c.building_id LEFT JOIN s ON b.building_id = s.building_id""")
def neighbour_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = rollup.cluster_rollup(_clustered(spark, sf_dir))
    return _rounded(neighbours.neighbour_support(clusters, assign.neighbour_candidates(adapters.buildings(spark, sf_dir), 21.0)))


def anomaly_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole run over the adapters: scored points, building roll-ups and the neighbourhood of the buildings that have points and neighbours.

    Points and roll-ups have the neighbourhood's columns; it moves no point. The table's points have no long series, so their epochs are the adapters'.
    """
    buildings, points = adapters.buildings(spark, sf_dir), materialize(_assigned(spark, sf_dir), "assigned")
    tracks = track_geometry(spark).where("dataset_id = 'salzburg_snt'").select("track", "default_incidence_deg", "look_bearing_deg")
    stats, tasks = materialize(series.track_stats(points), "track-stats"), task_count(points)
    rows = points.join(F.broadcast(tracks), "track")
    along, cross = along_cross(F.col("x_m") - F.col("building_x"), F.col("y_m") - F.col("building_y"), F.col("look_bearing_deg"))
    rows = rows.withColumns({"along_m": along, "cross_m": cross, "vertical": vertical_proxy(F.col("velocity"), F.coalesce("incidence_angle", "default_incidence_deg"))})
    featured = groups.step_support(groups.local_deviation(groups.height_ranks(rows.where("building_id IS NOT NULL"), tasks=tasks)), stats, tasks=tasks)
    unassigned = rows.where("building_id IS NULL").withColumns({c: F.lit(0.0) for c in ("height_rank", "local_deviation", "step_support")})
    gated = materialize(groups.group_gates(featured, stats, tasks=tasks).unionByName(groups.lone_gates(unassigned, stats)), "gated")
    # Kept points go through the clustering with their columns, so no table of points is joined with its like.
    kept = materialize(cluster_points(gated.where("NOT excluded"), columns=gated.columns, sizes="kept_points"), "clusters")
    excluded = gated.where("excluded").withColumns({"role": F.lit("excluded"), "cluster_id": F.lit(None).cast("string"), "probability": F.lit(None).cast("double"), "outlier": F.when(F.col("building_id").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))})
    rolled = materialize(rollup.cluster_rollup(kept), "cluster-rollup")
    near = materialize(assign.neighbour_candidates(buildings.join(gated.select("building_id").distinct(), "building_id", "left_semi")), "near")
    found = ["own_fit", "neighbour_id", "neighbour_cluster", "neighbour_fit", "misassigned"]
    fits = materialize(neighbours.neighbour_fit(kept.select("code", "track", "building_id", "role", "cluster_id", *score.FIT), rolled, near).select("code", "track", "building_id", *found), "fits")
    events = materialize(neighbours.neighbour_events(neighbours.neighbour_support(rolled, near), fits), "events")
    placed = kept.join(fits.drop("building_id"), ["code", "track"], "left").unionByName(excluded, allowMissingColumns=True).withColumn("misassigned", F.coalesce("misassigned", F.lit(False)))
    b = rollup.building_rollup(rolled, buildings)
    before = kept.groupBy("building_id").agg(F.abs(F.median(F.when(F.col("track") == 44, F.col("vertical"))) - F.median(F.when(F.col("track") == 95, F.col("vertical")))).alias("before_diff"))
    b = b.join(before, "building_id", "left").join(events, "building_id", "left")
    b = b.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("candidates", "supporters", "support_tracks")} | {c: F.coalesce(c, F.lit(False)) for c in ("context", "event")})
    scored = score.score_points(placed.join(b.select("building_id", "agreement"), "building_id", "left"), stats)
    return scored, b, events


def anomaly_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scored points and building roll-ups of the whole run."""
    return anomaly_run(spark, sf_dir)[:2]


@query("neighbour_events")
def neighbour_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings that move with their neighbours, and how many of their points fit a neighbour better."""
    return anomaly_run(spark, sf_dir)[2]


#: Columns of the neighbourhood in the building roll-ups.
NEIGHBOURHOOD = ("candidates", "context", "supporters", "support_tracks", "consistency", "event_score", "misassigned_points", "misassigned_share", "event")


@query("anomaly_buildings")
def anomaly_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: buildings of a whole run with status, motion, agreement and reliability."""
    return anomaly_points(spark, sf_dir)[1].select("building_id", "status", "kept_points", "noise_points", "main_tracks", "support", "motion", "agreement", "differential", "reliability", "band", *NEIGHBOURHOOD)


@query("anomaly_scores")
def anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly_points(spark, sf_dir)[0].select("code", "track", "building_id", "method", "role", "cluster_id", "probability", "anomaly", "quality", "label", "degraded_reason", F.to_json("reasons_top").alias("explain"), "own_fit", "neighbour_id", "neighbour_cluster", "neighbour_fit", "misassigned")


@query("anomaly_metrics")
def anomaly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, buildings = anomaly_points(spark, sf_dir)
    return score.run_metrics(points, buildings)


@query("kept_ratio", """
SELECT code, round(CAST(sum(CASE WHEN epochs >= 24 THEN 1 ELSE 0 END) OVER w AS DOUBLE) / count(*) OVER w, 6) AS kept_ratio FROM v_points WINDOW w AS (PARTITION BY building_id, track)""")
def kept_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("building_id", "track")
    return adapters.points(spark, sf_dir).select("code", F.round(F.avg((F.col("epochs") >= 24).cast("double")).over(w), 6).alias("kept_ratio"))
