"""Queries that measure on the spheroid and on rings instead of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsidia.functions import geodesy
from subsidia.functions.geo import FLATTENING, SEMI_MAJOR
from subsidia.operators import areas, assign
from subsidia.operators.measure import with_distances
from subsidia.plans.catalog import query
from subsidia.plans.layers import EDGES, OUTER, polygons
from subsidia.sources import adapters
from subsidia.sources.tracks import track_geometry

_LON, _LAT = "13 + (({}) - 350000) / 75000", "47.7 + (({}) - 5290000) / 111000"
_F, _A = f"{FLATTENING!r}::DOUBLE", f"{SEMI_MAJOR!r}::DOUBLE"
_B = f"{SEMI_MAJOR * (1 - FLATTENING)!r}::DOUBLE"
_SQ = f"{FLATTENING * (2 - FLATTENING)!r}::DOUBLE"


@query("geodesic_distances", f"""
WITH RECURSIVE k AS (SELECT p.code, {_LON.format("p.x_m")} AS lon1, {_LAT.format("p.y_m")} AS lat1, {_LON.format("b.cx")} - 3 * CAST(b.building_id AS BIGINT) % 170 AS lon2, {_LAT.format("b.cy")} - CAST(b.building_id AS BIGINT) % 90 AS lat2 FROM v_points p JOIN v_buildings b ON p.building_id = b.building_id),
u AS (SELECT code, radians(lon2 - lon1) AS l, atan((1 - {_F}) * tan(radians(lat1))) AS u1, atan((1 - {_F}) * tan(radians(lat2))) AS u2 FROM k),
s AS (SELECT code, l, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2 FROM u),
i AS (SELECT *, 0 AS step, l AS lam FROM s UNION ALL
  SELECT code, l, s1, c1, s2, c2, step + 1, l + (1 - c) * {_F} * alpha * (sigma + c * ss * (middle + c * cs * (2 * middle * middle - 1))) FROM (
    SELECT *, {_F} / 16 * square * (4 + {_F} * (4 - 3 * square)) AS c FROM (
      SELECT *, CASE WHEN square > 1e-15 THEN cs - 2 * s1 * s2 / square ELSE 0 END AS middle FROM (
        SELECT *, 1 - alpha * alpha AS square, atan2(ss, cs) AS sigma FROM (
          SELECT *, c1 * c2 * sin(lam) / CASE WHEN ss = 0 THEN 1 ELSE ss END AS alpha FROM (
            SELECT *, sqrt(power(c2 * sin(lam), 2) + power(c1 * s2 - s1 * c2 * cos(lam), 2)) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM i WHERE step < 12) x) x) x) x) x),
e AS (SELECT *, atan2(ss, cs) AS sigma, 1 - alpha * alpha AS square FROM (SELECT *, c1 * c2 * sin(lam) / CASE WHEN ss = 0 THEN 1 ELSE ss END AS alpha FROM (SELECT *, sqrt(power(c2 * sin(lam), 2) + power(c1 * s2 - s1 * c2 * cos(lam), 2)) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM i WHERE step = 12) x) x),
m AS (SELECT *, CASE WHEN square > 1e-15 THEN cs - 2 * s1 * s2 / square ELSE 0 END AS middle, square * ({_A} * {_A} / ({_B} * {_B}) - 1) AS q FROM e),
n AS (SELECT *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) AS a, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS b FROM m)
SELECT code, round({_B} * a * (sigma - b * ss * (middle + b / 4 * (cs * (2 * middle * middle - 1) - b / 6 * middle * (4 * ss * ss - 3) * (4 * middle * middle - 3)))), 4) AS distance_m FROM n""")
def geodesic_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres along the spheroid from each point to a far place that its building gives."""
    n = F.col("building_id").cast("long")
    b = adapters.buildings(spark, sf_dir).select("building_id", (F.expr(_LON.format("cx")) - 3 * n % 170).alias("lon2"), (F.expr(_LAT.format("cy")) - n % 90).alias("lat2"))
    p = adapters.points(spark, sf_dir).select("code", "building_id", F.expr(_LON.format("x_m")).alias("lon1"), F.expr(_LAT.format("y_m")).alias("lat1"))
    return p.join(b, "building_id").select("code", F.round(geodesy.geodesic_distance(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")), 4).alias("distance_m"))


@query("geography_nearest", f"""
WITH {EDGES},
g AS (SELECT building_id, {_LON.format("ax")} AS ax, {_LAT.format("ay")} AS ay, {_LON.format("zx")} AS zx, {_LAT.format("zy")} AS zy FROM e),
x AS (SELECT building_id, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM g GROUP BY building_id),
p AS (SELECT code, track, {_LON.format("x_m")} AS lon, {_LAT.format("y_m")} AS lat FROM v_points),
w AS (SELECT *, 1 - {_SQ} * power(sin(radians(lat)), 2) AS w FROM p),
q AS (SELECT *, radians(1) * {_A} * cos(radians(lat)) / sqrt(w) AS kx, radians(1) * {_A} * (1 - {_SQ}) / (w * sqrt(w)) AS ky FROM w),
c AS (SELECT q.*, x.building_id FROM q JOIN x ON lon BETWEEN x0 - 0.001 AND x1 + 0.001 AND lat BETWEEN y0 - 0.001 AND y1 + 0.001),
l AS (SELECT c.code, c.track, c.building_id, (ax - lon) * kx AS ax, (ay - lat) * ky AS ay, (zx - ax) * kx AS ex, (zy - ay) * ky AS ey FROM c JOIN g ON g.building_id = c.building_id),
t AS (SELECT *, greatest(0, least(1, -(ax * ex + ay * ey) / (ex * ex + ey * ey))) AS t, (ay > 0) <> (ay + ey > 0) AND 0 < ax - ex * ay / CASE WHEN ey = 0 THEN 1 ELSE ey END AS crosses FROM l),
d AS (SELECT code, track, building_id, CASE WHEN sum(crosses::INT) % 2 = 1 THEN 0 ELSE min(sqrt(power(ax + t * ex, 2) + power(ay + t * ey, 2))) END AS d FROM t GROUP BY code, track, building_id),
k AS (SELECT *, row_number() OVER (PARTITION BY code, track ORDER BY d, building_id) AS k FROM d WHERE d <= 15)
SELECT code, building_id, round(d, 4) AS distance_m FROM k WHERE k = 1""")
def geography_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest building of each point within 15 m on the spheroid; buildings are polygons with holes, in degrees."""
    degrees = lambda p: F.struct((13 + (p["x"] - 350000) / 75000).alias("x"), (47.7 + (p["y"] - 5290000) / 111000).alias("y"))
    houses = polygons(spark, sf_dir).select("building_id", F.transform("rings", lambda r: F.transform(r, degrees)).alias("rings"))
    p = adapters.points(spark, sf_dir).select("code", "track", F.expr(_LON.format("x_m")).alias("lon"), F.expr(_LAT.format("y_m")).alias("lat"))
    return assign.assign_geography(p, houses).select("code", "building_id", F.round("distance_m", 4).alias("distance_m"))


@query("ring_adjacency", f"""
WITH {EDGES},
p AS (SELECT a.building_id AS a, b.building_id AS b, a.area_id FROM v_buildings a JOIN v_buildings b ON a.area_id = b.area_id AND a.building_id < b.building_id AND abs(a.cx - b.cx) <= 60 AND abs(a.cy - b.cy) <= 60),
o AS (SELECT a, b, area_id FROM p UNION ALL SELECT b, a, area_id FROM p),
d AS (SELECT o.a, o.b, o.area_id, v.ax AS x, v.ay AS y, w.ax, w.ay, w.zx - w.ax AS ex, w.zy - w.ay AS ey FROM o JOIN e v ON v.building_id = o.a JOIN e w ON w.building_id = o.b),
t AS (SELECT *, greatest(0, least(1, ((x - ax) * ex + (y - ay) * ey) / (ex * ex + ey * ey))) AS t FROM d),
g AS (SELECT least(a, b) AS a, greatest(a, b) AS b, area_id, min(sqrt(power(x - ax - t * ex, 2) + power(y - ay - t * ey, 2))) AS gap FROM t GROUP BY 1, 2, 3)
SELECT area_id, a, b FROM g WHERE gap <= 9.5""")
def ring_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of buildings whose rings are within 9.5 m."""
    return assign.adjacent_buildings(assign.with_boxes(polygons(spark, sf_dir).drop("cx", "cy", "hw", "hh")), 9.5)


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas.candidate_areas(polygons(spark, sf_dir), track_geometry(spark).where("dataset_id = 'salzburg_snt'"))


@query("candidate_areas", f"""
SELECT b.building_id, CAST(t.track AS INTEGER) AS track, round(greatest(3, least(30, coalesce(height, 12) * tan(radians(inc)))), 6) AS range_offset_m, TRUE AS holds_both
FROM v_buildings b, (VALUES (44, 38.81), (95, 38.48)) t(track, inc)""")
def candidate_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of all buildings by track; whether a corner of the building and of its moved copy lie in them."""
    corner = F.get(F.get("rings", F.lit(0)), F.lit(0))
    tracks = track_geometry(spark).where("dataset_id = 'salzburg_snt'")
    found = areas.candidate_areas(polygons(spark, sf_dir).withColumn("c", corner), tracks, also=("c",))
    places = found.select("building_id", "track", "range_offset_m", F.col("c.x").alias("x"), F.col("c.y").alias("y"), (F.col("c.x") + F.col("shift_x_m")).alias("moved_x"), (F.col("c.y") + F.col("shift_y_m")).alias("moved_y"), "area")
    found = with_distances(places, {"own": ("x", "y"), "moved": ("moved_x", "moved_y")}, "area")
    return found.select("building_id", F.col("track").cast("int").alias("track"), F.round("range_offset_m", 6).alias("range_offset_m"), F.expr("own = 0 AND moved = 0").alias("holds_both"))


@query("candidate_points", f"""
WITH g(track, inc, dx, dy) AS (VALUES (44, 38.81, sin(radians(261.4)), cos(radians(261.4))), (95, 38.48, sin(radians(101.5)), cos(radians(101.5)))),
f(i, ua, va, ub, vb) AS (VALUES {", ".join(f"({i}, {float(a[0])}::DOUBLE, {float(a[1])}::DOUBLE, {float(b[0])}::DOUBLE, {float(b[1])}::DOUBLE)" for i, (a, b) in enumerate(zip(OUTER, OUTER[1:] + OUTER[:1])))}),
c AS (SELECT p.code, p.track, b.building_id, p.x_m, p.y_m, cx, cy, hw, hh, dx, dy, greatest(3, least(30, coalesce(b.height, 12) * tan(radians(inc)))) AS off FROM v_points p JOIN g ON g.track = p.track JOIN v_buildings b ON abs(p.x_m - b.cx) <= 50 AND abs(p.y_m - b.cy) <= 50),
q AS (SELECT *, x_m - cx AS x, y_m - cy AS y FROM c UNION ALL SELECT *, x_m - cx - dx * off, y_m - cy - dy * off FROM c),
e AS (SELECT code, track, building_id, x, y, i, ua * hw AS ax, va * hh AS ay, (ub - ua) * hw AS ex, (vb - va) * hh AS ey FROM q, f),
t AS (SELECT *, ((x - ax) * ex + (y - ay) * ey) / (ex * ex + ey * ey) AS t, abs((x - ax) * ey - (y - ay) * ex) / sqrt(ex * ex + ey * ey) AS aside, (ay > y) <> (ay + ey > y) AND x < ex * (y - ay) / CASE WHEN ey = 0 THEN 1 ELSE ey END + ax AS crosses, sqrt(power(x - ax, 2) + power(y - ay, 2)) AS r, atan2(y - ay, x - ax) + 2 * pi() AS a FROM e),
m AS (SELECT code, track, building_id, x, y, sum(crosses::INT) % 2 = 1 OR bool_or(t BETWEEN 0 AND 1 AND aside <= 2) OR bool_or(i <> 3 AND r <= 2 * cos(pi() / 32) / cos(a - floor(a / (pi() / 16)) * (pi() / 16) - pi() / 32)) AS held FROM t GROUP BY code, track, building_id, x, y)
SELECT DISTINCT code, building_id FROM m WHERE held""")
def candidate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and the buildings in whose candidate area of their track they lie."""
    return areas.points_in_areas(adapters.points(spark, sf_dir), _areas(spark, sf_dir)).select("code", "building_id")
