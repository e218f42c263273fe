"""Queries over polygons, tiles with attributes, states of results, ramps and other parts of the layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsidia.functions import classify, geo, json
from subsidia.operators import assign, resample
from subsidia.plans.catalog import query
from subsidia.sources import adapters, ingest
from subsidia.sources.tracks import track_geometry

#: Corners of an L-shaped house in half widths and heights around its middle, and its court, a square of half a metre each way.
OUTER = ((-1, -1), (1, -1), (1, 0), (0, 0), (0, 1), (-1, 1))
COURT = ((-0.5, -0.5), (-0.5, 0.5), (0.5, 0.5), (0.5, -0.5))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings as polygons of six corners with a hole."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    outer = F.array(*[at(F.col("cx") + a * F.col("hw"), F.col("cy") + b * F.col("hh")) for a, b in OUTER])
    court = F.array(*[at(F.col("cx") - F.col("hw") / 2 + a, F.col("cy") - F.col("hh") / 2 + b) for a, b in COURT])
    return adapters.buildings(spark, sf_dir).withColumn("rings", F.array(outer, court))


def _edge_rows() -> str:
    """Edges of both rings as SQL values: factors of the half sizes and metres for both ends."""
    outer = [(*OUTER[i], 0, 0, *OUTER[(i + 1) % 6], 0, 0) for i in range(6)]
    court = [(-0.5, -0.5, *COURT[i], -0.5, -0.5, *COURT[(i + 1) % 4]) for i in range(4)]
    return ", ".join(f"({', '.join(f'{float(v)}::DOUBLE' for v in row)})" for row in outer + court)


EDGES = f"""f(ua, va, pa, qa, ub, vb, pb, qb) AS (VALUES {_edge_rows()}),
e AS (SELECT building_id, cx + ua * hw + pa AS ax, cy + va * hh + qa AS ay, cx + ub * hw + pb AS zx, cy + vb * hh + qb AS zy FROM v_buildings, f)"""


@query("polygon_assignment", f"""
WITH g(track, inc0, dx, dy) AS (VALUES (44, 38.81, sin(radians(261.4)), cos(radians(261.4))), (95, 38.48, sin(radians(101.5)), cos(radians(101.5)))), {EDGES},
c AS (SELECT p.code, b.building_id, p.x_m, p.y_m, greatest(3, least(30, coalesce(b.height, 12) * tan(radians(coalesce(p.incidence_angle, g.inc0))))) AS off, g.dx, g.dy
      FROM v_points p JOIN g ON p.track = g.track JOIN v_buildings b ON abs(p.x_m - b.cx) <= 50 AND abs(p.y_m - b.cy) <= 50),
q AS (SELECT code, building_id, off, 0 AS shifted, x_m AS x, y_m AS y FROM c UNION ALL SELECT code, building_id, off, 1, x_m - dx * off, y_m - dy * off FROM c),
t AS (SELECT q.*, ax, ay, zx - ax AS ex, zy - ay AS ey, greatest(0, least(1, ((x - ax) * (zx - ax) + (y - ay) * (zy - ay)) / ((zx - ax) * (zx - ax) + (zy - ay) * (zy - ay)))) AS t, (ay > y) <> (zy > y) AND x < (zx - ax) * (y - ay) / CASE WHEN zy = ay THEN 1 ELSE zy - ay END + ax AS crosses FROM q JOIN e ON q.building_id = e.building_id),
m AS (SELECT code, building_id, shifted, any_value(off) AS off, min(sqrt(power(x - ax - t * ex, 2) + power(y - ay - t * ey, 2))) AS edge, sum(crosses::INT) % 2 = 1 AS odd FROM t GROUP BY code, building_id, shifted),
n AS (SELECT *, CASE WHEN odd OR edge <= 1e-9 THEN 0 ELSE edge END AS d FROM m),
d AS (SELECT a.code, a.building_id, a.off, a.d, s.d AS s FROM n a JOIN n s ON a.code = s.code AND a.building_id = s.building_id AND a.shifted = 0 AND s.shifted = 1),
r AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN d <= 2 OR s <= 2 THEN 1 WHEN d <= 15 THEN 2 END AS p FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY p, d, building_id) AS k FROM r WHERE p IS NOT NULL)
SELECT v.code, k.building_id, CASE k.p WHEN 0 THEN 'within' WHEN 1 THEN 'directional_buffer' WHEN 2 THEN 'nearest' END AS method, round(k.d, 4) AS distance_m FROM v_points v LEFT JOIN k ON v.code = k.code AND k.k = 1""")
def polygon_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and the buildings they belong to, where buildings are polygons with holes."""
    tracks = track_geometry(spark).where("dataset_id = 'salzburg_snt'")
    houses = assign.with_boxes(polygons(spark, sf_dir).drop("cx", "cy", "hw", "hh"))
    found = assign.assign_buildings(adapters.points(spark, sf_dir), houses, tracks)
    return found.select("code", "building_id", "method", F.round("distance_m", 4).alias("distance_m"))


@query("polygon_shapes", f"""
WITH {EDGES}, k AS (SELECT e.building_id, ax - cx AS ax, ay - cy AS ay, zx - cx AS zx, zy - cy AS zy, cx, cy FROM e JOIN v_buildings b ON e.building_id = b.building_id), c AS (SELECT *, ax * zy - zx * ay AS w FROM k)
SELECT building_id, round(abs(sum(w)) / 2, 3) AS area, round(sum((ax + zx) * w) / (3 * sum(w)) + any_value(cx), 4) AS x, round(sum((ay + zy) * w) / (3 * sum(w)) + any_value(cy), 4) AS y FROM c GROUP BY building_id""")
def polygon_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and centroid of polygons with holes, measured from their own corner so that large coordinates cost no digits."""
    p = polygons(spark, sf_dir)
    x, y = geo.rings_centroid(F.transform("rings", lambda r: F.transform(r, lambda c: F.struct((c["x"] - F.col("cx")).alias("x"), (c["y"] - F.col("cy")).alias("y")))))
    return p.select("building_id", F.round(geo.rings_area(F.transform("rings", lambda r: F.transform(r, lambda c: F.struct((c["x"] - F.col("cx")).alias("x"), (c["y"] - F.col("cy")).alias("y"))))), 3).alias("area"), F.round(x + F.col("cx"), 4).alias("x"), F.round(y + F.col("cy"), 4).alias("y"))


@query("inner_points", "SELECT building_id, TRUE AS inside FROM v_buildings")
def inner_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point of each polygon; whether the polygon covers it."""
    p = polygons(spark, sf_dir)
    x, y = geo.rings_centroid(F.col("rings"))
    p = p.withColumn("centroid", F.struct(x.alias("x"), y.alias("y")))
    p = p.withColumn("inner", geo.inner_point(F.col("rings"), F.col("centroid")))
    return p.select("building_id", geo.rings_cover(F.col("inner.x"), F.col("inner.y"), F.col("rings")).alias("inside"))


@query("near_buildings", """
WITH b AS (SELECT min(x_m) AS x0, max(x_m) AS x1, min(y_m) AS y0, max(y_m) AS y1 FROM v_points WHERE velocity > 9.9)
SELECT building_id FROM v_buildings, b WHERE cx + hw >= x0 - 47 AND cx - hw <= x1 + 47 AND cy + hh >= y0 - 47 AND cy - hh <= y1 + 47""")
def near_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings that the fast points can reach at all."""
    return assign.near_buildings(adapters.buildings(spark, sf_dir), adapters.points(spark, sf_dir).where("velocity > 9.9"), 47.0).select("building_id")


@query("geojson_buildings", """
SELECT building_id, round(height, 4) AS height, CASE WHEN CAST(building_id AS BIGINT) % 3 = 0 THEN 2 ELSE 1 END AS parts, round(4 * hw * hh, 4) AS area FROM v_buildings WHERE height IS NOT NULL AND slope_mean_deg > 0""")
def geojson_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features from GeoJSON text: one or more polygons, and some without geometry or with an empty one, which are dropped as such."""
    n = F.col("building_id").cast("long")
    corner = lambda a, b: F.array(F.col("cx") + a * F.col("hw"), F.col("cy") + b * F.col("hh"))
    ring = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))
    shape = lambda kind, c: F.to_json(F.struct(F.lit(kind).alias("type"), c.alias("coordinates")))
    geometry = F.when(F.col("height").isNull(), "null").when(F.col("slope_mean_deg") == 0, '{"type":"Polygon","coordinates":[]}').when(n % 3 == 0, shape("MultiPolygon", F.array(F.array(ring), F.array(ring)))).otherwise(shape("Polygon", F.array(ring)))
    text = F.concat(F.lit('{"type":"Feature","properties":{"id":"'), "building_id", F.lit('","height":'), F.coalesce(F.col("height").cast("string"), F.lit("null")), F.lit('},"geometry":'), geometry, F.lit("}"))
    found = ingest.geojson_features(adapters.buildings(spark, sf_dir).select(text.alias("value")))
    first = F.get("polygons", F.lit(0))
    return found.select(json.get_text(F.col("properties"), "id").alias("building_id"), F.round(json.get_float(F.col("properties"), "height"), 4).alias("height"), F.size("polygons").alias("parts"), F.round(geo.rings_area(_centred(first)), 4).alias("area"))


def _centred(rings):
    """Rings measured from the first corner of the first one."""
    zero = F.get(F.get(rings, F.lit(0)), F.lit(0))
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct((p["x"] - zero["x"]).alias("x"), (p["y"] - zero["y"]).alias("y"))))


_COLOR = "CAST(('0x' || substr(sha1({0}), 1, 8))::BIGINT % 60 AS INTEGER)"
_RESULTS = """r AS (SELECT code, track, area_id, dataset_id, CASE WHEN epochs >= 24 THEN building_id END AS building_id, abs(velocity) / 10 AS anomaly, coherence AS quality FROM v_points WHERE coherence IS NOT NULL),
l AS (SELECT area_id, building_id, count(*) AS points, avg(anomaly) AS anomaly FROM r WHERE building_id IS NOT NULL GROUP BY area_id, building_id)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a run, and of its buildings: some points have none, some no building."""
    p = adapters.points(spark, sf_dir).where("coherence IS NOT NULL")
    return p.select("code", "track", "area_id", "dataset_id", F.when(F.col("epochs") >= 24, F.col("building_id")).alias("building_id"), (F.abs("velocity") / 10).alias("anomaly"), F.col("coherence").alias("quality"))


def _rolled(results: DataFrame) -> DataFrame:
    return results.where("building_id IS NOT NULL").groupBy("area_id", "building_id").agg(F.count("*").alias("points"), F.avg("anomaly").alias("anomaly"))


def _colors(results: DataFrame) -> DataFrame:
    """Colours of the buildings with three points and more; others are coloured by their key alone."""
    return _rolled(results).where("points >= 3").select("area_id", "building_id", ((classify.palette_index(F.col("building_id")) + 7) % 60).alias("color"))


POINT_FEATURES = f"""
WITH {_RESULTS}
SELECT r.code, r.track, p.x_m, p.y_m, round(r.anomaly, 6) AS anomaly, r.building_id IS NOT NULL AS assigned,
  CASE WHEN l.points >= 3 THEN ({_COLOR.format('r.building_id')} + 7) % 60 ELSE {_COLOR.format('coalesce(r.building_id, r.code)')} END AS color
FROM r JOIN v_points p ON p.area_id = r.area_id AND p.dataset_id = r.dataset_id AND p.code = r.code AND p.track = r.track LEFT JOIN l ON l.area_id = r.area_id AND l.building_id = r.building_id"""


@query("tile_point_features", POINT_FEATURES)
def tile_point_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with their points, joined by all four keys, and the colour of the building or else of the key."""
    r = _results(spark, sf_dir)
    p = adapters.points(spark, sf_dir).select("area_id", "dataset_id", "code", "track", "x_m", "y_m")
    met = r.join(p, ["area_id", "dataset_id", "code", "track"]).join(_colors(r), ["area_id", "building_id"], "left")
    color = F.coalesce("color", classify.palette_index(F.coalesce("building_id", "code")))
    return met.select("code", "track", "x_m", "y_m", F.round("anomaly", 6).alias("anomaly"), F.col("building_id").isNotNull().alias("assigned"), color.alias("color"))


BUILDING_FEATURES = f"""
WITH {_RESULTS}
SELECT b.building_id, b.area_id, l.points, round(l.anomaly, 6) AS anomaly, CASE WHEN l.points >= 3 THEN ({_COLOR.format('b.building_id')} + 7) % 60 ELSE {_COLOR.format('b.building_id')} END AS color
FROM v_buildings b LEFT JOIN l ON l.area_id = b.area_id AND l.building_id = b.building_id"""


@query("tile_building_features", BUILDING_FEATURES)
def tile_building_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All buildings with their roll-up and colour, where they have them."""
    r, keys = _results(spark, sf_dir), ["area_id", "building_id"]
    met = adapters.buildings(spark, sf_dir).select(*keys).join(_rolled(r), keys, "left").join(_colors(r), keys, "left")
    return met.select("building_id", "area_id", "points", F.round("anomaly", 6).alias("anomaly"), F.coalesce("color", classify.palette_index(F.col("building_id"))).alias("color"))


@query("point_states", """
WITH q AS (SELECT p.code, p.track, CASE CAST(p.code AS BIGINT) % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'z' END AS run_id FROM v_points p),
s(run_id, status) AS (VALUES ('a', 'succeeded'), ('b', 'running'), ('c', 'failed')),
r AS (SELECT code, track, 'a' AS run_id, abs(velocity) / 10 AS anomaly FROM v_points WHERE coherence >= 0.5)
SELECT q.code, q.run_id, CASE WHEN r.code IS NOT NULL THEN 'ready' WHEN s.run_id IS NULL THEN 'not_found' WHEN s.status IN ('queued', 'running') THEN 'pending' ELSE 'missing' END AS state, round(r.anomaly, 6) AS anomaly
FROM q LEFT JOIN s ON q.run_id = s.run_id LEFT JOIN r ON q.code = r.code AND q.track = r.track AND q.run_id = r.run_id""")
def point_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For points that are asked for in a run: the result, or why there is none."""
    run = F.element_at(F.array(*[F.lit(x) for x in "abcz"]), (F.col("code").cast("long") % 4 + 1).cast("int"))
    asked = adapters.points(spark, sf_dir).select("code", "track", run.alias("run_id"))
    runs = spark.createDataFrame([("a", "succeeded"), ("b", "running"), ("c", "failed")], "run_id string, status string")
    results = adapters.points(spark, sf_dir).where("coherence >= 0.5").select("code", "track", F.lit("a").alias("run_id"), (F.abs("velocity") / 10).alias("anomaly"))
    return result_states(asked, runs, results).select("code", "run_id", "state", F.round("anomaly", 6).alias("anomaly"))


def result_states(asked: DataFrame, runs: DataFrame, results: DataFrame) -> DataFrame:
    """``asked`` (code, track, run_id) with its result and a state: ready, pending while the run goes on, missing, or not_found without the run."""
    met = asked.join(F.broadcast(runs.select("run_id", "status")), "run_id", "left").join(results.withColumn("there", F.lit(True)), ["code", "track", "run_id"], "left")
    state = F.when(F.col("there"), "ready").when(F.col("status").isNull(), "not_found").when(F.col("status").isin("queued", "running"), "pending").otherwise("missing")
    return met.withColumn("state", state).drop("there", "status")


@query("amplitude_merge", """
SELECT p.code, p.track, a.amplitude FROM v_points p LEFT JOIN (SELECT l_orderkey AS CODE_RAW, max(CAST(l_quantity AS DOUBLE)) AS amplitude FROM lineitem GROUP BY l_orderkey) a ON p.code = CAST(a.CODE_RAW AS VARCHAR)""")
def amplitude_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with a measure of another layer, whose key has another name and type; points without it stay."""
    a = adapters.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("CODE_RAW")).agg(F.max(F.col("l_quantity").cast("double")).alias("amplitude"))
    p = adapters.points(spark, sf_dir)
    return p.join(a, p["code"] == a["CODE_RAW"].cast("string"), "left").select("code", "track", "amplitude")


@query("terrain_fallback", """
WITH s AS (SELECT s_suppkey % 100 AS zone, avg(CAST(s_acctbal AS DOUBLE)) AS mean, min(CAST(s_acctbal AS DOUBLE)) AS min, max(CAST(s_acctbal AS DOUBLE)) AS max FROM supplier GROUP BY 1)
SELECT c_custkey AS zone, round(coalesce(s.mean, CAST(c_acctbal AS DOUBLE)), 6) AS mean, coalesce(s.min, CAST(c_acctbal AS DOUBLE)) AS min, coalesce(s.max, CAST(c_acctbal AS DOUBLE)) AS max, round(coalesce(s.max - s.min, 0), 6) AS range FROM customer LEFT JOIN s ON c_custkey = s.zone""")
def terrain_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones with the statistics of their cells or else the value at one place; customers stand for zones, suppliers for cells."""
    cells = adapters.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 100).alias("zone"), F.col("s_acctbal").cast("double").alias("v"))
    zones = adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("zone"), F.col("c_acctbal").cast("double").alias("here"))
    out = ingest.zones_with_fallback(zones, ingest.zonal_stats(cells, "zone", "v"), "zone", F.col("here"))
    return out.select("zone", F.round("mean", 6).alias("mean"), "min", "max", F.round("range", 6).alias("range"))


@query("first_ways", """
SELECT l_orderkey AS way, l_partkey AS node, l_linenumber AS at FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem) s WHERE k = 1""")
def first_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each key, the first in a stated order."""
    rows = adapters.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way"), F.col("l_partkey").alias("node"), F.col("l_linenumber").alias("at"))
    return ingest.first_by(rows, ["way"], ["at", "node"])


@query("bbox_parse", """
WITH t AS (SELECT code, CASE CAST(code AS BIGINT) % 4 WHEN 0 THEN x_m || ',' || y_m WHEN 1 THEN x_m || ',y,' || y_m || ',1' ELSE x_m || ', ' || y_m || ',' || (x_m + 1) || ',' || (y_m + 1) END AS text, x_m, y_m FROM v_points)
SELECT code, CAST(code AS BIGINT) % 4 > 1 AS valid, CASE WHEN CAST(code AS BIGINT) % 4 > 1 THEN round(x_m, 6) END AS min_lon, CASE WHEN CAST(code AS BIGINT) % 4 > 1 THEN round(y_m + 1, 6) END AS max_lat FROM t""")
def bbox_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, x, y = F.col("code").cast("long") % 4, F.col("x_m"), F.col("y_m")
    text = F.when(n == 0, F.concat_ws(",", x, y)).when(n == 1, F.concat_ws(",", x, F.lit("y"), y, F.lit("1"))).otherwise(F.concat(x, F.lit(", "), y, F.lit(","), x + 1, F.lit(","), y + 1))
    rows = adapters.points(spark, sf_dir).select("code", ingest.parse_bbox(text).alias("b"))
    return rows.select("code", F.col("b").isNotNull().alias("valid"), F.round("b.min_lon", 6).alias("min_lon"), F.round("b.max_lat", 6).alias("max_lat"))


@query("reason_labels", """
SELECT code, replace(CASE WHEN epochs < 24 THEN 'too_few_valid_epochs' ELSE 'low_coherence' END, '_', ' ') AS label, replace('it''s ' || method, '''', '''''') AS escaped FROM v_points""")
def reason_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes as words, and quotes doubled."""
    reason = F.when(F.col("epochs") < 24, "too_few_valid_epochs").otherwise("low_coherence")
    return adapters.points(spark, sf_dir).select("code", F.replace(reason, F.lit("_"), F.lit(" ")).alias("label"), F.replace(F.concat(F.lit("it's "), "method"), F.lit("'"), F.lit("''")).alias("escaped"))


_HELD = "CASE WHEN v IS NULL THEN 10.0 WHEN least(100.0, greatest(1.0, v)) < 10 THEN floor(least(100.0, greatest(1.0, v)) * 10 + 0.5) / 10 ELSE floor(least(100.0, greatest(1.0, v)) + 0.5) END"


@query("height_sensitivities", f"""
WITH s AS (SELECT code, height * 4 AS v FROM v_points), h AS (SELECT code, {_HELD} AS held FROM s), p AS (SELECT code, held, log10(held) AS slider, power(10.0, least(2.0, greatest(0.0, log10(held) + 0.1))) AS v FROM h)
SELECT code, CAST(held AS DOUBLE) AS held, round(slider, 6) AS slider, CAST({_HELD} AS DOUBLE) AS moved FROM p""")
def height_sensitivities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sensitivity held to its range, its place on the slider, and the sensitivity a tenth further on."""
    v = F.col("height") * 4
    slider = classify.sensitivity_slider(v)
    return adapters.points(spark, sf_dir).select("code", classify.height_sensitivity(v).alias("held"), F.round(slider, 6).alias("slider"), classify.slider_sensitivity(slider + 0.1).alias("moved"))


@query("dataset_sensors", """
WITH d AS (SELECT code, CASE CAST(code AS BIGINT) % 5 WHEN 0 THEN 'salzburg_snt' WHEN 1 THEN 'bad_gastein_snt' WHEN 2 THEN 'bad_gastein_tsx_paz' WHEN 3 THEN 'other' END AS dataset_id FROM v_points)
SELECT dataset_id, CASE WHEN coalesce(dataset_id, 'salzburg_snt') IN ('salzburg_snt', 'bad_gastein_snt') THEN 'SNT' WHEN dataset_id = 'bad_gastein_tsx_paz' THEN 'TSX/PAZ' END AS sensor, count(*) AS n FROM d GROUP BY 1, 2""")
def dataset_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("salzburg_snt", "bad_gastein_snt", "bad_gastein_tsx_paz", "other", None)])
    rows = adapters.points(spark, sf_dir).select(F.get(names, (F.col("code").cast("long") % 5).cast("int")).alias("dataset_id"))
    return rows.groupBy("dataset_id", classify.dataset_sensor(F.col("dataset_id")).alias("sensor")).agg(F.count("*").alias("n"))


def _ramp_sql(value: str, stops: tuple[tuple[float, str], ...]) -> str:
    def channel(i: int) -> str:
        points = [(float(x), int(c[i : i + 2], 16)) for x, c in stops]
        parts = [f"WHEN {value} <= {points[0][0]} THEN {points[0][1]}"] + [f"WHEN {value} <= {b[0]}::DOUBLE THEN {a[1]} + ({value} - {a[0]}::DOUBLE) / {b[0] - a[0]!r}::DOUBLE * ({b[1]} - {a[1]})" for a, b in zip(points, points[1:])]
        return f"CAST(round(CAST(CASE {' '.join(parts)} ELSE {points[-1][1]} END AS DOUBLE)) AS INTEGER)"

    return "format('#{:02x}{:02x}{:02x}', " + ", ".join(channel(i) for i in (1, 3, 5)) + ")"


@query("result_colors", f"""
WITH v AS (SELECT code, coherence::DOUBLE AS c, coalesce(coherence, 0)::DOUBLE AS q FROM v_points)
SELECT code, {_ramp_sql('q', classify.QUALITY_RAMP)} AS quality_color, {_ramp_sql('q', classify.ANOMALY_RAMP)} AS anomaly_color, CASE WHEN c IS NULL THEN '{classify.NO_AGREEMENT}' ELSE {_ramp_sql('c', classify.AGREEMENT_RAMP)} END AS agreement_color FROM v""")
def result_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of the three result ramps, by coherence."""
    c = F.col("coherence")
    return adapters.points(spark, sf_dir).select("code", classify.quality_color(c).alias("quality_color"), classify.anomaly_color(c).alias("anomaly_color"), classify.agreement_color(c).alias("agreement_color"))


@query("velocity_thresholds", """
SELECT count(*) FILTER (WHERE velocity <= -5) AS strong_subsidence, count(*) FILTER (WHERE velocity <= -2) AS moderate_subsidence, count(*) FILTER (WHERE velocity BETWEEN -1 AND 1) AS stable, count(*) FILTER (WHERE velocity >= 2) AS moderate_uplift, count(*) FILTER (WHERE velocity >= 5) AS strong_uplift FROM v_points""")
def velocity_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points beyond the published thresholds."""
    t, v = classify.thresholds(), F.col("velocity")
    n = lambda test: F.count(F.when(test, 1))
    return adapters.points(spark, sf_dir).agg(*[n(v <= t[k]).alias(k) for k in ("strong_subsidence", "moderate_subsidence")], n(v.between(t["stable_min"], t["stable_max"])).alias("stable"), *[n(v >= t[k]).alias(k) for k in ("moderate_uplift", "strong_uplift")])


#: Attributes by context: key, aliases, label; and where a context looks when it does not know a key.
ATTRIBUTES = [("building", "height", ("height_m", "hgt"), "Height of the building"), ("point", "height", ("h",), "Height of the point"), ("", "velocity", ("vel", "v"), "Velocity"), ("raw", "height", (), "Raw height")]
FALLBACKS = {"gba": ("gba", "building", "raw"), "osm": ("osm", "building", "raw"), "building": ("building", "gba", "osm", "terrain", "raw"), "raw": ("raw",), "point": ("point", "raw")}


def attribute_labels(asked: DataFrame, attributes: list[tuple[str, str, tuple[str, ...], str]], fallbacks: dict[str, tuple[str, ...]]) -> DataFrame:
    """``asked`` (context, key) with the label of the attribute: by context and those it falls back to, then without one, else the key as words."""
    spark = asked.sparkSession
    named = [(context, name, label) for context, key, aliases, label in attributes for name in (key, *aliases)]
    known = spark.createDataFrame(named, "found_in string, name string, label string").dropDuplicates(["found_in", "name"])
    order = spark.createDataFrame([(c, f, i) for c, fs in fallbacks.items() for i, f in enumerate(fs)] + [(c, "", 99) for c in fallbacks], "context string, found_in string, place int")
    ranked = order.join(known, "found_in").groupBy("context", "name").agg(F.min_by("label", "place").alias("label"))
    return asked.withColumn("name", F.lower(F.trim("key"))).join(F.broadcast(ranked), ["context", "name"], "left").select("context", "key", F.coalesce("label", F.replace(F.col("key"), F.lit("_"), F.lit(" "))).alias("label"))


@query("attribute_names", """
WITH q AS (SELECT code, CASE CAST(code AS BIGINT) % 3 WHEN 0 THEN 'gba' WHEN 1 THEN 'point' ELSE 'raw' END AS context, CASE CAST(code AS BIGINT) % 4 WHEN 0 THEN 'Height' WHEN 1 THEN 'hgt' WHEN 2 THEN 'vel' ELSE 'no_such_key' END AS key FROM v_points)
SELECT context, key, CASE WHEN key = 'vel' THEN 'Velocity' WHEN key = 'no_such_key' THEN 'no such key' WHEN context = 'gba' THEN 'Height of the building' WHEN key = 'hgt' THEN 'hgt' WHEN context = 'point' THEN 'Height of the point' ELSE 'Raw height' END AS label, count(*) AS n FROM q GROUP BY 1, 2, 3""")
def attribute_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("code").cast("long")
    pick = lambda names, k: F.get(F.array(*[F.lit(x) for x in names]), (n % k).cast("int"))
    asked = adapters.points(spark, sf_dir).select(pick(("gba", "point", "raw"), 3).alias("context"), pick(("Height", "hgt", "vel", "no_such_key"), 4).alias("key"))
    return attribute_labels(asked, ATTRIBUTES, FALLBACKS).groupBy("context", "key", "label").agg(F.count("*").alias("n"))


@query("track_texts", """
SELECT building_id, max(CASE WHEN track = 44 THEN CAST(n AS VARCHAR) END) AS a, max(CASE WHEN track = 95 THEN CAST(n AS VARCHAR) END) AS b FROM (SELECT building_id, track, count(*) AS n FROM v_points GROUP BY building_id, track) s GROUP BY building_id""")
def track_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by track in a map whose values are text."""
    counts = adapters.points(spark, sf_dir).groupBy("building_id", "track").agg(F.count("*").alias("n"))
    maps = counts.groupBy("building_id").agg(json.text_map(F.map_from_entries(F.collect_list(F.struct("track", "n")))).alias("m"))
    return maps.select("building_id", F.try_element_at("m", F.lit("44")).alias("a"), F.try_element_at("m", F.lit("95")).alias("b"))


_GRID = "SELECT CAST((c_custkey - c_custkey % 40) / 40 AS INTEGER) AS r, CAST(c_custkey % 40 AS INTEGER) AS c, CAST(c_nationkey * 3 + c_custkey % 7 AS DOUBLE) AS e FROM customer"


@query("raster_light", f"""
WITH g AS ({_GRID}),
d AS (SELECT g.*, u.e AS up, b.e AS dn, l.e AS le, i.e AS ri FROM g LEFT JOIN g u ON u.r = g.r - 1 AND u.c = g.c LEFT JOIN g b ON b.r = g.r + 1 AND b.c = g.c LEFT JOIN g l ON l.c = g.c - 1 AND l.r = g.r LEFT JOIN g i ON i.c = g.c + 1 AND i.r = g.r),
v AS (SELECT *, CASE WHEN up IS NULL AND dn IS NULL THEN 0 ELSE (coalesce(dn, e) - coalesce(up, e)) / (((up IS NOT NULL)::INT + (dn IS NOT NULL)::INT) * 10.0) END AS dy, CASE WHEN le IS NULL AND ri IS NULL THEN 0 ELSE (coalesce(ri, e) - coalesce(le, e)) / (((le IS NOT NULL)::INT + (ri IS NOT NULL)::INT) * 10.0) END AS dx FROM d),
s AS (SELECT r, c, atan(sqrt(dx * dx + dy * dy)) AS slope, degrees(atan2(-dx, dy)) + 360 AS a FROM v), t AS (SELECT r, c, slope, CASE WHEN a >= 360 THEN a - 360 ELSE a END AS aspect FROM s)
SELECT r AS row, c AS col, CASE WHEN slope = 0 THEN 0.0 ELSE round(aspect, 4) END AS aspect_deg, CAST(floor(least(255, greatest(0, 255 * (cos(radians(45)) * cos(slope) + sin(radians(45)) * sin(slope) * cos(radians(315) - radians(aspect)))))) AS INTEGER) AS light FROM t""")
def raster_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aspect and hillshade of a raster; level cells have aspect 0."""
    grid = adapters.table(spark, sf_dir, "customer").selectExpr("CAST((c_custkey - c_custkey % 40) / 40 AS INT) AS row", "CAST(c_custkey % 40 AS INT) AS col", "CAST(c_nationkey * 3 + c_custkey % 7 AS DOUBLE) AS elevation")
    slopes = ingest.slope_aspect(grid, 10.0)
    return slopes.select("row", "col", F.when(F.col("slope_deg") == 0, F.lit(0.0)).otherwise(F.round("aspect_deg", 4)).alias("aspect_deg"), ingest.hillshade(F.col("slope_deg"), F.col("aspect_deg")).alias("light"))


@query("building_draws", """
WITH d AS (SELECT building_id, track, code, row_number() OVER (PARTITION BY building_id, track ORDER BY code) AS i, velocity FROM v_points),
t AS (SELECT building_id, track, list(velocity ORDER BY i) FILTER (WHERE i <= 4) AS draws, count(*) AS n FROM d GROUP BY building_id, track HAVING count(*) >= 4),
u AS (SELECT building_id, track, unnest(draws) AS v, unnest(range(4)) AS k FROM t),
p AS (SELECT building_id, k, avg(v) AS m, count(*) AS tracks, exp(-(max(v) - min(v)) / greatest(1.0, 0.25)) AS agreement FROM u GROUP BY building_id, k)
SELECT building_id, max(tracks) AS tracks, round(avg(m), 6) AS mean, round(median(m), 6) AS median, round(quantile_cont(m, 0.95) - quantile_cont(m, 0.05), 6) AS ci_width, round(avg(CASE WHEN tracks >= 2 THEN agreement END), 6) AS agreement FROM p GROUP BY building_id""")
def building_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of a building's tracks joined draw by draw; here the first four velocities of each track stand for its draws."""
    p = adapters.points(spark, sf_dir)
    lists = p.groupBy("building_id", "track").agg(F.sort_array(F.collect_list(F.struct("code", "velocity"))).alias("x"), F.count("*").alias("n")).where("n >= 4")
    draws = lists.select("building_id", "track", F.transform(F.slice("x", 1, 4), lambda e: e["velocity"]).alias("draws"))
    found = resample.building_distributions(draws, "building_id", F.lit(1.0))
    r = lambda c: F.round(c, 6)
    return found.select("building_id", F.col("tracks").cast("long").alias("tracks"), r("motion.mean").alias("mean"), r("motion.median").alias("median"), r("motion.ci_width").alias("ci_width"), r("agreement.mean").alias("agreement"))
