"""Ingest, raster, tile, classification and evaluation queries."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsidia.functions import classify, geo
from subsidia.operators import resample, series
from subsidia.plans.catalog import query
from subsidia.session import materialize
from subsidia.sources import adapters, ingest, sinks

#: Days that are columns of one wide table.
DAYS_PER_BLOCK = 500


@query("melt_series", """
SELECT code, track, date, round(displacement, 6) AS displacement FROM v_series""")
def melt_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days of all series as wide ``dYYYYMMDD`` columns and back to rows, in blocks of days as wide as a layer's file."""
    rows = materialize(adapters.series(spark, sf_dir).withColumn("day", F.date_format("date", "yyyyMMdd")), "series")
    days = [r["day"] for r in rows.select("day").distinct().orderBy("day").collect()]
    blocks = []
    for at in range(0, len(days), DAYS_PER_BLOCK):
        some = days[at : at + DAYS_PER_BLOCK]
        wide = rows.where(F.col("day").between(some[0], some[-1])).groupBy("code", "track").pivot("day", some).agg(F.first("displacement"))
        blocks.append(series.melt_dates(wide.withColumnsRenamed({d: f"D{d}" for d in some}), ["code", "track"], "d", "displacement"))
    return functools.reduce(DataFrame.unionByName, blocks).select("code", "track", "date", F.round("displacement", 6).alias("displacement"))


@query("standardised_points", """
SELECT CAST(o_orderkey AS VARCHAR) AS code, CAST(o_totalprice AS DOUBLE) AS velocity, CAST(NULL AS DOUBLE) AS coherence, 'SNT' AS sensor, coalesce(TRY_CAST(o_orderpriority AS DOUBLE), 10.0) AS height FROM orders""")
def standardised_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw names to ours, missing columns as null, constants, and a numeric default."""
    raw = adapters.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS CODE", "o_totalprice AS Vel", "o_orderpriority AS hgt")
    named = ingest.standard_columns(raw)
    named = named.withColumn("height", ingest.first_number(named, ["height_m", "hgt"], 10.0))
    fixed = ingest.with_schema(named, [("code", "string"), ("velocity", "double"), ("coherence", "double"), ("sensor", "string"), ("height", "double")])
    return ingest.with_defaults(fixed, {"sensor": "SNT"})


@query("key_violations", """
SELECT 'o_orderstatus' AS key, count(*) FILTER (WHERE o_orderstatus IS NULL OR o_orderstatus <> 'F') AS violations FROM orders
UNION ALL SELECT 'o_orderpriority', count(*) FILTER (WHERE o_orderpriority IS NULL OR o_orderpriority <> '1-URGENT') FROM orders""")
def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.violations(adapters.table(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


@query("bbox_tiles", """
WITH b AS (SELECT n_nationkey AS id, CAST(n_nationkey AS DOUBLE) AS x0, 40.0::DOUBLE AS y0, n_nationkey + 0.25 * (1 + n_nationkey % 3) AS x1, 40.5::DOUBLE AS y1 FROM nation),
t AS (SELECT *, unnest(range(greatest(1, CAST(ceil((x1 - x0) / 0.2 - 1e-9) AS BIGINT)))) AS i FROM b), u AS (SELECT *, unnest(range(greatest(1, CAST(ceil((y1 - y0) / 0.2 - 1e-9) AS BIGINT)))) AS j FROM t)
SELECT id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(least(x1, x0 + i * 0.2), 6) AS min_lon, round(least(y1, y0 + j * 0.2), 6) AS min_lat, round(least(x1, x0 + (i + 1) * 0.2), 6) AS max_lon, round(least(y1, y0 + (j + 1) * 0.2), 6) AS max_lat FROM u""")
def bbox_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    boxes = adapters.table(spark, sf_dir, "nation").select(k.alias("id"), k.cast("double").alias("min_lon"), F.lit(40.0).alias("min_lat"), (k + 0.25 * (1 + k % 3)).alias("max_lon"), F.lit(40.5).alias("max_lat"))
    return ingest.bbox_tiles(boxes).select("id", "i", "j", *[F.round(c, 6).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])


@query("way_resolution", """
WITH n AS (SELECT p_partkey AS node FROM part), r AS (SELECT l_orderkey AS way, l_linenumber AS at, l_partkey AS node FROM lineitem),
w AS (SELECT way, count(*) AS refs, bool_and(n.node IS NOT NULL) AS whole FROM r LEFT JOIN n ON r.node = n.node GROUP BY way)
SELECT way AS way_id, refs AS vertices FROM w WHERE whole AND refs >= 4""")
def way_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways whose nodes are all known; orders stand for ways and parts for nodes."""
    kind = "array<bigint>"
    nodes = adapters.table(spark, sf_dir, "part").select(F.lit("node").alias("type"), F.col("p_partkey").cast("long").alias("id"), F.col("p_partkey").cast("double").alias("lon"), F.col("p_partkey").cast("double").alias("lat"), F.lit(None).cast(kind).alias("nodes"))
    ways = adapters.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("long")).alias("nodes"))
    ways = ways.select(F.lit("way").alias("type"), "id", F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), "nodes")
    return ingest.way_rings(nodes.unionByName(ways)).select("way_id", F.size("ring").cast("long").alias("vertices"))


@query("zonal_stats", """
SELECT l_suppkey AS zone, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS mean, min(CAST(l_quantity AS DOUBLE)) AS min, max(CAST(l_quantity AS DOUBLE)) AS max, max(CAST(l_quantity AS DOUBLE)) - min(CAST(l_quantity AS DOUBLE)) AS range FROM lineitem GROUP BY l_suppkey""")
def zonal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = adapters.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("zone"), F.col("l_quantity").cast("double").alias("v"))
    return ingest.zonal_stats(cells, "zone", "v").withColumn("mean", F.round("mean", 6))


_GRID = "SELECT CAST((c_custkey - c_custkey % 40) / 40 AS INTEGER) AS r, CAST(c_custkey % 40 AS INTEGER) AS c, CAST(c_nationkey * 3 + c_custkey % 7 AS DOUBLE) AS e FROM customer"


@query("raster_slope", f"""
WITH g AS ({_GRID}),
d AS (SELECT g.*, u.e AS up, b.e AS dn, l.e AS le, i.e AS ri FROM g LEFT JOIN g u ON u.r = g.r - 1 AND u.c = g.c LEFT JOIN g b ON b.r = g.r + 1 AND b.c = g.c LEFT JOIN g l ON l.c = g.c - 1 AND l.r = g.r LEFT JOIN g i ON i.c = g.c + 1 AND i.r = g.r),
v AS (SELECT *, CASE WHEN up IS NULL AND dn IS NULL THEN 0 ELSE (coalesce(dn, e) - coalesce(up, e)) / (((up IS NOT NULL)::INT + (dn IS NOT NULL)::INT) * 10.0) END AS dy, CASE WHEN le IS NULL AND ri IS NULL THEN 0 ELSE (coalesce(ri, e) - coalesce(le, e)) / (((le IS NOT NULL)::INT + (ri IS NOT NULL)::INT) * 10.0) END AS dx FROM d)
SELECT r AS row, c AS col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope_deg FROM v""")
def raster_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of a raster; customers stand for its cells."""
    grid = adapters.table(spark, sf_dir, "customer").selectExpr("CAST((c_custkey - c_custkey % 40) / 40 AS INT) AS row", "CAST(c_custkey % 40 AS INT) AS col", "CAST(c_nationkey * 3 + c_custkey % 7 AS DOUBLE) AS elevation")
    return ingest.slope_aspect(grid, 10.0).select("row", "col", F.round("slope_deg", 6).alias("slope_deg"))


@query("raster_sample", f"""
WITH g AS ({_GRID})
SELECT p.code, g.e AS elevation FROM v_points p LEFT JOIN g ON g.c = CAST(floor((p.x_m - 350000) / 20) AS INTEGER) AND g.r = CAST(floor((5290200 - p.y_m) / 20) AS INTEGER)""")
def raster_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = adapters.table(spark, sf_dir, "customer").selectExpr("CAST((c_custkey - c_custkey % 40) / 40 AS INT) AS row", "CAST(c_custkey % 40 AS INT) AS col", "CAST(c_nationkey * 3 + c_custkey % 7 AS DOUBLE) AS elevation")
    return ingest.sample_raster(adapters.points(spark, sf_dir), grid, 350000, 5290200, 20.0).select("code", "elevation")


@query("class_counts", """
SELECT (velocity >= -5)::INT + (velocity >= -2)::INT + (velocity >= -1)::INT + (velocity >= 1)::INT + (velocity >= 2)::INT + (velocity >= 5)::INT + (velocity >= 10)::INT AS velocity_class,
       CASE WHEN abs(velocity) < 1 THEN 'good' WHEN abs(velocity) < 3 THEN 'warning' ELSE 'bad' END AS tone, CASE WHEN coherence >= 0.7 THEN 'normal' WHEN coherence < 0.4 THEN 'outlier' ELSE 'suspect' END AS label,
       CASE WHEN coherence IS NULL THEN NULL WHEN coherence >= 0.75 THEN 'high' WHEN coherence >= 0.45 THEN 'medium' ELSE 'low' END AS band, count(*) AS n
FROM v_points GROUP BY 1, 2, 3, 4""")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c = F.col("velocity"), F.col("coherence")
    return adapters.points(spark, sf_dir).groupBy(classify.velocity_class(v).alias("velocity_class"), classify.velocity_tone(v).alias("tone"), classify.quality_label(c).alias("label"), classify.reliability_band(c).alias("band")).agg(F.count("*").alias("n"))


_LONLAT = ("13 + CAST(CAST(code AS BIGINT) % 1000 AS DOUBLE) / 4000", "47.7 + CAST(CAST(code AS BIGINT) % 777 AS DOUBLE) / 7000")


@query("utm_positions", f"""
WITH k AS (SELECT code, {_LONLAT[0]} AS lon, {_LONLAT[1]} AS lat FROM v_points),
c AS (SELECT *, radians(lat) AS p, radians(lon - 15) AS l, 0.0016792203863837047e0 AS n FROM k),
t AS (SELECT *, sinh(atanh(sin(p)) - 2 * sqrt(n) / (1 + n) * atanh(2 * sqrt(n) / (1 + n) * sin(p))) AS t, 6378137.0 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS a FROM c),
u AS (SELECT *, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS et, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3 FROM t)
SELECT code, round(500000 + 0.9996 * a * (et + a1 * cos(2 * xi) * sinh(2 * et) + a2 * cos(4 * xi) * sinh(4 * et) + a3 * cos(6 * xi) * sinh(6 * et)), 3) AS x_m,
       round(0.9996 * a * (xi + a1 * sin(2 * xi) * cosh(2 * et) + a2 * sin(4 * xi) * cosh(4 * et) + a3 * sin(6 * xi) * cosh(6 * et)), 3) AS y_m FROM u""")
def utm_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.to_utm(F.expr(_LONLAT[0]), F.expr(_LONLAT[1]))
    return adapters.points(spark, sf_dir).select("code", F.round(x, 3).alias("x_m"), F.round(y, 3).alias("y_m"))


@query("tile_counts", f"""
WITH k AS (SELECT {_LONLAT[0]} AS lon, {_LONLAT[1]} AS lat FROM v_points)
SELECT CAST(floor((lon + 180) / 360 * 16384) AS INTEGER) AS tile_x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384) AS INTEGER) AS tile_y, count(*) AS n FROM k GROUP BY 1, 2""")
def tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.tile_of(F.expr(_LONLAT[0]), F.expr(_LONLAT[1]), 14)
    return adapters.points(spark, sf_dir).groupBy(x.alias("tile_x"), y.alias("tile_y")).agg(F.count("*").alias("n"))


@query("vector_tiles")
def vector_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector tiles of all points, one for each map tile."""
    lon, lat = F.expr(_LONLAT[0]), F.expr(_LONLAT[1])
    (x, y), (px, py) = geo.tile_of(lon, lat, 14), geo.within_tile(lon, lat, 14)
    rows = adapters.points(spark, sf_dir).select(x.alias("tile_x"), y.alias("tile_y"), F.col("code").cast("long").alias("id"), px.alias("px"), py.alias("py"))
    return sinks.point_tiles(rows)


@query("data_bounds", "SELECT area_id, min(x_m) - 50 AS min_x, min(y_m) - 50 AS min_y, max(x_m) + 50 AS max_x, max(y_m) + 50 AS max_y FROM v_points GROUP BY area_id")
def data_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent of the data with a margin."""
    return adapters.points(spark, sf_dir).groupBy("area_id").agg((F.min("x_m") - 50).alias("min_x"), (F.min("y_m") - 50).alias("min_y"), (F.max("x_m") + 50).alias("max_x"), (F.max("y_m") + 50).alias("max_y"))


@query("bootstrap_stability")
def bootstrap_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap of the median velocity of each building and track, with its stability band."""
    rows = adapters.points(spark, sf_dir).select(F.concat_ws(":", "building_id", "track").alias("key"), "velocity", "code")
    return resample.bootstrap_summary(rows, "key", "velocity", "code").withColumn("band", classify.stability_band(F.col("n"), F.lit(0.5), F.col("ci_width")))


@query("cluster_hulls")
def cluster_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.cluster_hulls(adapters.points(spark, sf_dir), ["building_id", "track"]).withColumn("hull", F.to_json("hull"))


@query("raster_bilinear", f"""
WITH g AS ({_GRID}),
p AS (SELECT code, floor((x_m - 350000) / 20 - 0.5) AS c, floor((5290200 - y_m) / 20 - 0.5) AS r, (x_m - 350000) / 20 - 0.5 - floor((x_m - 350000) / 20 - 0.5) AS a, (5290200 - y_m) / 20 - 0.5 - floor((5290200 - y_m) / 20 - 0.5) AS b FROM v_points)
SELECT p.code, round(g0.e * (1 - a) * (1 - b) + g1.e * a * (1 - b) + g2.e * (1 - a) * b + g3.e * a * b, 9) AS value
FROM p LEFT JOIN g g0 ON g0.c = p.c AND g0.r = p.r LEFT JOIN g g1 ON g1.c = p.c + 1 AND g1.r = p.r LEFT JOIN g g2 ON g2.c = p.c AND g2.r = p.r + 1 LEFT JOIN g g3 ON g3.c = p.c + 1 AND g3.r = p.r + 1""")
def raster_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = adapters.table(spark, sf_dir, "customer").selectExpr("CAST((c_custkey - c_custkey % 40) / 40 AS INT) AS row", "CAST(c_custkey % 40 AS INT) AS col", "CAST(c_nationkey * 3 + c_custkey % 7 AS DOUBLE) AS elevation")
    return ingest.sample_bilinear(adapters.points(spark, sf_dir), grid, "code", 350000, 5290200, 20.0).select("code", F.round("value", 9).alias("value"))


@query("zone_cells", """
WITH z AS (SELECT CAST(building_id AS BIGINT) AS zone, unnest(range(CAST(floor((cx - hw) / 10) AS BIGINT), CAST(floor((cx + hw) / 10) AS BIGINT) + 1)) AS cell_x, cy, hh FROM v_buildings),
y AS (SELECT zone, cell_x, unnest(range(CAST(floor((cy - hh) / 10) AS BIGINT), CAST(floor((cy + hh) / 10) AS BIGINT) + 1)) AS cell_y FROM z)
SELECT cell_x, cell_y, max(zone) AS zone FROM y GROUP BY cell_x, cell_y""")
def zone_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = adapters.buildings(spark, sf_dir).withColumn("zone", F.col("building_id").cast("long"))
    return ingest.zone_cells(zones, 10.0)
