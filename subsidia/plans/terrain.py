"""Queries over rasters and the polygons on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsidia.operators import raster
from subsidia.plans.catalog import query
from subsidia.plans.layers import EDGES, polygons
from subsidia.sources import adapters, ingest

#: Corner and cell of the raster, in metres; no polygon's edge lies on a border of cells.
_X0, _Y0, _CELL = 349_980.3, 5_299_990.7, 3.7


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-shaped buildings with a court, each moved so that it lies across its neighbours' cells."""
    return polygons(spark, sf_dir).withColumn("zone", F.col("building_id").cast("long"))


_TOUCHED = f"""{EDGES},
p AS (SELECT CAST(building_id AS BIGINT) AS zone, (ax - {_X0}) / {_CELL} AS ax, ({_Y0} - ay) / {_CELL} AS ay, (zx - {_X0}) / {_CELL} AS zx, ({_Y0} - zy) / {_CELL} AS zy FROM e),
box AS (SELECT zone, floor(min(least(ax, zx)))::BIGINT AS c0, floor(max(greatest(ax, zx)))::BIGINT AS c1, floor(min(least(ay, zy)))::BIGINT AS r0, floor(max(greatest(ay, zy)))::BIGINT AS r1 FROM p GROUP BY zone),
cand AS (SELECT zone, c, r FROM (SELECT zone, c, unnest(range(r0, r1 + 1)) AS r FROM (SELECT *, unnest(range(c0, c1 + 1)) AS c FROM box))),
hit AS (SELECT k.zone, c, r,
    bool_or(greatest(0, least((c - ax) / nullif(zx - ax, 0), (c + 1 - ax) / nullif(zx - ax, 0)), least((r - ay) / nullif(zy - ay, 0), (r + 1 - ay) / nullif(zy - ay, 0))) <= least(1, greatest((c - ax) / nullif(zx - ax, 0), (c + 1 - ax) / nullif(zx - ax, 0)), greatest((r - ay) / nullif(zy - ay, 0), (r + 1 - ay) / nullif(zy - ay, 0)))
      AND (zx <> ax OR (ax >= c AND ax < c + 1)) AND (zy <> ay OR (ay >= r AND ay < r + 1))) AS edge,
    sum(((ay > r + 0.5) <> (zy > r + 0.5) AND c + 0.5 < (zx - ax) * (r + 0.5 - ay) / CASE WHEN zy = ay THEN 1 ELSE zy - ay END + ax)::INT) % 2 = 1 AS inside
  FROM cand k JOIN p ON k.zone = p.zone GROUP BY k.zone, c, r),
cell AS (SELECT r, c, max(zone) AS zone FROM hit WHERE edge OR inside GROUP BY r, c)"""


@query("rasterised_polygons", f"""
WITH {_TOUCHED} SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, zone FROM cell""")
def rasterised_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells that buildings touch; where two touch one, the later building has it."""
    return raster.touched_cells(_shapes(spark, sf_dir), _X0, _Y0, _CELL)


_GROUND = f"SELECT CAST(floor(({_Y0} - y_m) / {_CELL}) AS INTEGER) AS row, CAST(floor((x_m - {_X0}) / {_CELL}) AS INTEGER) AS col, min(height) AS elevation, avg(step_abs) AS slope FROM v_points WHERE height IS NOT NULL GROUP BY 1, 2"


@query("building_terrain", f"""
WITH {_TOUCHED}, g AS ({_GROUND}),
s AS (SELECT zone, avg(elevation) AS m, min(elevation) AS lo, max(elevation) AS hi, avg(slope) AS sm, max(slope) AS sx FROM cell JOIN g ON g.row = cell.r AND g.col = cell.c GROUP BY zone),
i AS (SELECT CAST(building_id AS BIGINT) AS zone, floor((cx - 0.25 * hw - {_X0}) / {_CELL}) AS col, floor(({_Y0} - cy + 0.75 * hh) / {_CELL}) AS row FROM v_buildings)
SELECT CAST(i.zone AS VARCHAR) AS building_id, round(coalesce(m, elevation), 6) AS elevation_mean, coalesce(lo, elevation) AS elevation_min, coalesce(hi, elevation) AS elevation_max, round(coalesce(hi - lo, 0), 6) AS elevation_range, round(coalesce(sm, slope), 6) AS slope_mean, round(coalesce(sx, slope), 6) AS slope_max
FROM i LEFT JOIN s ON s.zone = i.zone LEFT JOIN g ON g.row = i.row AND g.col = i.col""")
def building_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground below each building: heights of radar points by cell are the raster, so many cells have none."""
    p = adapters.points(spark, sf_dir).where("height IS NOT NULL")
    grid = p.groupBy(F.floor((_Y0 - F.col("y_m")) / _CELL).cast("int").alias("row"), F.floor((F.col("x_m") - _X0) / _CELL).cast("int").alias("col")).agg(F.min("height").alias("elevation"), F.avg("step_abs").alias("slope"))
    shapes = _shapes(spark, sf_dir).withColumns({"inner_x": F.col("cx") - 0.25 * F.col("hw"), "inner_y": F.col("cy") - 0.75 * F.col("hh")})
    found = raster.terrain_of_zones(shapes, grid, _X0, _Y0, _CELL, {"elevation": ["mean", "min", "max", "range"], "slope": ["mean", "max"]})
    r = lambda c: F.round(c, 6).alias(c)
    return found.select("building_id", r("elevation_mean"), "elevation_min", "elevation_max", r("elevation_range"), r("slope_mean"), r("slope_max"))


@query("elevation_mosaic", """
WITH g AS (SELECT c_nationkey % 3 AS i, c_nationkey % 4 AS j, CAST(c_custkey % 21 AS INTEGER) AS r, CAST(floor(c_custkey / 21) % 21 AS INTEGER) AS c, CAST(floor(c_acctbal) AS INTEGER) AS h FROM customer),
t AS (SELECT i, j, r, c, max(h) AS h FROM g GROUP BY i, j, r, c),
m AS (SELECT (47 - i) AS north, 12 + j AS east, r, c, h FROM t WHERE h > -900),
w AS (SELECT r - (north + 1) * 20 AS row, c + east * 20 AS col, h, north, east FROM m)
SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CAST(arg_min(h, (-north, east)) AS DOUBLE) AS elevation FROM w GROUP BY row, col""")
def elevation_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 21 x 21 heights, made from the customers' balances as files' contents, read as one raster; low balances are voids."""
    k = F.col("c_custkey")
    cells = adapters.table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 3).alias("i"), (F.col("c_nationkey") % 4).alias("j"), (k % 21 * 21 + F.floor(k / 21) % 21).cast("int").alias("at"), F.floor("c_acctbal").cast("int").alias("h"))
    cells = cells.groupBy("i", "j", "at").agg(F.max("h").alias("h")).where("h > -900")
    tiles = cells.groupBy("i", "j").agg(F.map_from_entries(F.collect_list(F.struct("at", "h"))).alias("m"))
    height = lambda at: F.lpad(F.hex(F.pmod(F.coalesce(F.try_element_at("m", at), F.lit(-32768)), F.lit(65536)).cast("long")), 4, "0")
    content = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(440)), height), ""))
    files = tiles.select(F.format_string("/tiles/N%02dE%03d.hgt", (47 - F.col("i")).cast("int"), (12 + F.col("j")).cast("int")).alias("path"), content.alias("content"))
    return ingest.hgt_mosaic(ingest.hgt_rows(files)).select("row", "col", F.col("elevation").cast("double").alias("elevation"))


@query("relation_resolution", """
WITH n AS (SELECT p_partkey AS node FROM part), w AS (SELECT l_orderkey AS way, count(*) AS refs, bool_and(n.node IS NOT NULL) AS whole FROM lineitem LEFT JOIN n ON l_partkey = n.node WHERE l_orderkey % 7 <> 3 GROUP BY l_orderkey),
m AS (SELECT o_custkey AS relation_id, o_orderkey AS way FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT relation_id, count(*) AS parts, sum(refs)::BIGINT AS vertices, min(m.way) AS first_way FROM m JOIN w ON w.way = m.way WHERE whole AND refs >= 4 GROUP BY relation_id""")
def relation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with a whole way among their members: customers are relations, orders ways, parts nodes; a seventh of the ways is unknown, and urgent orders are members of another kind."""
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda kind, ident, lon=none("double"), nodes=none("array<bigint>"), members=none("array<struct<type:string,ref:bigint>>"): (F.lit(kind).alias("type"), ident.cast("long").alias("id"), lon.alias("lon"), lon.alias("lat"), nodes.alias("nodes"), members.alias("members"))
    nodes = adapters.table(spark, sf_dir, "part").select(*row("node", F.col("p_partkey"), F.col("p_partkey").cast("double")))
    lines = adapters.table(spark, sf_dir, "lineitem").where("l_orderkey % 7 <> 3").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_orderkey"))).alias("x"))
    # The first vertex carries the way's number, to tell the order of the members.
    ways = lines.select(*row("way", F.col("l_orderkey"), nodes=F.transform("x", lambda x: x["l_partkey"].cast("long"))))
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "node").otherwise("way")
    members = adapters.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").cast("long").alias("ref"), kind.alias("type")))).alias("m"))
    relations = members.select(*row("relation", F.col("o_custkey"), members=F.transform("m", lambda x: F.struct(x["type"].alias("type"), x["ref"].alias("ref")))))
    elements = nodes.unionByName(ways).unionByName(relations)
    found = ingest.relation_polygons(elements)
    first = ingest.way_rings(elements.drop("members")).join(members.select("o_custkey", F.explode("m").alias("x")).where("x.type = 'way'").select(F.col("o_custkey").alias("relation_id"), F.col("x.ref").alias("way_id")), "way_id").groupBy("relation_id").agg(F.min("way_id").alias("first_way"))
    return found.join(first, "relation_id").select("relation_id", F.size("polygons").cast("long").alias("parts"), F.size(F.flatten(F.flatten("polygons"))).cast("long").alias("vertices"), "first_way")
