"""Vector tiles of results, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsidia.functions.geo import ring_area
from subsidia.plans.catalog import query
from subsidia.plans.layers import BUILDING_FEATURES, COURT, OUTER, POINT_FEATURES, polygons, tile_building_features, tile_point_features
from subsidia.sources import vector_tiles

#: Degrees of the metres in the tables; and the zooms of the two layers.
_LON, _LAT = "13 + (({}) - 350000) / 75000", "47.7 + (({}) - 5290000) / 111000"
_POINTS, _BUILDINGS = 16, 17
_POINT_KEYS = ["code", "track", "anomaly", "assigned", "color"]
_BUILDING_KEYS = ["building_id", "area_id", "points", "anomaly", "color"]


def _fy(lat: str, zoom: int) -> str:
    return f"(1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * {1 << zoom}"


@query("ml_point_tiles")
def ml_point_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector tile for each map tile with results, all attributes in it."""
    found = tile_point_features(spark, sf_dir).withColumns({"lon": F.expr(_LON.format("x_m")), "lat": F.expr(_LAT.format("y_m"))})
    return vector_tiles.encode_tiles(vector_tiles.point_tiles(found, _POINTS), "ml_points", _POINT_KEYS)


@query("ml_point_tile_rows", f"""
WITH f AS ({POINT_FEATURES}), w AS (SELECT *, ({_LON.format("x_m")} + 180) / 360 * {1 << _POINTS} AS fx, {_fy(_LAT.format("y_m"), _POINTS)} AS fy FROM f)
SELECT CAST(floor(fx) AS INTEGER) AS tile_x, CAST(floor(fy) AS INTEGER) AS tile_y, CAST(round((fx - floor(fx)) * 4096) AS INTEGER) AS px, CAST(round((fy - floor(fy)) * 4096) AS INTEGER) AS py, code, track, anomaly, assigned, color FROM w""")
def ml_point_tile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of all point tiles, read back from their bytes."""
    found = vector_tiles.decode_tiles(ml_point_tiles(spark, sf_dir).drop("features"))
    at, of = F.get(F.get("geometry", F.lit(0)), F.lit(0)), lambda k: F.try_element_at("attributes", F.lit(k))
    return found.select("tile_x", "tile_y", at["x"].alias("px"), at["y"].alias("py"), of("code").alias("code"), of("track").cast("int").alias("track"), of("anomaly").cast("double").alias("anomaly"), of("assigned").cast("boolean").alias("assigned"), of("color").cast("int").alias("color"))


@query("ml_building_tiles")
def ml_building_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector tile for each map tile with buildings: L-shaped ones with a court, cut at the tile's margin."""
    shapes = polygons(spark, sf_dir).select("building_id", "rings")
    degrees = lambda p: F.struct((13 + (p["x"] - 350000) / 75000).alias("x"), (47.7 + (p["y"] - 5290000) / 111000).alias("y"))
    found = tile_building_features(spark, sf_dir).join(shapes, "building_id").withColumn("polygons", F.array(F.transform("rings", lambda r: F.transform(r, degrees)))).drop("rings")
    return vector_tiles.encode_tiles(vector_tiles.polygon_tiles(found, _BUILDINGS), "ml_buildings", _BUILDING_KEYS, "polygon")


def _boxes() -> str:
    """The L and its court as signed boxes in half sizes and metres, as SQL values."""
    (x0, y0), (x1, _), _, (xm, ym), _, (_, y1) = OUTER
    (ca, cb), _, (cc, cd), _ = COURT
    rows = [(1, x0, y0, x1, ym, 0, 0, 0, 0), (1, x0, ym, xm, y1, 0, 0, 0, 0), (-1, -0.5, -0.5, -0.5, -0.5, ca, cb, cc, cd)]
    return ", ".join(f"({', '.join(f'{float(v)}::DOUBLE' for v in r)})" for r in rows)


@query("ml_building_tile_rows", f"""
WITH f AS ({BUILDING_FEATURES}), s(sign, ua, va, ub, vb, pa, qa, pb, qb) AS (VALUES {_boxes()}),
m AS (SELECT building_id, sign, ua, va, cx + ua * hw + pa AS xa, cx + ub * hw + pb AS xb, cy + va * hh + qa AS ya, cy + vb * hh + qb AS yb FROM v_buildings, s),
w AS (SELECT building_id, sign, ({_LON.format("xa")} + 180) / 360 * {1 << _BUILDINGS} AS xa, ({_LON.format("xb")} + 180) / 360 * {1 << _BUILDINGS} AS xb, {_fy(_LAT.format("yb"), _BUILDINGS)} AS ya, {_fy(_LAT.format("ya"), _BUILDINGS)} AS yb FROM m),
t AS (SELECT *, unnest(range(floor(y0)::BIGINT, floor(y1)::BIGINT + 1)) AS ty FROM (SELECT *, unnest(range(floor(x0)::BIGINT, floor(x1)::BIGINT + 1)) AS tx FROM (SELECT building_id, min(xa) AS x0, max(xb) AS x1, min(ya) AS y0, max(yb) AS y1 FROM w GROUP BY building_id))),
k AS (SELECT t.building_id, tx, ty, sign, greatest(0, least(4096, (xb - tx) * 4096)) - greatest(0, least(4096, (xa - tx) * 4096)) AS iw, greatest(0, least(4096, (yb - ty) * 4096)) - greatest(0, least(4096, (ya - ty) * 4096)) AS ih,
    round(greatest(-64, least(4160, (xb - tx) * 4096))) - round(greatest(-64, least(4160, (xa - tx) * 4096))) AS width, round(greatest(-64, least(4160, (yb - ty) * 4096))) - round(greatest(-64, least(4160, (ya - ty) * 4096))) AS height FROM t JOIN w ON w.building_id = t.building_id),
g AS (SELECT building_id, tx, ty, sum(CASE WHEN sign > 0 THEN iw * ih ELSE 0 END) AS inner_area, CAST(sum(sign * width * height) AS DOUBLE) AS area, CAST(1 + max(CASE WHEN sign < 0 AND width * height > 0 THEN 1 ELSE 0 END) AS INTEGER) AS rings FROM k GROUP BY building_id, tx, ty)
SELECT CAST(tx AS INTEGER) AS tile_x, CAST(ty AS INTEGER) AS tile_y, f.building_id, area_id, points, anomaly, color, area, rings FROM g JOIN f ON f.building_id = g.building_id WHERE inner_area > 0""")
def ml_building_tile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of all building tiles, read back from their bytes, with the area of what is left of each."""
    found = vector_tiles.decode_tiles(ml_building_tiles(spark, sf_dir).drop("features"))
    of = lambda k: F.try_element_at("attributes", F.lit(k))
    area = F.aggregate("geometry", F.lit(0.0), lambda s, r: s + ring_area(r))
    return found.select("tile_x", "tile_y", of("building_id").alias("building_id"), of("area_id").alias("area_id"), of("points").cast("long").alias("points"), of("anomaly").cast("double").alias("anomaly"), of("color").cast("int").alias("color"), area.alias("area"), F.size("geometry").alias("rings"))
