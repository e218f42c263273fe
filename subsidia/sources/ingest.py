"""Normalising raw layers: column aliases, defaults, validation, OpenStreetMap elements, paging, rasters."""

from __future__ import annotations

import gzip
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Names of measures in the raw layers and ours.
ALIASES = {
    "vel": "velocity", "v_stdev": "velocity_std", "h_stdev": "height_std", "acc": "acceleration", "a_stdev": "acceleration_std",
    "inc_angle": "incidence_angle", "look_ang": "look_angle", "eff_area": "eff_area", "code": "code", "coherence": "coherence", "height": "height",
}


def standard_columns(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Renames by alias, an exact name before one that differs in case; columns with another name stay."""
    names, folded = {}, {c.lower(): c for c in reversed(df.columns)}
    for raw, ours in (ALIASES if aliases is None else aliases).items():
        found = raw if raw in df.columns else folded.get(raw.lower())
        if found is not None and found != ours and ours not in names.values():
            names[found] = ours
    return df.withColumnsRenamed(names)


def with_schema(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Exactly the columns in order, cast; missing ones are null, others dropped."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns])


def with_defaults(df: DataFrame, defaults: dict[str, float | str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def first_number(df: DataFrame, names: list[str], default: float) -> Column:
    """The first of the columns that exists and reads as a number, else the default."""
    return F.coalesce(*[F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in names if c in df.columns], F.lit(default))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in all floating columns, for Spark sorts NaN above all numbers."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def violations(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """For key columns, how many rows lack the value or have another than their folder's."""
    return df.agg(*[F.count(F.when(F.col(c).isNull() | (F.col(c) != v), 1)).alias(c) for c, v in expected.items()]).unpivot([], list(expected), "key", "violations")


def bbox_tiles(df: DataFrame, step: float = 0.2) -> DataFrame:
    """Boxes (min_lon, min_lat, max_lon, max_lat) cut into tiles of at most ``step`` degrees, column by column."""
    at = lambda low, high: F.sequence(F.lit(0), F.greatest(F.ceil((F.col(high) - F.col(low)) / step - 1e-9).cast("int") - 1, F.lit(0)))
    tiles = df.withColumn("i", F.explode(at("min_lon", "max_lon"))).withColumn("j", F.explode(at("min_lat", "max_lat")))
    edge = lambda low, high, k, over: F.least(F.col(high), F.col(low) + (F.col(k) + over) * step)
    return tiles.select(*[c for c in df.columns if c not in ("min_lon", "min_lat", "max_lon", "max_lat")], "i", "j", edge("min_lon", "max_lon", "i", 0).alias("min_lon"), edge("min_lat", "max_lat", "j", 0).alias("min_lat"), edge("min_lon", "max_lon", "i", 1).alias("max_lon"), edge("min_lat", "max_lat", "j", 1).alias("max_lat"))


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order, by a mergeable minimum."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first")).select(*keys, "first.*")


def parse_bbox(text: Column) -> Column:
    """(min_lon, min_lat, max_lon, max_lat) of ``a,b,c,d``; null unless it is four numbers."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))
    good = (F.size(parts) == 4) & F.forall(parts, lambda p: p.isNotNull())
    return F.when(good, F.struct(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(("min_lon", "min_lat", "max_lon", "max_lat"))]))


def bbox(text: str) -> tuple[float, float, float, float]:
    """The same for a parameter, on the driver; a ValueError otherwise."""
    try:
        a, b, c, d = map(float, text.split(","))
    except ValueError:
        raise ValueError(f"a box is min_lon,min_lat,max_lon,max_lat and not {text!r}") from None
    return a, b, c, d


def discover(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """(area_id, dataset_id, path) of the tables ``<area_id>/<dataset_id>/<prefix>_t*.parquet`` under a folder of any file system."""
    return _matching(spark, root, f"*/*/{prefix}_t*.parquet").select(*[F.element_at(F.split("path", "/"), -k).alias(c) for k, c in ((3, "area_id"), (2, "dataset_id"))], "path").orderBy("path")


def discover_combined(spark: SparkSession, root: str, name: str) -> list[str]:
    """The table of all areas under a folder, or else those of the single areas in order."""
    combined = _matching(spark, root, name)
    return [r["path"] for r in (_matching(spark, root, f"*/{name}") if combined.isEmpty() else combined).orderBy("path").collect()]


def _matching(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Paths of files and folders that fit a pattern; names only are read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return spark.createDataFrame([(f.getPath().toString(),) for f in found], "path string")


def geojson_features(text: DataFrame, column: str = "value") -> DataFrame:
    """Rows with a GeoJSON feature as text, with ``properties`` (a variant) and ``polygons``, an array of polygons of rings.

    A Polygon is an array of one; features whose geometry is missing, empty or
    of another kind are dropped.
    """
    ring = "array<array<array<double>>>"
    doc = F.try_parse_json(F.col(column))
    kind = F.try_variant_get(doc, "$.geometry.type", "string")
    one, many = (F.try_variant_get(doc, "$.geometry.coordinates", k) for k in (ring, f"array<{ring}>"))
    polygons = F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)
    at = lambda rings: F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    solid = F.filter(polygons, lambda rings: rings.isNotNull() & (F.size(rings) > 0) & (F.size(F.get(rings, F.lit(0))) > 0))
    rows = text.withColumns({"properties": F.try_variant_get(doc, "$.properties", "variant"), "polygons": F.transform(solid, at)})
    return rows.where(F.size("polygons") > 0)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON collections, one document a file: properties and polygons as in ``geojson_features``."""
    whole = spark.read.text(path, wholetext=True)
    features = F.explode(F.try_variant_get(F.try_parse_json("value"), "$.features", "array<variant>")).alias("f")
    return geojson_features(whole.select(features).select(F.to_json("f").alias("value"))).drop("value")


def way_rings(elements: DataFrame) -> DataFrame:
    """(way_id, ring) of OpenStreetMap ways; a way that refers to an unknown node, or to fewer than four, is dropped.

    Elements have type, id, lon, lat and nodes (array of ids).
    """
    nodes = elements.where("type = 'node'").select(F.col("id").alias("node"), "lon", "lat")
    refs = elements.where("type = 'way' AND size(nodes) >= 4").select(F.col("id").alias("way_id"), F.posexplode("nodes").alias("at", "node"))
    placed = refs.join(nodes, "node", "left").groupBy("way_id").agg(F.bool_and(F.col("lon").isNotNull()).alias("whole"), F.sort_array(F.collect_list(F.struct("at", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("ring"))
    return placed.where("whole").select("way_id", F.transform("ring", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))


def relation_polygons(elements: DataFrame) -> DataFrame:
    """(relation_id, polygons) of OpenStreetMap relations: a polygon of one ring for each member way that is whole, in the members' order.

    Elements are as in ``way_rings``, with ``members``, an array of (type,
    ref).  Members that are no ways, or unknown ones, or that refer to an
    unknown node, are left out; a relation without any whole way is dropped.
    """
    members = elements.where("type = 'relation'").select(F.col("id").alias("relation_id"), F.posexplode("members").alias("at", "member"))
    members = members.where("member.type = 'way'").select("relation_id", "at", F.col("member.ref").alias("way_id"))
    asked = elements.where("type = 'way'").join(members.select(F.col("way_id").alias("id")).distinct(), "id", "left_semi")
    rings = way_rings(elements.where("type = 'node'").unionByName(asked))
    found = members.join(rings, "way_id").groupBy("relation_id").agg(F.sort_array(F.collect_list(F.struct("at", "ring"))).alias("parts"))
    return found.select("relation_id", F.transform("parts", lambda p: F.array(p["ring"])).alias("polygons"))


def matched_features(xml: Column) -> Column:
    """Number of features in a WFS hits reply; null where the server says unknown."""
    return F.regexp_extract(F.nullif(F.xpath_string(xml, F.lit("/*/@numberMatched")), F.lit("unknown")), r"^(\d+)$", 1).try_cast("int")


def byte_range(header: Column, size: Column) -> Column:
    """(first, last) of a ``bytes=a-b``, ``bytes=a-`` or ``bytes=-n`` header; null if it can't be met."""
    first, last = (F.nullif(F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", i), F.lit("")).cast("long") for i in (1, 2))
    start = F.when(first.isNotNull(), first).otherwise(F.greatest(size - last, F.lit(0)))
    stop = F.when(first.isNull() | last.isNull(), size - 1).otherwise(F.least(last, size - 1))
    return F.when((first.isNotNull() | last.isNotNull()) & (start <= stop), F.struct(start.alias("first"), stop.alias("last")))


def slope_aspect(grid: DataFrame, cell: float) -> DataFrame:
    """Slope and aspect in degrees of a raster (row, col, elevation), by central differences, one-sided at its edges.

    Neighbours come by equality joins on the shifted cell, so the raster is
    divided by cell and not by row.
    """
    at = lambda dr, dc, name: grid.select((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.col("elevation").alias(name))
    rows = grid
    for dr, dc, name in ((1, 0, "above"), (-1, 0, "below"), (0, 1, "left"), (0, -1, "right")):
        rows = rows.join(at(dr, dc, name), ["row", "col"], "left")

    def gradient(before: str, after: str) -> Column:
        steps = F.col(before).isNotNull().cast("int") + F.col(after).isNotNull().cast("int")
        return F.when(steps > 0, (F.coalesce(after, "elevation") - F.coalesce(before, "elevation")) / (steps * cell)).otherwise(F.lit(0.0))

    rows = rows.withColumns({"dy": gradient("above", "below"), "dx": gradient("left", "right")})
    return rows.select("row", "col", "elevation", F.degrees(F.atan(F.hypot("dx", "dy"))).alias("slope_deg"), F.pmod(F.degrees(F.atan2(-F.col("dx"), F.col("dy"))) + 360, F.lit(360.0)).alias("aspect_deg"))


def hillshade(slope_deg: Column, aspect_deg: Column, zenith_deg: float = 45.0, azimuth_deg: float = 315.0) -> Column:
    """Light on a slope from a direction, 0 to 255, whole numbers; nothing known is dark."""
    zenith, slope = math.radians(zenith_deg), F.radians(slope_deg)
    light = 255 * (math.cos(zenith) * F.cos(slope) + math.sin(zenith) * F.sin(slope) * F.cos(math.radians(azimuth_deg) - F.radians(aspect_deg)))
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.coalesce(light, F.lit(0.0))))).cast("int")


def zones_with_fallback(zones: DataFrame, stats: DataFrame, zone: str, fallback: Column) -> DataFrame:
    """Zones with the mean, min and max of their cells; a zone without cells takes ``fallback`` for each, and a range of 0."""
    met = zones.join(stats, zone, "left")
    return met.withColumns({c: F.coalesce(c, fallback) for c in ("mean", "min", "max")} | {"range": F.coalesce("range", F.lit(0.0))})


def sample_raster(points: DataFrame, grid: DataFrame, x0: float, y0: float, cell: float) -> DataFrame:
    """Points (x_m, y_m) with the values of the raster cell they lie in; null outside it."""
    placed = points.withColumns({"col": F.floor((F.col("x_m") - x0) / cell).cast("int"), "row": F.floor((y0 - F.col("y_m")) / cell).cast("int")})
    return placed.join(grid, ["row", "col"], "left")


def zonal_stats(cells: DataFrame, zone: str, value: str) -> DataFrame:
    return cells.groupBy(zone).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), (F.max(value) - F.min(value)).alias("range"))


class _Page(InputPartition):
    def __init__(self, start: int, count: int):
        super().__init__(start)
        self.start, self.count = start, count


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.total, self.size, self.source = int(options["total"]), int(options.get("page_size", "1000")), options["fetch"]

    def partitions(self) -> list[InputPartition]:
        return [_Page(at, min(self.size, self.total - at)) for at in range(0, self.total, self.size)]

    def read(self, partition):
        import importlib

        module, name = self.source.rsplit(":", 1)
        found = list(getattr(importlib.import_module(module), name)(partition.start, partition.count))
        if len(found) != partition.count:
            raise ValueError(f"page at {partition.start} has {len(found)} of {partition.count} features")
        yield from found


class PagedFeatures(DataSource):
    """A paged feature service, one partition for each page.

    Options: ``total`` (the service's count), ``page_size``, and ``fetch``, a
    ``module:function`` that is called with (start, count) and yields (id,
    properties JSON, geometry JSON).  A page with another number of features
    than asked for is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        return "id string, properties string, geometry string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


def hgt_rows(files: DataFrame) -> DataFrame:
    """(north, east, n, row, heights) of elevation tiles, a row of the raster each, from (path, content) as the ``binaryFile`` source gives them.

    A tile is n x n big-endian 16-bit heights in metres, rows from the north;
    its name begins with the degrees of its south-western corner.  Names that
    end in .gz hold it compressed.  Voids are null; a file of another name or
    size is an error.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                name = path.as_py().rsplit("/", 1)[-1]
                found = re.match(r"([NS])(\d+)([EW])(\d+)\.hgt(\.gz)?$", name, re.IGNORECASE)
                data = content.as_buffer() if found is None or not found[5] else gzip.decompress(content.as_buffer())
                n = math.isqrt(len(data) // 2)
                if found is None or 2 * n * n != len(data) or n < 2:
                    raise ValueError(f"{name} is no elevation tile")
                north, east = (int(v) * (-1 if side in "SWsw" else 1) for side, v in ((found[1], found[2]), (found[3], found[4])))
                heights = np.frombuffer(data, ">i2").astype(np.float32)
                values = pa.array(heights, mask=heights == -32768)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * n + 1, n, dtype=np.int32)), values)
                same = lambda v: pa.array(np.full(n, v, np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(north), same(east), same(n), pa.array(np.arange(n, dtype=np.int32)), lists], ["north", "east", "n", "row", "heights"])

    return files.select("path", "content").mapInArrow(made, "north int, east int, n int, row int, heights array<float>")


def read_hgt(spark: SparkSession, path: str) -> DataFrame:
    """Elevation tiles below a folder of any file system, .hgt and .hgt.gz; see ``hgt_rows``."""
    return hgt_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.{hgt,HGT,hgt.gz,HGT.gz}").option("recursiveFileLookup", "true").load(path))


def hgt_mosaic(tiles: DataFrame) -> DataFrame:
    """(row, col, elevation) of all tiles as one raster, rows counted from the equator to the south.

    Neighbouring tiles share their edges: there the first tile that has a value
    wins, from the north-west, row by row.  Only edges are grouped; what is
    inside a tile stays where it was read.  Cells without a value are left out.
    """
    step = F.col("n") - 1
    cells = tiles.select("north", "east", "n", (F.col("row") - (F.col("north") + 1) * step).alias("row"), F.posexplode("heights").alias("at", "elevation")).where("elevation IS NOT NULL")
    cells = cells.withColumn("col", F.col("at") + F.col("east") * step)
    shared = (F.col("at") == 0) | (F.col("at") == step) | (F.pmod("row", step) == 0)
    once = cells.where(shared).groupBy("row", "col").agg(F.min_by("elevation", F.struct(-F.col("north"), "east")).alias("elevation"))
    return cells.where(~shared).select("row", "col", "elevation").unionByName(once)


def sample_bilinear(points: DataFrame, grid: DataFrame, key: str, x0: float, y0: float, cell: float) -> DataFrame:
    """(key, value) at points by bilinear interpolation between the four nearest cell centres; null if one of them is missing.

    Each point asks for its four cells, so the raster is joined by cell.
    """
    u, v = (F.col("x_m") - x0) / cell - 0.5, (y0 - F.col("y_m")) / cell - 0.5
    rows = points.select(key, F.floor(u).cast("int").alias("c"), F.floor(v).cast("int").alias("r"), (u - F.floor(u)).alias("a"), (v - F.floor(v)).alias("b"))
    corner = lambda dr, dc, w: F.struct((F.col("r") + dr).alias("row"), (F.col("c") + dc).alias("col"), w.alias("w"))
    a, b = F.col("a"), F.col("b")
    asked = rows.select(key, F.explode(F.array(corner(0, 0, (1 - a) * (1 - b)), corner(0, 1, a * (1 - b)), corner(1, 0, (1 - a) * b), corner(1, 1, a * b))).alias("q")).select(key, "q.*")
    met = asked.join(grid.select("row", "col", "elevation"), ["row", "col"], "left")
    return met.groupBy(key).agg(F.when(F.count("elevation") == 4, F.sum(F.col("w") * F.col("elevation"))).alias("value"))


def zone_cells(zones: DataFrame, cell: float) -> DataFrame:
    """(cell_x, cell_y, zone) of all cells that a zone's box touches; of several zones the last one by ``zone``."""
    from subsidia.operators.assign import with_cells

    touched = with_cells(zones, F.col("cx") - F.col("hw"), F.col("cy") - F.col("hh"), F.col("cx") + F.col("hw"), F.col("cy") + F.col("hh"), cell)
    return touched.groupBy("cell_x", "cell_y").agg(F.max("zone").alias("zone"))
