"""Writers: result tables by run, GeoJSON lines, upserts and deletes, map tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_TABLES = ("points", "metrics", "colors", "runs")
#: Points of a map tile that are encoded at a time.
PER_PART = 50_000


def write_run(df: DataFrame, root: str, table: str, run_id: str) -> None:
    """One run's rows of a result table, in their own partition; writing again replaces them."""
    df.write.mode("overwrite").parquet(f"{root}/{table}/run_id={run_id}")


def read_runs(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}")


def delete_run(spark: SparkSession, root: str, run_id: str) -> list[str]:
    """Drops a run's partition from every result table, through Spark's file system; the tables go one by one, not as one transaction."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    gone = []
    for table in RESULT_TABLES:
        path = hadoop.Path(f"{root}/{table}/run_id={run_id}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True):
            gone.append(table)
    return gone


def feature(geometry: Column, properties: list[str], ident: Column | None = None) -> Column:
    """A GeoJSON feature as text; null properties are kept."""
    parts = [F.lit("Feature").alias("type")] + ([ident.alias("id")] if ident is not None else []) + [geometry.alias("geometry"), F.struct(*properties).alias("properties")]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def feature_id(parts: list[str], fallback: Column) -> Column:
    """Parts joined by colons if all are there, else the fallback."""
    whole = F.lit(True)
    for p in parts:
        whole = whole & F.col(p).isNotNull()
    return F.when(whole, F.concat_ws(":", *parts)).otherwise(fallback)


def write_geojson_lines(df: DataFrame, path: str, lon: str, lat: str, properties: list[str], ident: Column | None = None) -> None:
    """One feature per line; NaN becomes null, for JSON has none."""
    clean = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    clean.select(feature(geometry, properties, ident).alias("value")).write.mode("overwrite").text(path)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(number: int, payload: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def encode_point_tile(points: list[tuple[int, int, int]], layer: str = "points", extent: int = 4096) -> bytes:
    """A vector tile with one layer of point features (id, x, y) in tile units."""
    return _tile(b"".join(_point(i, x, y) for i, x, y in points), layer, extent)


def zigzag(v: int) -> int:
    return v << 1 if v >= 0 else (-v << 1) - 1


def _point(ident: int, x: int, y: int, tags: bytes = b"") -> bytes:
    """One point feature of a layer; ``tags`` are its packed attribute numbers."""
    geometry = field(4, varint(9) + varint(zigzag(x)) + varint(zigzag(y)))
    return field(2, varint(1 << 3) + varint(ident) + (field(2, tags) if tags else b"") + varint(3 << 3) + varint(1) + geometry)


def _tile(features: bytes, layer: str, extent: int, attributes: bytes = b"") -> bytes:
    return field(3, varint(15 << 3) + varint(2) + field(1, layer.encode()) + features + attributes + varint(5 << 3) + varint(extent))


def point_tiles(points: DataFrame, most: int | None = None) -> DataFrame:
    """(tile_x, tile_y, features, tile) from rows with tile_x, tile_y, id, px and py: one vector tile for each map tile.

    ``most`` thins a tile to so many points, those with the smallest hash.  A
    tile of many points is encoded in parts of ids, which are put one after the
    other: the bytes of a layer's features add up.
    """
    rows = points.select("tile_x", "tile_y", F.struct(F.xxhash64("id").alias("h"), F.col("id").cast("long").alias("id"), F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py")).alias("p"))
    if most is not None:
        from pyspark.sql.window import Window

        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("tile_x", "tile_y").orderBy("p"))).where(F.col("k") <= most)

    def encoded(group):
        import pandas as pd

        group = group.sort_values("id")
        part = b"".join(_point(i, x, y) for i, x, y in zip(group["id"].tolist(), group["px"].tolist(), group["py"].tolist()))
        return pd.DataFrame({"tile_x": group["tile_x"].iloc[:1], "tile_y": group["tile_y"].iloc[:1], "part": group["part"].iloc[:1], "features": [len(group)], "bytes": [part]})

    def closed(batches):
        for batch in batches:
            yield batch.assign(tile=[_tile(b"".join(parts), "points", 4096) for parts in batch["parts"]]).drop(columns="parts")

    rows = rows.select("tile_x", "tile_y", "p.id", "p.px", "p.py")
    counts = rows.groupBy("tile_x", "tile_y").agg(F.ceil(F.count("*") / PER_PART).alias("parts"), F.min("id").alias("low"), F.max("id").alias("high"))
    place = F.least(F.col("parts") - 1, F.floor((F.col("id") - F.col("low")) / (F.col("high") - F.col("low") + 1) * F.col("parts")))
    parted = rows.join(counts, ["tile_x", "tile_y"]).withColumn("part", place.cast("int"))
    parts = parted.select("tile_x", "tile_y", "id", "px", "py", "part").groupBy("tile_x", "tile_y", "part").applyInPandas(encoded, "tile_x int, tile_y int, part int, features long, bytes binary")
    whole = parts.groupBy("tile_x", "tile_y").agg(F.sum("features").alias("features"), F.transform(F.sort_array(F.collect_list(F.struct("part", "bytes"))), lambda p: p["bytes"]).alias("parts"))
    return whole.mapInPandas(closed, "tile_x int, tile_y int, features long, tile binary")
