"""Vector tiles of features with attributes: cutting at tiles, encoding, and reading back.

A feature goes to every tile whose square it overlaps.  Its geometry there is
cut at the square grown by a margin, on a grid of ``EXTENT`` units, and written
as the differences from vertex to vertex.  Attributes are numbers into a table
of keys and one of values, each value once for a tile.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsidia.functions.geo import let, ring_area, ring_edges, world_tiles
from subsidia.session import materialize
from subsidia.sources.sinks import field, varint, zigzag

EXTENT, MARGIN = 4096, 64
#: Features of a tile that are encoded at a time.
PER_PART = 20_000
#: Tiles, or parts of them, that a Python worker gets at a time; and features that it gives back at a time.
TILES, GIVEN = 4, 5_000
_POINT, _POLYGON = 1, 3


def _halved(ring: Column, axis: str, limit: float, keep_above: bool) -> Column:
    """A ring without what lies beyond a line; where it crosses the line it runs along it."""
    inside = lambda p: p[axis] >= limit if keep_above else p[axis] <= limit

    def step(e: Column) -> Column:
        a, b = e["a"], e["b"]
        t = (F.lit(limit) - a[axis]) / (b[axis] - a[axis])
        cut = F.struct(*[(F.lit(float(limit)) if c == axis else a[c] + t * (b[c] - a[c])).alias(c) for c in ("x", "y")])
        end = F.struct(b["x"].alias("x"), b["y"].alias("y"))
        return F.when(inside(a) & inside(b), F.array(end)).when(inside(a), F.array(cut)).when(inside(b), F.array(cut, end)).otherwise(F.slice(F.array(end), F.lit(1), F.lit(0)))

    return F.when(F.size(ring) > 0, F.flatten(F.transform(ring_edges(ring), step))).otherwise(ring)


def clip_ring(ring: Column, low: float, high: float) -> Column:
    """The part of a ring in the square from ``low`` to ``high``, side by side; empty if there is none."""

    def after(ring: Column, sides: list[tuple[str, float, bool]]) -> Column:
        return let(_halved(ring, *sides[0]), lambda r: after(r, sides[1:])) if sides else ring

    return let(ring, lambda r: after(r, [(axis, limit, above) for axis in ("x", "y") for limit, above in ((low, True), (high, False))]))


def _on_grid(ring: Column) -> Column:
    """A ring in whole units, without a vertex that equals the one before it or the first at its end; empty if it has no area."""
    whole = F.transform(ring, lambda p: F.struct(F.round(p["x"]).cast("int").alias("x"), F.round(p["y"]).cast("int").alias("y")))
    moved = let(whole, lambda r: F.filter(r, lambda p, i: p != F.get(r, F.when(i > 0, i - 1).otherwise(F.size(r) - 1))))
    return let(moved, lambda r: F.when((F.size(r) >= 3) & (ring_area(r) != 0), r).otherwise(F.slice(r, F.lit(1), F.lit(0))))


def _turned(ring: Column, positive: bool) -> Column:
    """A ring that runs the way its area has the sign, with rows counted downwards."""
    right = ring_area(ring) > 0 if positive else ring_area(ring) < 0
    return F.when(right, ring).otherwise(F.reverse(ring))


def polygon_tiles(features: DataFrame, zoom: int, *, extent: int = EXTENT, margin: int = MARGIN) -> DataFrame:
    """Rows with tile_x, tile_y and ``geometry`` (rings in tile units) for each tile that a polygon overlaps.

    ``features`` has ``polygons``, an array of polygons of rings of (x, y) in
    degrees; its other columns are kept.  Outer rings run one way and holes the
    other, each outer ring before its holes.  A hole that the cut leaves without
    area is dropped, a polygon with its holes.
    """
    rings = lambda body: F.transform("polygons", lambda rs: F.transform(rs, body))

    def in_tiles(p: Column) -> Column:
        x, y = world_tiles(p["x"], p["y"], zoom)
        return F.struct(x.alias("x"), y.alias("y"))

    rows = features.withColumn("polygons", rings(lambda r: F.transform(r, in_tiles)))
    corner = lambda c, of: of(F.transform(F.flatten(F.flatten("polygons")), lambda p: p[c]))
    span = lambda c: F.sequence(F.floor(corner(c, F.array_min)).cast("int"), F.floor(corner(c, F.array_max)).cast("int"))
    rows = rows.where(F.size(F.flatten(F.flatten("polygons"))) > 0).withColumns({"tile_y": span("y"), "tile_x": F.explode(span("x"))}).withColumn("tile_y", F.explode("tile_y"))
    local = rows.withColumn("polygons", rings(lambda r: F.transform(r, lambda p: F.struct(((p["x"] - F.col("tile_x")) * extent).alias("x"), ((p["y"] - F.col("tile_y")) * extent).alias("y")))))
    local = local.where(F.exists("polygons", lambda rs: ring_area(clip_ring(F.get(rs, F.lit(0)), 0.0, float(extent))) != 0))
    cut = local.withColumn("polygons", rings(lambda r: _on_grid(clip_ring(r, -float(margin), float(extent + margin)))))
    solid = F.filter("polygons", lambda rs: F.size(F.get(rs, F.lit(0))) > 0)
    turned = F.transform(solid, lambda rs: F.transform(F.filter(rs, lambda r: F.size(r) > 0), lambda r, i: F.when(i == 0, _turned(r, True)).otherwise(_turned(r, False))))
    return cut.withColumn("geometry", F.flatten(turned)).where(F.size("geometry") > 0).drop("polygons")


def point_tiles(features: DataFrame, zoom: int, *, extent: int = EXTENT) -> DataFrame:
    """Rows with tile_x, tile_y and ``geometry`` (one ring of one vertex) from points with lon and lat in degrees."""
    x, y = world_tiles(F.col("lon"), F.col("lat"), zoom)
    held = lambda v: F.greatest(F.lit(0), F.least(F.lit((1 << zoom) - 1), F.floor(v))).cast("int")
    rows = features.withColumns({"fx": x, "fy": y}).withColumns({"tile_x": held(F.col("fx")), "tile_y": held(F.col("fy"))})
    unit = lambda v, t: F.round((F.col(v) - F.col(t)) * extent).cast("int")
    return rows.withColumn("geometry", F.array(F.array(F.struct(unit("fx", "tile_x").alias("x"), unit("fy", "tile_y").alias("y"))))).drop("fx", "fy", "lon", "lat")


def _number(kind: str, text: str) -> bytes:
    """A value of the table: text, floating, whole or truth."""
    if kind == "s":
        return field(1, text.encode())
    if kind == "d":
        return varint(3 << 3 | 1) + struct.pack("<d", float(text))
    if kind == "i":
        return varint(6 << 3) + varint(zigzag(int(text)))
    return varint(7 << 3) + varint(int(text == "true"))


_SHORT = [varint(n) for n in range(1 << 14)]


def _varint(n: int) -> bytes:
    return _SHORT[n] if n < len(_SHORT) else varint(n)


def _commands(kind: int, rings: list[tuple[list[int], list[int]]]) -> bytes:
    """The vertices of rings, each as its xs and ys."""
    out, x, y = [], 0, 0
    if kind == _POINT:
        out.append(_varint(1 | sum(len(xs) for xs, _ in rings) << 3))
    for xs, ys in rings:
        for i, (nx, ny) in enumerate(zip(xs, ys)):
            if kind != _POINT and i < 2:
                out.append(_varint(9) if i == 0 else _varint(2 | len(xs) - 1 << 3))
            out += (_varint(zigzag(nx - x)), _varint(zigzag(ny - y)))
            x, y = nx, ny
        if kind != _POINT:
            out.append(_varint(15))
    return b"".join(out)


def _ends(lists: pa.ListArray) -> list[int]:
    """Where each list begins and ends in the flattened array."""
    at = lists.offsets.to_numpy()
    return (at - at[0]).tolist() if len(at) else [0]


def _columns(rows: pa.StructArray) -> list[list]:
    return [c.to_pylist() for c in rows.flatten()]


def _tables(batch: pa.RecordBatch) -> Iterator[list[tuple[str, str]]]:
    """The values (kind, text) of the table of each row's tile."""
    values = batch["values"].fill_null([]) if batch["values"].null_count else batch["values"]
    at, (kinds, texts) = _ends(values), _columns(values.flatten())
    return (list(zip(kinds[i:j], texts[i:j])) for i, j in zip(at, at[1:]))


def encode_tiles(features: DataFrame, layer: str, keys: list[str], kind: str = "point", *, id_col: str | None = None, extent: int = EXTENT, per_part: int = PER_PART) -> DataFrame:
    """(tile_x, tile_y, features, tile) from rows with tile_x, tile_y, ``geometry`` and the attributes ``keys``.

    Null attributes are left out.  Values are collected once for a tile and
    numbered; a tile of many features is encoded in parts of about ``per_part``
    that share the numbers, and the parts are put one after the other.
    """
    number = {"point": _POINT, "polygon": _POLYGON}[kind]
    kinds = {"string": "s", "boolean": "b", "double": "d", "float": "d"}
    types = dict(features.dtypes)
    attribute = lambda i, c: F.struct(F.lit(i).alias("key"), F.lit(kinds.get(types[c], "i")).alias("kind"), F.col(c).cast("string").alias("text"))
    attributes = F.filter(F.array(*[attribute(i, c) for i, c in enumerate(keys)]), lambda a: a["text"].isNotNull())
    ident = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    rows = materialize(features.select("tile_x", "tile_y", F.struct(ident.alias("id"), attributes.alias("attributes"), "geometry").alias("feature")), "tile-features")
    values = rows.select("tile_x", "tile_y", F.explode("feature.attributes").alias("a")).select("tile_x", "tile_y", F.struct("a.kind", "a.text").alias("value")).distinct()
    tables = materialize(values.groupBy("tile_x", "tile_y").agg(F.sort_array(F.collect_list("value")).alias("values")), "tile-values")
    counts = rows.groupBy("tile_x", "tile_y").agg(F.ceil(F.count("*") / per_part).cast("int").alias("parts"))
    parted = rows.join(counts, ["tile_x", "tile_y"]).withColumn("part", F.pmod(F.xxhash64("feature"), F.col("parts")).cast("int"))
    parted = parted.groupBy("tile_x", "tile_y", "part").agg(F.sort_array(F.collect_list("feature")).alias("features"))

    head = varint(3 << 3) + varint(number)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, counts, features = [], [], batch["features"]
            of, (ids, attributes, geometry) = _ends(features), features.flatten().flatten()
            ids, rings = ids.to_pylist(), geometry.flatten()
            tag_at, (tag_key, tag_kind, tag_text) = _ends(attributes), _columns(attributes.flatten())
            ring_at, vertex_at, (xs, ys) = _ends(geometry), _ends(rings), _columns(rings.flatten())
            for first, last, values in zip(of, of[1:], _tables(batch)):
                place = {v: _varint(i) for i, v in enumerate(values)}
                out = []
                for f in range(first, last):
                    tags = b"".join([_SHORT[tag_key[i]] + place[tag_kind[i], tag_text[i]] for i in range(tag_at[f], tag_at[f + 1])])
                    shape = _commands(number, [(xs[a:b], ys[a:b]) for a, b in ((vertex_at[r], vertex_at[r + 1]) for r in range(ring_at[f], ring_at[f + 1]))])
                    body = (varint(8) + varint(ids[f]) if ids[f] is not None else b"") + (field(2, tags) if tags else b"")
                    out.append(field(2, body + head + field(4, shape)))
                made.append(b"".join(out))
                counts.append(len(out))
            yield pa.RecordBatch.from_arrays([batch["tile_x"], batch["tile_y"], batch["part"], pa.array(counts, pa.int64()), pa.array(made, pa.binary())], ["tile_x", "tile_y", "part", "n", "bytes"])

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts, values in zip(batch["parts"], _tables(batch)):
                table = b"".join(field(3, k.encode()) for k in keys) + b"".join([field(4, _number(*v)) for v in values])
                out.append(field(3, varint(15 << 3) + varint(2) + field(1, layer.encode()) + b"".join(parts.as_py()) + table + varint(5 << 3) + varint(extent)))
            yield pa.RecordBatch.from_arrays([batch["tile_x"], batch["tile_y"], batch["features"], pa.array(out, pa.binary())], ["tile_x", "tile_y", "features", "tile"])

    parts = parted.join(tables, ["tile_x", "tile_y"], "left").mapInArrow(encoded, "tile_x int, tile_y int, part int, n long, bytes binary")
    parts = materialize(parts, "tile-parts", arrow_rows=TILES)
    whole = parts.groupBy("tile_x", "tile_y").agg(F.sum("n").alias("features"), F.transform(F.sort_array(F.collect_list(F.struct("part", "bytes"))), lambda p: p["bytes"]).alias("parts"))
    closed_tiles = whole.join(tables, ["tile_x", "tile_y"], "left").mapInArrow(closed, "tile_x int, tile_y int, features long, tile binary")
    return materialize(closed_tiles, "tiles", arrow_rows=TILES)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and contents of a message's fields."""
    at = 0

    def read() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = read()
        if key & 7 == 0:
            yield key >> 3, read()
        else:
            size = read() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


def _packed(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(value)
            value = shift = 0
    return out


def _rings(commands: list[int]) -> list[list[tuple[int, int]]]:
    rings, at, x, y = [], 0, 0, 0
    while at < len(commands):
        command, count = commands[at] & 7, commands[at] >> 3
        at += 1
        if command == 7:
            continue
        for _ in range(count):
            x += (commands[at] >> 1) ^ -(commands[at] & 1)
            y += (commands[at + 1] >> 1) ^ -(commands[at + 1] & 1)
            at += 2
            if command == 1:
                rings.append([])
            rings[-1].append((x, y))
    return rings


def _value(data: bytes) -> str:
    number, content = next(_fields(data))
    as_text: dict[int, Callable] = {1: lambda v: v.decode(), 2: lambda v: str(struct.unpack("<f", v)[0]), 3: lambda v: str(struct.unpack("<d", v)[0]), 6: lambda v: str((v >> 1) ^ -(v & 1)), 7: lambda v: "true" if v else "false"}
    return as_text.get(number, str)(content)


_DECODED = pa.schema([("layer", pa.string()), ("id", pa.int64()), ("kind", pa.int32()), ("geometry", pa.list_(pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))), ("attributes", pa.map_(pa.string(), pa.string()))])


def _lists(values: pa.Array, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), values)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Features (layer, id, kind, rings, names and values of attributes) as a batch, made from flat arrays."""
    layer, ident, kind, geometry, names, values = zip(*rows)
    rings = [r for g in geometry for r in g]
    vertices = [p for r in rings for p in r]
    points = pa.StructArray.from_arrays([pa.array([p[i] for p in vertices], pa.int32()) for i in (0, 1)], ["x", "y"])
    shapes = _lists(_lists(points, [len(r) for r in rings]), [len(g) for g in geometry])
    at = pa.array([0, *accumulate(len(n) for n in names)], pa.int32())
    attributes = pa.MapArray.from_arrays(at, pa.array([x for n in names for x in n], pa.string()), pa.array([x for v in values for x in v], pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(layer, pa.string()), pa.array(ident, pa.int64()), pa.array(kind, pa.int32()), shapes, attributes], schema=_DECODED)


def decode_tiles(tiles: DataFrame, column: str = "tile") -> DataFrame:
    """Features of vector tiles: the other columns, layer, id, kind, geometry (rings in tile units) and attributes as text."""
    others = [c for c in tiles.columns if c != column]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, tile in enumerate(batch[column]):
                for rows in given(tile.as_py() or b""):
                    own = batch.select(others).take(pa.array([i] * len(rows), pa.int64()))
                    found = _batch(rows)
                    yield pa.RecordBatch.from_arrays([*own.columns, *found.columns], [*others, *_DECODED.names])

    def given(tile: bytes) -> Iterator[list[tuple]]:
        """The features of a tile, some at a time."""
        for _, layer in _fields(tile):
            parts = list(_fields(layer))
            name = next(v.decode() for n, v in parts if n == 1)
            names, values = [v.decode() for n, v in parts if n == 3], [_value(v) for n, v in parts if n == 4]
            rows = []
            for f in (dict(_fields(v)) for n, v in parts if n == 2):
                tags = _packed(f.get(2, b""))
                rows.append((name, f.get(1), f[3], _rings(_packed(f[4])), [names[k] for k in tags[::2]], [values[v] for v in tags[1::2]]))
                if len(rows) == GIVEN:
                    yield rows
                    rows = []
            if rows:
                yield rows

    schema = ", ".join(f"{c} {dict(tiles.dtypes)[c]}" for c in others)
    return tiles.mapInArrow(made, f"{schema}, layer string, id long, kind int, geometry array<array<struct<x:int,y:int>>>, attributes map<string,string>")
