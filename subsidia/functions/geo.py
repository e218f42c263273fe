"""Geometry as column expressions: projections, boxes, rings, tiles.

Positions are metre or degree columns.  A polygon is an array of rings, each an
array of (x, y) structs; holes are rings, told apart by even-odd parity.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 ellipsoid and the transverse Mercator grid of the data (zone 33 north).
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
CENTRAL_MERIDIAN, SCALE, FALSE_EASTING = 15.0, 0.9996, 500_000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_INVERSE = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing of degrees, by the third-order series."""
    phi, lam = F.radians(lat), F.radians(lon - CENTRAL_MERIDIAN)
    k = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - k * F.atanh(k * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_FORWARD, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EASTING + SCALE * _RADIUS * east, SCALE * _RADIUS * north


def from_utm(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of grid metres."""
    xi, eta = y / (SCALE * _RADIUS), (x - FALSE_EASTING) / (SCALE * _RADIUS)
    a, b = xi, eta
    for j, c in enumerate(_INVERSE, 1):
        a = a - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for j, c in enumerate(_LATITUDE, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return CENTRAL_MERIDIAN + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(lat)


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * SEMI_MAJOR, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * SEMI_MAJOR


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the map tile that holds a position, rows from the north."""
    n = 1 << zoom
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2 * n)
    clip = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("int")
    return clip(x), clip(y)


def within_tile(lon: Column, lat: Column, zoom: int, extent: int = 4096) -> tuple[Column, Column]:
    """Position inside its tile on a grid of ``extent`` units."""
    n = 1 << zoom
    x, y = (lon + 180) / 360 * n, (1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2 * n
    return F.round((x - F.floor(x)) * extent).cast("int"), F.round((y - F.floor(y)) * extent).cast("int")


def world_tiles(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Position on the map in tiles, fractions kept, rows from the north."""
    n = 1 << zoom
    return (lon + 180) / 360 * n, (1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2 * n


def flip_row(row: Column, zoom: int) -> Column:
    """Tile row counted from the other side."""
    return F.lit((1 << zoom) - 1) - row


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a position lies in a box, its border included."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def box_distance(x: Column, y: Column, cx: Column, cy: Column, half_width: Column, half_height: Column) -> Column:
    """Distance to an axis-aligned rectangle, 0 inside."""
    dx, dy = F.greatest(F.abs(x - cx) - half_width, F.lit(0.0)), F.greatest(F.abs(y - cy) - half_height, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def ring_edges(ring: Column) -> Column:
    """Pairs of successive vertices; the ring is closed if it isn't."""
    return F.transform(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, F.when(i + 1 < F.size(ring), i + 1).otherwise(F.lit(0))).alias("b")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ring_area(ring: Column) -> Column:
    """Area of a ring, negative if it runs the other way; 0 for an empty one."""
    doubled = F.aggregate(ring_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"].cast("double") * e["b"]["y"] - e["b"]["x"].cast("double") * e["a"]["y"])
    return F.when(F.size(ring) > 0, doubled / 2).otherwise(F.lit(0.0))


def _to_scale(scale: tuple[Column, Column] | None) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """What takes a difference of x and one of y to metres."""
    return (lambda c: c, lambda c: c) if scale is None else (lambda c: c * scale[0], lambda c: c * scale[1])


def ring_distance(x: Column, y: Column, ring: Column, scale: tuple[Column, Column] | None = None) -> Column:
    """Distance to the nearest edge of a ring; ``scale`` has the metres of a unit of x and y."""
    in_x, in_y = _to_scale(scale)

    def of(e: Column) -> Column:
        dx, dy, px, py = in_x(e["b"]["x"] - e["a"]["x"]), in_y(e["b"]["y"] - e["a"]["y"]), in_x(x - e["a"]["x"]), in_y(y - e["a"]["y"])
        length = dx * dx + dy * dy
        t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / length))).otherwise(F.lit(0.0))
        off_x, off_y = px - t * dx, py - t * dy
        return F.sqrt(off_x * off_x + off_y * off_y)

    return F.array_min(F.transform(ring_edges(ring), of))


def rings_cover(x: Column, y: Column, rings: Column, scale: tuple[Column, Column] | None = None) -> Column:
    """Whether a polygon covers a point, border included; even-odd over all rings."""
    in_x, in_y = _to_scale(scale)

    def crossings(ring: Column) -> Column:
        def crosses(e: Column) -> Column:
            a, b = e["a"], e["b"]
            cut = in_x(b["x"] - a["x"]) * in_y(y - a["y"]) / in_y(b["y"] - a["y"])
            return ((a["y"] > y) != (b["y"] > y)) & (x < cut + a["x"] if scale is None else in_x(x - a["x"]) < cut)

        return F.size(F.filter(ring_edges(ring), crosses))

    odd = F.aggregate(rings, F.lit(0), lambda n, r: n + crossings(r)) % 2 == 1
    return odd | F.exists(rings, lambda r: ring_distance(x, y, r, scale) <= 1e-9)


def rings_distance(x: Column, y: Column, rings: Column, scale: tuple[Column, Column] | None = None) -> Column:
    """Distance to a polygon, 0 where it covers the point."""
    return F.when(rings_cover(x, y, rings, scale), F.lit(0.0)).otherwise(F.array_min(F.transform(rings, lambda r: ring_distance(x, y, r, scale))))


def rings_gap(a: Column, b: Column) -> Column:
    """Distance between two polygons, 0 where they meet: from the vertices of each to the edges of the other, unless edges cross or one holds the other."""

    def side(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))

    edges = lambda rings: F.flatten(F.transform(rings, ring_edges))
    crosses = lambda e, f: (side(e["a"], e["b"], f["a"]) * side(e["a"], e["b"], f["b"]) < 0) & (side(f["a"], f["b"], e["a"]) * side(f["a"], f["b"], e["b"]) < 0)
    first = lambda rings: F.get(F.get(rings, F.lit(0)), F.lit(0))
    away = lambda p, q: F.array_min(F.transform(F.flatten(p), lambda v: F.array_min(F.transform(q, lambda r: ring_distance(v["x"], v["y"], r)))))
    crossing = let(edges(b), lambda fs: F.exists(edges(a), lambda e: F.exists(fs, lambda f: crosses(e, f))))
    meet = crossing | rings_cover(first(a)["x"], first(a)["y"], b) | rings_cover(first(b)["x"], first(b)["y"], a)
    return F.when(meet, F.lit(0.0)).otherwise(F.least(away(a, b), away(b, a)))


def rings_box(rings: Column) -> Column:
    """Box (x0, y0, x1, y1) around a polygon."""
    of = lambda c: F.transform(F.flatten(rings), lambda p: p[c])
    return F.struct(F.array_min(of("x")).alias("x0"), F.array_min(of("y")).alias("y0"), F.array_max(of("x")).alias("x1"), F.array_max(of("y")).alias("y1"))


def rings_area(rings: Column) -> Column:
    """Area of a polygon's first ring less that of the others, whichever way they run."""

    def doubled(ring: Column) -> Column:
        return F.abs(F.aggregate(ring_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))

    every = F.transform(rings, doubled)
    return (2 * F.get(every, F.lit(0)) - F.aggregate(every, F.lit(0.0), lambda s, a: s + a)) / 2


def inner_point(rings: Column, centroid: Column) -> Column:
    """A point (x, y) of a polygon: the centroid if the polygon covers it, else the middle of the widest span of the centroid's row.

    The row is that of the centroid's y; its crossings with all edges, in
    order, bound by turns what is inside and what is not.
    """

    def crossings(y: Column) -> Column:
        every = F.flatten(F.transform(rings, ring_edges))
        cut = F.filter(every, lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
        return F.array_sort(F.transform(cut, lambda e: e["a"]["x"] + (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"])))

    xs = crossings(centroid["y"])
    spans = F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) / 2 - 1, F.lit(0)).cast("int")), lambda k: F.struct((F.get(xs, 2 * k + 1) - F.get(xs, 2 * k)).alias("width"), ((F.get(xs, 2 * k + 1) + F.get(xs, 2 * k)) / 2).alias("x")))
    return F.when(rings_cover(centroid["x"], centroid["y"], rings), centroid).otherwise(F.struct(F.array_max(spans)["x"].alias("x"), centroid["y"].alias("y")))


def rings_centroid(rings: Column) -> tuple[Column, Column]:
    """Area centroid by signed areas; holes must run the other way round."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("a", "x", "y")])

    def add(acc: Column, e: Column) -> Column:
        cross = e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
        return F.struct((acc["a"] + cross).alias("a"), (acc["x"] + (e["a"]["x"] + e["b"]["x"]) * cross).alias("x"), (acc["y"] + (e["a"]["y"] + e["b"]["y"]) * cross).alias("y"))

    total = F.aggregate(F.flatten(F.transform(rings, ring_edges)), zero, add)
    return total["x"] / (3 * total["a"]), total["y"] / (3 * total["a"])


def range_offset(height: Column, incidence_deg: Column, *, multiplier: float = 1.0, low: float = 3.0, high: float = 30.0, default_height: float = 12.0) -> Column:
    """Ground range shift of a roof: height times tan of incidence, clipped."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(height, F.lit(default_height)) * F.tan(F.radians(incidence_deg)) * multiplier))


def along_cross(dx: Column, dy: Column, look_bearing_deg: Column) -> tuple[Column, Column]:
    """A displacement's parts along and across the look direction."""
    lx, ly = F.sin(F.radians(look_bearing_deg)), F.cos(F.radians(look_bearing_deg))
    return dx * lx + dy * ly, dy * lx - dx * ly


def vertical_proxy(velocity: Column, incidence_deg: Column) -> Column:
    """Line-of-sight velocity projected to the vertical."""
    return velocity / F.greatest(F.cos(F.radians(incidence_deg)), F.lit(0.30))


def geojson_point(lon: Column, lat: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
