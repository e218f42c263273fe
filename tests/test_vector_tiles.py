import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from subsidia.functions import geo
from subsidia.sources import vector_tiles as vt


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def area(points):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1])) / 2


def test_clipping_by_counting(spark):
    """Areas of random stars cut at a square, against a count of sample places that lie in both."""
    rng = np.random.default_rng(1)
    stars = []
    for i in range(20):
        n, (cx, cy) = int(rng.integers(3, 9)), rng.uniform(-5, 15, 2)
        turn = np.sort(rng.uniform(0, 2 * math.pi, n))
        stars.append((i, ring([(cx + rng.uniform(2, 12) * math.cos(t), cy + rng.uniform(2, 12) * math.sin(t)) for t in turn])))
    frame = spark.createDataFrame(stars, "id int, ring array<struct<x:double,y:double>>")
    got = {r.id: r.a for r in frame.select("id", F.abs(geo.ring_area(vt.clip_ring(F.col("ring"), 0.0, 10.0))).alias("a")).collect()}
    side = (np.arange(400) + 0.5) / 40
    for i, points in stars:
        ps = [(p["x"], p["y"]) for p in points]
        x, y = np.meshgrid(side, side)
        odd = np.zeros(x.shape, bool)
        for (ax, ay), (bx, by) in zip(ps, ps[1:] + ps[:1]):
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) / (by - ay) * (bx - ax))
        assert got[i] == pytest.approx(odd.sum() / 1600, abs=0.5)


def test_round_trip_of_attributes(spark):
    """All kinds of values, nulls left out, holes, parts, several layers' keys; in parts as whole."""
    shape = [[{"x": 0, "y": 0}, {"x": 0, "y": 40}, {"x": 300, "y": -64}], [{"x": 5, "y": 5}, {"x": 9, "y": 5}, {"x": 9, "y": 9}]]
    rows = [(i % 3, 7, i if i % 2 else None, shape, "é" * (i % 4), i - 50, i / 7, i % 5 == 0, None if i % 3 else -i) for i in range(100)]
    frame = spark.createDataFrame(rows, "tile_x int, tile_y int, id long, geometry array<array<struct<x:int,y:int>>>, s string, i int, d double, b boolean, n long")
    text = lambda v: {True: "true", False: "false"}[v] if isinstance(v, bool) else str(v)
    want = sorted(str((r[0], 7, "l", r[2], {k: text(v) for k, v in zip("sidbn", r[4:]) if v is not None})) for r in rows)
    for per_part in (1000, 7):
        tiles = vt.encode_tiles(frame, "l", list("sidbn"), "polygon", id_col="id", per_part=per_part)
        got = vt.decode_tiles(tiles.drop("features")).collect()
        plain = [[[(p.x, p.y) for p in r] for r in g.geometry] for g in got]
        assert sorted(str((g.tile_x, g.tile_y, g.layer, g.id, dict(sorted(g.attributes.items(), key=lambda x: "sidbn".index(x[0]))))) for g in got) == want
        assert all(g == [[(p["x"], p["y"]) for p in r] for r in shape] for g in plain)
        assert {r.tile_x: r.features for r in tiles.collect()} == {0: 34, 1: 33, 2: 33}


def test_values_are_stored_once(spark):
    rows = [(0, 0, [[{"x": 1, "y": 1}]], "the same long value") for _ in range(500)]
    frame = spark.createDataFrame(rows, "tile_x int, tile_y int, geometry array<array<struct<x:int,y:int>>>, s string")
    tile = bytes(vt.encode_tiles(frame, "l", ["s"], per_part=50).first().tile)
    assert tile.count(b"the same long value") == 1


def test_polygons_in_tiles(spark):
    """A square over four tiles with a hole on their corner, turned as the format asks; slivers and far polygons vanish."""
    corner = (0.0, 0.0)
    d = 360 / (1 << 10)
    box = lambda x, y, w: ring([(x - w, y - w), (x + w, y - w), (x + w, y + w), (x - w, y + w)])
    rows = [(1, [[box(*corner, d / 4), box(*corner, d / 16)]]), (2, [[ring([(d / 2, d / 2), (d / 2 + 1e-9, d / 2), (d / 2, d / 2 + 1e-9)])]]), (3, [[box(d / 2, d / 2, d / 8)], [box(5 * d / 2, d / 2, d / 8)]]), (4, []), (5, [[box(-d / 400, d / 2, d / 500)]])]
    frame = spark.createDataFrame(rows, "id int, polygons array<array<array<struct<x:double,y:double>>>>")
    got = {(r.id, r.tile_x - 512, r.tile_y - 512): [[(p.x, p.y) for p in g] for g in r.geometry] for r in vt.polygon_tiles(frame, 10).collect()}
    assert {k for k in got if k[0] == 1} == {(1, x, y) for x in (-1, 0) for y in (-1, 0)}
    for k, rings in got.items():
        assert area(rings[0]) > 0 and all(area(r) < 0 for r in rings[1:]) and all(-64 <= v <= 4160 for r in rings for p in r for v in p)
    first = got[1, 0, 0]
    assert len(first) == 2 and abs(area(first[0])) == pytest.approx((1024 + 64) ** 2, rel=1e-3) and abs(area(first[1])) == pytest.approx((256 + 64) ** 2, rel=1e-2)
    assert {k for k in got if k[0] == 3} == {(3, 0, -1), (3, 2, -1)} and not [k for k in got if k[0] in (2, 4)]
    # Within the margin of its neighbour, but only in the tile that it overlaps.
    assert {k for k in got if k[0] == 5} == {(5, -1, -1)}
