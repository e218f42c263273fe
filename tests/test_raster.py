import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from subsidia.operators import raster


def brute(shapes, cell, size=None):
    """Cells by a test of each one: an edge passes through, or the middle is inside."""
    out = {}
    for zone, rings in shapes:
        edges = [((a[0] / cell, -a[1] / cell), (b[0] / cell, -b[1] / cell)) for r in rings for a, b in zip(r, r[1:] + r[:1])]
        xs, ys = [p[0] for e in edges for p in e], [p[1] for e in edges for p in e]
        for r in range(math.floor(min(ys)), math.floor(max(ys)) + 1):
            for c in range(math.floor(min(xs)), math.floor(max(xs)) + 1):
                inside, touched = False, False
                for (ax, ay), (bx, by) in edges:
                    if (ay > r + 0.5) != (by > r + 0.5) and c + 0.5 < ax + (r + 0.5 - ay) / (by - ay) * (bx - ax):
                        inside = not inside
                    low, high, apart = 0.0, 1.0, False
                    for p, q, k in ((ax, bx, c), (ay, by, r)):
                        if p == q:
                            apart |= not k <= p < k + 1
                        else:
                            s, t = sorted(((k - p) / (q - p), (k + 1 - p) / (q - p)))
                            low, high = max(low, s), min(high, t)
                    touched |= not apart and low <= high
                if (inside or touched) and (size is None or (0 <= r < size[0] and 0 <= c < size[1])):
                    out[r, c] = max(zone, out.get((r, c), zone))
    return out


def found(spark, shapes, cell, **options):
    ring = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
    frame = spark.createDataFrame([(z, [ring(r) for r in rings]) for z, rings in shapes], "zone long, rings array<array<struct<x:double,y:double>>>")
    return {(r.row, r.col): r.zone for r in raster.touched_cells(frame, 0.0, 0.0, cell, **options).collect()}


@pytest.mark.parametrize("size", [None, (9, 12)])
def test_cells_of_random_polygons(spark, size):
    """Slanted edges, stars, holes, slivers thinner than a cell, polygons that overlap or lie outside."""
    rng = np.random.default_rng(3)
    shapes = []
    for z in range(25):
        n, (cx, cy) = int(rng.integers(3, 9)), rng.uniform(-20, 60, 2)
        turn = np.sort(rng.uniform(0, 2 * math.pi, n))
        outer = [(cx + rng.uniform(1, 25) * math.cos(t), -cy + rng.uniform(1, 25) * math.sin(t)) for t in turn]
        hole = [(cx + 0.4 * math.cos(t), -cy + 0.4 * math.sin(t)) for t in (0, 2, 4)]
        shapes.append((z, [outer, hole] if z % 2 else [outer]))
    shapes.append((99, [[(0.1, -0.1), (40.3, -22.2), (0.2, -0.1)]]))
    assert found(spark, shapes, 3.7, size=size) == brute(shapes, 3.7, size)


def test_borders_and_order(spark):
    """A cell holds its western and northern border; the last shape by the stated order wins; shapes without rings touch nothing."""
    square = [(0, 0), (2, 0), (2, -2), (0, -2)]
    assert set(found(spark, [(1, [square])], 2.0)) == {(r, c) for r in (0, 1) for c in (0, 1)}
    assert set(found(spark, [(1, [[(0.5, -0.5), (1.5, -0.5), (1.5, -1.5), (0.5, -1.5)]])], 2.0)) == {(0, 0)}
    rows = [(1, [[{"x": a, "y": -b} for a, b in ((0.1, 0.1), (1.0, 0.1), (1.0, 1.0))]], 7), (2, [[{"x": a, "y": -b} for a, b in ((0.2, 0.1), (1.0, 0.1), (1.0, 1.0))]], 3), (3, [], 9), (4, None, 9)]
    frame = spark.createDataFrame(rows, "zone long, rings array<array<struct<x:double,y:double>>>, at int")
    assert [tuple(r) for r in raster.touched_cells(frame, 0.0, 0.0, 2.0, order="at").collect()] == [(0, 0, 1)]


def test_multipolygons_and_terrain(spark):
    """Both parts count; a shape without a cell that has a value takes that of its inner point, or none."""
    square = lambda x: [[{"x": x + a, "y": -b} for a, b in ((0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.1, 0.9))]]
    shapes = spark.createDataFrame([(1, [square(0.0), square(2.0)], 0.5, -0.5), (2, [square(4.0)], 6.5, -0.5), (3, [square(5.0)], 99.0, -99.0)], "zone long, polygons array<array<array<struct<x:double,y:double>>>>, inner_x double, inner_y double")
    grid = spark.createDataFrame([(0, 0, 1.0), (0, 1, 100.0), (0, 2, 4.0), (0, 6, 9.0)], "row int, col int, z double")
    got = {r.zone: (r.z_mean, r.z_max, r.z_range) for r in raster.terrain_of_zones(shapes, grid, 0.0, 0.0, 1.0, {"z": ["mean", "max", "range"]}).collect()}
    assert got == {1: (2.5, 4.0, 3.0), 2: (9.0, 9.0, 0.0), 3: (None, None, 0.0)}


def test_large_polygons_are_rows(spark):
    """No array grows with the area: edges are exploded by row and cells by span."""
    frame = spark.createDataFrame([(1, [[{"x": 0.5, "y": -0.5}, {"x": 500.5, "y": -0.5}, {"x": 500.5, "y": -400.5}, {"x": 0.5, "y": -400.5}]])], "zone long, rings array<array<struct<x:double,y:double>>>")
    assert raster.touched_cells(frame, 0.0, 0.0, 1.0).agg(F.count("*")).first()[0] == 501 * 401
