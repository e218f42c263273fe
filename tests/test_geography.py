import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from subsidia.functions import geo, geodesy
from subsidia.operators import assign

#: Published lines: degrees, minutes and seconds of both ends on WGS84 or lengths that follow from the spheroid itself.
QUARTER = 10_001_965.7293


def test_geodesic_distances(spark):
    """Lines whose lengths are known: meridian quarter, equator, a published survey line, the same place, nearly opposite places, nulls."""
    dms = lambda d, m, s: math.copysign(abs(d) + m / 60 + s / 3600, d)
    flinders, buninyong = (dms(144, 25, 29.52440), dms(-37, 57, 3.72030)), (dms(143, 55, 35.38390), dms(-37, 39, 10.15610))
    rows = [("quarter", 10.0, 0.0, 10.0, 90.0, QUARTER), ("equator", 0.0, 0.0, 1.0, 0.0, 6378137 * math.pi / 180), ("line", *flinders, *buninyong, 54_972.271), ("turn", 179.9, 10.0, -179.9, 10.0, None), ("same", 5.0, 5.0, 5.0, 5.0, 0.0), ("opposite", 0.0, 0.0, 179.9, 0.1, None), ("null", None, 1.0, 1.0, 1.0, None)]
    frame = spark.createDataFrame(rows, "name string, a double, b double, c double, d double, want double")
    got = {r.name: (r.m, r.want) for r in frame.withColumn("m", geodesy.geodesic_distance(*[F.col(c) for c in "abcd"])).collect()}
    for name in ("quarter", "equator", "line", "same"):
        assert got[name][0] == pytest.approx(got[name][1], abs=1e-3), name
    assert got["turn"][0] == pytest.approx(0.2 * 109_639.4, rel=1e-3) and got["opposite"][0] is None and got["null"][0] is None


def test_local_metres_equal_geodesics(spark):
    """Within 100 m the radii at a place give the geodesic's length to a millimetre, at all latitudes."""
    rng = np.random.default_rng(1)
    rows = [(float(x), float(y), float(x + a), float(y + b)) for x, y, a, b in zip(rng.uniform(-180, 180, 200), rng.uniform(-80, 80, 200), rng.uniform(-4e-4, 4e-4, 200), rng.uniform(-4e-4, 4e-4, 200))]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double")
    kx, ky = geodesy.metres_per_degree(F.col("b"))
    got = frame.select(geodesy.geodesic_distance(*[F.col(c) for c in "abcd"]).alias("m"), F.hypot((F.col("c") - F.col("a")) * kx, (F.col("d") - F.col("b")) * ky).alias("n")).collect()
    assert all(abs(r.m - r.n) < 2e-3 for r in got if r.m < 60)


def test_cells_follow_the_latitude(spark):
    """Points and small buildings from the equator to 80 degrees: the same as all pairs."""
    rng = np.random.default_rng(2)
    places = [(float(rng.uniform(-179, 179)), float(lat)) for lat in rng.uniform(-80, 80, 60)]
    metres = lambda lat: (111_320 * math.cos(math.radians(lat)), 110_574)
    houses, points = [], []
    for i, (lon, lat) in enumerate(places):
        kx, ky = metres(lat)
        houses.append((f"b{i:02d}", [[{"x": lon + a / kx, "y": lat + b / ky} for a, b in ((-5, -5), (5, -5), (5, 5), (-5, 5))]]))
        for j in range(4):
            a, b = rng.uniform(-25, 25, 2).tolist()
            points.append((f"{i}-{j}", 44, lon + a / kx, lat + b / ky))
    h = spark.createDataFrame(houses, "building_id string, rings array<array<struct<x:double,y:double>>>")
    p = spark.createDataFrame(points, "code string, track int, lon double, lat double")
    every = p.crossJoin(h).withColumn("d", geodesy.geography_distance(F.col("lon"), F.col("lat"), F.col("rings"))).where("d <= 15")
    want = {r.code: (r.building_id, r.d) for r in every.collect()}
    assert {r.code: (r.building_id, r.distance_m) for r in assign.assign_geography(p, h).collect()} == want and 30 < len(want) < 240


def test_gaps_of_polygons(spark):
    """Apart, touching, crossing without a vertex inside, one in the other, in its hole."""
    box = lambda x0, y0, x1, y1: [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    rows = [("apart", [box(0, 0, 1, 1)], [box(4, 5, 6, 6)], 5.0), ("touch", [box(0, 0, 1, 1)], [box(1, 0, 2, 1)], 0.0), ("cross", [box(0, 1, 3, 2)], [box(1, 0, 2, 3)], 0.0), ("within", [box(0, 0, 9, 9)], [box(4, 4, 5, 5)], 0.0), ("hole", [box(0, 0, 9, 9), box(2, 2, 7, 7)], [box(4, 4, 5, 6)], 1.0)]
    frame = spark.createDataFrame(rows, "name string, a array<array<struct<x:double,y:double>>>, b array<array<struct<x:double,y:double>>>, want double")
    got = frame.select("name", geo.rings_gap(F.col("a"), F.col("b")).alias("x"), geo.rings_gap(F.col("b"), F.col("a")).alias("y"), "want").collect()
    assert all(r.x == r.want == r.y for r in got), got
