import numpy as np
import pytest
from pyspark.sql import functions as F

from subsidia.functions import geo, geodesy
from subsidia.operators import assign, measure

RINGS = "array<array<struct<x:double,y:double>>>"


def plan(frame):
    return frame._jdf.queryExecution().toString()


def shapes(rng, n, size=8.0, at=(0.0, 0.0)):
    """Stars, some with a hole, some with an empty ring or a vertex twice."""
    out = []
    for i in range(n):
        turn = np.sort(rng.uniform(0, 2 * np.pi, int(rng.integers(3, 9))))
        outer = np.stack([np.cos(turn), np.sin(turn)], 1) * rng.uniform(size / 2, size, (len(turn), 1))
        rings = [outer if i % 5 else np.vstack([outer, outer[-1:]])]
        if i % 3 == 0:
            rings.append(np.array([(-1.0, -1), (-1, 1), (1, 1), (1, -1)]))
        if i % 7 == 0:
            rings.append(np.zeros((0, 2)))
        out.append([[{"x": float(x + at[0]), "y": float(y + at[1])} for x, y in r] for r in rings])
    return out


@pytest.mark.parametrize("edges", [500_000, 11])
def test_distances_are_those_of_the_expressions(spark, monkeypatch, edges):
    monkeypatch.setattr(measure, "EDGES", edges)
    rng = np.random.default_rng(1)
    rows = [(i, *rng.uniform(-6, 6, 2).tolist(), r) for i, r in enumerate(shapes(rng, 60))]
    rows += [(60, 0.0, 0.0, []), (61, None, 0.0, rows[0][3]), (62, *rows[1][3][0][0].values(), rows[1][3]), (63, 1.0, 1.0, None)]
    frame = spark.createDataFrame(rows, f"id int, x double, y double, rings {RINGS}").withColumn("want", geo.rings_distance(F.col("x"), F.col("y"), F.col("rings")))
    got = measure.with_distances(frame, {"d": ("x", "y")}).collect()
    assert len(got) == 64 and sum(r.d == 0 for r in got) > 5
    for r in got:
        assert r.d is None and r.want is None if r.want is None else r.d == pytest.approx(r.want, abs=1e-12), r


def test_distances_in_degrees(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 13 + float(a) / 75_000, 47 + float(b) / 111_000, [[{"x": 13 + p["x"] / 75_000, "y": 47 + p["y"] / 111_000} for p in ring] for ring in r]) for i, ((a, b), r) in enumerate(zip(rng.uniform(-12, 12, (60, 2)), shapes(rng, 60)))]
    kx, ky = geodesy.metres_per_degree(F.col("lat"))
    frame = spark.createDataFrame(rows, f"id int, lon double, lat double, rings {RINGS}").withColumns({"kx": kx, "ky": ky, "want": geodesy.geography_distance(F.col("lon"), F.col("lat"), F.col("rings"))})
    got = measure.with_distances(frame, {"d": ("lon", "lat", "kx", "ky")}).collect()
    assert [r.d for r in got] == pytest.approx([r.want for r in got], abs=1e-9) and sum(r.d == 0 for r in got) > 5


def test_polygons_are_measured_in_batches(spark, sf_dir):
    """No edge of a pair is left to an interpreted expression, and cells are not broadcast, however small the buildings' table is."""
    from subsidia.plans.layers import polygons
    from subsidia.sources import adapters
    from subsidia.sources.tracks import track_geometry

    houses = assign.with_boxes(polygons(spark, sf_dir).drop("cx", "cy", "hw", "hh"))
    shown = plan(assign.assign_buildings(adapters.points(spark, sf_dir), houses, track_geometry(spark).where("dataset_id = 'salzburg_snt'")))
    assert "MapInArrow" in shown and "SortMergeJoin [cell_x" in shown and "lambda crosses" not in shown and "hypot" not in shown.lower()


def test_geography_is_measured_in_batches(spark):
    houses = spark.createDataFrame([("b", [[{"x": 13.0, "y": 47.0}, {"x": 13.001, "y": 47.0}, {"x": 13.0, "y": 47.001}]])], f"building_id string, rings {RINGS}")
    points = spark.createDataFrame([("in", 44, 13.0002, 47.0002), ("near", 44, 12.9999, 47.0002), ("far", 44, 12.9, 47.0002)], "code string, track int, lon double, lat double")
    found = assign.assign_geography(points, houses)
    shown = plan(found)
    assert "MapInArrow" in shown and "SortMergeJoin [cell_x" in shown and "hypot" not in shown.lower()
    got = {r.code: r.distance_m for r in found.collect()}
    assert got == {"in": 0.0, "near": pytest.approx(7.6, abs=0.05)}
