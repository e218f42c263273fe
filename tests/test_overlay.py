import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from subsidia.functions import overlay
from subsidia.operators import areas, assign


def inside(rings, points):
    """Even-odd."""
    return overlay.winding(points, np.vstack([overlay._edges([r]) for r in rings])) % 2 == 1 if rings else np.zeros(len(points), bool)


def distance(points, rings):
    """To the nearest edge, by segments."""
    out = np.full(len(points), np.inf)
    for ax, ay, bx, by in overlay._edges(rings):
        d = np.array([bx - ax, by - ay])
        t = np.clip(((points - (ax, ay)) @ d) / (d @ d), 0, 1)
        out = np.minimum(out, np.hypot(*(points - (ax, ay) - t[:, None] * d).T))
    return out


def star(rng, n, size):
    turn = np.sort(rng.uniform(0, 2 * math.pi, n))
    return np.stack([rng.uniform(size / 4, size, n) * np.cos(turn), rng.uniform(size / 4, size, n) * np.sin(turn)], 1)


@pytest.mark.parametrize("seed", range(12))
def test_grown_unions_by_sampling(seed):
    """Every sample place is in the outline if it is within the distance of the polygon or its copy, but for the arcs' chords."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(3, 9))
    turn = np.sort(rng.uniform(0, 2 * math.pi, n))
    outer = np.stack([np.cos(turn), np.sin(turn)], 1) * rng.uniform(4, 12, (n, 1)) + (5e5, 5e6)
    rings = [outer]
    if seed % 2:
        rings.append(outer.mean(0) + np.array([(0.0, 0.0), (0.0, 0.6), (0.6, 0.0)]))
    shift, slack = tuple(rng.uniform(-12, 12, 2).tolist()) if seed % 3 else (0.0, 0.0), 2.0
    got = overlay.grown_union(rings, shift, slack)
    places = rng.uniform(-30, 30, (4000, 2)) + (5e5, 5e6)
    solid = overlay.turned(rings)
    near = np.zeros(len(places), bool)
    doubtful = np.zeros(len(places), bool)
    for move in {(0.0, 0.0), shift}:
        p = places - np.array(move)
        d = np.where(overlay.winding(p, np.vstack([overlay._edges([r]) for r in solid])) > 0, 0.0, distance(p, solid))
        near |= d <= slack * math.cos(math.pi / 32)
        doubtful |= (d > slack * math.cos(math.pi / 32) - 1e-6) & (d < slack + 1e-6)
    held = inside(got, places)
    assert (held == near)[~doubtful | near].all() and held.any()
    assert all(np.isfinite(r).all() and len(r) > 2 for r in got)


def test_outline_of_known_shapes():
    """Overlapping, touching and nested squares: area and number of rings."""
    box = lambda x, y, w: np.array([(x, y), (x + w, y), (x + w, y + w), (x, y + w)], float)
    area = lambda rings: sum(map(overlay.signed_area, rings))
    for rings, want, count in (([box(0, 0, 2), box(1, 1, 2)], 7, 1), ([box(0, 0, 2), box(2, 0, 2)], 8, 1), ([box(0, 0, 9), box(2, 2, 2)], 81, 1), ([box(0, 0, 9), box(2, 2, 2)[::-1]], 77, 2), ([box(0, 0, 2), box(5, 5, 1)], 5, 2), ([box(0, 0, 2), box(0, 0, 2)], 4, 1), ([box(0, 0, 2), box(2, 2, 2)], 8, 2), ([], 0, 0)):
        got = overlay.outline(rings)
        assert area(got) == pytest.approx(want) and len(got) == count
    assert area(overlay.grown_union([box(0, 0, 10)], (0.0, 0.0), 1.0)) == pytest.approx(140 + 16 * math.sin(math.pi / 16))
    assert len(overlay.grown_union([box(0, 0, 10), box(4, 4, 1)], (0.0, 0.0), 1.0)) == 1
    assert len(overlay.grown_union([box(0, 0, 10), box(2, 2, 6)], (0.0, 0.0), 1.0)) == 2


def test_assigned_points_lie_in_areas(spark, sf_dir):
    """Each point that the assignment places by its shifted position lies in the area of its building, but for the chords."""
    from subsidia.plans.geography import track_geometry
    from subsidia.plans.layers import polygons
    from subsidia.sources import adapters

    tracks = track_geometry(spark).where("dataset_id = 'salzburg_snt'")
    points = adapters.points(spark, sf_dir).withColumn("incidence_angle", F.lit(None).cast("double"))
    houses = assign.with_boxes(polygons(spark, sf_dir).drop("cx", "cy", "hw", "hh"))
    placed = assign.assign_buildings(points, houses, tracks, slack=1.95).where("method IN ('within', 'directional_buffer')").select("code", "building_id")
    held = areas.points_in_areas(points, areas.candidate_areas(houses, tracks)).select("code", "building_id")
    assert placed.count() > 100 and placed.join(held, ["code", "building_id"], "left_anti").count() == 0


def test_areas_are_made_once_for_a_plan(spark, monkeypatch):
    """Buildings of one plan at different places share an outline, whatever their tracks; each has its own area, where it stands."""
    made = []
    own = overlay.grown
    monkeypatch.setattr(overlay, "grown", lambda polygons, *a: made.extend(polygons) or own(polygons, *a))
    areas._GROWN.clear()
    areas._AREAS.clear()
    plan = np.array([(0.0, 0.0), (8.0, 0.0), (8.0, 6.0), (0.0, 6.0)])
    vertex = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
    shapes = [[vertex(plan + (350_000 + 20 * i, 5_290_000))] for i in range(6)] + [[], [[]], [vertex(plan * 2), vertex(plan / 2 + 3)]]
    shifts = np.array([(3.0 * (i % 2), -2.0) for i in range(len(shapes))])
    got = areas._areas(pa.array(shapes, areas._areas(pa.array([[vertex(plan)]]), shifts[:1], 2.0, 8).type), shifts, 2.0, 8).to_pylist()
    assert len(made) == 2 and got[6] == got[7] == []
    for rings, shift, area in zip(shapes, shifts, got):
        want = overlay.grown_union([np.array([(p["x"], p["y"]) for p in r]) for r in rings], tuple(shift.tolist()), 2.0) if rings and rings[0] else []
        assert area == [vertex(r) for r in want]


def test_areas_are_dealt_and_points_measured_in_batches(spark, sf_dir):
    """Work on areas is divided by their number and not by the bytes of the buildings' table; points in them are not told by interpreted expressions."""
    from subsidia.plans.geography import track_geometry
    from subsidia.plans.layers import polygons
    from subsidia.sources import adapters

    shown = lambda df: df._jdf.queryExecution().toString()
    found = areas.candidate_areas(polygons(spark, sf_dir), track_geometry(spark).where("dataset_id = 'salzburg_snt'"))
    assert "REPARTITION_BY_NUM" in shown(found)
    held = shown(areas.points_in_areas(adapters.points(spark, sf_dir), found))
    assert "MapInArrow" in held and "lambda e" not in held and "SortMergeJoin [cell_x" in held


def test_outlines_of_many_shapes_together(monkeypatch):
    """Shapes of unlike sizes, one of them empty: each has the outline it has alone, and they take few calls."""
    calls, own = [], overlay._outlined
    monkeypatch.setattr(overlay, "_outlined", lambda edges, some, out: calls.append(len(some)) or own(edges, some, out))
    rng = np.random.default_rng(4)
    shapes = [[star(rng, int(rng.integers(3, 30)), 9.0), star(rng, 5, 9.0) + rng.uniform(-6, 6, 2)] for _ in range(60)] + [[]]
    got = overlay.outlines(shapes)
    assert sum(calls) == 60 and len(calls) < 5 and got[60] == []
    for rings, want in zip(got, [overlay.outline(s) for s in shapes]):
        assert len(rings) == len(want) and all((a == b).all() for a, b in zip(rings, want))
