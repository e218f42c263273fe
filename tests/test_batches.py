import numpy as np
import pytest
from pyspark.sql import functions as F

from subsidia.operators import resample


def plan(frame):
    return frame._jdf.queryExecution().toString()


@pytest.fixture
def small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_hulls_of_many_groups_in_one_call(spark, small_batches):
    """No Python call for each group; groups run over batches of seven rows."""
    rng = np.random.default_rng(5)
    rows = [(f"k{g % 40}", int(g % 3), float(x), float(y)) for g, (x, y) in enumerate(rng.integers(0, 9, (700, 2)))]
    found = resample.cluster_hulls(spark.createDataFrame(rows, "key string, track int, x_m double, y_m double"), ["key", "track"])
    assert "FlatMapGroups" not in plan(found)
    got = {(r.key, r.track): (r.points, [(p.x, p.y) for p in r.hull]) for r in found.collect()}
    for key in {r[:2] for r in rows}:
        own = [r[2:] for r in rows if r[:2] == key]
        assert got[key] == (len(own), resample.convex_hull(own))
    assert len(got) == len({r[:2] for r in rows})


def test_bootstrap_of_many_groups_in_one_call(spark, small_batches):
    rng = np.random.default_rng(6)
    rows = [(f"k{int(g)}", float(v), i) for i, (g, v) in enumerate(zip(rng.integers(0, 60, 400) ** 2 // 60, rng.normal(size=400)))]
    found = resample.bootstrap_summary(spark.createDataFrame(rows, "k string, v double, o int"), "k", "v", "o")
    assert "FlatMapGroups" not in plan(found)
    got = {r.key: r for r in found.collect()}
    for key in {r[0] for r in rows}:
        own = np.array([r[1] for r in rows if r[0] == key])
        m = np.median(own[np.random.default_rng(resample.key_seed(key)).integers(0, len(own), size=(500, len(own)))], axis=1)
        low, high = np.percentile(m, [5, 95])
        r = got[key]
        assert (r.n, r.mean, r.median, r.std, r.p05, r.p95) == (len(own), m.mean(), np.median(m), m.std(), low, high)


def test_bootstrap_of_a_long_group_in_parts(monkeypatch):
    values = np.random.default_rng(7).normal(size=333)
    whole = resample.bootstrap_medians(values, 50, 9)
    monkeypatch.setattr(resample, "HELD", 1_000)
    assert (resample.bootstrap_medians(values, 50, 9) == whole).all()


def test_clusters_of_many_groups_in_one_call(spark, small_batches):
    from subsidia.operators import cluster

    rng, rows = np.random.default_rng(8), []
    for g in range(12):
        for i in range(int(rng.integers(6, 30))):
            rows.append((f"{i:03d}", f"b{g}", 44, *[float(v) for v in rng.normal(size=5)], float(rng.random()), float(rng.random()), "nearest" if i % 3 else "within", float(rng.random() * 15)))
    points = spark.createDataFrame(rows, "code string, building_id string, track int, along_m double, cross_m double, height_rank double, velocity double, acceleration double, coherence double, local_deviation double, method string, distance_m double")
    found = cluster.cluster_points(points)
    assert "FlatMapGroups" not in plan(found)
    got = found.toPandas().sort_values(["building_id", "code"]).reset_index(drop=True)
    own = points.toPandas().assign(coherence_penalty=lambda d: (0.65 - d["coherence"]).clip(lower=0.0))
    one = lambda rows: cluster.cluster_group(rows, cluster._reachability_edges(cluster.scaled_matrix(rows.sort_values("code")), cluster.group_limits(len(rows))[1]))
    want = [one(rows) for _, rows in own.groupby("building_id")]
    columns = ["building_id", "code", "role", "cluster_id", "probability", "outlier"]
    assert got[columns].values.tolist() == [r for w in want for r in w[columns].values.tolist()]


def test_tree_of_few_points_is_that_of_rounds(monkeypatch):
    from subsidia.operators import cluster

    x = np.random.default_rng(9).integers(0, 4, (40, 6)).astype(float)  # many equal distances
    few = cluster._reachability_edges(x, 3)
    monkeypatch.setattr(cluster, "FEW", 0)
    assert (cluster._reachability_edges(x, 3) == few).all()


def points_of(spark, n):
    return spark.range(n).selectExpr("CAST(id AS STRING) AS code", "CAST(id % 300 AS STRING) AS building_id", "CAST(44 + id % 2 AS INT) AS track", "CAST(id % 80 AS DOUBLE) / 10 AS step_abs", "CAST(id % 5 AS INT) AS step_index", "CAST(id % 3 - 1 AS INT) AS step_sign", "CAST(id % 60 AS INT) AS epochs", "60 AS total_dates", "0.9 AS coherence")


@pytest.mark.parametrize("name", ["step_support", "apply_gates"])
def test_groups_are_dealt_by_their_rows(spark, monkeypatch, name):
    """Two tracks and rows that compress well are still as many tasks as the rows need."""
    from subsidia import session
    from subsidia.operators import groups

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    monkeypatch.setattr(session.task_count, "__defaults__", (100,))
    points = points_of(spark, 3000)
    stats = spark.createDataFrame([(44, 5.0, 0.5), (45, 6.0, 0.5)], "track int, step_p90 double, coherence_p05 double")
    assert getattr(groups, name)(points, stats).where("building_id IS NOT NULL").rdd.getNumPartitions() >= 30


def houses(spark, n):
    return spark.range(n).selectExpr("id AS zone", "CAST(id AS STRING) AS building_id", "'a' AS area_id", "CAST(id % 40 * 20 AS DOUBLE) AS cx", "CAST(floor(id / 40) * 20 AS DOUBLE) AS cy", "4.0D AS hw", "3.0D AS hh")


def test_neighbours_are_dealt_by_buildings(spark, monkeypatch):
    from subsidia.operators import assign

    monkeypatch.setattr(assign, "BUILDINGS", 50)
    found = assign.neighbour_candidates(houses(spark, 1000))
    assert found.rdd.getNumPartitions() >= 20 and "BroadcastHashJoin" not in plan(found)


def test_cells_are_dealt_by_shapes_and_terrain_sends_no_side_round(spark, monkeypatch):
    from subsidia.operators import raster

    monkeypatch.setattr(raster, "SHAPES", 50)
    at = lambda a, b: F.struct((F.col("cx") + a * F.col("hw")).alias("x"), (F.col("cy") + b * F.col("hh")).alias("y"))
    shapes = houses(spark, 1000).withColumns({"rings": F.array(F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1))), "inner_x": F.col("cx"), "inner_y": F.col("cy")})
    assert raster.touched_cells(shapes, -0.3, 600.7, 3.7).rdd.getNumPartitions() >= 20
    grid = spark.range(5000).selectExpr("CAST(id % 160 AS INT) AS row", "CAST(floor(id / 160) AS INT) AS col", "CAST(id AS DOUBLE) AS elevation")
    assert "Broadcast" not in plan(raster.terrain_of_zones(shapes, grid, -0.3, 600.7, 3.7, {"elevation": ["mean"]}))


def test_colours_send_no_side_round(spark, monkeypatch):
    from subsidia.operators import coloring

    plans = []
    written = coloring.materialize
    monkeypatch.setattr(coloring, "materialize", lambda df, name="table": plans.append(plan(df)) or written(df, name))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e")], "a string, b string")
    found = coloring.color_buildings(spark.createDataFrame([(k,) for k in "abcdef"], "key string"), edges)
    assert found.count() == 6 and not any("BroadcastHashJoin" in p for p in plans)


def test_moments_of_a_series_are_added_by_date(spark):
    """A slope whose tenth digit is a five, up to the last bit: as the SQL rounds it."""
    from subsidia.operators import series

    rows = [('2024-01-04', 51.12), ('2024-01-06', 98.23), ('2024-01-08', 117.55), ('2024-01-16', 16.42), ('2024-01-19', 90.9), ('2024-01-25', 14.13), ('2024-01-27', 5.04)]
    long = spark.createDataFrame([("a", d, v) for d, v in rows], "code string, d string, displacement double").select("code", F.to_date("d").alias("date"), "displacement")
    found = series.displacement_features(long.repartition(5), ["code"]).select(F.round("slope_per_year", 9).alias("s"), F.round("residual_std", 9).alias("r")).first()
    assert (found.s, found.r) == (-1203.784101563, 32.00108385)


def test_tiles_are_given_some_features_at_a_time(spark, monkeypatch):
    """A tile's features are not one batch, and tiles do not reach a worker all at once."""
    import pyarrow as pa

    from subsidia.sources import vector_tiles as vt

    rows = [(1, 2, f"p{i}", i, [[{"x": i % 4096, "y": i * 7 % 4096}]]) for i in range(40)]
    frame = spark.createDataFrame(rows, "tile_x int, tile_y int, s string, n int, geometry array<array<struct<x:int,y:int>>>")
    tiles = vt.encode_tiles(frame, "l", ["s", "n"])
    assert "MapInArrow" not in plan(tiles)
    runs = []

    class Tiles:
        columns, dtypes = ["tile_x", "tile"], [("tile_x", "int"), ("tile", "binary")]

        def mapInArrow(self, made, schema):
            runs.append(made)

    monkeypatch.setattr(vt, "GIVEN", 15)
    vt.decode_tiles(Tiles())
    tile = bytes(tiles.first().tile)
    found = list(runs[0](iter([pa.RecordBatch.from_pydict({"tile_x": pa.array([1], pa.int32()), "tile": pa.array([tile])})])))
    assert [len(b) for b in found] == [15, 15, 10]
    got = {dict(r["attributes"])["s"]: (r["geometry"], dict(r["attributes"])["n"]) for b in found for r in b.to_pylist()}
    assert got == {s: (g, str(n)) for _, _, s, n, g in rows}


def test_groups_are_moved_once(spark):
    """Ranks, deviations, step support and gates of points by group take one shuffle of the points."""
    from subsidia.operators import groups

    points = points_of(spark, 300).selectExpr("*", *[f"CAST(code AS DOUBLE) * {k} % 17 AS {c}" for k, c in ((1, "height"), (3, "velocity"), (5, "acceleration"), (7, "along_m"), (11, "cross_m"))])
    stats = spark.createDataFrame([(44, 5.0, 0.5), (45, 6.0, 0.5)], "track int, step_p90 double, coherence_p05 double")
    rows = groups.step_support(groups.local_deviation(groups.height_ranks(points, tasks=8)), stats, tasks=8)
    assert groups.group_gates(rows, stats, tasks=8)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_points_go_through_the_clustering(spark, small_batches):
    """Small and larger groups keep the columns of their points, and no rows are lost or doubled where codes repeat."""
    from subsidia.operators import cluster

    rows = [(f"{i % 9:03d}", f"b{g}", 44, *[float((i * k + g) % 7) for k in range(1, 6)], 0.9, 0.1, "within", 1.0, f"{g}/{i}", ["x", str(i)], n) for g, n in enumerate((2, 4, 6, 20)) for i in range(n)]
    points = spark.createDataFrame(rows, "code string, building_id string, track int, along_m double, cross_m double, height_rank double, velocity double, acceleration double, coherence double, local_deviation double, method string, distance_m double, name string, marks array<string>, kept_points long")
    got = cluster.cluster_points(points, columns=points.columns, sizes="kept_points")
    assert got.columns == [*points.columns, "role", "cluster_id", "probability", "outlier"]
    assert sorted(tuple(r)[: len(points.columns)] for r in got.collect()) == sorted(rows)
    assert {r.building_id for r in got.collect() if r.role == "insufficient_support"} == {"b0"}


def test_details_parse_a_roll_up_once_chosen(spark, monkeypatch):
    """Rows keep their roll-ups as text; documents have the values of the row of least rank, and each cluster once."""
    import json

    from subsidia.plans import documents

    stored, write = {}, documents.materialize
    monkeypatch.setattr(documents, "materialize", lambda df, name: stored.setdefault(name, write(df, name)))
    c = lambda k: {"cluster_id": f"c{k}", "track": 44, "cluster_rank": k, "point_count": 2}
    metas = [{"cluster": {"cluster_role": "core", "cluster_rank": k}, "cluster_rollup": c(k), "building_rollup": {"building_status": f"s{k}", "building_motion_mm_a": 0.1 + k, "reliability_penalties": ["a", "b"]}} for k in (2, 1, 2)]
    metas.append({"cluster": {"cluster_role": "noise"}, "visual_context": {"gate_excluded": True}})
    rows = [("r", "a", "d", f"p{i}", 44, f"c{k}", "gba", "b1", 1.0, 0.5, 0.1, 0.5, None, json.dumps(m)) for i, (k, m) in enumerate(zip((2, 1, 2, 0), metas))]
    results = spark.createDataFrame(rows, "run_id string, area_id string, dataset_id string, code string, track int, cluster_id string, building_source string, building_id string, distance_m double, score double, anomaly_score double, quality_score double, label string, meta string")
    got = json.loads(documents.building_details(results).first().document)
    assert {f.name: f.dataType.simpleString() for f in stored["detail-rows"].schema["m"].dataType}["building_rollup"] == "string"
    assert got["rollup"] == metas[1]["building_rollup"] and got["clusters"] == [c(1), c(2)]
    assert (got["point_count"], got["noise_point_count"], got["excluded_point_count"]) == (4, 1, 1)


def test_stability_of_many_buildings_in_one_call(spark, small_batches):
    """Draws never leave the batch that they are made in; points without a value count for support only, tracks of such points not at all."""
    rng, rows = np.random.default_rng(10), []
    for b in range(30):
        for t in (44, 95, 117)[: b % 4]:
            for i in range(int(rng.integers(1, 6))):
                rows.append((f"b{b:02d}", t, f"{i:03d}", float(rng.normal()) if (b + i) % 5 else None, float(rng.random())))
    points = spark.createDataFrame(rows, "building_id string, track int, code string, vertical double, support double")
    own = "building_id string, status string, motion double, agreement double, reliability double, differential boolean, reliable_clusters int, allowed double"
    buildings = spark.createDataFrame([(f"b{b:02d}", "ok", 0.0, 0.9, 0.5, False, 3, 0.1 if b % 3 else 1.5) for b in range(30)], own)
    found = resample.building_stability(points, buildings, 80)
    assert "MapInArrow" in plan(found) and "collect_list(draws" not in plan(found)
    got = {r.building_id: r for r in found.collect()}
    want = {}
    for b in sorted({r[0] for r in rows}):
        m, bands = [], []
        for t in sorted({r[1] for r in rows if r[0] == b}):
            v = np.array([r[3] for r in rows if r[:2] == (b, t) and r[3] is not None])
            if len(v):
                d = resample.bootstrap_medians(v, 80, resample.key_seed(f"{b}:{t}"))
                m.append(d)
                width, support = np.subtract(*np.percentile(d, [95, 5])), max(r[4] for r in rows if r[:2] == (b, t))
                bands.append("unstable" if len(v) < 2 else "stable" if width <= 0.75 and support >= 0.35 else "monitor" if width <= 1.5 and support >= 0.2 else "unstable")
        if m:
            want[b] = (len(m), sorted(bands), np.mean(m, 0), np.exp(-np.ptp(m, 0) / (0.25 if int(b[1:]) % 3 else 1.5)) if len(m) > 1 else None)
    assert set(got) == set(want) and {w[0] for w in want.values()} == {1, 2, 3} and len({x for w in want.values() for x in w[1]}) > 1
    for b, (tracks, bands, motion, agreement) in want.items():
        r = got[b]
        assert (r.tracks, r.bands) == (tracks, bands)
        for d, v in ((r.motion_draws, motion), (r.agreement_draws, agreement)):
            assert d is None if v is None else tuple(d) == pytest.approx((v.mean(), *np.percentile(v, [50, 5, 95]), np.subtract(*np.percentile(v, [95, 5]))), abs=1e-12)
