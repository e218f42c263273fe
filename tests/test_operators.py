import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from subsidia.functions import classify, geo
from subsidia.operators import assign, cluster, coloring, groups, resample, rollup, score, series
from subsidia.plans import features
from subsidia.plans.service import upserted
from subsidia.sources import ingest, sinks, tracks
from subsidia.streaming.series import windowed_means


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_range_offset(spark):
    got = one(spark, *[geo.range_offset(F.lit(h), F.lit(i)).alias(f"c{k}") for k, (h, i) in enumerate([(12.0, 38.81), (3.0, 20.0), (60.0, 45.0), (15.443, 38.795)])])
    assert got.c0 == pytest.approx(9.651697, abs=1e-6) and got.c1 == 3 and got.c2 == 30 and got.c3 == pytest.approx(12.414457, abs=5e-4)


def test_bearings():
    assert tracks.bearing_vector(261.4) == pytest.approx((-0.988756, -0.149535), abs=1e-6)
    assert tracks.bearing_vector(101.5) == pytest.approx((0.979925, -0.199368), abs=1e-6)


def test_projection(spark):
    x, y = geo.to_utm(F.lit(12.94), F.lit(47.74))
    lon, lat = geo.from_utm(x, y)
    got = one(spark, x.alias("x"), geo.to_utm(F.lit(13.16), F.lit(47.86))[0].alias("x2"), lon.alias("lon"), lat.alias("lat"))
    assert (got.x, got.x2) == pytest.approx((345565.879, 362375.661), abs=1e-3) and (got.lon, got.lat) == pytest.approx((12.94, 47.74), abs=1e-8)


def test_vertical_proxy_and_flip(spark):
    got = one(spark, geo.vertical_proxy(F.lit(-5.0), F.lit(38.81)).alias("v"), geo.flip_row(F.lit(2), 3).alias("y"))
    assert got.v == pytest.approx(-6.416602, abs=1e-6) and got.y == 5


def test_rings(spark):
    ring = lambda ps: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ps])
    rings = F.array(ring([(0, 0), (10, 0), (10, 10), (0, 10)]), ring([(4, 4), (4, 6), (6, 6), (6, 4)]))
    points = [(1, 1), (5, 5), (10, 5), (12, 5), (13, 14), (5, 4)]
    got = one(spark, *[geo.rings_distance(F.lit(float(x)), F.lit(float(y)), rings).alias(f"c{i}") for i, (x, y) in enumerate(points)], *[c.alias(n) for c, n in zip(geo.rings_centroid(F.array(ring([(0, 0), (4, 0), (4, 2), (0, 2)]))), ("mx", "my"))])
    assert list(got)[:6] == pytest.approx([0, 1, 0, 2, 5, 0]) and (got.mx, got.my) == pytest.approx((2, 1))


def test_step_and_trend(spark):
    rows = spark.createDataFrame([("a", f"2024-01-0{i + 1}", v) for i, v in enumerate([0.0, 1.0, 4.0, 3.0])], "code string, date string, displacement double").withColumn("date", F.to_date("date"))
    got = series.displacement_features(rows, ["code"]).first()
    x, y = np.arange(4), np.array([0.0, 1.0, 4.0, 3.0])
    fit = np.polyfit(x, y, 1)
    assert (got.step_index, got.step_abs, got.step_sign) == (1, 3.0, 1)
    assert got.slope_per_year == pytest.approx(fit[0] * 365.25) and got.residual_std == pytest.approx(np.std(y - np.polyval(fit, x)))


def group(spark, rows):
    base = {"building_id": "b", "track": 44, "height": None, "x_m": 0.0, "y_m": 0.0, "step_abs": 0.0, "step_index": None, "step_sign": 0}
    kinds = "code string, building_id string, track int, height double, x_m double, y_m double, step_abs double, step_index int, step_sign int"
    return spark.createDataFrame([tuple((base | r)[c.split()[0]] for c in kinds.split(", ")) for r in rows], kinds)


def test_height_ranks(spark):
    rows = group(spark, [{"code": c, "height": h} for c, h in [("a", 10.0), ("b", 20.0), ("c", None), ("d", 20.0)]])
    assert {r.code: r.height_rank for r in groups.height_ranks(rows).collect()} == {"a": 0.0, "b": 0.5, "c": 0.5, "d": 1.0}


def test_density(spark):
    rows = group(spark, [{"code": "a"}, {"code": "b", "x_m": 2.0}, {"code": "c", "building_id": "other"}])
    got = {r.code: r.local_density for r in groups.local_density(rows).collect()}
    assert got["a"] == got["b"] == pytest.approx(0.716531, abs=1e-6) and got["c"] == 0


def test_small_group_all_deviate(spark):
    rows = spark.createDataFrame([("b", 44, "p", 0.90), ("b", 44, "q", 0.85), ("b", 44, "r", 0.95)], "building_id string, track int, code string, local_deviation double")
    got = {r.code: (r.role, round(r.probability, 6)) for r in groups.small_group_roles(rows).collect()}
    assert got["q"] == ("core", 0.15) and got["p"][0] == got["r"][0] == "noise"


def test_agreement_and_pair(spark):
    got = one(spark, score.pair_consistency(F.lit(-3.0), F.lit(-2.5), F.lit(0.8), F.lit(0.5)).alias("a"), score.pair_consistency(F.lit(-3.0), F.lit(2.5), F.lit(0.8), F.lit(0.5)).alias("b"), score.pair_consistency(F.lit(-3.0), F.lit(None).cast("double"), F.lit(0.8), F.lit(0.5)).alias("c"))
    assert got.a == pytest.approx(0.453174, abs=1e-6) and got.b == 0 and got.c is None


def test_building_rollup_reliability(spark):
    """Two main clusters of seven and two points, mean signal and assignment 0.75, full agreement."""
    rows = []
    for track, n in ((44, 7), (95, 2)):
        rows += [("b", track, f"b:t{track}:cluster_0", "core", 1.0, 1.0, 0.75, 0.5, "nearest" if i < n * 0.25 and track == 44 else "within", 0.0, 0.0) for i in range(n)]
    points = spark.createDataFrame(rows, "building_id string, track int, cluster_id string, role string, velocity double, vertical double, coherence double, height_rank double, method string, x_m double, y_m double")
    clusters = rollup.cluster_rollup(points).withColumn("assignment_quality", F.lit(0.75))
    got = rollup.building_rollup(clusters, spark.createDataFrame([("b", None)], "building_id string, slope_mean_deg double")).first()
    assert got.reliability == pytest.approx(0.7875) and got.band == "medium" and got.status == "ok" and got.agreement == 1 and got.track_motions == {"44": 1.0, "95": 1.0}


def test_excluded_score(spark):
    stats = spark.createDataFrame([(44, 0.4, 1.0, 0.5, 1.0, 2.0)], "track int, coherence_p05 double, velocity_std_p95 double, amp_cv_p95 double, step_p90 double, step_p95 double")
    rows = spark.createDataFrame([(44, None, "excluded", True, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, None, None)], "track int, method string, role string, excluded boolean, outlier double, local_deviation double, coherence double, amp_cv double, velocity_std double, step_abs double, step_support double, kept_ratio double, agreement double, building_id string")
    got = score.score_points(rows, stats).first()
    assert (got.anomaly, got.label) == (pytest.approx(0.90), "outlier") and got.quality == pytest.approx(0.45 * 0.1 + 0.1 * 0.65)


def test_density_clusters_separate_and_ignore_order():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.2, (12, 6)), rng.normal(5, 0.2, (9, 6)), [[20.0] * 6]])
    labels, probability, outlier = cluster.density_clusters(x, 4, 2)
    assert set(labels[:12]) == {0} and set(labels[12:21]) == {1} and labels[21] == -1
    assert (0 <= probability).all() and (probability <= 1).all() and (0 <= outlier).all() and (outlier <= 1).all()
    order = rng.permutation(len(x))
    again = cluster.density_clusters(x[order], 4, 2)[0]
    assert (again == labels[order]).all()


def test_cluster_group_with_equal_points():
    rows = pd.DataFrame({"code": list("abcdefg"), "building_id": "b", "track": 44, "coherence": 0.9, "local_deviation": 0.1, "method": "within", "distance_m": 0.0} | {f: 1.0 for f in cluster.FEATURES})
    got = cluster.cluster_group(rows)
    assert set(got["role"]) == {"core"} and got["probability"].between(0.05, 0.99).all()


def test_bootstrap_published_case():
    m = resample.bootstrap_medians(np.array([1.0, 2, 3, 4, 10]), 500, resample.key_seed("c1:44"))
    assert m[:5].tolist() == [2, 3, 2, 4, 4] and np.percentile(m, [5, 95]) == pytest.approx([1.95, 4.0]) and m.mean() == pytest.approx(3.26)


def test_hull():
    assert resample.convex_hull([(0, 0), (1, 1), (2, 0), (2, 2), (0, 2), (1, 0)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert resample.convex_hull([(1, 1)]) == [(1, 1)] and len(resample.convex_hull([(0, 0), (1, 1)])) == 2


def greedy(keys, edges, start, palette):
    near = {k: set() for k in keys}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    colors = {}
    for k in sorted(keys, key=lambda k: (len(near[k]), k), reverse=True):
        used = {colors[n] for n in near[k] if n in colors}
        colors[k] = next(((start[k] + i) % palette for i in range(palette) if (start[k] + i) % palette not in used), start[k])
    return colors


def test_coloring_is_greedy(spark):
    rng = np.random.default_rng(1)
    keys = [f"k{i}" for i in range(40)]
    edges = sorted({tuple(sorted(rng.choice(keys, 2, replace=False).tolist())) for _ in range(70)})
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    start = {r.key: r.c for r in frame.select("key", classify.palette_index(F.col("key"), 4).alias("c")).collect()}
    got = {r.key: r.color for r in coloring.color_buildings(frame, spark.createDataFrame(edges, "a string, b string"), 4).collect()}
    assert got == greedy(keys, edges, start, 4)


def test_palette_hash(spark):
    assert one(spark, classify.palette_index(F.lit("area_a:gba:1")).alias("c")).c == 9


def test_byte_ranges(spark):
    cases = {"bytes=-10": (90, 99), "bytes=5-": (5, 99), "bytes=5-7": (5, 7), "bytes=100-": None, "bytes=-": None, "x": None}
    rows = spark.createDataFrame([(c,) for c in cases], "h string").select("h", ingest.byte_range(F.col("h"), F.lit(100).cast("long")).alias("r")).collect()
    assert {r.h: tuple(r.r) if r.r else None for r in rows} == cases


def test_ways_with_unknown_nodes_are_dropped(spark):
    rows = [("node", i, float(i), 0.0, None) for i in range(4)] + [("way", 10, None, None, [0, 1, 2, 3]), ("way", 11, None, None, [0, 1, 2, 9]), ("way", 12, None, None, [0, 1, 2])]
    got = ingest.way_rings(spark.createDataFrame(rows, "type string, id long, lon double, lat double, nodes array<long>")).collect()
    assert [(r.way_id, [p.x for p in r.ring]) for r in got] == [(10, [0.0, 1.0, 2.0, 3.0])]


def test_hits(spark):
    rows = spark.createDataFrame([('<r numberMatched="42"/>',), ('<r numberMatched="unknown"/>',)], "x string")
    assert [r[0] for r in rows.select(ingest.matched_features(F.col("x"))).collect()] == [42, None]


def stub_page(start, count):
    return [(str(i), "{}", "{}") for i in range(start, start + count)]


def short_page(start, count):
    return stub_page(start, count)[:-1]


def test_paged_source(spark):
    spark.dataSource.register(ingest.PagedFeatures)
    read = lambda f: spark.read.format("paged_features").option("total", 25).option("page_size", 10).option("fetch", f"tests.test_operators:{f}").load()
    assert sorted(int(r.id) for r in read("stub_page").collect()) == list(range(25))
    with pytest.raises(Exception, match=r"of \d+ features"):
        read("short_page").collect()


def test_standard_columns(spark):
    df = ingest.standard_columns(spark.createDataFrame([(1, 2.0, 3.0)], "Code int, VEL double, other double"))
    assert df.columns == ["code", "velocity", "other"]


def test_runs_are_written_and_deleted(spark, tmp_path):
    root = f"file://{tmp_path}"
    for run in ("a", "b"):
        sinks.write_run(spark.range(3), root, "points", run)
    assert sinks.delete_run(spark, root, "a") == ["points"]
    assert {r.run_id for r in sinks.read_runs(spark, root, "points").collect()} == {"b"}


def test_geojson_lines(spark, tmp_path):
    df = spark.createDataFrame([("a", 13.0, 47.5, float("nan")), ("b", 13.5, 48.0, 2.0)], "code string, lon double, lat double, v double")
    sinks.write_geojson_lines(df, str(tmp_path / "out"), "lon", "lat", ["code", "v"], sinks.feature_id(["code"], F.lit("x")))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines[0] == '{"type":"Feature","id":"a","geometry":{"type":"Point","coordinates":[13.0,47.5]},"properties":{"code":"a","v":null}}'


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_capped_bands(spark):
    got = one(spark, classify.capped_band(F.lit("high"), F.lit("medium")).alias("a"), classify.capped_band(F.lit("low"), F.lit("medium")).alias("b"), classify.capped_band(F.lit("high"), F.lit(None).cast("string")).alias("c"))
    assert list(got) == ["medium", "low", "high"]


def test_area_dataset():
    assert tracks.resolve_area_dataset("bad_gastein", None) == ("bad_gastein", "bad_gastein_snt")
    with pytest.raises(ValueError):
        tracks.resolve_area_dataset("salzburg", "bad_gastein_snt")


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("CAST(user_id AS STRING) AS code", "event_type AS track", "ts", "value AS displacement")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = windowed_means(stream, late="3650 days").writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    plain = lambda df: sorted((r.code, r.track, r.start, round(r.displacement, 6), r.n) for r in df.collect())
    assert plain(spark.table("windowed")) == plain(windowed_means(rows))


def test_assignment_priority(spark):
    buildings = spark.createDataFrame([("far", 10.0, 0.0, 2.0, 2.0, None), ("in", 0.0, 0.0, 1.0, 1.0, None)], "building_id string, cx double, cy double, hw double, hh double, height double")
    points = spark.createDataFrame([("p", 44, 0.5, 0.5, None, "x"), ("q", 44, 6.5, 0.0, None, "x"), ("r", 44, 300.0, 0.0, None, "x")], "code string, track int, x_m double, y_m double, incidence_angle double, building_id string")
    geometry = tracks.track_geometry(spark).where("dataset_id = 'salzburg_snt'")
    got = {r.code: (r.building_id, r.method) for r in assign.assign_buildings(points, buildings, geometry).collect()}
    assert got == {"p": ("in", "within"), "q": ("far", "directional_buffer"), "r": (None, None)}


def test_explain_severities(spark):
    assert math.isclose(one(spark, classify.ramp(F.lit(10.0), [(0, 0), (20, 1)]).alias("c")).c, 0.5)


def test_whole_run_has_the_neighbourhood(spark, sf_dir):
    """Supporters, event scores and misassigned points come from the run's own clusters."""
    points, buildings, events = (x.toPandas() for x in features.anomaly_run(spark, sf_dir))
    kept = points[~points.excluded]
    b = buildings.set_index("building_id")
    assert set(features.NEIGHBOURHOOD) <= set(b.columns) and len(b) == len(buildings) and (events.candidates > 0).all()
    assert not points[["code", "track"]].duplicated().any() and not points[points.excluded].misassigned.any()
    assert kept.neighbour_fit.notna().any() and (b.candidates > 0).any() and b.context.any()
    wrong = kept.groupby("building_id").misassigned.sum()
    seen = b[b.misassigned_points.notna()]
    assert len(seen) and (seen.misassigned_points == wrong.reindex(seen.index)).all()
    assert features.anomaly_buildings(spark, sf_dir).columns[-len(features.NEIGHBOURHOOD):] == list(features.NEIGHBOURHOOD)


def test_two_deviations_are_no_spike(spark):
    """Eight values of mean 16 and deviation 7, one of them 30: just two deviations away, in whatever order they come and are divided."""
    x = [4.0, 10.0, 14.0, 16.0, 18.0, 18.0, 18.0, 30.0]
    assert sum(x) / 8 == 16 and sum((v - 16) ** 2 for v in x) / 8 == 49
    rows = [(k, d, v) for k, order in enumerate(itertools.islice(itertools.permutations(x), 0, 40_000, 97)) for d, v in enumerate(order)]
    frame = spark.createDataFrame(rows + [(-1, 0, None), (-2, 0, 3.0), (-2, 1, None)], "code int, date int, amplitude double").repartition(3)
    got = {r.code: r for r in series.amplitude_features(frame, ["code"]).collect()}
    assert len(got) == 415 and {(r.amp_mean, r.amp_std, r.spike_rate, r.amp_cv) for k, r in got.items() if k >= 0} == {(16.0, 7.0, 0.0, 0.4375)}
    assert tuple(got[-1])[1:] == (None,) * 4 and (got[-2].amp_mean, got[-2].amp_std, got[-2].spike_rate) == (3.0, 0.0, 0.0)
