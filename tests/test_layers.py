import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from subsidia.functions import classify, geo
from subsidia.operators import cluster, groups, resample, series
from subsidia.plans.report import markdown_summary
from subsidia.sources import ingest, schemas, sinks


@pytest.mark.parametrize("few", [series.FEW, 0])
def test_exact_percentiles(spark, monkeypatch, few):
    """Against numpy: a hot key, ties, a single value, nulls, a key without values, and more distinct values than parts."""
    monkeypatch.setattr(series, "FEW", few)
    rng = np.random.default_rng(0)
    rows = [("hot", float(v)) for v in rng.normal(size=3000)] + [("ties", float(v)) for v in rng.integers(0, 3, 500)] + [("one", 2.5), ("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "key string, v double")
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        got = {r.key: r.p for r in series.exact_percentiles(df, "key", {"p": (F.col("v"), q)}).collect()}
        assert got["none"] is None and got["one"] == 2.5
        for key in ("hot", "ties"):
            assert got[key] == pytest.approx(np.percentile([v for k, v in rows if k == key and v is not None], 100 * q), abs=1e-12)


def test_gates_without_building(spark):
    rows = spark.createDataFrame([("a", "b1", 44, 30, 0.9), ("b", None, 44, 30, 0.9), ("c", "b1", 44, 2, 0.9)], "code string, building_id string, track int, epochs int, coherence double").withColumn("total_dates", F.lit(30))
    stats = spark.createDataFrame([(44, 0.1)], "track int, coherence_p05 double")
    got = {r.code: (r.kept_points, r.kept_ratio, r.excluded) for r in groups.apply_gates(rows, stats).collect()}
    assert got == {"a": (1, 0.5, False), "c": (1, 0.5, True), "b": (0, 0.0, True)}


def test_spanning_tree_of_many_points():
    """The rows of the distance matrix, made one by one, give the tree of the whole matrix."""
    x = np.random.default_rng(1).normal(size=(60, 6))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, 3]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    edges = cluster._reachability_edges(x, 3)
    known, total = {0}, 0.0
    while len(known) < 60:
        a, b = min(((i, j) for i in known for j in range(60) if j not in known), key=lambda e: reach[e])
        known.add(b)
        total += reach[a, b]
    assert edges[:, 2].sum() == pytest.approx(total) and len(edges) == 59


def test_hulls_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(resample, "PER_PART", 7)
    rng = np.random.default_rng(2)
    rows = [("a", float(x), float(y)) for x, y in rng.integers(0, 30, (200, 2))] + [("b", 1.0, 1.0), (None, 0.0, 0.0), (None, 2.0, 0.0), (None, 0.0, 2.0)]
    got = {r.key: r for r in resample.cluster_hulls(spark.createDataFrame(rows, "key string, x_m double, y_m double").where("key IS NOT NULL"), ["key"]).collect()}
    assert [(p.x, p.y) for p in got["a"].hull] == resample.convex_hull([(x, y) for k, x, y in rows if k == "a"])
    assert got["a"].points == 200 and got["b"].points == 1


def test_tiles_in_parts(spark, monkeypatch):
    rows = [(1, 2, i, (i * 37) % 4096, (i * 91) % 4096) for i in range(100)] + [(1, 3, 5, 1, 1)]
    points = spark.createDataFrame(rows, "tile_x int, tile_y int, id long, px int, py int")
    whole = {(r.tile_x, r.tile_y): (r.features, bytes(r.tile)) for r in sinks.point_tiles(points).collect()}
    monkeypatch.setattr(sinks, "PER_PART", 9)
    assert {(r.tile_x, r.tile_y): (r.features, bytes(r.tile)) for r in sinks.point_tiles(points).collect()} == whole
    assert whole[1, 2] == (100, sinks.encode_point_tile([(i, x, y) for _, ty, i, x, y in rows if ty == 2]))


def test_markdown_has_all_rows(spark):
    text = markdown_summary(spark.range(2500).select(F.format_string("a%05d", "id").alias("area"), F.col("id").alias("n")))
    assert text.count("\n") == 2501 and text.splitlines()[:3] == ["| area | n |", "| --- | --- |", "| a00000 | 0 |"]


def test_geojson_collections(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 2], [0, 2], [0, 0]]
    shapes = [{"type": "Polygon", "coordinates": [ring]}, {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}, None, {"type": "Polygon", "coordinates": []}, {"type": "Point", "coordinates": [1, 2]}]
    document = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": str(i)}, "geometry": g} for i, g in enumerate(shapes)]}
    (tmp_path / "b.geojson").write_text(json.dumps(document))
    got = ingest.read_geojson(spark, str(tmp_path / "b.geojson"))
    rows = got.select(F.try_variant_get("properties", "$.id", "string").alias("id"), F.size("polygons").alias("n"), geo.rings_area(F.get("polygons", F.lit(0))).alias("area")).collect()
    assert sorted(map(tuple, rows)) == [("0", 1, 8.0), ("1", 2, 8.0)]


def test_discovery(spark, tmp_path):
    for path in ("salzburg/snt/insar_t44.parquet", "salzburg/snt/insar_t95.parquet", "gastein/tsx/insar_t70.parquet", "gastein/gba.parquet", "salzburg/gba.parquet"):
        spark.range(1).write.parquet(str(tmp_path / path))
    found = [(r.area_id, r.dataset_id, r.path.rsplit("/", 1)[1]) for r in ingest.discover(spark, str(tmp_path), "insar").collect()]
    assert found == [("gastein", "tsx", "insar_t70.parquet"), ("salzburg", "snt", "insar_t44.parquet"), ("salzburg", "snt", "insar_t95.parquet")]
    assert [p.split("/")[-2] for p in ingest.discover_combined(spark, str(tmp_path), "gba.parquet")] == ["gastein", "salzburg"]
    spark.range(1).write.parquet(str(tmp_path / "gba.parquet"))
    assert len(ingest.discover_combined(spark, str(tmp_path), "gba.parquet")) == 1
    assert ingest.discover_combined(spark, str(tmp_path), "osm.parquet") == []


def test_bbox_parameter():
    assert ingest.bbox("1, 2,3,4") == (1.0, 2.0, 3.0, 4.0)
    for bad in ("1,2,3", "a,b,c,d", ""):
        with pytest.raises(ValueError):
            ingest.bbox(bad)


def test_inner_point_outside_centroid(spark):
    """A horseshoe does not cover its centroid."""
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (10, 0), (10, 10), (9, 10), (9, 1), (1, 1), (1, 10), (0, 10)]])
    rows = spark.range(1).select(F.array(ring).alias("rings"))
    x, y = geo.rings_centroid(F.col("rings"))
    rows = rows.withColumn("c", F.struct(x.alias("x"), y.alias("y")))
    got = rows.withColumn("p", geo.inner_point(F.col("rings"), F.col("c"))).select(geo.rings_cover(F.col("c.x"), F.col("c.y"), F.col("rings")).alias("a"), geo.rings_cover(F.col("p.x"), F.col("p.y"), F.col("rings")).alias("b")).first()
    assert (got.a, got.b) == (False, True)


def test_building_stability(spark):
    """One building with two tracks that agree, and one with a single point."""
    rng = np.random.default_rng(3)
    rows = [("b", t, f"{t}{i}", float(v), 0.8) for t in (44, 95) for i, v in enumerate(rng.normal(-3, 0.05, 30))] + [("c", 44, "x", 1.0, 0.5)]
    points = spark.createDataFrame(rows, "building_id string, track int, code string, vertical double, support double")
    buildings = spark.createDataFrame([("b", "ok", -3.0, 0.9, 0.9, False, 2, 1.0), ("c", "small_n", 3.0, 0.1, 0.9, True, 1, 1.0)], "building_id string, status string, motion double, agreement double, reliability double, differential boolean, reliable_clusters int, allowed double")
    got = {r.building_id: r for r in resample.building_stability(points, buildings, 200).collect()}
    assert (got["b"].band, got["b"].tracks, list(got["b"].notes)) == ("stable", 2, []) and got["b"].motion_draws.median == pytest.approx(-3, abs=0.05) and got["b"].agreement_draws.mean > 0.9
    assert got["c"].band == "unstable" and got["c"].agreement_draws is None and len(got["c"].notes) == 4


def test_schemas(spark):
    for table in schemas.SCHEMAS:
        empty = spark.createDataFrame([], schemas.SCHEMAS[table])
        assert schemas.conform(empty.select(empty.columns[0]), table).dtypes == empty.dtypes and set(schemas.KEYS[table]) <= set(empty.columns)
    rows = spark.createDataFrame([("r", "m"), ("r", "m"), ("s", "m"), (None, "m")], "run_id string, metric string")
    assert sorted((str(r.run_id), r.rows) for r in schemas.key_faults(rows, "run_metrics").collect()) == [("None", 1), ("r", 2)]


def test_sensitivity_and_ramps(spark):
    held = {v: spark.range(1).select(classify.height_sensitivity(F.lit(v)).alias("c")).first().c for v in (0.2, 4.26, 33.4, 1e9, float("nan"), float("inf"))}
    assert list(held.values()) == [1.0, 4.3, 33.0, 100.0, 10.0, 10.0]
    got = spark.range(1).select(classify.agreement_color(F.lit(None).cast("double")).alias("a"), classify.quality_color(F.lit(1.0)).alias("b"), classify.quality_color(F.lit(0.2)).alias("c")).first()
    assert tuple(got) == ("#9aa0a6", "#1b9e77", "#b4452c")


def test_entry_without_the_optional_parts(monkeypatch):
    """The entry module loads, and offers all other queries, where the subpackage and the pipeline can't be imported."""
    import importlib
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("subsidia.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "subsidia.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        without = importlib.reload(entry)
        assert not [n for n in without.queries() if n.startswith("op") or n == "pipeline"] and set(without.oracle_sql()) <= set(without.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
