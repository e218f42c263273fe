import gzip
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from subsidia.operators import groups, nearest
from subsidia.sources import ingest
from subsidia.streaming import runs


def test_elevation_files(spark, tmp_path):
    """Four tiles, one compressed, one in the south-west: voids, and shared edges where the first tile with a value wins."""
    rng, n = np.random.default_rng(1), 5
    want = {}
    for north, east in ((47, 12), (47, 13), (46, 12), (-1, -2)):
        heights = rng.integers(-50, 3000, (n, n)).astype(">i2")
        heights[rng.random((n, n)) < 0.3] = -32768
        name = f"{'N' if north >= 0 else 'S'}{abs(north):02d}{'E' if east >= 0 else 'W'}{abs(east):03d}.hgt"
        if (north, east) == (46, 12):
            (tmp_path / f"{name}.gz").write_bytes(gzip.compress(heights.tobytes()))
        else:
            (tmp_path / name).write_bytes(heights.tobytes())
        for r in range(n):
            for c in range(n):
                if heights[r, c] != -32768:
                    want.setdefault((r - (north + 1) * (n - 1), c + east * (n - 1)), float(heights[r, c]))
    (tmp_path / "readme.txt").write_text("no tile")
    got = ingest.hgt_mosaic(ingest.read_hgt(spark, str(tmp_path))).collect()
    assert {(r.row, r.col): r.elevation for r in got} == want and len(got) == len(want)
    bad = spark.createDataFrame([("N47E012.hgt", bytearray(7))], "path string, content binary")
    with pytest.raises(Exception, match="no elevation tile"):
        ingest.hgt_rows(bad).collect()


def test_relations(spark):
    """Members in order, twice, of other kinds, unknown, with an unknown node; a relation without a whole way is dropped."""
    node = lambda i: ("node", i, float(i), float(-i), None, None)
    way = lambda i, *refs: ("way", i, None, None, list(refs), None)
    relation = lambda i, *members: ("relation", i, None, None, None, list(members))
    rows = [*map(node, range(1, 9)), way(10, 1, 2, 3, 1), way(11, 4, 5, 6, 4), way(12, 7, 8, 99, 7), way(13, 1, 2, 1), relation(20, ("way", 11), ("node", 1), ("way", 10), ("way", 77), ("way", 12), ("way", 11)), relation(21, ("way", 12), ("way", 13)), relation(22), relation(23, ("way", 10))]
    frame = spark.createDataFrame(rows, "type string, id long, lon double, lat double, nodes array<long>, members array<struct<type:string,ref:long>>")
    got = {r.relation_id: [[[int(p.x) for p in ring] for ring in polygon] for polygon in r.polygons] for r in ingest.relation_polygons(frame).collect()}
    assert got == {20: [[[4, 5, 6, 4]], [[1, 2, 3, 1]], [[4, 5, 6, 4]]], 23: [[[1, 2, 3, 1]]]}


def test_nearest_by_all_pairs(spark):
    """Large and small groups, clusters of unlike density, coincident points, a point alone, rows without a group."""
    rng = np.random.default_rng(2)
    rows = [("big", 44, float(x), float(y)) for x, y in np.vstack([rng.normal(0, 0.01, (300, 2)), rng.normal(50, 20, (200, 2)), [(5000.0, 5000.0)]])]
    rows += [("same", 44, 1.0, 1.0)] * 60 + [("same", 44, 4.0, 5.0)] + [("few", 95, float(i), 0.0) for i in range(3)] + [("one", 44, 1.0, 2.0), (None, 44, 1.0, 1.0), (None, 44, 1.0, 1.0)]
    frame = spark.createDataFrame([(f"{i:04d}", *r) for i, r in enumerate(rows)], "code string, building_id string, track int, x_m double, y_m double")
    got = {r.code: r.local_density for r in groups.local_density(frame).collect()}
    for i, (b, t, x, y) in enumerate(rows):
        d = sorted(np.hypot(x - r[2], y - r[3]) for j, r in enumerate(rows) if j != i and b is not None and r[:2] == (b, t))[:3]
        assert got[f"{i:04d}"] == pytest.approx(np.exp(-np.mean(d) / 6) if d else 0.0, abs=1e-9)
    plan = groups.local_density(frame)._jdf.queryExecution().toString()
    assert "level" in plan and len(got) == len(rows)
    pairs = nearest.nearest_mean(spark.range(0, 20_000).select(F.lit("g").alias("g"), F.rand(1).alias("x_m"), F.rand(2).alias("y_m")), ["g"], 3)
    assert pairs.count() == 20_000


def test_states_of_shuffled_events(spark, tmp_path):
    """The stream, whatever order events arrive in, ends with the states of the table."""
    random.seed(5)
    names = ["queued", "running", "succeeded", "failed", "odd"]
    rows = [(f"r{i % 40:02d}", f"2024-01-{random.randint(1, 28):02d} 00:00:00", i, random.choice(names)) for i in range(400)] + [("good", f"2024-01-0{k} 00:00:00", k, s) for k, s in enumerate(names[:3], 1)]
    events = spark.createDataFrame(rows, "run_id string, at string, number long, status string").withColumn("at", F.col("at").cast("timestamp"))
    want = {r.run_id: tuple(r)[1:] for r in runs.run_states(events).collect()}
    assert want["good"][0] == "succeeded" and want["good"][2:] == (0, 0) and any(w[2] for w in want.values()) and any(w[3] for w in want.values())
    random.shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[k::4], "run_id string, at string, number long, status string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", runs.PROVIDER)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    got = {}

    def keep(batch, number):
        got.update({r.run_id: tuple(r)[1:] for r in batch.collect()})

    stream = session.readStream.schema("run_id string, at timestamp, number long, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = runs.stream_run_states(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / uuid.uuid4().hex)).trigger(availableNow=True).start()
    query.awaitTermination()
    assert got == want
