import uuid

import pytest
from pyspark.sql import functions as F

from subsidia.plans import storage
from subsidia.sources import commits, layout


@pytest.fixture
def store(spark, tmp_path):
    return commits.Store(spark, f"file://{tmp_path}/store")


def metrics(spark, *rows):
    return spark.createDataFrame(list(rows), "run_id string, metric string, value double")


def seen(store, table="run_metrics", version=None):
    return sorted((r.run_id, r.metric, r.value) for r in store.read(table, version).collect())


def test_a_writer_that_dies(spark, store):
    """Readers see the old tables until the change is whole; what it left behind is removed."""
    with store.begin() as change:
        change.append("run_metrics", metrics(spark, ("a", "m", 1.0)), "a")
        change.append("runs", spark.createDataFrame([("a", "succeeded")], "run_id string, status string"), "a")
    with pytest.raises(RuntimeError), store.begin() as change:
        change.append("run_metrics", metrics(spark, ("b", "m", 2.0)), "b")
        assert seen(store) == [("a", "m", 1.0)]
        raise RuntimeError("lost between two tables")
    assert seen(store) == [("a", "m", 1.0)] and store.read("runs").count() == 1 and store.versions() == [1]
    assert len(store.vacuum(older_s=0)) == 1 and seen(store) == [("a", "m", 1.0)] and store.read("building_colors").count() == 0


def test_batches_are_written_once(spark, store):
    for number in (0, 1, 1, 0):
        store.sink("run_metrics", "stream")(metrics(spark, ("a", f"m{number}", 1.0)), number)
    assert seen(store) == [("a", "m0", 1.0), ("a", "m1", 1.0)] and store.versions() == [1, 2]


def test_stream_into_a_table(spark, store, tmp_path):
    metrics(spark, *[("a", f"m{i}", float(i)) for i in range(30)]).repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("run_id string, metric string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(store.sink("run_metrics", "s")).option("checkpointLocation", str(tmp_path / f"c{uuid.uuid4().hex}")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen(store)) == 30 and len(store.versions()) == 3


def test_upserts_rewrite_what_they_touch(spark, store):
    for run in "abc":
        with store.begin() as change:
            change.append("run_metrics", metrics(spark, (run, "m", 1.0), (run, "n", 1.0)), run)
    before = {e["folder"] for e in store.manifest()["tables"]["run_metrics"]}
    with store.begin() as change:
        change.upsert("run_metrics", metrics(spark, ("b", "m", 5.0), ("d", "m", 6.0)))
    after = {e["folder"] for e in store.manifest()["tables"]["run_metrics"]}
    assert len(before & after) == 2 and seen(store) == [("a", "m", 1.0), ("a", "n", 1.0), ("b", "m", 5.0), ("b", "n", 1.0), ("c", "m", 1.0), ("c", "n", 1.0), ("d", "m", 6.0)]
    assert len(seen(store, version=3)) == 6
    with store.begin() as change:
        change.delete_run("b")
    assert [r[0] for r in seen(store)] == ["a", "a", "c", "c", "d"] and {e["run_id"] for e in store.manifest()["tables"]["run_metrics"]} == {"a", "c", None}


def test_two_writers(spark, store):
    """Appends of both stay; a change computed from rows that another writer has replaced is refused."""
    one, two = store.begin(), store.begin()
    one.append("run_metrics", metrics(spark, ("a", "m", 1.0)))
    two.append("run_metrics", metrics(spark, ("b", "m", 2.0)))
    for change in (one, two):
        change.__exit__(None, None, None)
    assert seen(store) == [("a", "m", 1.0), ("b", "m", 2.0)] and store.versions() == [1, 2]
    one, two = store.begin(), store.begin()
    one.upsert("run_metrics", metrics(spark, ("a", "m", 3.0)))
    two.upsert("run_metrics", metrics(spark, ("a", "m", 4.0)))
    one.__exit__(None, None, None)
    with pytest.raises(commits.Conflict):
        two.__exit__(None, None, None)
    assert seen(store) == [("a", "m", 3.0), ("b", "m", 2.0)]
    same = [store.begin("x"), store.begin("x")]
    for change in same:
        change.append("run_metrics", metrics(spark, ("x", "m", 0.0)))
    for change in same:
        change.__exit__(None, None, None)
    assert [r for r in seen(store) if r[0] == "x"] == [("x", "m", 0.0)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_of_the_layout(spark, sf_dir, tmp_path):
    """No exchange for the join, folders pruned by filters and at run time, and the same rows after the tables are made known again."""
    points, results = storage._layers(spark, sf_dir)
    name = f"l{uuid.uuid4().hex}"
    p, r = layout.write_layout(points, f"{name}p", f"{tmp_path}/p", 8), layout.write_layout(results, f"{name}r", f"{tmp_path}/r", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = layout.joined(p.where("area_id = 'area_a' AND track = 44"), r)
        text = plan(met)
        assert "Exchange" not in text and "PartitionFilters: [isnotnull(area_id" in text and "SortMergeJoin" in text
        want = points.where("area_id = 'area_a' AND track = 44").join(results, ["area_id", "dataset_id", "track", "code"])
        assert met.count() == want.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    chosen = layout.of_selection(p, spark.createDataFrame([("area_b", "ds_a", 44)], "area_id string, dataset_id string, track int"))
    assert chosen.count() == points.where("area_id = 'area_b' AND dataset_id = 'ds_a' AND track = 44").count()
    some = p.join(F.broadcast(spark.createDataFrame([("area_b", 1), ("area_c", 2)], "area_id string, n int").where("n < 2")), "area_id")
    assert "dynamicpruning" in plan(some)
    spark.sql(f"DROP TABLE {name}p")
    again = layout.open_layout(spark, f"{name}p", f"{tmp_path}/p", "area_id string, dataset_id string, track int, code string, x_m double, velocity double", 8)
    assert again.count() == points.count()
