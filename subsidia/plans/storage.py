"""Queries over stored results: commits, and the layout that prunes and joins without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsidia.plans.catalog import query
from subsidia.session import shared_path
from subsidia.sources import adapters, layout
from subsidia.sources.commits import Store
from subsidia.streaming import runs as state_machine


def _results(spark: SparkSession, sf_dir: str, run_id: str, test: str) -> DataFrame:
    p = adapters.points(spark, sf_dir).where(test)
    return p.select(F.lit(run_id).alias("run_id"), "area_id", "dataset_id", "code", "track", "building_id", (F.abs("velocity") / 10).alias("anomaly_score"), F.to_json(F.struct("method", F.struct("epochs", "total_dates").alias("cover"))).alias("meta"))


@query("committed_results", """
WITH r AS (SELECT 'a' AS run_id, code, abs(velocity) / 10 AS s, epochs, method FROM v_points UNION ALL SELECT 'c', code, abs(velocity) / 10, epochs, method FROM v_points WHERE coherence >= 0.5),
u AS (SELECT run_id, code, CASE WHEN run_id = 'c' AND epochs < 30 THEN s + 1 ELSE s END AS s, method, epochs FROM r),
m AS (SELECT run_id, count(*) AS n FROM r GROUP BY run_id)
SELECT u.run_id, code, round(s, 6) AS anomaly_score, method, epochs, CASE WHEN u.run_id = 'c' THEN -1.0 ELSE CAST(n AS DOUBLE) END AS points FROM u JOIN m ON m.run_id = u.run_id""")
def committed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs are written with their metrics, some results and a metric are replaced, one batch comes twice, one run is dropped; what readers then see."""
    store = Store(spark, shared_path(spark, "results"))
    tests = {"a": "TRUE", "b": "velocity > 0", "c": "coherence >= 0.5"}
    for run_id, test in tests.items():
        found = _results(spark, sf_dir, run_id, test)
        with store.begin() as change:
            change.append("point_results", found, run_id)
            change.append("run_metrics", found.groupBy("run_id").agg(F.count("*").cast("double").alias("value")).withColumn("metric", F.lit("points")), run_id)
    for _ in range(2):
        with store.begin("rescored") as change:
            again = _results(spark, sf_dir, "c", "coherence >= 0.5 AND epochs < 30").withColumn("anomaly_score", F.col("anomaly_score") + 1)
            change.upsert("point_results", again)
            change.upsert("run_metrics", spark.range(1).select(F.lit("c").alias("run_id"), F.lit("points").alias("metric"), F.lit(-1.0).alias("value")))
    with store.begin() as change:
        change.delete_run("b")
    metrics = store.read("run_metrics").where("metric = 'points'").select("run_id", F.col("value").alias("points"))
    document = F.from_json("meta", "method string, cover struct<epochs:int,total_dates:int>")
    return store.read("point_results").join(metrics, "run_id").select("run_id", "code", F.round("anomaly_score", 6).alias("anomaly_score"), document["method"].alias("method"), document["cover"]["epochs"].alias("epochs"), "points")


_TWICE = "CAST(CAST(floor(CAST(code AS BIGINT) / 2) AS BIGINT) AS STRING)"


def _layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Points and results whose codes occur in two datasets, and in both tracks."""
    p = adapters.points(spark, sf_dir).selectExpr(f"{_TWICE} AS code", "track", "area_id", "CASE WHEN CAST(code AS BIGINT) % 2 = 0 THEN 'ds_a' ELSE 'ds_b' END AS dataset_id", "x_m", "velocity", "coherence")
    results = p.where("coherence IS NOT NULL").selectExpr("code", "track", "area_id", "dataset_id", "abs(velocity) / 10 AS anomaly")
    return p.drop("coherence"), results


@query("stored_join", f"""
WITH p AS (SELECT {_TWICE} AS code, track, area_id, CASE WHEN CAST(code AS BIGINT) % 2 = 0 THEN 'ds_a' ELSE 'ds_b' END AS dataset_id, x_m, velocity, coherence FROM v_points)
SELECT p.area_id, p.dataset_id, p.track, p.code, round(p.x_m, 4) AS x_m, round(abs(r.velocity) / 10, 6) AS anomaly FROM p JOIN p r ON r.code = p.code AND r.track = p.track AND r.area_id = p.area_id AND r.dataset_id = p.dataset_id AND r.coherence IS NOT NULL
WHERE p.area_id = 'area_a' AND (p.dataset_id = 'ds_b' OR p.track = 44)""")
def stored_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with their results from stored tables: only the folders of a selection are read, and nothing is shuffled for the join."""
    name, path = f"t{uuid.uuid4().hex}", shared_path(spark, "layout")
    points, results = (layout.write_layout(df, f"{name}_{part}", f"{path}/{part}") for df, part in zip(_layers(spark, sf_dir), ("points", "results")))
    chosen = points.where("area_id = 'area_a' AND (dataset_id = 'ds_b' OR track = 44)")
    return layout.joined(chosen, results).select("area_id", "dataset_id", "track", "code", F.round("x_m", 4).alias("x_m"), F.round("anomaly", 6).alias("anomaly"))


@query("run_states", """
WITH RECURSIVE e AS (SELECT pipeline AS run_id, status, CAST(created AS TIMESTAMP) AS at, row_number() OVER (PARTITION BY pipeline ORDER BY created, CAST(run_id AS BIGINT)) AS k FROM (
    SELECT pipeline, run_id, created, CASE WHEN value > 300000 THEN 'failed' ELSE status END AS status FROM v_runs) x),
s AS (SELECT DISTINCT run_id, 0::BIGINT AS k, '' AS status, NULL::TIMESTAMP AS since, 0 AS refused, 0 AS late FROM e UNION ALL
  SELECT s.run_id, e.k, CASE WHEN ok THEN e.status ELSE s.status END, CASE WHEN ok THEN e.at ELSE s.since END, s.refused + (NOT ok AND NOT ended)::INT, s.late + ended::INT FROM (
    SELECT *, status IN ('succeeded', 'failed') AS ended FROM s) s JOIN (SELECT * FROM e) e ON e.run_id = s.run_id AND e.k = s.k + 1,
    LATERAL (SELECT (s.status = '' AND e.status IN ('queued', 'running')) OR (s.status = 'queued' AND e.status IN ('running', 'failed')) OR (s.status = 'running' AND e.status IN ('succeeded', 'failed')) AS ok))
SELECT run_id, nullif(status, '') AS status, CAST(since AS DATE) AS since, refused, late FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY k DESC) AS z FROM s) WHERE z = 1""")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each pipeline from its log, with the events that were refused or late."""
    runs = adapters.runs(spark, sf_dir)
    events = runs.select(F.col("pipeline").alias("run_id"), F.col("created").cast("timestamp").alias("at"), F.col("run_id").cast("long").alias("number"), F.when(F.col("value") > 300000, "failed").otherwise(F.col("status")).alias("status"))
    return state_machine.run_states(events).withColumn("since", F.col("since").cast("date"))
