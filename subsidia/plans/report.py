"""Reading results back: nested documents, summaries and reports, and the registry of pipelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsidia.functions import classify, json
from subsidia.plans import features
from subsidia.plans.catalog import query
from subsidia.sources import adapters


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result documents as text, every eleventh of them broken."""
    n = F.col("code").cast("long")
    meta = F.to_json(F.struct(F.struct("velocity", "epochs", F.when(n % 2 == 0, " True ").otherwise("no").alias("flag"), F.create_map(F.col("track").cast("string"), F.col("velocity")).alias("motions")).alias("building"), F.array(F.lit("a"), F.lit("b")).alias("reasons")))
    return adapters.points(spark, sf_dir).select("code", F.when(n % 11 == 0, "{broken").otherwise(meta).alias("meta"))


@query("nested_documents", """
SELECT code, CASE WHEN CAST(code AS BIGINT) % 11 <> 0 THEN velocity END AS velocity, CASE WHEN CAST(code AS BIGINT) % 11 <> 0 THEN CAST(epochs AS BIGINT) END AS epochs,
  CASE WHEN CAST(code AS BIGINT) % 11 <> 0 AND CAST(code AS BIGINT) % 2 = 0 THEN TRUE END AS flag, CASE WHEN CAST(code AS BIGINT) % 11 <> 0 THEN 'a,b' ELSE '' END AS reasons,
  CAST(CASE WHEN CAST(code AS BIGINT) % 11 <> 0 THEN velocity END AS DOUBLE) AS motion, CAST(code AS BIGINT) % 11 <> 0 AS has_building FROM v_points""")
def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("code", json.parsed(F.col("meta")).alias("m"))
    m = F.col("m")
    motion = F.get(F.map_values(json.float_map(json.get_map(m, "building", "motions"))), F.lit(0))
    return rows.select("code", json.get_float(m, "building", "velocity").alias("velocity"), json.get_int(m, "building", "epochs").alias("epochs"), json.get_bool(m, "building", "flag").alias("flag"), F.array_join(json.get_list(m, "reasons"), ",").alias("reasons"), motion.alias("motion"), json.has_key(m, "building").alias("has_building"))


@query("metadata_merge", """
WITH d AS (SELECT c_custkey AS k, max(c_acctbal) AS v FROM customer GROUP BY c_custkey), t AS (SELECT o_custkey AS k, min(o_totalprice) AS v FROM orders GROUP BY o_custkey)
SELECT coalesce(d.k, t.k) AS k, CAST(coalesce(t.v, d.v) AS DOUBLE) AS v FROM d FULL OUTER JOIN t ON d.k = t.k""")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources merged by key; the second one's values win and its new keys are added."""
    d = adapters.table(spark, sf_dir, "customer").groupBy(F.col("c_custkey").alias("k")).agg(F.max("c_acctbal").alias("left_v"))
    t = adapters.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_totalprice").alias("right_v"))
    return d.join(t, "k", "full").select("k", F.coalesce("right_v", "left_v").cast("double").alias("v"))


@query("run_summary", """
SELECT area_id, count(*) AS points, count(DISTINCT building_id) AS buildings, round(median(abs(velocity)), 6) AS median_abs_velocity, round(avg(CASE WHEN coherence >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS normal_share,
  sum(CASE WHEN method = 'nearest' THEN 1 ELSE 0 END)::BIGINT AS nearest, sum(CASE WHEN coherence IS NULL THEN 1 ELSE 0 END)::BIGINT AS unknown FROM v_points GROUP BY area_id""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda test: F.count(F.when(test, 1))
    return adapters.points(spark, sf_dir).groupBy("area_id").agg(
        F.count("*").alias("points"), F.count_distinct("building_id").alias("buildings"), F.round(F.median(F.abs("velocity")), 6).alias("median_abs_velocity"),
        F.round(F.avg(F.when(F.col("coherence") >= 0.7, 1.0).otherwise(0.0)), 6).alias("normal_share"), n(F.col("method") == "nearest").alias("nearest"), n(F.col("coherence").isNull()).alias("unknown"),
    )


@query("height_bins", """
SELECT CAST(floor((greatest(0, 400 + height * 5 - 450) % 90.0) / 10) AS INTEGER) AS bin, round(least(1, greatest(0, CAST(CASE WHEN height <= 5 THEN height / 25 WHEN height <= 15 THEN 0.2 + (height - 5) / 50 WHEN height <= 25 THEN 0.4 + (height - 15) / 50 WHEN height <= 35 THEN 0.6 + (height - 25) / 50 ELSE 0.8 + (height - 35) / 275 END AS DOUBLE))), 6) AS shade, count(*) AS n
FROM v_points WHERE height IS NOT NULL GROUP BY 1, 2""")
def height_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.points(spark, sf_dir).where("height IS NOT NULL")
    return rows.groupBy(classify.height_cycle(400 + F.col("height") * 5).alias("bin"), F.round(classify.slope_ramp(F.col("height")), 6).alias("shade")).agg(F.count("*").alias("n"))


@query("tracks_in_order", """
SELECT track, row_number() OVER (ORDER BY TRY_CAST(track AS INTEGER) NULLS LAST, track) AS position FROM (SELECT DISTINCT CASE WHEN CAST(code AS BIGINT) % 5 = 0 THEN 'x' || track ELSE CAST(track AS VARCHAR) END AS track FROM v_points) s""")
def tracks_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track names in numeric order, others after them; the window reads one row per track."""
    from pyspark.sql.window import Window

    name = F.when(F.col("code").cast("long") % 5 == 0, F.concat(F.lit("x"), F.col("track").cast("string"))).otherwise(F.col("track").cast("string"))
    names = adapters.points(spark, sf_dir).select(name.alias("track")).distinct()
    return names.select("track", F.row_number().over(Window.orderBy(F.col("track").try_cast("int").asc_nulls_last(), "track")).cast("long").alias("position"))


def markdown_lines(summary: DataFrame) -> DataFrame:
    """A summary as the lines (at, value) of a Markdown table, in order of its first column; one task only numbers the rows."""
    from pyspark.sql.window import Window

    columns = summary.columns
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    lines = summary.select((F.row_number().over(Window.orderBy(columns[0])) + 1).alias("at"), row.alias("value"))
    head = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(x).alias("value")) for i, x in enumerate(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)])])
    return summary.sparkSession.range(1).select(F.inline(head)).unionByName(lines)


def markdown_summary(summary: DataFrame) -> str:
    """The whole run summary, one row per area, as a Markdown table; areas are a fixed dimension."""
    return "\n".join(r["value"] for r in markdown_lines(summary).orderBy("at").toLocalIterator())


#: Pipelines by name: default parameters and the function of (spark, sf_dir) that gives the result.
PIPELINES: dict[str, tuple[dict, Callable[[SparkSession, str], DataFrame]]] = {
    "anomaly": ({"min_epochs": 24, "min_ratio": 0.50, "coherence_floor": 0.45, "max_distance": 15.0, "slack": 2.0}, features.anomaly_scores),
}


def pipeline(name: str) -> Callable[[SparkSession, str], DataFrame]:
    if name not in PIPELINES:
        raise ValueError(f"unknown pipeline {name}")
    return PIPELINES[name][1]
