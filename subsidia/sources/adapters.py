"""The star-schema tables in the roles of points, buildings, series and runs.

Each adapter is a list of select expressions that Spark and DuckDB both accept,
so the queries and their SQL counterparts start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POINTS = [
    "CAST(o_orderkey AS STRING) AS code",
    "CASE WHEN o_orderkey % 2 = 0 THEN 44 ELSE 95 END AS track",
    "CASE WHEN o_custkey % 2 = 0 THEN 'area_a' ELSE 'area_b' END AS area_id",
    "'ds_a' AS dataset_id",
    "CAST(o_custkey AS STRING) AS building_id",
    "CAST(350000 + (o_custkey % 40) * 20 AS DOUBLE) + CAST((o_orderkey * 37) % 3000 AS DOUBLE) / 100 - 15 AS x_m",
    "CAST(5290000 + ((o_custkey - o_custkey % 40) / 40) * 20 AS DOUBLE) + CAST((o_orderkey * 53) % 3000 AS DOUBLE) / 100 - 15 AS y_m",
    "CAST((o_orderkey * 7919) % 2001 - 1000 AS DOUBLE) / 100 AS velocity",
    "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST((o_orderkey * 104729) % 1000 AS DOUBLE) / 1000 END AS coherence",
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST((o_orderkey * 31) % 400 AS DOUBLE) / 10 END AS height",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(300 + (o_orderkey * 3) % 200 AS DOUBLE) / 10 END AS incidence_angle",
    "CAST((o_orderkey * 13) % 41 - 20 AS DOUBLE) / 10 AS acceleration",
    "CAST((o_orderkey * 11) % 50 AS DOUBLE) / 10 AS velocity_std",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST((o_orderkey * 19) % 100 AS DOUBLE) / 100 END AS amp_cv",
    "CAST((o_orderkey * 17) % 80 AS DOUBLE) / 10 AS step_abs",
    "CAST((o_orderkey * 7) % 5 AS INT) AS step_index",
    "CAST((o_orderkey * 5) % 3 - 1 AS INT) AS step_sign",
    "CAST((o_orderkey * 23) % 60 AS INT) AS epochs",
    "60 AS total_dates",
    "CASE WHEN o_orderkey % 4 = 0 THEN 'nearest' WHEN o_orderkey % 4 = 1 THEN 'directional_buffer' ELSE 'within' END AS method",
]
BUILDINGS = [
    "CAST(c_custkey AS STRING) AS building_id",
    "CASE WHEN c_custkey % 2 = 0 THEN 'area_a' ELSE 'area_b' END AS area_id",
    "CAST(350000 + (c_custkey % 40) * 20 AS DOUBLE) AS cx",
    "CAST(5290000 + ((c_custkey - c_custkey % 40) / 40) * 20 AS DOUBLE) AS cy",
    "CAST(4 + c_nationkey % 5 AS DOUBLE) AS hw",
    "CAST(3 + c_nationkey % 4 AS DOUBLE) AS hh",
    "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(3 + c_custkey % 25 AS DOUBLE) END AS height",
    "CAST(c_nationkey % 12 AS DOUBLE) AS slope_mean_deg",
]
SERIES = ["CAST(user_id AS STRING) AS code", "event_type AS track", "CAST(ts AS DATE) AS date", "value"]
#: Displacement and amplitude of each point by date, from the order's lines.
LINES = ["CAST(l_orderkey AS STRING) AS code", "CAST(l_shipdate AS DATE) AS date", "CAST((l_partkey * 37) % 400 - 200 AS DOUBLE) / 10 AS displacement", "CAST(l_quantity AS DOUBLE) AS amplitude"]
RUNS = [
    "CAST(o_orderkey AS STRING) AS run_id",
    "CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'succeeded' END AS status",
    "CAST(o_custkey AS STRING) AS pipeline",
    "CAST(o_orderdate AS DATE) AS created",
    "CAST(o_totalprice AS DOUBLE) AS value",
]

#: SQL text of the adapters, for a WITH clause.
SQL = {
    "v_points": f"SELECT {', '.join(POINTS)} FROM orders",
    "v_buildings": f"SELECT {', '.join(BUILDINGS)} FROM customer",
    "v_series": "SELECT code, track, date, avg(value) AS displacement FROM (SELECT " + ", ".join(SERIES) + " FROM events) s GROUP BY code, track, date",
    "v_lines": "SELECT code, date, avg(displacement) AS displacement, avg(amplitude) AS amplitude FROM (SELECT " + ", ".join(LINES) + " FROM lineitem) s GROUP BY code, date",
    "v_runs": f"SELECT {', '.join(RUNS)} FROM orders",
}


def with_views(sql: str) -> str:
    """``sql`` after a WITH clause of the adapters that it names."""
    named = [f"{name} AS ({text})" for name, text in SQL.items() if name in sql]
    rest = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if rest.upper().startswith(start):
            return start + ", ".join([*named, rest[len(start) :]])
    return ("WITH " + ", ".join(named) + " " if named else "") + rest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*POINTS)


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*BUILDINGS)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean displacement by code, track and date."""
    return table(spark, sf_dir, "events").selectExpr(*SERIES).groupBy("code", "track", "date").agg({"value": "avg"}).withColumnRenamed("avg(value)", "displacement")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean displacement and amplitude of each point by date."""
    return table(spark, sf_dir, "lineitem").selectExpr(*LINES).groupBy("code", "date").agg({"displacement": "avg", "amplitude": "avg"}).withColumnsRenamed({"avg(displacement)": "displacement", "avg(amplitude)": "amplitude"})


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*RUNS)
