"""Schemas of the stored layers and result tables, their keys, and a check of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_POINT = "area_id string, dataset_id string, code string, track int"
_BUILDING = "area_id string, building_source string, building_id string"
_POLYGONS = "array<array<array<struct<x:double,y:double>>>>"
# Names and types of the columns of each table; documents are JSON text, positions degrees.
SCHEMAS = {
    "points": "area_id string, dataset_id string, sensor string, code string, track int, los string, velocity double, velocity_std double, coherence double, height double, height_std double, acceleration double, acceleration_std double,"
    " season_amp double, season_phs double, s_amp_std double, s_phs_std double, incidence_angle double, look_angle double, eff_area double, amp_mean double, amp_std double, lon double, lat double",
    "timeseries": f"{_POINT}, date date, displacement double",
    "amplitudes": f"{_POINT}, date date, amplitude double",
    "gba_buildings": f"area_id string, gba_id string, height double, properties string, polygons {_POLYGONS}",
    "osm_buildings": f"area_id string, osm_id bigint, name string, building_type string, tags string, polygons {_POLYGONS}",
    "point_terrain": f"{_POINT}, terrain_source string, terrain_resolution_m double, terrain_elevation_m double, slope_deg double, aspect_deg double",
    "building_terrain": f"{_BUILDING}, terrain_source string, terrain_resolution_m double, terrain_elevation_mean_m double, terrain_elevation_min_m double, terrain_elevation_max_m double, slope_mean_deg double, slope_max_deg double, relief_range_m double",
    "runs": "run_id string, area_id string, dataset_id string, pipeline string, pipeline_version string, run_type string, source string, track int, bbox string, params string, status string, created_at timestamp, started_at timestamp, finished_at timestamp, error string",
    "point_results": f"run_id string, {_POINT}, cluster_id string, building_source string, building_id string, distance_m double, score double, anomaly_score double, quality_score double, cross_track_consistency double, label string, feature_set_version string, model_set_version string, meta string",
    "run_metrics": "run_id string, metric string, value double, meta string",
    "building_colors": f"run_id string, {_BUILDING}, color_index int",
}
KEYS = {
    "points": ("area_id", "dataset_id", "code", "track"), "timeseries": ("area_id", "dataset_id", "code", "track", "date"), "amplitudes": ("area_id", "dataset_id", "code", "track", "date"),
    "gba_buildings": ("area_id", "gba_id"), "osm_buildings": ("area_id", "osm_id"), "point_terrain": ("area_id", "dataset_id", "code", "track"), "building_terrain": ("area_id", "building_source", "building_id"),
    "runs": ("run_id",), "point_results": ("run_id", "area_id", "dataset_id", "code", "track"), "run_metrics": ("run_id", "metric"), "building_colors": ("run_id", "area_id", "building_source", "building_id"),
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Exactly the table's columns in its types: missing ones null, others dropped."""
    from subsidia.sources.ingest import with_schema

    fields = df.sparkSession.createDataFrame([], SCHEMAS[table]).dtypes
    return with_schema(df, fields)


def key_faults(df: DataFrame, table: str) -> DataFrame:
    """Key values that are null in a part or stand on several rows, with the number of rows."""
    keys = list(KEYS[table])
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(missing | (F.col("rows") > 1))
