"""Static dimensions: areas, datasets and the radar tracks' geometry."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

# Areas and their bounds, datasets, and tracks with their bearings and incidence angles.
AREAS = [
    ("salzburg", "Salzburg", "salzburg_snt", (12.95, 47.75, 13.15, 47.85)),
    ("bad_gastein", "Bad Gastein", "bad_gastein_snt", (13.000531, 47.013449, 13.277222, 47.159603)),
]
DATASETS = [
    ("salzburg_snt", "salzburg", "Salzburg SNT", "SNT", (44, 95)),
    ("bad_gastein_snt", "bad_gastein", "Bad Gastein SNT", "SNT", (44, 95)),
    ("bad_gastein_tsx_paz", "bad_gastein", "Bad Gastein TSX/PAZ", "TSX/PAZ", (93, 70)),
]
TRACKS = [
    ("salzburg_snt", 44, "A", 81.4, 261.4, 38.81),
    ("salzburg_snt", 95, "D", 281.5, 101.5, 38.48),
    ("bad_gastein_snt", 22, "D", 280.2, 100.2, 45.66),
    ("bad_gastein_snt", 44, "A", 81.4, 261.4, 38.32),
    ("bad_gastein_snt", 95, "D", 281.5, 101.5, 37.16),
    ("bad_gastein_tsx_paz", 70, "D", 279.45, 99.45, 51.68),
    ("bad_gastein_tsx_paz", 93, "A", 83.77, 263.77, 53.9),
]


def bearing_vector(degrees: float) -> tuple[float, float]:
    """East and north parts of a compass bearing."""
    return math.sin(math.radians(degrees)), math.cos(math.radians(degrees))


def track_geometry(spark: SparkSession) -> DataFrame:
    """One row per dataset and track: bearings, default incidence, and the unit vector in range."""
    sensors = {d: (area, sensor) for d, area, _, sensor, _ in DATASETS}
    rows = [(sensors[d][0], d, sensors[d][1], t, los, look, sensor, inc, *bearing_vector(sensor), True) for d, t, los, look, sensor, inc in TRACKS]
    return spark.createDataFrame(rows, "area_id string, dataset_id string, sensor string, track int, los string, look_bearing_deg double, sensor_bearing_deg double, default_incidence_deg double, range_dx double, range_dy double, direction_dependent boolean")


def dataset_contracts(spark: SparkSession) -> DataFrame:
    """Datasets with their tracks as a sorted list."""
    return track_geometry(spark).groupBy("area_id", "dataset_id", "sensor").agg({"track": "collect_list"}).selectExpr("area_id", "dataset_id", "sensor", "array_sort(`collect_list(track)`) AS tracks")


def resolve_area_dataset(area_id: str | None, dataset_id: str | None) -> tuple[str, str | None]:
    """The area and dataset that a request means; a ValueError if they are unknown or don't fit."""
    datasets, areas = {d: area for d, area, *_ in DATASETS}, {a: default for a, _, default, _ in AREAS}
    if dataset_id is not None and dataset_id not in datasets:
        raise ValueError(f"unknown dataset {dataset_id}")
    if area_id is None:
        if dataset_id is None:
            raise ValueError("an area or a dataset is needed")
        area_id = datasets[dataset_id]
    if area_id not in areas:
        raise ValueError(f"unknown area {area_id}")
    if dataset_id is not None and datasets[dataset_id] != area_id:
        raise ValueError(f"dataset {dataset_id} is not of area {area_id}")
    return area_id, dataset_id or areas[area_id]
