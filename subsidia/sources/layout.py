"""Tables stored so that filters skip folders and joins need no shuffle.

Rows lie in folders by area, dataset and track, and in each in buckets by the
whole key, sorted.  Two tables with the same number of buckets are joined by
that key bucket by bucket.  The tables are known to Spark's catalog; a new
session makes them known again from their folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = ("area_id", "dataset_id", "track")
BUCKETS = 64


def point_key(*columns: str) -> Column:
    """Area, dataset, track and code as one text; parts are told apart by a character that none of them holds."""
    return F.concat_ws("\x1f", *(columns or (*FOLDERS, "code")))


def write_layout(df: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Writes points' rows (area_id, dataset_id, track, code and others) as a table of the catalog, in place of one of that name.

    Rows are dealt by folder and bucket first, so each folder has a file for
    each bucket and not one for each task.
    """
    keyed = df.withColumn("point_key", point_key())
    dealt = keyed.repartition(*FOLDERS, F.pmod(F.hash("point_key"), F.lit(buckets)))
    dealt.write.mode("overwrite").option("path", path).partitionBy(*FOLDERS).bucketBy(buckets, "point_key").sortBy("point_key").saveAsTable(table)
    return df.sparkSession.table(table)


def open_layout(spark: SparkSession, table: str, path: str, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """Makes a stored table known to this session's catalog; ``schema`` has all its columns."""
    columns = schema if "point_key" in schema else f"{schema}, point_key string"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY ({', '.join(FOLDERS)}) CLUSTERED BY (point_key) SORTED BY (point_key) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.catalog.recoverPartitions(table)
    return spark.table(table)


def joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Two stored tables by all four keys, without a shuffle; the right one's keys are dropped."""
    right = right.drop(*FOLDERS, "code")
    return left.join(right, "point_key", how)


def of_selection(table: DataFrame, selection: DataFrame) -> DataFrame:
    """Rows of the areas, datasets and tracks in a small table; their folders are found when the query runs, and only they are read."""
    return table.join(F.broadcast(selection.select(*FOLDERS).distinct()), list(FOLDERS), "left_semi")
