"""Ranks of rows within groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subsidia.session import materialize

_ROW_BITS = 33


def ranked(rows: DataFrame, group: str, order: list[Column], name: str = "ranked") -> DataFrame:
    """``rows`` with ``rank`` (from 0, within the group, by ``order``) and ``group_rows``; written once.

    The rows are sorted over the whole cluster by range, a large group over
    many partitions.  A row's place in its partition and the counts of its
    group in earlier partitions give its rank; only the counts, a row for each
    partition and group in it, go through a window.  Rows that ``order`` does
    not tell apart take any order, so it should end with what makes them alike.
    """
    place = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    placed = materialize(placed.withColumn("place", place).withColumns({"part": F.shiftright("place", _ROW_BITS), "at": F.col("place").bitwiseAND((1 << _ROW_BITS) - 1)}).drop("place"), name)
    runs = placed.groupBy("part", group).agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "group_rows": F.sum("n").over(Window.partitionBy(group))}), f"{name}-runs")
    return placed.join(runs, ["part", group]).withColumn("rank", F.col("before") + F.col("at") - F.col("first_at")).drop("part", "at", "first_at", "n", "before")
