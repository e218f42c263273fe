"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsidia.session import counted, materialize

#: Up to so many links the minima are broadcast; beyond, those of hubs are, at most so many.
FEW, MAX_HUBS = 500_000, 100_000


def _with_least(rows: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """Rows (u, v) with the least neighbour m of u.

    Few minima are broadcast, so the rows stay where they are.  Of many, those
    of hubs are: nodes with so many links that there can't be more than
    ``MAX_HUBS`` of them.  Only the rows of other nodes are dealt by node.
    """
    if links <= FEW:
        return rows.join(F.broadcast(least.select("u", "m")), "u")
    is_hub = F.col("degree") > 2 * links // MAX_HUBS
    hubs = F.broadcast(materialize(least.where(is_hub).select("u", "m"), "hubs"))
    others = rows.join(hubs.select("u"), "u", "left_anti").join(least.where(~is_hub).select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(others)


def _least(rows: DataFrame) -> DataFrame:
    return rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))


def _star_step(edges: DataFrame, links: int) -> DataFrame:
    """Links every node's larger neighbours, then its smaller ones, to the smallest node in sight."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("m", F.least("u", "m"))
    large = _with_least(both.where("v > u"), least, links).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if links > FEW:
        large = materialize(large, "large-star")
    small = _with_least(large, _least(large), links).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return small.select("e.u", "e.v").where("u <> v").distinct()


def components(links: DataFrame, first: str, second: str) -> DataFrame:
    """(node, component) of all linked nodes, the component being its smallest node.

    Nodes that are linked with nothing but themselves don't appear.  Each step
    is two joins and two grouped minima, which combine before the shuffle; the
    links of a hub are joined where they are, so it is no single task's work.
    The steps stop when the links no longer change.
    """
    a, b = F.col(first), F.col(second)
    hashed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    edges, new = counted(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links", hashed=hashed)
    mark = None
    while new["rows"] and new != mark:
        mark = new
        edges, new = counted(_star_step(edges, new["rows"]), "links", hashed=hashed)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
