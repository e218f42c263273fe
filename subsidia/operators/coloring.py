"""Greedy colouring of adjacent buildings, as a sequence of rounds.

Greedy order is by (number of neighbours, key), both descending.  A building's
colour depends only on neighbours that come before it, so in each round all
buildings whose earlier neighbours are coloured take theirs at once; the result
is that of going through them one by one.  Each round's rows are written once.  No
side of a join goes through the driver, since all grow with the buildings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsidia.functions.classify import palette_index
from subsidia.session import materialize

PALETTE = 60


def color_buildings(keys: DataFrame, edges: DataFrame, palette: int = PALETTE) -> DataFrame:
    """(key, color) for all keys; edges are pairs (a, b) of keys.

    Each key starts at its hash's colour and takes the next one that no
    earlier neighbour has; if all are taken, the first.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degrees = both.groupBy("a").agg(F.count("*").alias("degree")).withColumnRenamed("a", "key")
    nodes = keys.select("key").distinct().join(degrees.hint("merge"), "key", "left").withColumn("rank", F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "key")).select("key", "rank")
    nodes = materialize(nodes, "nodes")
    links = both.join(nodes.withColumnsRenamed({"key": "a", "rank": "ra"}).hint("merge"), "a").join(nodes.withColumnsRenamed({"key": "b", "rank": "rb"}).hint("merge"), "b")
    earlier = materialize(links.where("rb > ra").select(F.col("a").alias("key"), F.col("b").alias("before")), "earlier")
    start = palette_index(F.col("key"), palette)
    waiting = nodes.join(earlier.select("key").distinct().hint("merge"), "key", "left_semi").select("key")
    done = materialize(nodes.join(earlier.select("key").distinct().hint("merge"), "key", "left_anti").select("key", start.alias("color")), "colored")
    waiting = materialize(waiting, "waiting")
    while not waiting.isEmpty():
        seen = waiting.join(earlier.hint("merge"), "key").join(done.withColumnRenamed("key", "before").hint("merge"), "before", "left")
        ready = seen.groupBy("key").agg(F.collect_set("color").alias("used"), F.max(F.col("color").isNull()).alias("open")).where("NOT open")
        turns = F.transform(F.sequence(F.lit(0), F.lit(palette - 1)), lambda i: (start + i) % palette)
        colored = materialize(ready.select("key", F.coalesce(F.get(F.filter(turns, lambda c: ~F.array_contains("used", c)), F.lit(0)), start).alias("color")), "colored")
        done = done.unionByName(colored)
        waiting = materialize(waiting.join(colored.hint("merge"), "key", "left_anti"), "waiting")
    return done
