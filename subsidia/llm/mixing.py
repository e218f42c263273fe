"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed hash.  A source takes whole copies of all its
documents as often as its target holds its size, and for the rest the
documents whose hash lies below a threshold.  The threshold is found without
sorting: sizes are summed by source and hash bucket, the bucket in which the
running sum passes the budget is the boundary, and only documents in that
bucket are summed again by the next bits of the hash.  After the last level
the boundary holds one hash value; it is taken if that brings the source
nearer to its budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subsidia.llm.ranks import ranked
from subsidia.session import materialize

#: Bits of the hash, those of them that the id gives, and bits by level.
HASH_BITS, ID_BITS, LEVEL_BITS = 60, 36, (12, 12, 12, 12, 12)
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of other characters than blank, tab, LF, VT, FF and CR; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def _hash(ident: Column, text: Column) -> Column:
    """60 bits, the same in every run and engine: 36 of the id, and 24 of the text, which divide the rows of one id or of none."""
    digits = lambda value, n: F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, n)
    return F.conv(F.concat(digits(ident, ID_BITS // 4), digits(text, (HASH_BITS - ID_BITS) // 4)), 16, 10).cast("bigint")


def source_targets(totals: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Targets by source from (source, source_size).

    Sources in code point order, null last, get the weights in turn.  A source
    is held at ``cap`` times its size when its share would exceed that; the
    excess goes to the others by weight.  In order of size over weight the held
    sources come first, so one running sum settles all rounds.  These windows
    are one task's work over one row per source: some millions of sources are
    fine, each document being a source of its own is not.
    """
    common = math.lcm(*weights)
    everything = Window.partitionBy()
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1))
    by_ratio = Window.orderBy(F.col("source_size") * (F.lit(common) / F.col("weight")).cast("bigint"), "rank")
    wide = "decimal(38,0)"
    ranked = ranked.withColumns({
        "total": F.sum("source_size").over(everything),
        "held_before": F.coalesce(F.sum(F.col("source_size") * cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weight_left": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    })
    ranked = ranked.withColumn("held", (F.col("source_size") * cap).cast("decimal(19,0)") * F.col("weight_left").cast("decimal(19,0)") <= F.col("weight").cast("decimal(19,0)") * (F.col("total") - F.col("held_before")).cast("decimal(19,0)"))
    ranked = ranked.withColumns({
        "rest": F.col("total") - F.coalesce(F.sum(F.when(F.col("held"), F.col("source_size") * cap)).over(everything), F.lit(0)),
        "rest_weight": F.sum(F.when(~F.col("held"), F.col("weight"))).over(everything),
    })
    target = F.when(F.col("held"), (F.col("source_size") * cap).cast("double")).otherwise((F.col("weight") * F.col("rest")).cast("double") / F.col("rest_weight").cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def _copies(targets: DataFrame) -> DataFrame:
    """Whole copies of each source, and the words that are left to take by threshold."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    return targets.withColumn("copies", copies).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _hash(F.col(id_col), F.col(text_col)).alias("hash")), "mix-sizes")


def _plan(base: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """One row for each source: source, source_size, target, copies, ``limit``, below which a hash gives one copy more, and ``edge`` and ``edge_take``.

    Where the last hash stands on several rows, equal ones, and some of them
    bring the source nearest to its target, ``edge`` is that hash, and so many
    of its rows get one copy more.
    """
    shift = HASH_BITS - LEVEL_BITS[0]
    first = materialize(base.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n")), "mix-histogram")
    totals = first.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = materialize(_copies(source_targets(totals, weights, cap)), "mix-targets")

    edge = _boundary(first, plan.select("source", "budget", F.lit(0).cast("bigint").alias("before")))
    for bits in LEVEL_BITS[1:]:
        edge, last = materialize(edge, "mix-boundary"), shift
        shift -= bits
        inside = base.alias("d").join(edge.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.shiftright("d.hash", last) == F.col("e.bucket")))
        level = inside.groupBy(F.col("d.source").alias("source"), F.shiftright("d.hash", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        edge = _boundary(level, edge.select("source", "budget", "before"))
    each = (F.col("after") - F.col("before")).cast("double") / F.col("n")
    take = F.greatest(F.lit(0), F.least(F.col("n"), F.ceil((F.col("budget") - F.col("before")) / each - 0.5)))
    some = (F.col("take") > 0) & (F.col("take") < F.col("n"))
    limit = edge.withColumn("take", take).select("source", (F.col("bucket") + (F.col("take") == F.col("n")).cast("bigint")).alias("limit"), F.when(some, F.col("bucket")).alias("edge"), F.when(some, F.col("take")).alias("edge_take"))
    plan = plan.alias("p").join(limit.alias("l"), F.col("p.source").eqNullSafe(F.col("l.source")), "left")
    return materialize(plan.select("p.source", "source_size", "target", "copies", F.coalesce("limit", F.lit(1 << HASH_BITS)).alias("limit"), "edge", "edge_take"), "mix-plan")


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (source, hash and others) with ``plan`` as columns and ``copies`` as how often they are taken.

    Equal rows at the edge of a source are told apart by their rank among one
    another; they are few sources' rows, and ranked over the whole cluster.
    """
    met = rows.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).drop(F.col("p.source"))
    at_edge = F.coalesce(F.col("hash") == F.col("edge"), F.lit(False))
    out = met.where(~at_edge).withColumn("copies", F.col("copies") + (F.col("hash") < F.col("limit")).cast("bigint"))
    if not plan.where("edge IS NOT NULL").isEmpty():
        key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
        edge = ranked(met.where(at_edge).withColumns({"mix_group": key, "mix_tie": F.monotonically_increasing_id()}), "mix_group", [F.col("mix_tie")], "mix-edge")
        edge = edge.withColumn("copies", F.col("copies") + (F.col("rank") < F.col("edge_take")).cast("bigint"))
        out = out.unionByName(edge.select(*out.columns))
    return out


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words the mix takes of each document.

    Returns one row per input row: id, source, size, source_size, target, copies and
    taken.  ``copies`` is how often the document is in the mix and ``taken`` is
    that times its size.  A null source is a source of its own; null and empty
    texts have size 0, very long ones are counted whole.  Documents are chosen by
    a hash of id and text, so rows that share an id, or have none, go their own
    ways; of rows equal in both any are taken, as many as bring the source
    nearest to its target.  An empty table gives an empty result; other columns
    are ignored.
    """
    base = _sizes(docs, id_col, text_col, source_col)
    out = _with_copies(base, _plan(base, weights, cap))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def draw_mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as ``mix_sources`` takes them, all columns kept; rows without a word go.

    Only the plan, one row for each source, is joined to the documents, so
    their texts stay where they are while the plan is small enough to be
    broadcast by Spark's own threshold.  Columns may have any names.
    """
    plan = _plan(_sizes(docs, id_col, text_col, source_col), weights, cap).select("source", "copies", "limit", "edge", "edge_take")
    records = docs.where(F.col(text_col).rlike(_WORD)).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col(source_col).alias("source"), _hash(F.col(id_col), F.col(text_col)).alias("hash"))
    copies = F.col("copies").cast("int")
    return _with_copies(records, plan).where(copies > 0).select("record", F.explode(F.sequence(F.lit(1), copies))).select("record.*")


def _boundary(histogram: DataFrame, budgets: DataFrame) -> DataFrame:
    """By source, the first bucket whose running sum exceeds the budget, with the sums before and after it."""
    by_bucket = Window.partitionBy("source").orderBy("bucket")
    joined = histogram.alias("h").join(budgets.alias("b"), F.col("h.source").eqNullSafe(F.col("b.source"))).select("h.source", "bucket", "words", "n", "budget", "before")
    run = joined.withColumn("after", F.col("before") + F.sum("words").over(by_bucket))
    past = run.where(F.col("after") > F.col("budget")).withColumn("before", F.col("after") - F.col("words"))
    return past.groupBy("source").agg(F.min(F.struct("bucket", "budget", "before", "after", "n")).alias("m")).select("source", "m.*")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9) || substr(md5(coalesce(text, '')), 1, 6))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, sum(source_size) OVER () AS total FROM s),
o AS (
  SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY source_size * (6 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held_before,
         sum(w) OVER (ORDER BY source_size * (6 // w), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM r),
k AS (SELECT *, 3 * source_size * weight_left <= w * (total - held_before) AS held FROM o),
t AS (
  SELECT source, source_size, CASE WHEN held THEN (3 * source_size)::DOUBLE
         ELSE (w * (total - coalesce(sum(3 * source_size) FILTER (WHERE held) OVER (), 0)))::DOUBLE / (sum(w) FILTER (WHERE NOT held) OVER ())::DOUBLE END AS target FROM k),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS words, count(*) AS n FROM d GROUP BY source, h),
c AS (SELECT *, (sum(words) OVER (PARTITION BY source ORDER BY h))::BIGINT AS after FROM g),
x AS (
  SELECT c.source, c.h, p.source_size, p.target, p.copies,
         CASE WHEN after <= target - copies * source_size THEN n ELSE greatest(0, least(n, ceil((target - copies * source_size - (after - words)) / (words::DOUBLE / n) - 0.5))) END AS more
  FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source),
e AS (SELECT *, row_number() OVER (PARTITION BY source, h ORDER BY doc_id) AS k FROM d)
SELECT e.doc_id, e.size, x.source_size, x.target, (e.size * (x.copies + (e.k <= x.more)::INT))::BIGINT AS taken
FROM e JOIN x ON e.source IS NOT DISTINCT FROM x.source AND e.h = x.h
"""
