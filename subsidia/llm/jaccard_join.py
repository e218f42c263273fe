"""Self-join of documents on the Jaccard similarity of their word shingles, by T-occurrence search.

Two sets of sizes a and b are similar enough only if they share T = ceil(4 (a
+ b) / 9) shingles (at a similarity of 0.8).  Every shingle has an inverted
list of the sets that hold it.  As DivideSkip does, the longest lists of a set
are left aside, L of them, and only the short ones are merged: a partner must
occur on T - L of those at least.  What is missing to T is then looked up in
the long lists by binary search, list by list, until a partner has T or can't
have it any more.

The merge of the short lists is a sort by shingle and a count by pair, spread
over the cluster; it takes the place of the heap.  Which lists are long is
estimated on a sample of the sets and puts shingles in order; any order gives
the same result.  Long lists are stored for blocks of nodes: a block holds, as
sorted arrays, the lists of all its nodes, and meets the sets that ask for
these nodes.

Sets that are equal are one node from the start.  Links within a group of
copies are not all expanded: first each node is compared with the first node
of its lists (a star), and in large lists with some more of their nodes, the
links found are closed to components, and then all pairs that pass the
occurrence bound are compared unless both nodes already are in one component.
No link between different components is lost, so the components are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subsidia.llm.exact_dedup import from_files, located, without_rows
from subsidia.llm.graph import components
from subsidia.llm.words import BATCH_ROWS, released, set_hashes, shingle_sets, text_slices
from subsidia.session import counted, materialize

WORDS = 5
#: One set in this many is in the sample that tells long lists; lists with this many sampled sets are long.
SAMPLED, LONG = 16, 4
#: The long lists that are told apart, longest first; and the most documents whose places are broadcast.
MAX_LONG, MAX_BROADCAST = 1_000_000, 500_000
#: Sets of a long list that one task orders at a time.
PER_SALT = 50_000
#: Lists of this many sets are contracted further before all pairs are compared, in rounds with so many leaders each.
LARGE, CENTRAL_LEADERS, LEADERS = 64, (4, 4), (16,)
#: Bytes of sets in a block of stored lists, about, and lists probed before partners are looked through.
BLOCK_BYTES, PROBED = 2 << 20, 64
#: Sets whose nodes a task remembers as done.
REMEMBERED = 1_000_000
#: Entries of one list and size class that are paired in one go; longer ones are split on both sides.
PER_SPLIT = 2_000
#: Ratio of neighbouring size classes of the last pass.
CLASS = 1.05


def short_lists(n: np.ndarray | int) -> np.ndarray | int:
    """How many lists of a set of n are merged; the others are fewer than it shares with any partner."""
    return n - (4 * n + 4) // 5 + 1


def _rest(n: str) -> Column:
    """How many lists of a set of n are left aside."""
    return F.floor((F.col(n) * 4 + 4) / 5).cast("int") - 1


def _needed(a: str, b: str) -> Column:
    """T - L: on how many short lists two sets of these sizes must meet."""
    return F.floor(((F.col(a) + F.col(b)) * 4 + 8) / F.lit(9)) - F.greatest(_rest(a), _rest(b))


def _close(a: str, b: str) -> Column:
    return F.least(a, b) * 5 >= F.greatest(a, b) * 4


def _sets(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """doc_id, file, row, node, check, n, and the set itself for one node in ``SAMPLED``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in text_slices(batch["text"]):
                found, starts = shingle_sets(batch["text"].slice(at, to - at), WORDS)
                node, check = set_hashes(found, starts)
                n = np.diff(starts)
                chosen = (n > 0) & (node % SAMPLED == 0)
                sizes = np.where(chosen, n, 0)
                sample = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(found[np.repeat(chosen, n)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(at, to - at) for c in kinds), pa.array(node), pa.array(check), pa.array(n), sample], [*kinds, "node", "check", "n", "sample"])

    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return rows.select(*kinds, "text").mapInArrow(released(made), f"{schema}, node long, check long, n long, sample array<long>")


def _nodes_of(found: np.ndarray, starts: np.ndarray, clashing: np.ndarray) -> np.ndarray:
    """The first hash of each set, the second one where unlike sets have the same first one."""
    node, check = set_hashes(found, starts)
    return np.where(np.isin(node, clashing), check, node) if len(clashing) else node


def _in_order(found: np.ndarray, starts: np.ndarray, long_lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each set in the order of lists, those with long lists last, and which are such."""
    at = np.minimum(np.searchsorted(long_lists, found), max(0, len(long_lists) - 1))
    is_long = long_lists[at] == found if len(long_lists) else np.zeros(len(found), bool)
    order = np.argsort(np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * 2 + is_long, kind="stable")
    return found[order], is_long[order]


def _short_lists(rows: DataFrame, long_lists, salts: int, clashing: np.ndarray) -> DataFrame:
    """Entries (shingle, salt, node, n) of the short lists of every set.

    Shingles stand in hash order, those with long lists last.  A task emits a
    set once, however many copies of it the task reads, as far as it remembers.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at, to in text_slices(batch["text"]):
                found, starts = shingle_sets(batch["text"].slice(at, to - at), WORDS)
                node, n = _nodes_of(found, starts, clashing), np.diff(starts)
                new = np.zeros(len(n), bool)
                new[np.unique(node, return_index=True)[1]] = True
                new &= (n > 0) & [x not in seen for x in node.tolist()]
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.update(node[new].tolist())
                found, is_long = _in_order(found, starts, long_lists.value)
                place = np.arange(len(found)) - np.repeat(starts[:-1], n)
                kept = np.repeat(new, n) & (place < np.repeat(short_lists(n), n))
                nodes, sizes = np.repeat(node, n)[kept], np.repeat(n, n)[kept].astype(np.int32)
                salt = np.where(is_long[kept], nodes % salts, -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(found[kept].view(np.int64)), pa.array(salt), pa.array(nodes), pa.array(sizes)], ["shingle", "salt", "node", "n"])

    return rows.select("text").mapInArrow(released(made), "shingle long, salt int, node long, n int")


class _Sets:
    """The sets of the nodes that were asked for so far, each written once: node, n, n_short and found.

    ``found`` are the shingles in the order of lists; the first ``n_short`` of
    them have no long list.  Each is made from one document of its node, which
    is found by its place.  Places are broadcast where they are few, counted
    first; else both sides are shuffled.
    """

    def __init__(self, rows: DataFrame, nodes: DataFrame, long_lists, clashing: np.ndarray):
        self.rows, self.nodes, self.long_lists, self.clashing = rows, nodes, long_lists, clashing
        self.known: DataFrame | None = None

    def of(self, asked: DataFrame) -> DataFrame:
        """All sets known, those of the nodes asked for among them."""
        new = asked if self.known is None else asked.join(self.known.select("node"), "node", "left_anti")
        wanted, seen = counted(self.nodes.join(new, "node").select("node", F.xxhash64("place.file").alias("file"), "place.row"), "wanted")
        count = seen["rows"]
        if count or self.known is None:
            made = self._made(F.broadcast(wanted) if count <= MAX_BROADCAST else wanted)
            self.known = made if self.known is None else self.known.union(made)
        return self.known

    def _made(self, wanted: DataFrame) -> DataFrame:
        long_lists, clashing = self.long_lists, self.clashing

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, to in text_slices(batch["text"]):
                    found, starts = shingle_sets(batch["text"].slice(at, to - at), WORDS)
                    node = batch["node"].slice(at, to - at)
                    meant = _nodes_of(found, starts, clashing) == node.to_numpy()
                    found, is_long = _in_order(found, starts, long_lists.value)
                    n = np.diff(starts)
                    owner = np.repeat(np.arange(len(n)), n)
                    short = n - np.bincount(owner[is_long], minlength=len(n))
                    data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((starts * 8).astype(np.int32)), pa.py_buffer(found)])
                    # Places are hashed, so another document may come along; its set is another.
                    yield pa.RecordBatch.from_arrays([node, pa.array(n, pa.int32()), pa.array(short, pa.int32()), data], ["node", "n", "n_short", "found"]).filter(pa.array(meant))

        read = self.rows.withColumn("file", F.xxhash64("file")).join(wanted, ["file", "row"]).select("node", "text")
        return materialize(read.mapInArrow(released(made), "node long, n int, n_short int, found binary"), "sets", arrow_rows=BATCH_ROWS)


def _occurring(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, c) that occur on T - L lists at least; from (a, an, b, bn), one row for each list, b being a leader in the rounds."""
    counted = pairs.where(_close("an", "bn")).groupBy("a", "b").agg(F.count("*").alias("c"), F.min(_needed("an", "bn")).alias("needed"))
    return counted.where("c >= needed").select("a", "b", F.col("c").cast("int").alias("c"))


class _Block:
    """The stored lists of a block of nodes: by shingle, the sorted places of the nodes that have it."""

    def __init__(self, nodes: list, sizes: list, shorts: list, sets: list):
        order = np.argsort(np.array(nodes, np.int64))
        self.nodes = np.array(nodes, np.int64)[order]
        self.n, n_short, sets = np.array(sizes, np.int64)[order], np.array(shorts, np.int64)[order], [sets[i] for i in order.tolist()]
        owner, every = np.repeat(np.arange(len(sets)), self.n), np.concatenate(sets)
        order = np.lexsort((owner, every))
        self.owner, every = owner[order].astype(np.int64), every[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        self.shingles, self.bounds = every[first], np.append(first, len(every))
        # Where each node's merged lists end in the order of lists: is it among the long ones, and its shingle.
        take = short_lists(self.n)
        self.last_is_long = take > n_short
        self.last = np.array([s[t - 1] for s, t in zip(sets, take.tolist())], np.uint64)
        self.keys = np.repeat(np.arange(len(self.shingles)), np.diff(self.bounds)) * len(self.nodes) + self.owner

    def partners(self, n: int, n_short: int, found: np.ndarray, nodes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Those of ``nodes`` with which the set shares T shingles.

        ``counts`` says on how many short lists both occur, or -1 where the
        short lists were not all merged; then all lists are probed.
        """
        at = np.searchsorted(self.nodes, nodes)
        needed = (4 * (n + self.n[at]) + 8) // 9
        # A pair's short lists end at the earlier of both ends; the lists up to there are counted already.
        place = np.where(self.last_is_long[at], n_short + np.searchsorted(found[n_short:], self.last[at], "right"), np.searchsorted(found[:n_short], self.last[at], "right"))
        begin = np.where(counts < 0, 0, np.minimum(place, short_lists(n)))
        have = np.maximum(counts, 0)
        which = np.minimum(np.searchsorted(self.shingles, found), len(self.shingles) - 1)
        held = self.shingles[which] == found
        size = np.where(held, self.bounds[which + 1] - self.bounds[which], 0)
        lists = np.flatnonzero(held)
        lists = lists[np.argsort(size[lists], kind="stable")]
        left = held[::-1].cumsum()[::-1]
        left = np.append(left, 0)[begin]
        good = have >= needed
        alive = np.flatnonzero(~good & (have + left >= needed))
        for k in range(0, len(lists), PROBED):
            if not len(alive):
                break
            some = lists[k : k + PROBED]
            keys = which[some][None, :] * len(self.nodes) + at[alive][:, None]
            spot = np.minimum(np.searchsorted(self.keys, keys.ravel()), len(self.keys) - 1).reshape(keys.shape)
            asked = some[None, :] >= begin[alive][:, None]
            have[alive] += ((self.keys[spot] == keys) & asked).sum(1)
            left[alive] -= asked.sum(1)
            good[alive] = have[alive] >= needed[alive]
            alive = alive[~good[alive] & (have[alive] + left[alive] >= needed[alive])]
        return nodes[good]


def _probed(pairs: DataFrame, count: int, sets: _Sets) -> DataFrame:
    """The ``count`` pairs (a, b) whose exact similarity is 0.8 or more; from (a, b, c), where a null c stands for lists not merged.

    The a side is stored, in blocks by hash of the node, each node once; the
    set of b goes to every block in which it has partners.
    """
    known = sets.of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    # Few pairs go to the sets, which then are shuffled once, to their blocks.
    few = F.broadcast if count <= MAX_BROADCAST else lambda side: side
    stored = known.join(few(pairs.select(F.col("a").alias("node")).distinct()), "node")
    size = stored.agg(F.sum(F.col("n").cast("long") * 8)).first()[0] or 0
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(max(1, size // BLOCK_BYTES)))
    none = F.lit(None).cast("array<struct<node:bigint,c:int>>")
    stored = stored.select(block("node").alias("block"), F.lit(0).alias("kind"), "node", "n", "n_short", "found", none.alias("partners"))
    asking = pairs.withColumn("block", block("a")).groupBy("block", F.col("b").alias("node")).agg(F.collect_list(F.struct(F.col("a").alias("node"), F.coalesce("c", F.lit(-1)).alias("c"))).alias("partners"))
    asking = known.join(few(asking), "node").select("block", F.lit(1).alias("kind"), "node", "n", "n_short", "found", "partners")

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, lists = None, ([], [], [], []), None
        for batch in batches:
            a, b = [], []
            where, kinds, nodes, sizes, shorts = (batch[c].to_numpy().tolist() for c in ("block", "kind", "node", "n", "n_short"))
            partners = batch["partners"]
            for i in range(len(where)):
                if where[i] != key:
                    key, parts, lists = where[i], ([], [], [], []), None
                found = np.frombuffer(batch["found"][i].as_buffer(), np.uint64)
                if kinds[i] == 0:
                    for held, value in zip(parts, (nodes[i], sizes[i], shorts[i], found.copy())):
                        held.append(value)
                    continue
                lists = lists or _Block(*parts)
                asked = partners[i].values
                good = lists.partners(sizes[i], shorts[i], found, asked.field("node").to_numpy(), asked.field("c").to_numpy().astype(np.int64))
                a.append(good)
                b.append(np.full(len(good), nodes[i], np.int64))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    columns = ["block", "kind", "node", "n", "n_short", "found", "partners"]
    dealt = stored.unionByName(asking).select(*columns).repartition("block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(released(probed), "a long, b long")


def _placed(lists: DataFrame, joined: DataFrame) -> DataFrame:
    return lists.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _closed(links: DataFrame, joined: DataFrame, name: str) -> DataFrame:
    return materialize(components(links.union(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))), "a", "b"), name)


def _contracted(lists: DataFrame, joined: DataFrame, sets: _Sets) -> DataFrame:
    """Components after further stars in the large lists that still hold several of them.

    Each round compares leaders of a list with its nodes of other components.
    First they are nodes with the largest share of their short lists among the
    large ones (in steps of a twentieth), for what a group has in common is
    densest there; then any nodes, by another hash each time.  Links may be
    found here or not; the pass over all pairs that follows finds the others.
    """
    long = lists.groupBy("shingle").count().where(F.col("count") >= LARGE).select("shingle")
    lists = lists.join(materialize(long, "large"), "shingle", "left_semi").select("shingle", "node", "n")
    share = F.count("*").over(Window.partitionBy("node")) / (F.col("n") - _rest("n"))
    lists = materialize(lists.withColumn("outer", F.floor((1 - share) * 20).cast("int")), "large-lists")
    tried = 0
    for central, number in [*((True, n) for n in CENTRAL_LEADERS), *((False, n) for n in LEADERS)]:
        placed = _placed(lists, joined)
        one = F.struct("node", "n", "component")
        seeds = [F.xxhash64("node", F.lit(tried + k)) for k in range(number)]
        leaders = F.array(*[F.min_by(one, F.struct("outer", seed) if central else seed) for seed in seeds])
        tried += number
        mixed = placed.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.array_distinct(leaders).alias("leaders")).where("low <> high")
        other = F.filter("leaders", lambda x: (x["component"] != F.col("component")) & (F.least(x["n"], F.col("n")) * 5 >= F.greatest(x["n"], F.col("n")) * 4))
        met = placed.join(mixed.select("shingle", "leaders"), "shingle").withColumn("leader", F.explode(other))
        met = met.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("leader.node").alias("b"), F.col("leader.n").alias("bn"))
        pairs, seen = counted(_occurring(met).withColumn("c", F.lit(None).cast("int")), "round-pairs")
        if not seen["rows"]:
            break
        links, seen = counted(_probed(pairs, seen["rows"], sets), "round-links", arrow_rows=BATCH_ROWS)
        if not seen["rows"]:
            if central:
                continue
            break
        joined = _closed(links, joined, "round-components")
    return joined


def _met(lists: DataFrame) -> DataFrame:
    """(a, an, b, bn) for each list on which two nodes of different components and of near sizes occur.

    From (shingle, node, n, component).  A node with e entries can reach T - L
    only with partners of some sizes, so it looks for smaller ones just in the
    size classes that its e allows.  Classes with many entries in a list are
    split on both sides, each part of one meeting each part of the other.
    """
    log = lambda c: F.floor(F.log(c) / math.log(CLASS)).cast("int")
    entries = F.count("*").over(Window.partitionBy("node"))
    sized = materialize(lists.withColumns({"e": entries.cast("int"), "class": log(F.col("n"))}), "sized-lists")
    # For b <= n: T - L = ceil(4 (n + b) / 9) - rest(n) <= e bounds b.
    most = F.least(F.col("n"), F.floor((F.col("e") + _rest("n")) * 9 / 4) - F.col("n"))
    least = F.floor((F.col("n") * 4 + 4) / 5)
    wide = sized.where(most >= least).withColumn("class", F.explode(F.sequence(log(least), log(most))))
    parts = sized.groupBy("shingle", "class").count().where(F.col("count") > PER_SPLIT).select("shingle", "class", F.ceil(F.col("count") / PER_SPLIT).cast("int").alias("parts_b"))
    wider = wide.groupBy("shingle", "class").count().where(F.col("count") > PER_SPLIT).select("shingle", "class", F.ceil(F.col("count") / PER_SPLIT).cast("int").alias("parts_a"))
    split = materialize(parts.join(wider, ["shingle", "class"], "full").select("shingle", "class", F.coalesce("parts_a", F.lit(1)).alias("parts_a"), F.coalesce("parts_b", F.lit(1)).alias("parts_b")), "split-lists")

    def side(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(split, ["shingle", "class"], "left").withColumns({own: F.pmod(F.xxhash64("node"), F.coalesce(own, F.lit(1))).cast("int"), other: F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)})
        return rows.withColumn(other, F.explode(other))

    large = side(wide, "parts_a", "parts_b").select("shingle", "class", "parts_a", "parts_b", F.col("node").alias("a"), F.col("n").alias("an"), F.col("e").alias("ae"), F.col("component").alias("ac"))
    small = side(sized, "parts_b", "parts_a").select("shingle", "class", "parts_a", "parts_b", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("e").alias("be"), F.col("component").alias("bc"))
    ordered = (F.col("an") > F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("a") < F.col("b")))
    return large.join(small, ["shingle", "class", "parts_a", "parts_b"]).where(ordered & (F.col("ac") != F.col("bc")) & _close("an", "bn") & (F.least("ae", "be") >= _needed("an", "bn"))).select("a", "an", "b", "bn")


def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, file, row, n, component_id and ``keep``, the (no id, doc_id, file, row) of the first row of the component."""
    id_type = dict(docs.dtypes)[id_col]
    spark, docs = docs.sparkSession, from_files(docs)
    rows = located(docs, [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")])
    known = materialize(_sets(rows, {"doc_id": id_type, "file": "string", "row": "long"}), "sets-by-document", arrow_rows=BATCH_ROWS)
    filled = known.where("n > 0")
    clashing = filled.groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("node").toPandas()["node"].to_numpy(np.int64)
    if len(clashing):
        known = known.withColumn("node", F.when(F.col("node").isin(clashing.tolist()), F.col("check")).otherwise(F.col("node")))
        filled = known.where("n > 0")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    nodes, seen = counted(filled.groupBy("node").agg(F.min(first).alias("keep"), F.min(F.struct("file", "row")).alias("place")), "nodes")

    sampled = filled.where("sample IS NOT NULL").groupBy("node").agg(F.first("sample").alias("sample"))
    frequent = sampled.select(F.explode("sample").alias("shingle")).groupBy("shingle").count().where(F.col("count") >= LONG)
    frequent = frequent.orderBy(F.desc("count"), "shingle").limit(MAX_LONG).select("shingle").toPandas()["shingle"].to_numpy(np.int64)
    long_lists = spark.sparkContext.broadcast(np.sort(frequent.view(np.uint64)))
    sets = _Sets(rows, nodes, long_lists, clashing)
    salts = max(1, math.ceil(seen["rows"] / PER_SALT))
    entries = _short_lists(rows, long_lists, salts, clashing).withColumn("size_class", F.floor(F.log("n") / math.log(1.25)).cast("int"))

    listed = Window.partitionBy("shingle", "salt").orderBy("size_class", "node")
    whole = listed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lists = entries.repartition("shingle", "salt").withColumns({"before": F.lag("node").over(listed), "head": F.first("node").over(whole), "tail": F.last("node").over(whole)})
    lists = lists.where("(before IS NULL OR before <> node) AND (head <> tail OR salt >= 0)").drop("before", "head", "tail")
    by_class = Window.partitionBy("shingle", "salt", "size_class").orderBy("node")
    lists = materialize(lists.withColumn("lead", F.first(F.struct("node", "n")).over(by_class)), "lists", arrow_rows=BATCH_ROWS)

    star = lists.where("node <> lead.node").select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("lead.node").alias("b"), F.col("lead.n").alias("bn"))
    next_class = Window.partitionBy("shingle").orderBy("size_class", "salt", "node")
    leads = lists.where("node = lead.node").withColumn("last", F.lag(F.struct("node", "n")).over(next_class)).where("last IS NOT NULL")
    chain = leads.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("last.node").alias("b"), F.col("last.n").alias("bn"))
    first_pairs, seen = counted(_occurring(star.union(chain)).withColumn("c", F.lit(None).cast("int")), "star-pairs")
    links = materialize(_probed(first_pairs, seen["rows"], sets), "star-links", arrow_rows=BATCH_ROWS)
    joined = materialize(components(links, "a", "b"), "star-components")

    lists = lists.drop("lead", "size_class", "salt")
    joined = _contracted(lists, joined, sets)
    placed = _placed(lists, joined)
    mixed = placed.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle")
    # Any two nodes of different components meet in mixed lists only, so this pass counts all their common short lists.
    more, seen = counted(_occurring(_met(placed.join(mixed, "shingle", "left_semi"))), "more-pairs")
    if seen["rows"]:
        joined = _closed(materialize(_probed(more, seen["rows"], sets), "more-links", arrow_rows=BATCH_ROWS), joined, "components")

    placed = nodes.join(joined, "node", "left").select("node", "keep", F.coalesce("component", "node").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("keep").alias("keep"))
    placed = placed.drop("keep").join(smallest, "component").select("node", "keep")
    out = known.drop("sample", "check").join(placed, "node", "left")
    return out.select("doc_id", "file", "row", "n", F.when(F.col("n") > 0, F.col("keep.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("keep")).alias("keep"))


def join_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of the links between documents with a shingle similarity of 0.8 or more.

    Returns one row per input row: doc_id, n_shingles and component_id, the
    smallest id that links reach.  Texts of fewer than five words have one
    shingle, the whole sequence.  Null texts and texts without words have an
    empty set and are linked with nothing, their component is their own id.
    Repeated rows have equal sets and one component.  Rows with a null id are
    linked like others; a component without any id has a null one.  Very long
    texts are read whole, an empty table gives an empty result, and other
    columns are ignored.
    """
    found = _groups(docs, id_col, text_col)
    return found.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of ``join_similar``, all columns kept.

    That row has the smallest id, null ids last; of rows with that id it is the
    first by place.  Rows without words all stay.  Rows are told apart by
    their place, not by their id, so repeated and null ids do no harm.
    """
    found = from_files(docs)
    groups = _groups(found, id_col, text_col).where(F.col("keep").isNotNull() & (F.struct("file", "row") != F.struct("keep.file", "keep.row")))
    return without_rows(found, materialize(groups.select("file", "row"), "near-copies")).toDF(*docs.columns)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))
