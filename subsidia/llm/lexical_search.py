"""Ranked lexical search: exact top k for each item, by block-max pruning with blocks of variable size.

A first pass over the texts counts terms and keeps, of every document, its
length and the terms that items ask for.  A second pass takes these rows in
shards, runs of rows within one task, and makes posting lists of each shard.

Block boundaries of a list are chosen by dynamic programming: a block costs
the sum of what its maximum exceeds its postings by, plus a fixed cost, and
the division with the least total is taken.  An item's blocks divide the
shard's documents into spans; the sum of the maxima over a span bounds all
scores in it.  Spans are searched from the highest bound down; spans, and in
them documents whose lists' maxima add up to less than the k-th score so far,
are skipped, all others are scored exactly.  The k-th score is kept from shard
to shard within a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subsidia.llm.columns import ascii_lower
from subsidia.llm.words import byte_lower, released, text_slices
from subsidia.session import materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Items searched in one go at most, and bytes of their texts; more take further passes.
ITEMS, ITEM_BYTES = 2_000, 32 << 20
#: Postings of one shard, about; postings of one block at most; and what a block costs, in mean postings of its list.
SHARD, WIDEST, BLOCK_COST = 1 << 20, 64, 4
#: Lists divided into blocks together.
LISTS = 20_000
#: Spans searched at a time, the highest bounds first.
SPANS = 64
#: Documents in one Arrow batch.
BATCH_ROWS = 1000

_IN_TERM = np.zeros(256, bool)
_IN_TERM[48:58] = _IN_TERM[97:123] = _IN_TERM[128:] = True


def terms(text: Column) -> Column:
    """All terms of a text, A-Z lower-cased, with repeats."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def weight(n_docs: int, df: Column) -> Column:
    return F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * df + 1))).cast("long")


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of a column of texts one after the other, and how many each text has; the bytes of terms are only moved together."""
    data, ends = byte_lower(texts)
    size = len(data) - 8
    kept = _IN_TERM[data[:size]]
    starts = kept.copy()
    starts[1:] &= ~kept[:-1] if size else kept[:0]
    edges = ends[:-1][ends[:-1] < size]
    starts[edges] = kept[edges]
    at = np.flatnonzero(starts)
    before = np.concatenate([[0], np.cumsum(kept)])
    offsets = np.append(before[at], before[-1]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[:size][kept])])
    return found, np.diff(np.searchsorted(at, ends))


def _occurrences(rows: DataFrame, vocabulary: list[bytes], id_type: str) -> DataFrame:
    """doc_id, n (terms in all), and for terms of the vocabulary their numbers and counts."""
    held = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(held.value, pa.binary())
        for batch in batches:
            for at, to in text_slices(batch["text"]):
                found, n = split_terms(batch["text"].slice(at, to - at))
                number = pc.index_in(found, wanted).fill_null(-1).to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(len(n)), n)
                mine = number >= 0
                key, tf = np.unique(doc[mine] * max(1, len(wanted)) + number[mine], return_counts=True)
                doc, number = np.divmod(key, max(1, len(wanted)))
                offsets = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (number, tf)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, to - at), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return rows.mapInArrow(released(made), f"doc_id {id_type}, n long, terms array<int>, tfs array<int>")


def block_ends(scores: np.ndarray, bounds: np.ndarray, widest: int = WIDEST, cost: float = BLOCK_COST) -> np.ndarray:
    """Marks the last posting of every block of the lists ``scores[bounds[i]:bounds[i + 1]]``.

    Of all divisions into blocks of at most ``widest`` postings, each list gets
    the one with the least sum of (block length times its maximum, less the
    scores) and ``cost`` mean scores for each block.  Lists advance together,
    one posting at a time, longest first.
    """
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    end = np.zeros(len(scores), bool)
    for some in range(0, len(order), LISTS):
        own = order[some : some + LISTS]
        _divide(scores, bounds[:-1][own], length[own], widest, cost, end)
    return end


def _divide(scores: np.ndarray, first: np.ndarray, length: np.ndarray, widest: int, cost: float, end: np.ndarray) -> None:
    """Marks the block ends of lists that begin at ``first``, longest first."""
    live, chosen, width = len(first), [], np.arange(1, widest + 1)
    fixed = np.array([cost * scores[a : a + n].mean() for a, n in zip(first.tolist(), length.tolist())])
    # Least costs of the last ``widest`` prefixes of each list, newest first, and the maxima of the blocks that begin there.
    least, peak = np.full((live, widest), np.inf), np.zeros((live, widest))
    least[:, 0] = 0
    for j in range(int(length[0])):
        while length[live - 1] <= j:
            live -= 1
        peak[:live, 1:] = peak[:live, :-1].copy()
        peak[:live, 0] = 0
        np.maximum(peak[:live], scores[first[:live] + j][:, None], out=peak[:live])
        total = least[:live] + width * peak[:live]
        best = total.argmin(1)
        chosen.append(best.astype(np.int16))
        least[:live, 1:] = least[:live, :-1].copy()
        least[:live, 0] = total[np.arange(live), best] + fixed[:live]
    for i, (a, n) in enumerate(zip(first.tolist(), length.tolist())):
        at = n - 1
        while at >= 0:
            end[a + at] = True
            at -= int(chosen[at][i]) + 1


class _Shard:
    """Posting lists of some documents: by term the places, exact scores and blocks."""

    def __init__(self, ids: np.ndarray, no_id: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        # Documents in the order in which ties go.
        order = np.lexsort((ids, no_id))
        self.ids, self.no_id, place = ids[order], no_id[order], np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        m = 10 + (90 * lengths.astype(np.int64) * n_docs) // max(1, n_terms)
        doc = np.repeat(np.arange(len(ids)), sizes)
        tfs = tfs.astype(np.int64)
        score = weights[numbers] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc]))
        sort = np.lexsort((place[doc], numbers))
        self.doc, self.score, numbers = place[doc][sort], score[sort], numbers[sort]
        first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])) if len(numbers) else np.zeros(0, np.int64)
        self.term, bounds = numbers[first], np.append(first, len(numbers))
        end = block_ends(self.score, bounds)
        self.block_end = np.flatnonzero(end) + 1
        self.block_start = np.concatenate([[0], self.block_end[:-1]])[: len(self.block_end)]
        self.block_max = np.maximum.reduceat(self.score, self.block_start) if len(self.block_start) else self.score
        self.of_term = np.searchsorted(self.block_start, bounds)

    def best(self, asked: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the k best documents for the terms, none with less than ``floor``, and the new floor."""
        none = np.zeros(0, np.int64)
        lists = np.searchsorted(self.term, asked)
        lists = lists[(lists < len(self.term)) & (self.term[np.minimum(lists, len(self.term) - 1)] == asked)] if len(self.term) else none
        if not len(lists):
            return none, none, floor
        counts = self.of_term[lists + 1] - self.of_term[lists]
        blocks = np.repeat(self.of_term[lists] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        low, high, most = self.doc[self.block_start[blocks]], self.doc[self.block_end[blocks] - 1] + 1, self.block_max[blocks]
        edges, spot = np.unique(np.concatenate([low, high]), return_inverse=True)
        change = np.zeros(len(edges), np.int64)
        np.add.at(change, spot[: len(low)], most)
        np.add.at(change, spot[len(low) :], -most)
        bound = np.cumsum(change)[:-1]
        span_of_low, span_of_high = spot[: len(low)], spot[len(low) :]
        docs, scores = none, none
        order = np.argsort(-bound, kind="stable")
        tried = 0
        while tried < len(order):
            some = order[tried : tried + SPANS]
            some = some[bound[some] >= max(floor, 1)]
            if not len(some):
                break
            tried += SPANS
            chosen = np.zeros(len(edges), np.int64)
            chosen[some] = 1
            hit = np.concatenate([[0], np.cumsum(chosen)])
            mine = np.flatnonzero(hit[span_of_high] > hit[span_of_low])
            size = self.block_end[blocks[mine]] - self.block_start[blocks[mine]]
            at = np.repeat(self.block_start[blocks[mine]] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            doc, limit = self.doc[at], np.repeat(most[mine], size)
            inside = chosen[np.searchsorted(edges, doc, "right") - 1] == 1
            at, doc, limit = at[inside], doc[inside], limit[inside]
            seen, which = np.unique(doc, return_inverse=True)
            good = np.bincount(which, limit, len(seen)) >= max(floor, 1)  # sums of maxima stay below 2^53
            left = good[which]
            total = np.zeros(len(seen), np.int64)
            np.add.at(total, which[left], self.score[at[left]])
            docs, scores = np.concatenate([docs, seen[good]]), np.concatenate([scores, total[good]])
            top = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[top], scores[top]
            if len(scores) == k:
                floor = max(floor, int(scores[-1]))
        keep = scores > 0
        return docs[keep], scores[keep], floor


def _searched(rows: DataFrame, asked: dict[int, np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int, id_type: str, shard: int) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast((asked, weights))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = held.value
        floors = dict.fromkeys(asked, 0)
        parts: list[tuple] = []

        def found() -> pa.RecordBatch:
            lists = _Shard(*(np.concatenate(x) for x in zip(*parts)), weights, n_docs, n_terms)
            out = []
            for query, own in asked.items():
                docs, scores, floors[query] = lists.best(own, k, floors[query])
                out.append((np.full(len(docs), query, np.int64), lists.ids[docs], lists.no_id[docs], scores))
            query, ids, no_id, scores = (np.concatenate(x) for x in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids, mask=no_id).cast(kind), pa.array(scores)], ["query", "doc_id", "score"])

        kind, size = None, 0
        for batch in batches:
            ids, tfs, numbers = batch["doc_id"], batch["tfs"], batch["terms"]
            kind = ids.type
            sizes = pc.list_value_length(numbers).to_numpy().astype(np.int64)
            parts.append((ids.fill_null(0).cast(pa.int64()).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch["n"].to_numpy(), sizes, numbers.flatten().to_numpy(), tfs.flatten().to_numpy()))
            size += int(sizes.sum())
            if size >= shard:
                yield found()
                parts, size = [], 0
        if parts:
            yield found()

    return rows.mapInArrow(released(made), f"query long, doc_id {id_type}, score long")


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard: int = SHARD, most_items: int = ITEMS) -> DataFrame:
    """The k best documents for each item.

    Returns item id, rank (from 1), document id and score.  Equal scores go by
    ascending id, null ids last.  Every row of ``items`` is searched on its
    own, with its id as it is, so repeated item ids get k rows each; items
    without terms get none.  Repeated documents are found each.  Null and empty
    texts have no terms and are never found; very long texts count whole.  Ids
    are whole numbers.  An empty table on either side gives an empty result,
    and other columns are ignored.
    """
    spark, id_type, item_type = docs.sparkSession, dict(docs.dtypes)[id_col], dict(items.dtypes)[item_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    words = items.select(F.col(item_col).alias("item"), F.array_distinct(terms(F.col(item_text_col))).alias("words"), F.octet_length(F.coalesce(item_text_col, F.lit(""))).cast("long").alias("bytes"))
    words = materialize(words.withColumn("query", F.monotonically_increasing_id()), "lexical-items")
    count, size = words.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    passes = max(1, -(-count // most_items), -(-size // ITEM_BYTES))
    found = None
    for number in range(passes):
        some = words.where((F.pmod(F.xxhash64("query"), F.lit(passes)) == number) & (F.size("words") > 0)).select("query", "words").toArrow()
        asked = dict(zip(some["query"].to_pylist(), some["words"].to_pylist()))
        vocabulary = sorted({w.encode() for own in asked.values() for w in own})
        held = materialize(_occurrences(rows, vocabulary, id_type), "lexical-postings", arrow_rows=BATCH_ROWS)
        n_docs, n_terms = held.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).select("term", weight(n_docs, F.col("df")).alias("w")).toArrow()
        weights = np.zeros(len(vocabulary), np.int64)
        weights[frequency["term"].to_numpy()] = frequency["w"].to_numpy()
        place = {w: i for i, w in enumerate(vocabulary)}
        numbers = {q: np.array(sorted(place[w.encode()] for w in own), np.int64) for q, own in asked.items()}
        best = _searched(held.where("size(terms) > 0"), numbers, weights, n_docs, n_terms, k, id_type, shard)
        found = best if found is None else found.unionByName(best)
    # Each task has sent k rows for an item and shard at most; by part first, so no item is one task's work.
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    part = Window.partitionBy("query", "part").orderBy(*order)
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(words.select("query", "item"), "query").select(F.col("item").cast(item_type).alias(item_col), "rank", F.col("doc_id").alias(id_col if id_col != item_col else "doc_id"), "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"list_filter(regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')"
OP11_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS ts FROM documents),
total AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM doc),
asked AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS.format("text")}) AS ts FROM benchmark),
wanted AS (SELECT q, item_id, unnest(ts) AS term FROM asked),
posting AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM doc) WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weighed AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posting, total GROUP BY term),
scored AS (
  SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM wanted JOIN posting USING (term) JOIN weighed USING (term), total GROUP BY q, r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
