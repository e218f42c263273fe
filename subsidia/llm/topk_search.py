"""Exact top-k search by inner product: columnar branch-and-bound over blocks.

Vectors become rows of integers, floor(scale * x), packed into blocks with one
row per dimension.  A block of queries meets a block of candidates one group of
dimensions after the other: partial products are summed, and a candidate stays
only while its sum plus the most that the remaining dimensions can add, the
product of the remaining norms, reaches the query's k-th best score so far.
The survivors are moved together before the next group.  Each query starts
with the k-th best score within one seed block, a lower bound for the result.

All rows are candidates and a stated set are queries, so the work is queries
times rows; it is spread over the cells of a grid, each of which joins some
query blocks with some candidate blocks.  The grid's sides are chosen so that
both kinds of blocks are copied about as much.

Sums are exact in double precision while they stay below 2^53.  Vectors that
are too long for that are compared by whole numbers of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subsidia.session import materialize

K, SCALE = 20, 64
#: Vectors in a candidate block, queries searched together, dimensions added at once.
BLOCK, QUERIES, STEP = 2048, 16, 16
#: Query vectors packed into one block at most.
QUERY_BLOCK = 1024
_EXACT = float(2**53)
#: Pairs of blocks in a cell of the grid, at most about.
PER_CELL = 1 << 16
_LEAST, _MOST = -(2**63), 2**63 - 1
_PACKED = "dim int, block long, ids binary, keys binary, data binary"


def _pack(batches: Iterator[pd.DataFrame], most: int, scale: float) -> Iterator[pd.DataFrame]:
    """Blocks of up to ``most`` vectors, by dimension; ids and data as bytes, data with one row per dimension.

    Rows with a ``key`` are told apart by it, others by their id.
    """
    held: dict[int, tuple[list, list, list]] = {}

    def block(dim: int) -> pd.DataFrame:
        ids, keys, rows = held.pop(dim)
        ids, keys = np.array(ids, np.int64), np.array(keys, np.int64)
        data = np.nan_to_num(np.floor(scale * np.stack(rows).astype(np.float64))) if dim else np.empty((len(ids), 0))
        number = int(np.bitwise_xor.reduce((keys.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
        return pd.DataFrame({"dim": [dim], "block": [number], "ids": [ids.tobytes()], "keys": [keys.tobytes()], "data": [np.ascontiguousarray(data.T).tobytes()]})

    for batch in batches:
        for ident, key, vector in zip(batch["id"], batch["key" if "key" in batch else "id"], batch["vector"]):
            ids, keys, rows = held.setdefault(len(vector), ([], [], []))
            ids.append(ident)
            keys.append(key)
            rows.append(np.asarray(vector))
            if len(ids) == most:
                yield block(len(vector))
    for dim in list(held):
        yield block(dim)


def _unpack(dim: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, np.int64)
    return found, np.frombuffer(data, np.float64).reshape(dim, len(found))


class _Best:
    """The best candidates of a block of queries so far, and the scores that new ones must reach."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, k: int, floor: np.ndarray | None = None, keys: np.ndarray | None = None):
        self.ids, self.data, self.k, self.keys = ids, data, k, ids if keys is None else keys
        self.floor = np.full(len(ids), _LEAST, np.int64) if floor is None else floor.copy()
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((data**2).sum(0)).max(initial=0)

    def search(self, ids: np.ndarray, data: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            exact = np.sqrt((data**2).sum(0)) * self.norm < _EXACT
        if not exact.all():
            self._search_long(ids[~exact], data[:, ~exact])
            ids, data = ids[exact], data[:, exact]
        dim = len(data)
        energy = (self.data**2).sum(1) * (data**2).sum(1) if np.isfinite(self.norm) else np.zeros(dim)
        order = np.argsort(-energy, kind="stable")
        queries, rows = self.data[order], data[order]
        cuts = list(range(0, dim, STEP))
        rest_q = [np.sqrt((queries[c + STEP :] ** 2).sum(0)) for c in cuts]
        rest_c = [np.sqrt((rows[c + STEP :] ** 2).sum(0)) for c in cuts]
        for at in range(0, len(self.ids) if len(ids) else 0, QUERIES):
            some = slice(at, at + QUERIES)
            need, live = self._need(some), np.arange(len(ids))
            partial = np.zeros((len(self.ids[some]), len(ids)))
            for i, c in enumerate(cuts):
                partial = partial + queries[c : c + STEP, some].T @ (rows[c : c + STEP] if len(live) == len(ids) else rows[c : c + STEP, live])
                most = partial + rest_q[i][some, None] * rest_c[i][live] * (1 + 1e-9) + 1e-6
                stay = np.flatnonzero((most >= need[:, None]).any(0))
                if len(stay) < len(live):
                    live, partial = live[stay], partial[:, stay]
                if not len(live):
                    break
            for j in range(len(partial)):
                self._add(at + j, partial[j].astype(np.int64), ids[live])

    def _need(self, some: slice | int) -> np.ndarray:
        """The floors in double precision, rounded down where they are not exact."""
        floor = self.floor[some].astype(np.float64)
        return floor - (np.abs(floor) >= _EXACT) * np.abs(floor) * 2.0**-50

    def _search_long(self, ids: np.ndarray, data: np.ndarray) -> None:
        """The same for vectors whose sums may pass 2^53: rounded sums with their error's bound, and whole numbers for those that may do."""
        whole = [[int(x) for x in column] for column in data.T]
        for q in range(len(self.ids)):
            own = self.data[:, q]
            with np.errstate(over="ignore", invalid="ignore"):
                rounded, error = own @ data, (np.abs(own) @ np.abs(data)) * len(own) * 2.0**-50
                near = np.flatnonzero(~(rounded + error < self._need(q)))
            mine = [int(x) for x in own]
            scores = [min(max(sum(x * y for x, y in zip(mine, whole[c])), _LEAST), _MOST) for c in near.tolist()]
            self._add(q, np.array(scores, np.int64), ids[near])

    def _add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores >= self.floor[q]) & (ids != self.ids[q])
        if not good.any():
            return
        scores, ids = np.concatenate([self.found[q][0], scores[good]]), np.concatenate([self.found[q][1], ids[good]])
        best = np.lexsort((ids, ~scores))[: self.k]
        self.found[q] = scores[best], ids[best]
        if len(best) == self.k:
            self.floor[q] = max(self.floor[q], scores[best[-1]])

    def rows(self) -> pd.DataFrame:
        counts = [len(s) for s, _ in self.found]
        return pd.DataFrame({"query_id": np.repeat(self.ids, counts), "key": np.repeat(self.keys, counts), "vec_id": np.concatenate([i for _, i in self.found]), "score": np.concatenate([s for s, _ in self.found])})


def search_top_k(vectors: DataFrame, is_query: Column, *, k: int = K, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` candidates of highest score of each query: query_id, rank, vec_id, score.

    Queries are the rows for which ``is_query`` holds, candidates all rows with
    another id; ties go to the smaller id.  Vectors that are null or hold null
    or non-finite components take no part, nor do rows without id; vectors of
    another length than the query's are no candidates.  Each repeated row is a
    candidate, and each row of a query id on several rows is searched with its
    own vector and has its own ranks.  A score beyond the range of long is held at its end.  An
    empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    finite = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    valid = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & finite)
    rows = valid.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    asked = valid.where(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.monotonically_increasing_id().alias("key"))

    blocks = materialize(rows.mapInPandas(lambda batches: _pack(batches, BLOCK, scale), _PACKED), "blocks")
    seeds = {r["dim"]: r["seed"] for r in blocks.groupBy("dim").agg(F.min("block").alias("block")).join(blocks, ["dim", "block"]).select("dim", F.struct("ids", "data").alias("seed")).orderBy("dim").limit(64).collect()}
    seeds = spark.sparkContext.broadcast({dim: (bytes(s["ids"]), bytes(s["data"])) for dim, s in seeds.items()})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _pack(batches, QUERY_BLOCK, scale):
            dim = int(block["dim"][0])
            best = _Best(*_unpack(dim, block["ids"][0], block["data"][0]), k)
            if dim in seeds.value:
                best.search(*_unpack(dim, *seeds.value[dim]))
            yield block.assign(floor=[best.floor.tobytes()])

    queries = materialize(asked.mapInPandas(packed, _PACKED + ", floor binary"), "queries")
    asking, offered = max(1, queries.count()), max(1, blocks.count())
    cells = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-asking * offered // PER_CELL))
    # A candidate block is about twice as large as a query block.
    across = min(offered, math.ceil(math.sqrt(2 * offered * cells / asking)))
    down = min(asking, -(-cells // across))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    left = queries.select("dim", cell(down).alias("x"), every(across).alias("y"), F.col("block").alias("q"), F.col("ids").alias("qids"), F.col("keys").alias("qkeys"), F.col("data").alias("qdata"), "floor")
    right = blocks.select("dim", every(down).alias("x"), cell(across).alias("y"), "ids", "data")
    # A merge join keeps all candidate blocks of a query block together.
    met = left.hint("merge").join(right, ["dim", "x", "y"])

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, best = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if key != (r.dim, r.x, r.y, r.q):
                    if best is not None:
                        yield best.rows()
                    key, best = (r.dim, r.x, r.y, r.q), _Best(*_unpack(r.dim, r.qids, r.qdata), k, np.frombuffer(r.floor, np.int64), np.frombuffer(r.qkeys, np.int64))
                best.search(*_unpack(r.dim, r.ids, r.data))
        if best is not None:
            yield best.rows()

    found = met.mapInPandas(searched, "query_id long, key long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INT AS rank, vec_id, score FROM r WHERE k <= 20
"""
