"""Density clusters of the points of one building and track.

The mutual-reachability tree of a group is cut by excess of mass (Campello et
al. 2013, 2015).  A group is mostly the points of one roof, some hundred, and
is handed to Arrow with many others.  Of a group of more than ``LARGE``
points the work that grows with their square, core distances and the rounds of
the spanning tree, is spread over tasks by blocks of points; what is left for
one task is the cut of the tree, with memory and time by the number of points.
Edges of equal length stand in the order of their points, so the tree is the
same either way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subsidia.operators.batches import in_groups
from subsidia.session import counted, materialize

# Weights of the six features, and the quantiles that scale them.
WEIGHTS = (1.10, 1.00, 0.75, 1.30, 0.90, 0.80)
QUANTILES = (15, 85)
FEATURES = ("along_m", "cross_m", "height_rank", "velocity", "acceleration", "coherence_penalty")


def scaled_matrix(rows: pd.DataFrame) -> np.ndarray:
    """Features centred on the median and divided by their quantile range, weighted; missing values 0."""
    return scaled(rows[list(FEATURES)].to_numpy(float))


def scaled(x: np.ndarray) -> np.ndarray:
    """The same of the features as an array."""
    percentile = np.nanpercentile if np.isnan(x).any() else np.percentile
    low, middle, high = percentile(x, [QUANTILES[0], 50, QUANTILES[1]], axis=0)
    spread = np.where(high > low, high - low, 1.0)
    return np.nan_to_num((x - middle) / spread * WEIGHTS, nan=0.0)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """From each row of ``x`` to each of ``y``; feature by feature, so that any division into blocks gives the same digits."""
    total = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        total += (x[:, k, None] - y[None, :, k]) ** 2
    return np.sqrt(total)


#: Points of a group up to which all its pairs are sorted at once.
FEW = 64


def _edges_of_few(x: np.ndarray, kth: int) -> np.ndarray:
    """The same tree, which the order of the edges makes unique, from all pairs in order."""
    n, d = len(x), distances(x, x)
    core = np.partition(d, kth, axis=1)[:, kth]
    a, b = np.triu_indices(n, 1)
    d = np.maximum(d[a, b], np.maximum(core[a], core[b]))
    order = np.argsort(d, kind="stable")
    part, edges = list(range(n)), []
    for i, j, v in zip(a[order].tolist(), b[order].tolist(), d[order].tolist()):
        p, q = part[i], part[j]
        if p != q:
            edges.append((i, j, v))
            part = [p if k == q else k for k in part]
            if len(edges) == n - 1:
                break
    return np.array(edges, float).reshape(-1, 3)


def _reachability_edges(x: np.ndarray, neighbours: int) -> np.ndarray:
    """Minimum spanning tree of mutual reachability as rows (a, b, distance), a below b, by distance and then by the points.

    Distances are made row by row when they are needed, so memory grows with the number of points only.
    """
    n, kth = len(x), min(neighbours, len(x) - 1)
    if n <= FEW:
        return _edges_of_few(x, kth)
    core = np.array([np.partition(distances(x[i : i + 1], x)[0], kth)[kth] for i in range(n)])
    number = np.arange(n)
    inside, best, low, high, edges = np.zeros(n, bool), np.full(n, np.inf), np.full(n, n), np.full(n, n), []
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        d = np.maximum(distances(x[at : at + 1], x)[0], np.maximum(core, core[at]))
        a, b = np.minimum(number, at), np.maximum(number, at)
        closer = ~inside & ((d < best) | ((d == best) & ((a < low) | ((a == low) & (b < high)))))
        best[closer], low[closer], high[closer] = d[closer], a[closer], b[closer]
        open_ = np.where(inside, np.inf, best)
        near = np.flatnonzero(open_ == open_.min())
        at = int(near[np.lexsort((high[near], low[near]))[0]])
        edges.append((low[at], high[at], best[at]))
    return np.array(sorted(edges, key=lambda e: (e[2], e[0], e[1]))).reshape(-1, 3)


def density_clusters(x: np.ndarray, smallest: int, neighbours: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels (-1 noise, larger clusters first), membership and outlier scores of each row."""
    return cut_tree(len(x), _reachability_edges(x, neighbours), smallest)


def cut_tree(n: int, edges: np.ndarray, smallest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from the edges of the spanning tree of ``n`` points, in order."""
    children, height = {}, {}
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b, d in edges.tolist():
        node = len(root)
        children[node], height[node] = (top(int(a)), top(int(b))), d
        root.append(node)
        for c in children[node]:
            root[c] = node
    size = [1] * n
    for node in range(n, len(root)):
        size.append(size[children[node][0]] + size[children[node][1]])

    def members(node: int) -> list[int]:
        out, open_ = [], [node]
        while open_:
            at = open_.pop()
            if at < n:
                out.append(at)
            else:
                open_ += children[at][::-1]
        return out

    density = lambda d: 1.0 / d if d > 0 else np.inf
    born, fell, parent, leaves = [0.0], [{}], [-1], [[]]  # condensed clusters, each after its parent
    stack = [(len(root) - 1, 0)]
    while stack:
        node, cluster = stack.pop()
        if node < n:
            fell[cluster][node] = np.inf
            continue
        at = density(height[node])
        large = [c for c in children[node] if size[c] >= smallest]
        if len(large) == 2:
            for c in large:
                born.append(at)
                fell.append({})
                parent.append(cluster)
                leaves.append([])
                leaves[cluster].append(len(born) - 1)
                stack.append((c, len(born) - 1))
            continue
        for c in children[node]:
            if c in large:
                stack.append((c, cluster))
            else:
                fell[cluster] |= dict.fromkeys(members(c), at)

    count = [0] * len(born)
    ends = [max([v for v in f.values() if np.isfinite(v)], default=0.0) for f in fell]
    finite = lambda v, cap: v if np.isfinite(v) else cap
    most = max([v for f in fell for v in f.values() if np.isfinite(v)], default=1.0)
    stability = [sum(finite(v, most) - finite(born[c], most) for v in fell[c].values()) for c in range(len(born))]
    chosen, last = [True] * len(born), [0.0] * len(born)
    for c in reversed(range(len(born))):
        count[c] = len(fell[c]) + sum(count[k] for k in leaves[c])
        stability[c] += sum(count[k] * (finite(born[k], most) - finite(born[c], most)) for k in leaves[c])
        below = sum(stability[k] for k in leaves[c])
        if leaves[c] and below > stability[c]:
            chosen[c], stability[c] = False, below
        last[c] = max([ends[c], *(last[k] for k in leaves[c])])
    # The chosen cluster that each one is, or is part of.
    owner: list[int | None] = []
    for c in range(len(born)):
        above = owner[parent[c]] if c else None
        owner.append(above if above is not None else c if chosen[c] else None)

    whole = max([finite(born[k], most) for k in leaves[0]], default=0.0)
    labels, probability, outlier = np.full(n, -1), np.zeros(n), np.zeros(n)
    for c in range(len(born)):
        own = owner[c]
        for i, v in fell[c].items():
            outlier[i] = 1 - finite(v, most) / last[c] if last[c] > 0 and np.isfinite(v) else 0.0
            if own is None or (own == 0 and v < whole):
                continue
            labels[i] = own
            probability[i] = min(1.0, finite(v, last[own]) / last[own]) if last[own] > 0 else 1.0
    names, first, sizes = np.unique(labels, return_index=True, return_counts=True)
    real = names >= 0
    order = names[real][np.lexsort((first[real], -sizes[real]))]
    place = dict(zip(order.tolist(), range(len(order))))
    return np.array([place.get(k, -1) for k in labels.tolist()]), probability, np.clip(outlier, 0, 1)


def normalised(scores: np.ndarray) -> np.ndarray:
    """Scores scaled to 0..1: all 0.5 if none is finite, all 0.25 if they are equal, and 1 for infinite ones."""
    finite = scores[np.isfinite(scores)]
    if not finite.size:
        return np.full(len(scores), 0.5)
    low, high = finite.min(), finite.max()
    if high <= low + 1e-9:
        return np.full(len(scores), 0.25)
    return np.where(np.isfinite(scores), np.clip((scores - low) / (high - low), 0, 1), 1.0)


def _rejoined(calm: np.ndarray, near_roof: np.ndarray, x: np.ndarray, labels: np.ndarray, probability: np.ndarray, outlier: np.ndarray) -> None:
    """Noise that is near a cluster and otherwise inconspicuous joins it; centres and radii are those before."""
    names = sorted(set(labels[labels >= 0]))
    if not names or not ((labels == -1) & calm & near_roof).any():
        return
    order = np.argsort(labels, kind="stable")
    own = np.split(order, np.searchsorted(labels[order], names))[1:]
    centres = np.array([np.median(x[of], axis=0) for of in own])
    radii = np.array([max(np.percentile(np.linalg.norm(x[of] - c, axis=1), 90), 0.65) for of, c in zip(own, centres)])
    for i in np.flatnonzero((labels == -1) & calm & near_roof):
        distances = np.linalg.norm(x[i] - centres, axis=1)
        k = int(distances.argmin())
        if distances[k] <= 1.35 * radii[k] + 0.35:
            labels[i], probability[i], outlier[i] = names[k], max(probability[i], 0.35), min(outlier[i], 0.55)


def group_limits(n: int) -> tuple[int, int]:
    """The smallest cluster of a group of ``n`` points, and the neighbours of a core distance."""
    smallest = max(2, min(8, int(np.ceil(0.2 * n))))
    return smallest, max(1, smallest // 2)


def cluster_group(rows: pd.DataFrame, edges: np.ndarray | None = None) -> pd.DataFrame:
    """Roles of the points of one group of six or more, in order of code; ``edges`` are those of its spanning tree, if they are known."""
    rows = rows.sort_values("code").reset_index(drop=True)
    labels, probability, outlier = _roles(scaled_matrix(rows), _calm(rows), _near_roof(rows), edges)
    prefix = f"{rows['building_id'].iloc[0]}:t{rows['track'].iloc[0]}:"
    return rows[["code", "building_id", "track"]].assign(role=np.where(labels >= 0, "core", "noise"), cluster_id=[prefix + (f"cluster_{k}" if k >= 0 else "noise") for k in labels], probability=probability, outlier=outlier)


def _calm(rows: pd.DataFrame) -> np.ndarray:
    return (rows["local_deviation"].to_numpy(float) <= 0.75) & (rows["coherence"].fillna(0.0).to_numpy(float) >= 0.45)


def _near_roof(rows: pd.DataFrame) -> np.ndarray:
    return (rows["method"] != "nearest").to_numpy() | (rows["distance_m"].fillna(0.0).to_numpy(float) <= 8.0)


def _roles(x: np.ndarray, calm: np.ndarray, near_roof: np.ndarray, edges: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, probability and outlier score of the scaled points of one group."""
    n = len(x)
    smallest, neighbours = group_limits(n)
    labels, probability, outlier = cut_tree(n, _reachability_edges(x, neighbours) if edges is None else edges, smallest)
    outlier = normalised(outlier)
    if not (labels >= 0).any():
        labels = np.zeros(n, int)
    _rejoined(calm, near_roof | (n <= 12), x, labels, probability, outlier)
    return labels, np.clip(probability, 0.05, 0.99), np.where(labels == -1, np.maximum(outlier, 0.75), outlier)


def cluster_groups(table: pa.Table, starts: np.ndarray, columns: list[str]) -> pa.Table:
    """``cluster_group`` of many groups, each in order of code, beside the named columns of the rows."""
    rows = table.select([*FEATURES, "local_deviation", "coherence", "method", "distance_m"]).to_pandas()
    x, calm, near_roof = rows[list(FEATURES)].to_numpy(float), _calm(rows), _near_roof(rows)
    at = starts.tolist()
    made = [_roles(scaled(x[a:b]), calm[a:b], near_roof[a:b]) for a, b in zip(at, at[1:])]
    labels, probability, outlier = (np.concatenate(c) for c in zip(*made))
    keys = zip(table["building_id"].to_pylist(), table["track"].to_pylist(), labels.tolist())
    names = [f"{b}:t{t}:" + (f"cluster_{k}" if k >= 0 else "noise") for b, t, k in keys]
    return table.select(columns).append_column("role", pa.array(np.where(labels >= 0, "core", "noise").tolist())).append_column("cluster_id", pa.array(names)).append_column("probability", pa.array(probability)).append_column("outlier", pa.array(outlier))


#: Points of a group above which its tree is made by blocks; points in a block, and in a task at most about.
LARGE, BLOCK, CELL_POINTS = 5_000, 512, 8_192
_GROUP = ["building_id", "track"]


def _met(points: DataFrame, made, schema: str) -> DataFrame:
    """``made`` over each cell of a group's points with all points of the group, block by block.

    ``points`` has the group's columns, n, i, x, core and part.  A cell's own
    blocks come first, then the group's blocks go through one at a time, so a
    task holds a cell and a block.
    """
    packed = points.groupBy(*_GROUP, "n", F.floor(F.col("i") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "x", "core", "part"))).alias("points"))
    cell = F.floor(F.col("block") / (CELL_POINTS // BLOCK)).cast("int")
    own = packed.select(*_GROUP, "n", cell.alias("cell"), F.lit(0).alias("kind"), "points")
    every = packed.select(*_GROUP, "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CELL_POINTS).cast("int"))).alias("cell"), F.lit(1).alias("kind"), "points")
    dealt = own.unionByName(every).repartition(*_GROUP, "cell").sortWithinPartitions(*_GROUP, "cell", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, held = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                points = row["points"]
                block = np.array([p["i"] for p in points]), np.array([p["x"] for p in points]), np.array([p["core"] for p in points], float), np.array([p["part"] for p in points])
                now = (*(row[c] for c in _GROUP), row["cell"])
                if now != key:
                    if state is not None:
                        yield state.rows(key)
                    key, state, held = now, None, []
                if row["kind"] == 0:
                    held.append(block)
                    continue
                if state is None:
                    state = made([np.concatenate(c) for c in zip(*held)], row["n"])
                state.meet(*block)
        if state is not None:
            yield state.rows(key)

    return dealt.mapInArrow(run, schema)


class _Cores:
    """Core distances of a cell's points: the few smallest distances so far."""

    def __init__(self, own: list[np.ndarray], n: int):
        self.i, self.x = own[:2]
        self.kth = min(group_limits(n)[1], n - 1)
        self.least = np.full((len(self.i), self.kth + 1), np.inf)

    def meet(self, i: np.ndarray, x: np.ndarray, core: np.ndarray, part: np.ndarray) -> None:
        every = np.hstack([self.least, distances(self.x, x)])
        self.least = np.partition(every, self.kth, axis=1)[:, : self.kth + 1]

    def rows(self, key: tuple) -> pa.RecordBatch:
        n = len(self.i)
        return pa.RecordBatch.from_pydict({"building_id": pa.array([key[0]] * n, pa.string()), "track": pa.array([key[1]] * n, pa.int32()), "i": pa.array(self.i, pa.int64()), "core": pa.array(self.least.max(1))})


class _Links:
    """For each part of the tree in a cell, its shortest edge to another part."""

    def __init__(self, own: list[np.ndarray], n: int):
        self.i, self.x, self.core, self.part = own
        self.best = np.full(len(self.i), np.inf)
        self.low, self.high = np.full(len(self.i), n), np.full(len(self.i), n)

    def meet(self, i: np.ndarray, x: np.ndarray, core: np.ndarray, part: np.ndarray) -> None:
        d = np.maximum(distances(self.x, x), np.maximum(self.core[:, None], core[None]))
        d[self.part[:, None] == part[None]] = np.inf
        least = d.min(1)
        # Of equal distances the pair of the smallest points; i is in order, so for each row it is the first or, above it, the first again.
        first = i[(d == least[:, None]).argmax(1)]
        low, high = np.minimum(self.i, first), np.maximum(self.i, first)
        closer = np.isfinite(least) & ((least < self.best) | ((least == self.best) & ((low < self.low) | ((low == self.low) & (high < self.high)))))
        self.best[closer], self.low[closer], self.high[closer] = least[closer], low[closer], high[closer]

    def rows(self, key: tuple) -> pa.RecordBatch:
        order = np.lexsort((self.high, self.low, self.best, self.part))
        order = order[np.isfinite(self.best[order])]
        first = order[np.unique(self.part[order], return_index=True)[1]] if len(order) else order
        n = len(first)
        return pa.RecordBatch.from_pydict({"building_id": pa.array([key[0]] * n, pa.string()), "track": pa.array([key[1]] * n, pa.int32()), "part": pa.array(self.part[first], pa.int64()), "d": pa.array(self.best[first]), "a": pa.array(self.low[first], pa.int64()), "b": pa.array(self.high[first], pa.int64())})


def _joined_parts(chosen: pd.DataFrame) -> pd.DataFrame:
    """New numbers of the parts of one group that the chosen edges (part, other) join: the smallest of each."""
    names = np.unique(chosen[["part", "other"]].to_numpy())
    root = {k: k for k in names.tolist()}

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in chosen[["part", "other"]].itertuples(index=False):
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return pd.DataFrame({"building_id": chosen["building_id"].iloc[0], "track": chosen["track"].iloc[0], "part": names, "now": [top(k) for k in names.tolist()]})


def spanning_edges(points: DataFrame) -> DataFrame:
    """(building_id, track, a, b, d): the tree of ``_reachability_edges`` of each group of ``points`` (n, i from 0 and the scaled features x), in rounds.

    In a round every part of the tree takes its shortest edge to another one,
    edges of equal length by their points; so parts at least halve in number.
    """
    points = points.withColumn("track", F.col("track").cast("int"))
    cores = _met(points.withColumns({"core": F.lit(0.0), "part": F.col("i")}), _Cores, "building_id string, track int, i long, core double")
    points = materialize(points.join(cores, [*_GROUP, "i"]).withColumn("part", F.col("i")), "tree-points")
    edges = None
    while True:
        least = _met(points, _Links, "building_id string, track int, part long, d double, a long, b long")
        best = least.groupBy(*_GROUP, "part").agg(F.min(F.struct("d", "a", "b")).alias("e")).select(*_GROUP, "part", "e.*")
        best, seen = counted(best, "tree-links")
        if not seen["rows"]:
            return edges
        new = best.select(*_GROUP, "a", "b", "d").distinct()
        edges = new if edges is None else edges.unionByName(new)
        ends = points.select(*_GROUP, F.col("i").alias("end"), F.col("part").alias("of"))
        pairs = best.withColumn("end", F.explode(F.array("a", "b"))).join(ends, [*_GROUP, "end"]).where("of <> part").select(*_GROUP, "part", F.col("of").alias("other"))
        now = pairs.groupBy(*_GROUP).applyInPandas(_joined_parts, "building_id string, track int, part long, now long")
        points = materialize(points.join(now, [*_GROUP, "part"], "left").withColumn("part", F.coalesce("now", "part")).drop("now"), "tree-points")


def _large_groups(rows: DataFrame, schema: str) -> DataFrame:
    """``cluster_group`` of large groups, with their trees made first."""
    q = [p / 100 for p in (QUANTILES[0], 50, QUANTILES[1])]
    cuts = rows.groupBy(*_GROUP).agg(F.count("*").alias("n"), *[F.percentile(F.when(~F.isnan(f), F.col(f)), q).alias(f"{f}_cuts") for f in FEATURES])

    def scaled(f: str, w: float):
        low, middle, high = (F.get(f"{f}_cuts", F.lit(k)) for k in range(3))
        return F.coalesce((F.nanvl(F.col(f), F.lit(None)) - middle) / F.when(high > low, high - low).otherwise(F.lit(1.0)) * w, F.lit(0.0))

    number = F.row_number().over(Window.partitionBy(*_GROUP).orderBy("code")) - 1
    points = rows.withColumn("i", number.cast("long")).join(cuts, _GROUP).select(*_GROUP, "n", "i", F.array(*[scaled(f, w) for f, w in zip(FEATURES, WEIGHTS)]).alias("x"))
    edges = spanning_edges(materialize(points, "large-groups")).withColumn("track", F.col("track").cast(dict(rows.dtypes)["track"]))

    def cut(own: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        tree = tree.sort_values(["d", "a", "b"])
        return cluster_group(own, tree[["a", "b", "d"]].to_numpy(float))

    return rows.groupBy(*_GROUP).cogroup(edges.groupBy(*_GROUP)).applyInPandas(cut, schema)


def cluster_points(kept: DataFrame, *, columns: list[str] | None = None, sizes: str | None = None) -> DataFrame:
    """code, building_id, track, role, cluster_id, probability and outlier of kept points, by the size of their group.

    ``columns`` are those of the points that go through, in place of the first
    three, so that the result need not be joined with the points again.
    ``sizes`` names a column with the number of kept points of the group, where
    it is known; else the groups are counted.
    """
    from subsidia.operators.groups import GROUP, small_group_roles

    columns, added = columns or ["code", *GROUP], ["role", "cluster_id", "probability", "outlier"]
    if sizes is None:
        sizes = "group_size"
        kept = kept.join(materialize(kept.groupBy(*GROUP).agg(F.count("*").alias(sizes)), "group-sizes"), GROUP)
    small = small_group_roles(kept.where(F.col(sizes) <= 5)).select(*columns, *added)
    rows = kept.where(F.col(sizes) >= 6).withColumn("coherence_penalty", F.greatest(F.lit(0.0), 0.65 - F.coalesce("coherence", F.lit(0.65))))
    used = list(dict.fromkeys([*columns, "code", *GROUP, *FEATURES, "coherence", "local_deviation", "method", "distance_m"]))
    rows = rows.withColumns({f: F.col(f).cast("double") for f in (*FEATURES, "distance_m")})
    schema = "role string, cluster_id string, probability double, outlier double"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema)
    medium, large = rows.where(F.col(sizes) <= LARGE).select(*used), rows.where(F.col(sizes) > LARGE).select(*used)
    out = small.unionByName(in_groups(medium, GROUP, ["code"], partial(cluster_groups, columns=columns), f"{kinds}, {schema}"))
    if large.isEmpty():
        return out
    found = _large_groups(large, f"code string, building_id string, track {dict(kept.dtypes)['track']}, {schema}")
    return out.unionByName(large.select(*columns).join(found, ["code", *GROUP]).select(*columns, *added))
