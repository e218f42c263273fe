import numpy as np
import pytest
from pyspark.sql import functions as F

from subsidia.operators import cluster


def brute(x, smallest, neighbours):
    """Density clusters by their definition: all edges, merges one by one, clusters as sets of points."""
    n = len(x)
    d = [[float(cluster.distances(x[i : i + 1], x[j : j + 1])[0, 0]) for j in range(n)] for i in range(n)]
    core = [sorted(row)[min(neighbours, n - 1)] for row in d]
    edges = sorted((max(d[a][b], core[a], core[b]), a, b) for a in range(n) for b in range(a + 1, n))
    sets = {i: (i,) for i in range(n)}
    tree = {}  # a set of points -> (height, the two sets that it came from)
    for h, a, b in edges:
        p, q = sets[a], sets[b]
        if p is not q:
            joined = p + q
            tree[joined] = (h, p, q)
            for i in joined:
                sets[i] = joined
    rate = lambda h: 1 / h if h > 0 else np.inf
    clusters = []  # birth, when each point leaves, children

    def grow(points, birth):
        own = {"birth": birth, "left": {}, "children": []}
        clusters.append(own)
        while True:
            if len(points) == 1:
                own["left"][points[0]] = np.inf
                return own
            h, p, q = tree[points]
            at = rate(h)
            if len(p) >= smallest and len(q) >= smallest:
                own["children"] = [grow(p, at), grow(q, at)]
                return own
            for part in (p, q):
                if len(part) < smallest:
                    own["left"] |= dict.fromkeys(part, at)
            if max(len(p), len(q)) < smallest:
                return own
            points = p if len(p) >= smallest else q

    top = grow(sets[0], 0.0)
    most = max((v for c in clusters for v in c["left"].values() if np.isfinite(v)), default=1.0)
    cap = lambda v: v if np.isfinite(v) else most

    def every(c):
        return list(c["left"]) + [i for k in c["children"] for i in every(k)]

    def mass(c):
        """Excess of mass, and the clusters that give it."""
        own = sum(cap(v) - cap(c["birth"]) for v in c["left"].values()) + sum(len(every(k)) * (cap(k["birth"]) - cap(c["birth"])) for k in c["children"])
        below = [mass(k) for k in c["children"]]
        if below and sum(m for m, _ in below) > own:
            return sum(m for m, _ in below), [k for _, ks in below for k in ks]
        return own, [c]

    groups = []
    for c in mass(top)[1]:
        points = every(c)
        if c is top and top["children"]:
            points = [i for k in top["children"] for i in every(k)] + [i for i, v in top["left"].items() if v >= max(cap(k["birth"]) for k in top["children"])]
        groups.append(sorted(points))
    labels = [-1] * n
    for k, points in enumerate(sorted(groups, key=lambda g: (-len(g), g[0]))):
        for i in points:
            labels[i] = k
    return labels


@pytest.mark.parametrize("seed", range(50))
def test_labels_by_definition(seed):
    """Random groups, most with many equal distances."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(6, 45))
    x = rng.integers(0, 4, (n, 6)).astype(float) if seed % 3 else rng.normal(size=(n, 6))
    x[: n // 2] += 5 * (seed % 2)
    smallest, neighbours = cluster.group_limits(n)
    labels, probability, outlier = cluster.density_clusters(x, smallest, neighbours)
    assert labels.tolist() == brute(x, smallest, neighbours)
    assert ((probability >= 0) & (probability <= 1)).all() and ((outlier >= 0) & (outlier <= 1)).all()


def kept(spark, sizes, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in enumerate(sizes):
        x = rng.integers(0, 5, (n, 6)).astype(float) + 8 * rng.integers(0, 3, (n, 1))
        rows += [(f"{k}-{i:05d}", f"b{k}", 44 + k % 2, *map(float, v), 0.6, float(v[0] % 3) / 3, "within", 1.0) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "code string, building_id string, track int, along_m double, cross_m double, height_rank double, velocity double, acceleration double, other double, coherence double, local_deviation double, method string, distance_m double")
    return frame.withColumn("coherence", F.col("other") / 10).drop("other")


def test_trees_by_blocks(spark, monkeypatch):
    """Large groups, made by blocks and rounds, have the same roles as in one piece; equal distances, a small group and one without a tree beside them."""
    points = kept(spark, [150, 90, 40, 7, 3], 1)
    monkeypatch.setattr(cluster, "LARGE", 10**6)
    want = {r.code: tuple(r) for r in cluster.cluster_points(points).collect()}
    monkeypatch.setattr(cluster, "LARGE", 20)
    monkeypatch.setattr(cluster, "BLOCK", 16)
    monkeypatch.setattr(cluster, "CELL_POINTS", 64)
    got = {r.code: tuple(r) for r in cluster.cluster_points(points).collect()}
    assert len(got) == 290 and {c: r[:5] for c, r in got.items()} == {c: r[:5] for c, r in want.items()}
    assert all(np.allclose(got[c][5:], want[c][5:]) for c in want)
