import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from subsidia.llm import merkle, ranks

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, width):
    """Root, and for each node the siblings before and after it on each level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H("".join(now[i : i + width])) for i in range(0, len(now), width)])
    proofs = []
    for i in range(len(nodes)):
        way = []
        for level in levels[:-1]:
            a = i // width * width
            way.append((level[a:i], level[i + 1 : a + width]))
            i //= width
        proofs.append(way)
    return levels[-1][0], proofs


def brute(rows, width):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf(row)))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[k])], width) for k in keys]
    root, paths = tree([t[0] for t in trees], width)
    out = []
    for k, (subroot, proofs), path in zip(keys, trees, paths):
        for (has, i, own), proof in zip(sorted(groups[k]), proofs):
            out.append((str(i) if has else "null", own, subroot, root, tuple((tuple(a), tuple(b)) for a, b in proof + path)))
    return sorted(out)


ROWS = [(i * 7 % 41, f"s{i % 3}", ("en", "de", None, "é", "")[i * i % 5], i, "x" * (i % 4) + "é") for i in range(41)]
ODD = [(None, None, None, None, None), (None, None, None, None, None), (3, "s", "en", 1, ""), (3, "s", "en", 1, None), (3, "s", "en", 1, ""), (9, None, "zz", None, "a" * 300_000)]


@pytest.mark.parametrize("rows, width, block", [(ROWS, 2, 64), (ROWS + ODD, 2, 4), (ROWS + ODD, 3, 9), (ODD[:1], 2, 64), ([], 2, 64)])
def test_manifest_equals_brute_force(spark, monkeypatch, rows, width, block):
    """Trees of several passes, other widths, null and repeated ids and rows, null and empty groups, columns with clashing names."""
    monkeypatch.setattr(merkle, "BLOCK", block)
    docs = spark.createDataFrame([r + (1, 2, 3) for r in rows], "doc_id long, source string, lang string, n_chars int, text string, rank int, digest int, `group` int")
    found = merkle.manifest(docs, width=width).collect()
    way = lambda proof: tuple((tuple(bytes(x).hex() for x in s.left), tuple(bytes(x).hex() for x in s.right)) for s in proof)
    assert sorted((str(r.doc_id) if r.doc_id is not None else "null", r.leaf, r.subroot, r.root, way(r.proof)) for r in found) == brute(rows, width) if rows else found == []
    assert all(r.leaf == r.seen_leaf for r in found)


def test_tampering_is_seen(spark):
    docs = spark.createDataFrame(ROWS + ODD, "doc_id long, source string, lang string, n_chars int, text string")
    found = merkle.manifest(docs, seen={"text": F.when(F.col("doc_id") == 9, F.lit("b")).otherwise(F.col("text"))})
    found = found.withColumn("good", merkle.folded(F.col("seen_leaf"), F.col("proof")) == F.col("root")).collect()
    assert {r.doc_id for r in found if not r.good} == {9} and sum(not r.good for r in found) == sum(r[0] == 9 for r in ROWS + ODD)


def test_ranks_over_partitions(spark):
    """Groups over many partitions, and rows that the order does not tell apart."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(0, 3000, 1, 7).select(F.when(F.col("id") % 10 > 0, "a").otherwise(F.concat(F.lit("b"), F.col("id") % 3)).alias("g"), (F.col("id") * 37 % 1500).alias("v"))
        got = ranks.ranked(rows, "g", [F.col("v")]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for g in ("a", "b0", "b1", "b2"):
        mine = sorted((r["rank"], r.v) for r in got if r.g == g)
        assert [x for x, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine) and all(r.group_rows == len(mine) for r in got if r.g == g)
