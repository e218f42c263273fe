"""Merkle manifest of a table: a tree for each group, one over the groups, and each row's proof.

Nodes of a level are numbered within their group, and node i has the parent i
div ``width``.  A window by group and parent, ordered and over its full frame,
collects the run of children: their digests are the parent's preimage, and to
each child the others are its siblings.  Then only the first row of each run
goes on as the parent.

Several levels are built in one pass.  The rows are dealt by blocks of
``width ** levels`` consecutive nodes, in which all parents of these levels
lie, so the windows of a pass need one shuffle.  A node carries the proofs of
its descendants since the start of the pass; they are given the proofs of the
passes above by one join for each pass, from the top down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subsidia.llm.exact_dedup import from_files, located
from subsidia.llm.ranks import ranked
from subsidia.session import materialize

#: Children of a node, and nodes in one block of a pass at most (a pass of six levels of two).
WIDTH, BLOCK = 2, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A row is tampered with where this divides the CRC-32 of its id.
TAMPER = 7


def field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    """Digests one after the other as text."""
    return F.array_join(F.transform(digests, _hexed), "")


def _levels(width: int, nodes: int) -> int:
    """Levels of the next pass: as many as are left, a block at most."""
    levels = 0
    while width**levels < nodes and (levels == 0 or width ** (levels + 1) <= BLOCK):
        levels += 1
    return levels


def _level(nodes: DataFrame, width: int) -> DataFrame:
    """The parents of the nodes of one level; a group with a single node keeps it as it is."""
    run = Window.partitionBy("group", "block", "parent").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nodes = nodes.withColumns({"parent": F.floor(F.col("rank") / width), "alone": F.col("group_rows") == 1})
    nodes = nodes.withColumn("run", F.collect_list(F.struct("digest", "members")).over(run)).where(F.pmod("rank", F.lit(width)) == 0)
    digests = F.transform("run", lambda c: c["digest"])
    digest = F.when(F.col("alone"), F.col("digest")).otherwise(F.unhex(F.sha2(_joined(digests), 256)))

    def with_siblings(child: Column, i: Column) -> Column:
        step = F.struct(F.slice(digests, F.lit(1), i).alias("left"), F.slice(digests, i + 2, F.lit(width)).alias("right"))
        return F.transform(child["members"], lambda m: F.struct(m["rank"].alias("rank"), F.when(F.col("alone"), m["proof"]).otherwise(F.concat(m["proof"], F.array(step))).alias("proof")))

    return nodes.select("group", "block", F.col("parent").alias("rank"), F.ceil(F.col("group_rows") / width).alias("group_rows"), digest.alias("digest"), F.flatten(F.transform("run", with_siblings)).alias("members"))


_PROOF = "array<struct<left:array<binary>,right:array<binary>>>"


def build_tree(nodes: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Roots and proofs of the groups of ``nodes`` (group, rank from 0, group_rows, digest as binary).

    Returns (group, digest), and (group, rank, proof) for each node: from its
    own level up, the digests of its siblings before and after it.  A last run
    may be short, even of one node, and is hashed like others; a group of one
    node is its own root, with an empty proof.
    """
    if width < 2:
        raise ValueError("a node needs two children at least")
    passes, most = [], nodes.agg(F.max("group_rows")).first()[0] or 0
    while True:
        levels = _levels(width, most)
        own = F.array(F.struct("rank", F.array().cast(_PROOF).alias("proof")))
        level = nodes.select("group", F.floor(F.col("rank") / width**levels).alias("block"), "rank", "group_rows", "digest", own.alias("members")).repartition("group", "block")
        for _ in range(levels):
            level = _level(level, width)
        done = materialize(level.drop("block"), "merkle-pass")
        passes.append(done.select("group", F.col("rank").alias("block"), "members"))
        nodes = done.drop("members")
        if most <= width**levels:
            break
        most = -(-most // width**levels)
    above = None
    for done in reversed(passes):
        below = done.select("group", "block", F.explode("members").alias("m")) if above is None else done.join(above, ["group", "block"]).select("group", "block", F.explode(F.transform("members", lambda m: F.struct(m["rank"].alias("rank"), F.concat(m["proof"], F.col("above")).alias("proof")))).alias("m"))
        proofs = below.select("group", F.col("m.rank").alias("rank"), F.col("m.proof").alias("proof"))
        above = proofs.select("group", F.col("rank").alias("block"), F.col("proof").alias("above"))
    return nodes.select("group", "digest"), proofs


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(_joined(s["left"]), _joined(s["right"]))), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (as hex text) and the siblings on its way give."""
    return F.aggregate(proof, leaf, lambda digest, s: F.sha2(F.concat(_joined(s["left"]), digest, _joined(s["right"])), 256))


def manifest(docs: DataFrame, *, group_col: str = "lang", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, seen: dict[str, Column] | None = None, width: int = WIDTH) -> DataFrame:
    """Leaves, subtrees' roots, root and proofs of a table.

    Returns one row for each input row: id, leaf, ``seen_leaf``, subroot, root
    and proof.  The leaves of a group ascend by id, null ids first and rows of
    one id by their leaf; repeated rows have equal leaves at places of their
    own.  Groups ascend by the bytes of their key, null first.  ``seen``
    replaces fields by what is found on checking; ``seen_leaf`` is the digest
    with them.  Empty texts have zero bytes and differ from null.  Very long
    texts are hashed whole, an empty table gives an empty result, and other
    columns have no part in it.
    """
    kinds, seen = dict(docs.dtypes), seen or {}
    docs = from_files(docs)
    value = {c: F.col(f"`{c}`") for c in fields}
    key = F.when(F.col(group_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group_col).cast("string")))
    leaf, changed = leaf_digest([value[c] for c in fields]), leaf_digest([seen.get(c, value[c]) for c in fields])
    same = F.lit(True) if not seen else F.lit(False)
    for c, other in seen.items():
        same = other.eqNullSafe(value[c].cast("string"))
    rows = located(docs, [key.alias("group"), F.col(id_col).alias("id"), F.unhex(leaf).alias("digest"), F.when(~same, F.unhex(changed)).alias("seen_digest")])
    rows = materialize(rows.select("group", "id", "digest", "seen_digest", F.xxhash64("file", "row").alias("tie")), "merkle-leaves")
    leaves = materialize(ranked(rows, "group", [F.col("id").asc_nulls_first(), F.col("digest"), F.col("tie")], "merkle-sorted").drop("tie"), "merkle-ranked")
    subroots, proofs = build_tree(leaves.select("group", "rank", "group_rows", "digest"), width)
    subroots = ranked(subroots.select(F.lit(0).alias("all"), F.col("group"), "digest"), "all", [F.col("group")], "merkle-groups")
    roots, paths = build_tree(subroots.select(F.col("all").alias("group"), "rank", "group_rows", "digest"), width)
    tops = materialize(subroots.select("group", "digest", "rank").join(paths.select("rank", F.col("proof").alias("path")), "rank").select("group", F.col("digest").alias("subroot"), "path"), "merkle-subroots")
    root = roots.select(F.col("digest").alias("root"))
    tops = tops.join(F.broadcast(root))  # the root is one row
    out = leaves.join(proofs, ["group", "rank"]).join(tops, "group")
    kind = kinds[id_col]
    return out.select(F.col("id").cast(kind).alias(id_col), _hexed(F.col("digest")).alias("leaf"), _hexed(F.coalesce("seen_digest", "digest")).alias("seen_leaf"), _hexed(F.col("subroot")).alias("subroot"), _hexed(F.col("root")).alias("root"), F.concat("proof", "path").alias("proof"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, checked against rows of which one in seven has a character count too large by one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPER)) == 0, F.lit(False))
    chars = F.col("n_chars").cast("decimal(20,0)")
    found = manifest(docs, seen={"n_chars": F.when(hit, chars + 1).otherwise(chars).cast("decimal(20,0)").cast("string")})
    again = folded(F.col("seen_leaf"), F.col("proof"))
    out = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = """
WITH RECURSIVE field AS (
  SELECT doc_id, n_chars, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS g,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS crc
  FROM documents),
leaf AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM (
    SELECT doc_id, g, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
      CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN sha256(head || strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1) || tail) END AS seen
    FROM field)),
level AS (
  SELECT 0 AS depth, g, i, count(*) OVER (PARTITION BY g) AS n, leaf AS h FROM leaf
  UNION ALL
  SELECT depth + 1, g, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM level WHERE n > 1 GROUP BY depth, g, i // 2),
top AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM level WHERE n = 1),
upper_level AS (
  SELECT 0 AS depth, i, n, h FROM top
  UNION ALL
  SELECT depth + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM upper_level WHERE n > 1 GROUP BY depth, i // 2),
base AS (SELECT max(depth) AS d FROM level),
node AS (
  SELECT l.g, l.depth, l.i, s.h AS sibling FROM level l LEFT JOIN level s ON s.g = l.g AND s.depth = l.depth AND s.i // 2 = l.i // 2 AND s.i <> l.i WHERE l.n > 1
  UNION ALL
  SELECT NULL, d + l.depth, l.i, s.h FROM base, upper_level l LEFT JOIN upper_level s ON s.depth = l.depth AND s.i // 2 = l.i // 2 AND s.i <> l.i WHERE l.n > 1),
step AS (
  SELECT k.g AS own, k.i AS own_i, t.depth, t.i % 2 AS odd, t.sibling FROM leaf k JOIN node t ON t.g = k.g AND t.i = k.i >> t.depth
  UNION ALL
  SELECT k.g, k.i, t.depth, t.i % 2, t.sibling FROM leaf k JOIN top p ON p.g = k.g JOIN base ON true JOIN node t ON t.g IS NULL AND t.i = p.i >> (t.depth - d)),
way AS (SELECT own, own_i, list(struct_pack(odd := odd, sibling := sibling) ORDER BY depth) AS steps, coalesce(string_agg(sibling, '' ORDER BY depth), '') AS proof FROM step GROUP BY own, own_i),
fold AS (
  SELECT k.g, k.i, 1::BIGINT AS pos, coalesce(k.seen, k.leaf) AS h, steps FROM leaf k LEFT JOIN way ON own = k.g AND own_i = k.i
  UNION ALL
  SELECT g, i, pos + 1, sha256(CASE WHEN steps[pos].odd = 1 THEN coalesce(steps[pos].sibling, '') || h ELSE h || coalesce(steps[pos].sibling, '') END), steps FROM fold WHERE pos <= coalesce(len(steps), 0)),
root AS (SELECT h FROM upper_level WHERE n = 1)
SELECT k.doc_id, k.leaf, p.h AS subroot, r.h AS root, sha256(coalesce(w.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaf k JOIN top p ON p.g = k.g CROSS JOIN root r LEFT JOIN way w ON own = k.g AND own_i = k.i
JOIN fold f ON f.g = k.g AND f.i = k.i AND f.pos = coalesce(len(f.steps), 0) + 1
"""
