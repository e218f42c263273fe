"""Secret scans: base patterns, and weak candidates linked with their complements.

Base kinds are strong by themselves.  A bare 40-character key or an endpoint
is weak: it is reported only where its complements occur with it.  Access
identifiers, keys and endpoints are joined by interval: two parts belong
together if they stand in the same scope, a block of lines that no blank line
divides, and one's interval, widened by ``WINDOW`` on both sides, meets the
other's.  The join is a sweep over the sorted spans: a span's rank among those
of another kind gives its neighbours there, of which the nearer one is taken,
so no pairs of all with all are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subsidia.llm.columns import let, match_spans, prefix_sums

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Matches of the plain pattern that are long enough; the runs are maximal either way, so shorter ones can't hide a long one.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12
#: A bare key: 40 characters of which some are upper case, some lower case and some digits; it may follow the '=' of an assignment.
BARE_KEY = r"(?<![A-Za-z0-9/+])(?=[A-Za-z/+]{0,39}[0-9])(?=[A-Z0-9/+]{0,39}[a-z])(?=[a-z0-9/+]{0,39}[A-Z])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"
ENDPOINT = r"(?i)\b(?:https?://[^\s\"'<>]+|[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){0,8}\.amazonaws\.com)"
#: What divides scopes: line ends with nothing but blanks and tabs between them.
SCOPE = r"\r?\n[\x20\t]*\r?\n"
#: The most characters between two parts of one credential.
WINDOW = 2000


def _named(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


_NONE = "array<struct<start:bigint,order:int,end:bigint,kind:string>>"


def _where(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(_NONE))


_LINKS = "array<struct<access:struct<start:bigint,end:bigint>,key:struct<start:bigint,end:bigint>,endpoint:struct<start:bigint,end:bigint>>>"
_PARTS = (("access", 1), ("key", 3), ("endpoint", 4))


def _scoped(text: Column) -> Column:
    """Spans (access, key, endpoint) of each scope that holds an access identifier and a bare key."""
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x).cast("bigint"))

    def by_scope(scopes: Column) -> Column:
        breaks = lengths(F.regexp_extract_all(text, F.lit(SCOPE), F.lit(0)))
        starts = prefix_sums(F.zip_with(lengths(scopes), breaks, lambda s, b: s + F.coalesce(b, F.lit(0))))
        found = lambda s, at: F.struct(*[_named(match_spans(s, F.lit(p), 0, at), kind, order).alias(kind) for p, (kind, order) in zip((ACCESS, BARE_KEY, ENDPOINT), _PARTS)])
        return let(starts, lambda at: F.array_compact(F.transform(scopes, lambda s, i: F.when(s.rlike(ACCESS) & s.rlike(BARE_KEY), found(s, F.get(at, i))))))

    return let(F.split(text, SCOPE, -1), by_scope)


def _gap(s: Column, t: Column) -> Column:
    """Characters between two spans, below 0 if they overlap."""
    return F.greatest(s["start"], t["start"]) - F.least(s["end"], t["end"])


def _nearest(spans: Column, s: Column, before: Column) -> Column:
    """Which span has the smallest gap to ``s``, null if that is above ``WINDOW``; the earlier one if two are as near; ``before`` of the spans start before ``s``."""
    away = lambda i: F.when((i >= 0) & (i < F.size(spans)), _gap(s, F.get(spans, i)))
    gaps = F.struct(away(before - 1).alias("last"), away(before).alias("following"))
    first = lambda g: g["last"].isNotNull() & (g["following"].isNull() | (g["last"] <= g["following"]))
    return let(gaps, lambda g: F.when(first(g) & (g["last"] <= WINDOW), before - 1).when(~first(g) & (g["following"] <= WINDOW), before))


def _weak(links: Column) -> Column:
    """The keys and endpoints that are linked, each once."""
    each = lambda kind, order: F.transform(F.filter(F.transform(links, lambda x: x[kind]), lambda s: s.isNotNull()), lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.array_distinct(F.concat(*[each(kind, order) for kind, order in _PARTS[1:]]))


def _with_links(rows: DataFrame) -> DataFrame:
    """``scoped`` and the ``links`` of its spans.

    Steps are columns, as deeply nested lambdas can't be resolved; what a step
    takes from another goes through its arguments, for a column inside a lambda
    may be computed again for each element.
    """
    rows = rows.withColumn("merged", F.transform("scoped", lambda x: F.array_sort(F.concat(*[x[kind] for kind, _ in _PARTS]))))
    before = lambda m, order: prefix_sums(F.transform(m, lambda s: F.when(s["order"] == order, 1).otherwise(0).cast("bigint")))
    rows = rows.withColumn("ranks", F.transform("merged", lambda m: F.struct(*[before(m, order).alias(kind) for kind, order in _PARTS])))
    rank = lambda r, j: [F.get(r[kind], j).cast("int").alias(f"n_{kind}") for kind, _ in _PARTS]
    ranked = F.zip_with("merged", "ranks", lambda m, r: F.transform(m, lambda s, j: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["order"].alias("order"), *rank(r, j))))
    rows = rows.withColumn("ranked", ranked)
    rows = rows.withColumn("parts", F.transform("ranked", lambda m: F.struct(*[F.filter(m, lambda s: s["order"] == order).alias(kind) for kind, order in _PARTS])))
    near = lambda x, of, kind: F.transform(x[of], lambda s: _nearest(x[kind], s, s[f"n_{kind}"])).alias(f"{of}_{kind}")
    rows = rows.withColumn("paired", F.transform("parts", lambda x: F.struct(*[x[kind].alias(kind) for kind, _ in _PARTS], near(x, "key", "access"), near(x, "key", "endpoint"), near(x, "access", "key"))))
    place = lambda spans, j: F.when(j.isNotNull(), F.struct(F.get(spans, j)["start"].alias("start"), F.get(spans, j)["end"].alias("end")))
    link = lambda x, a, k: F.struct(place(x["access"], a).alias("access"), place(x["key"], k).alias("key"), place(x["endpoint"], F.get(x["key_endpoint"], k)).alias("endpoint"))
    # Each key with its nearest identifier, then each identifier that no key takes with its nearest key; the endpoint is the key's nearest.
    of_keys = lambda x: F.transform(x["key_access"], lambda a, k: F.when(a.isNotNull(), link(x, a, k)))
    # If any key takes an identifier, one of the two keys beside it does.
    taken = lambda x, s, a: F.coalesce(F.get(x["key_access"], s["n_key"] - 1) == a, F.lit(False)) | F.coalesce(F.get(x["key_access"], s["n_key"]) == a, F.lit(False))
    further = lambda x: F.transform(x["access"], lambda s, a: F.when(F.get(x["access_key"], a).isNotNull() & ~taken(x, s, a), link(x, a, F.get(x["access_key"], a))))
    links = F.flatten(F.transform("paired", lambda x: F.array_sort(F.array_compact(F.concat(of_keys(x), further(x))))))
    return rows.withColumn("links", F.coalesce(links, F.array().cast(_LINKS)))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of each text, as id, text, ``found``, an array of (start, order, end, kind) in text order, and ``links``.

    Kinds in order: assign, access, hex (base), key and endpoint (linked).
    ``links`` are the (access, key, endpoint) spans that belong together; the
    endpoint is null where none is near.  An identifier and an endpoint without
    a key are no link.  Of two parts that are as near the earlier one counts.
    Offsets are code points, the end exclusive.  A null text counts as empty and
    has no finds; very long texts are scanned whole, n finds in one costing
    n**1.5; repeated rows are scanned each; an empty table gives an empty
    result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    assign = F.filter(match_spans(text, F.lit(ASSIGN), 2), lambda s: F.length(s["found"]) >= ASSIGN_VALUE)
    found = F.concat(
        _where(text.rlike(ASSIGN), _named(assign, "assign", 0)),
        _where(text.contains("AKIA"), _named(match_spans(text, F.lit(ACCESS)), "access", 1)),
        _where(text.rlike(HEX), _named(match_spans(text, F.lit(HEX)), "hex", 2)),
        F.coalesce(_weak(F.col("links")), F.array().cast(_NONE)),
    )
    rows = _with_links(rows.withColumn("scoped", F.when(text.contains("AKIA") & text.rlike(ACCESS) & text.rlike(BARE_KEY), _scoped(text))))
    return rows.select(F.col(id_col), text, F.array_sort(found).alias("found"), "links")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def joined_links(links: Column) -> Column:
    at = lambda s: F.concat_ws(":", s["start"], s["end"])
    return F.array_join(F.transform(links, lambda x: F.concat_ws("-", at(x["access"]), at(x["key"]), F.when(x["endpoint"].isNotNull(), at(x["endpoint"])))), ",")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "found", "links")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    base = joined(F.filter("found", lambda s: s["order"] < 3))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), joined_links(F.col("links")).alias("links"))
