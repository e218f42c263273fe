"""URL filters: host and path rules applied by a sort-merge range join.

A host is turned into a canonical key, its labels in reverse order, each
closed by ``\\x01``.  All subdomains of a rule's host then have keys that begin
with the rule's key, so each rule is an interval ``[key, end)`` and any two
intervals are nested or disjoint.  URLs and rules are sorted by key; one sweep
over both keeps a stack of the rules that are open at the current key.

Rules up to ``broadcast_rules`` rows (counted first) go to every task, and the
URLs are sorted inside their scan partitions, without a shuffle.  Larger rule
tables are range-partitioned together with the URLs; a rule is copied to each
range that its interval touches.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RESULT = "host string, path string, rule string, verdict string"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``; A-Z lower-cased, empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """Canonical key: reversed labels, each followed by ``\\x01``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "\x01"), F.lit("\x01"))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (host, path, verdict)."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _keyed_rules(rules: DataFrame) -> DataFrame:
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null and verdict is not null")
    return rules.withColumn("key", host_key(F.col("host")))


class _Sweep:
    """The sweep's state: rules still to open, in key order, and the stack of open ones."""

    def __init__(self, default: str):
        self.default, self.stack = default, []

    def open(self, key: str, host: str, paths: dict[str, str]) -> None:
        while self.stack and self.stack[-1][0] <= key:
            self.stack.pop()
        by_length = sorted({len(p) for p in paths}, reverse=True)
        self.stack.append((key[:-1] + "\x02", host, "." + host, paths, by_length))

    def at(self, key: str) -> None:
        while self.stack and self.stack[-1][0] <= key:
            self.stack.pop()

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        best, found = (-1, -1), (None, self.default)
        for _, rule_host, suffix, paths, lengths in self.stack:
            if host != rule_host and not host.endswith(suffix):
                continue
            for n in lengths:
                if path[:n] in paths and n <= len(path):
                    size = (len(rule_host) + n, len(rule_host))
                    if size > best:
                        best, found = size, (rule_host + path[:n], paths[path[:n]])
                    break
        return found


def _group(rows) -> list[tuple[str, str, dict[str, str]]]:
    """Rules by key; of rules with the same host and path but other verdicts, block wins."""
    by_key: dict[str, tuple[str, dict[str, str]]] = {}
    for key, host, path, verdict in rows:
        paths = by_key.setdefault(key, (host, {}))[1]
        paths[path] = max(verdict, paths.get(path, verdict), key=lambda v: (v == "block", v))
    return sorted((key, host, paths) for key, (host, paths) in by_key.items())


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = 100_000, partitions: int | None = None) -> DataFrame:
    """Verdict of each URL under the longest rule that fits it.

    A rule fits its host and all subdomains when the URL's path starts with the
    rule's path.  Longest means the longest rule string (host and path), then
    the longer host.  URLs that no rule fits get ``default`` and a null rule.

    Returns one row per input row: id, host, path, rule, verdict.  A null URL
    or one without ``://`` has an empty host and path.  Repeated rows are judged
    each; an empty table gives an empty result; other columns are ignored.
    """
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    keyed = _keyed_rules(rules)
    id_type = dict(pages.dtypes)[id_col]
    schema = f"`{id_col}` {id_type}, {_RESULT}"
    few = keyed.limit(broadcast_rules + 1).collect()
    if len(few) <= broadcast_rules:
        grouped = _group([(r.key, r.host, r.path, r.verdict) for r in few])

        def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state, i, last = _Sweep(default), 0, None
            for batch in batches:
                found = []
                for key, host, path in zip(batch["key"], batch["host"], batch["path"]):
                    if key != last:
                        while i < len(grouped) and grouped[i][0] <= key:
                            state.open(*grouped[i])
                            i += 1
                        state.at(key)
                        last = key
                    found.append(state.judge(host, path))
                yield pd.DataFrame({id_col: batch["id"], "host": batch["host"], "path": batch["path"], "rule": [r for r, _ in found], "verdict": [v for _, v in found]})

        return urls.sortWithinPartitions("key").mapInPandas(sweep, schema)
    return _ranged(urls, keyed, id_col, schema, default, partitions)


def _ranged(urls: DataFrame, keyed: DataFrame, id_col: str, schema: str, default: str, partitions: int | None) -> DataFrame:
    """Both sides by key range.  The path and a hash of the row follow the host's key, so one host can span many ranges."""
    spark = urls.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = urls.withColumn("at", F.concat("key", F.lit("\x00"), "path", F.lit("\x00"), F.lpad(F.hex(F.xxhash64("id", "path")), 16, "0")))
    share = min(1.0, 100.0 * n / max(1, urls.count()))
    sample = sorted(r.at for r in urls.where(F.pmod(F.xxhash64("at"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) or 1)).select("at").collect())
    bounds = [sample[len(sample) * k // n] for k in range(1, n)] if sample else []

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["part"] = [bisect.bisect_right(bounds, x) for x in batch["at"]]
            yield batch

    def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["part"] = [list(range(bisect.bisect_right(bounds, k), bisect.bisect_right(bounds, k[:-1] + "\x02") + 1)) for k in batch["key"]]
            yield batch.explode("part").astype({"part": "int32"})

    id_type = dict(urls.dtypes)["id"]
    columns = f"id {id_type}, host string, path string, key string, at string, verdict string"
    left = urls.select("id", "host", "path", "key", "at", F.lit(None).cast("string").alias("verdict")).mapInPandas(ranges, columns + ", part int")
    right = keyed.select(F.lit(None).cast(id_type).alias("id"), "host", "path", "key", F.col("key").alias("at"), "verdict").mapInPandas(copies, columns + ", part int")
    events = left.unionByName(right).repartition(n, "part").sortWithinPartitions("part", "at", F.col("verdict").asc_nulls_last())

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, part, pending = _Sweep(default), None, []
        for batch in batches:
            out = []
            for ident, host, path, key, verdict, p in zip(batch["id"], batch["host"], batch["path"], batch["key"], batch["verdict"], batch["part"]):
                if p != part:
                    state, part, pending = _Sweep(default), p, []
                if verdict is not None:
                    if pending and pending[0][0] != key:
                        state.open(*_group(pending)[0])
                        pending = []
                    pending.append((key, host, path, verdict))
                    continue
                if pending:
                    state.open(*_group(pending)[0])
                    pending = []
                state.at(key)
                out.append((ident, host, path, *state.judge(host, path)))
            yield pd.DataFrame(out, columns=[id_col, "host", "path", "rule", "verdict"])

    return events.mapInPandas(sweep, schema)


#: The rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark, RULES))


OP1_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT u.page_id, u.host, u.path, r.h || r.p AS rule, r.v AS v,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.h || r.p) DESC NULLS LAST, length(r.h) DESC) AS k
  FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
