"""Exact deduplication with keyed streaming state.

A stream reads one slim row for each document (digest, id and place of its
content) and keeps a state by digest that never expires: the largest id, the
place of that row, and the size of the group.  The state store is RocksDB, on
the executors' disks, with its changes in the shared folder; later batches of
documents continue it.

Digests only propose groups.  The texts of every group of two or more are
read again and grouped by their whole bytes; where one digest has several
texts, its rows get the groups of those texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subsidia.session import materialize, shared_path

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.maintenanceInterval": "15s",
}
#: Digests in one shard of the state, about, and the fewest shards; each is a RocksDB instance of its own with some MB of files.
PER_SHARD, FEWEST_SHARDS = 5_000_000, 24
#: Digests of repeated texts that are broadcast at most, counted first.
MAX_BROADCAST = 500_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def from_files(docs: DataFrame) -> DataFrame:
    """``docs`` as it is if each row's file and place in it are known, else written to the shared folder and read again."""
    if "_metadata" not in docs.columns:
        try:
            docs.select("_metadata.file_path", "_metadata.row_index")
            return docs
        except AnalysisException:
            pass
    return materialize(docs.select(*[F.col(f"`{c}`").alias(_other_name(c)) for c in docs.columns]), "dedup-docs")


def _other_name(column: str) -> str:
    """Another name for a column that would hide the files' metadata."""
    return "metadata of the input" if column == "_metadata" else column


def located(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """The columns with each row's place: its file and row there."""
    return docs.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Documents from files without the rows at the places (file, row) in ``dropped``; columns may have any names."""
    records = located(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")])
    return records.join(dropped, ["file", "row"], "left_anti").select("record.*")


def _shards(spark: SparkSession, slim: DataFrame, state: str) -> int:
    """The number of shards that was fixed when the state began, beside the state, or one by the rows counted now."""
    fixed = f"{state}-shards"
    try:
        return spark.read.schema("shards int").parquet(fixed).first()[0]
    except AnalysisException:
        shards = max(FEWEST_SHARDS, -(-slim.count() // PER_SHARD))
        spark.range(1).select(F.lit(shards).alias("shards")).write.parquet(fixed)
        return shards


def keep_state(spark: SparkSession, slim: str, state: str, out: str, schema, files_per_batch: int | None = None) -> list[int]:
    """Streams the slim rows that are new in folder ``slim`` into the state and writes each batch's changed groups to ``out``.

    Returns the numbers of the batches.  A second call with the same ``state``
    continues where the first one ended.
    """
    shards = _shards(spark, spark.read.schema(schema).parquet(slim), state)
    session, batches = spark.newSession(), []
    for key, value in (_STATE | {"spark.sql.streaming.internal.stateStore.partitions": str(shards)}).items():
        session.conf.set(key, value)
    reader = session.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    groups = reader.parquet(slim).groupBy("digest").agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count("*").alias("group_size"))

    def write(batch: DataFrame, number: int) -> None:
        batches.append(number)
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = groups.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return batches


def group_exact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """Groups of equal texts.

    Returns one row per input row: id, keep_id, group_size, kept, digest, file
    and row.  Of equal texts the row with the largest id is kept; of rows with
    that id, the one at the last place.  Null counts as the empty text, and
    null ids as smaller than all others.  An empty table gives an empty result;
    other columns are ignored.
    """
    spark, docs = docs.sparkSession, from_files(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim_path, out = shared_path(spark, "dedup-slim"), shared_path(spark, "dedup-groups")
    slim = located(docs, [F.col(id_col).alias("id"), digest(text).alias("digest")])
    slim.write.parquet(slim_path)
    slim = spark.read.schema(slim.schema).parquet(slim_path)
    batches = keep_state(spark, slim_path, shared_path(spark, "dedup-state"), out, slim.schema, files_per_batch)
    if not batches:
        return _result(slim.withColumns({"keep": F.struct("id", "file", "row"), "group_size": F.lit(1).cast("bigint")}), id_col)
    groups = spark.read.option("basePath", out).parquet(*[f"{out}/batch={b}" for b in batches])
    if len(batches) > 1:
        groups = groups.groupBy("digest").agg(F.max(F.struct("batch", "keep", "group_size")).alias("g")).select("digest", "g.keep", "g.group_size")
    groups = groups.select("digest", "keep", "group_size")

    hits = materialize(groups.where("group_size > 1").select("digest"), "dedup-hits")
    few = F.broadcast(hits) if hits.count() <= MAX_BROADCAST else hits
    texts = docs.select(digest(text).alias("digest"), text.alias("text")).join(few, "digest", "left_semi")
    bytes_read = texts.groupBy("digest", "text").agg(F.count("*").alias("n"))
    clashing = materialize(bytes_read.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "dedup-clashing")
    rows = slim.join(groups, "digest")
    if not clashing.isEmpty():
        again = located(docs, [F.col(id_col).alias("id"), digest(text).alias("digest"), text.alias("text")]).join(clashing, "digest", "left_semi")
        by_text = again.groupBy("digest", "text").agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count("*").alias("group_size"))
        parted = again.join(by_text, ["digest", "text"]).drop("text")
        rows = rows.join(clashing, "digest", "left_anti").unionByName(parted)
    return _result(rows, id_col)


def _result(rows: DataFrame, id_col: str) -> DataFrame:
    kept = F.struct("id", "file", "row").eqNullSafe(F.col("keep"))
    return rows.select(F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("digest"), "file", "row")


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each text, all columns kept.

    Rows are found again by their place, so rows that come from no file are
    written to the shared folder first.
    """
    found = from_files(docs)
    copies = group_exact(found, id_col=id_col, text_col=text_col).where(~F.col("kept"))
    return without_rows(found, materialize(copies.select("file", "row"), "dedup-dropped")).toDF(*docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = group_exact(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
