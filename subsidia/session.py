"""Session construction and intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def build_session(master: str = "local[*]", app_name: str = "subsidia", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC timestamps and Arrow on."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    return SparkSession.builder.master(master).appName(app_name).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a local-mode session gets a temporary folder
    of its own; on a cluster that would not be shared, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not _is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="subsidia-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return f"file://{_LOCAL_DIRS[app]}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; a local-mode session removes it when Python ends."""
    path = f"{shared_dir(spark)}/subsidia/{name}-{uuid.uuid4().hex}"
    if _is_local(spark) and (path.startswith("file:") or path.startswith("/")):
        atexit.register(shutil.rmtree, "/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
    return path


#: Rows of a task where ``dealt`` divides rows that are sorted or gathered by key.
TASK_ROWS = 100_000


def task_count(df: DataFrame, per_task: int = TASK_ROWS) -> int:
    """Tasks for the rows of ``df``, ``per_task`` each, and not fewer than there are cores; the rows are counted."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // per_task))


def dealt(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """``df`` divided by hash of the keys into as many tasks as its rows need.

    Adaptive execution sizes tasks by compressed bytes and the number of cores,
    so rows that compress well make few tasks, whose memory grows with the
    table; a stated number it leaves alone.
    """
    return df.repartition(tasks or task_count(df), *keys)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, name: str = "table", arrow_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs at most the tasks it was
    running, and later scans see real file sizes, so the planner's own
    threshold decides which sides are small enough to broadcast.
    ``arrow_rows`` bounds the rows of one Arrow batch while it is written, for
    rows of long texts; the session's setting is left as it was.
    """
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(_BATCH)
    if arrow_rows is not None:
        spark.conf.set(_BATCH, str(min(arrow_rows, int(before)) if int(before) > 0 else arrow_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str = "table", arrow_rows: int | None = None, **sums: Column) -> tuple[DataFrame, Row]:
    """``materialize``, with ``rows`` and further aggregates of what is written, seen on the way and not by another job."""
    seen, wanted = Observation(), [F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in sums.items()]]
    written = materialize(df.observe(seen, *wanted), name, arrow_rows)
    found = seen.get
    if "rows" in found:
        return written, Row(**found)
    return written, written.agg(*wanted).first()  # a plan known to be empty has nothing to observe
