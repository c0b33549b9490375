"""Session helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import NullType


def build_session(app: str = "tablework", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent on one machine (tests, a laptop) a temporary folder is chosen once and remembered in the
    session; on a cluster, whose executors would not see it, the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master is {master})")
        configured = tempfile.mkdtemp(prefix="tablework-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run meanwhile go when it ends, not when the driver happens to collect garbage; a submitter's own setting wins."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    given = spark.conf.get(key, "false") != "false"
    if not given:
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        if not given:
            spark.conf.unset(key)


def batches_within(spark: SparkSession, most: int) -> None:
    """Arrow batches of the session go to Python tasks with at most about so many bytes from now on; a lower limit that was given stays.

    A plan reads the limit when it runs, which may be after the operator that needs it has returned, so it is not set back."""
    given = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < given <= most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def checkpointed(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Cut the lineage of ``df``: a table written below the shared folder and read back.

    Survives lost executors, is computed once, and lets each reader take only its columns. Rows of much data need ``group_rows``: a task reads 4,096 rows
    at once, but not beyond the end of a row group, and holds a whole group when it writes."""
    spark = df.sparkSession
    if any(isinstance(f.dataType, NullType) for f in df.schema.fields):
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
        return df.checkpoint(eager=True)
    path = scratch_path(spark, "stage")
    with shuffles_removed(spark):
        (df.write if group_rows is None else df.write.option("parquet.block.row.count.limit", group_rows)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files of a table that ``checkpointed`` has written; nobody may read it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.rpartition("/")[2].startswith("stage-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Workers wait for their next task; what this one has freed goes back to the machine meanwhile."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
