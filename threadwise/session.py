"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Settings every job relies on. Partition counts are left to the cluster and to AQE.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A job's shuffle files go when it ends, not when the driver happens to collect its garbage:
    # plans of several jobs pass tables on through written files.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Texts travel to Python in small batches, so that long ones do not fill a worker's memory.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators expect."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@functools.cache
def _local_scratch() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="threadwise-")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors can reach.

    A cluster names it in ``spark.checkpoint.dir``; a temporary folder of one machine is refused
    there. Only a local session, as in tests, may fall back to a scratch folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.startswith("local")
    if folder:
        path = re.sub("^file:/*", "/", folder)
        if not local and path.startswith((tempfile.gettempdir() + "/", "/tmp/", "/var/tmp/")):
            raise ValueError(f"{folder} is a temporary folder of one machine")
        return folder.rstrip("/")
    if not local:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_scratch().name


# The folders written inside ``passing_tables``, if any.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing_tables(spark: SparkSession):
    """Tables that ``cut_lineage`` writes inside go at the end, so nothing may read them later."""
    outer = _PASSING.set([])
    try:
        yield
    finally:
        folders = _PASSING.get()
        _PASSING.reset(outer)
        for folder in folders:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            files.delete(path, True)


def _folder(spark: SparkSession) -> str:
    folder = f"{shared_folder(spark)}/threadwise-{uuid.uuid4().hex}"
    if _PASSING.get() is not None:
        _PASSING.get().append(folder)
    return folder


def cut_lineage(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table.

    A lost executor then costs a re-read instead of a recomputation, and a table used several
    times is computed once. ``schema`` may name another kind with the same columns in the file.
    """
    path = _folder(df.sparkSession)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def settle(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """``cut_lineage`` of the table that ``build`` returns, without the tables written on its way.

    The way of a long plan then takes the disk of its widest step, not that of all steps.
    """
    path = _folder(spark)
    with passing_tables(spark):
        df = build()
        df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def task_count(df: DataFrame, amount: int, per_task: int) -> int:
    """Partitions for a table of ``amount``: the session's number, more where the table is larger."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, -(-amount // per_task))


def spread(df: DataFrame) -> DataFrame:
    """Give every shuffle partition a share of a table that arrives in fewer files than those.

    Text work is bound by the processor, so a small table in one file is worth a shuffle. Tables
    with enough files are left alone.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if len(df.inputFiles()) >= partitions else df.repartition(partitions)
