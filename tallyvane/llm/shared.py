"""The folder that the driver and all executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Whether a statement's shuffle files go when it ends; Spark keeps them until the driver collects garbage otherwise.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Paths that this process has made, by application.
_made: dict[str, list[str]] = {}


@lru_cache(maxsize=1)
def _own() -> str:
    """This process's own folder, for sessions that name none."""
    return tempfile.mkdtemp(prefix="shared-")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where that is unset and all tasks run on this machine, as in tests, a
    local one; on a cluster it must be set."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = _own()
    if "://" not in top:
        top = f"file://{top}"
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean(spark: SparkSession) -> int:
    """Delete all that this session has put into the shared folder, once nothing reads its results any more; how many paths these were. Results
    that a query has returned but not written elsewhere read these tables, so queries can't delete them themselves."""
    made = _made.pop(spark.sparkContext.applicationId, [])
    for path in made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(made)


def give_back() -> None:
    """Return to the system what this Python worker has freed. Workers live on from task to task, and what large arrays have left in their
    heaps counts against the executor all the while."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows, written as a table in the shared folder and read from there: what made them isn't run again, and an
    executor that is lost takes nothing with it. Shuffle files of the steps that made them are deleted once they are written."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more, and let the driver collect what it holds of finished steps, so that their
    shuffle files go, too."""
    for table in tables:
        files = table.inputFiles()
        if files:
            jvm = table.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()
