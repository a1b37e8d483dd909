"""Paths that the driver and all executors share, and sinks and sources of records as JSON lines or Parquet."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Whether a statement's shuffle files go when it ends.
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


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def clean(spark: SparkSession) -> int:
    """Delete all that this session has put into the shared folder, once nothing reads its results any more; how many paths these were. Results
    that a query has returned but not written elsewhere read these tables, so queries can't delete them themselves."""
    made = _made.pop(spark.sparkContext.applicationId, [])
    for path in made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(made)


def save(df: DataFrame, path: str) -> None:
    """Write rows to a path. The statement's shuffle files go when it ends; Spark would keep them until the driver collects garbage."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as a table in the shared folder and read from there, so that what made them runs once."""
    path = folder(df.sparkSession, name)
    save(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_from(df: DataFrame) -> tuple | None:
    """What tells whether another plan of this session gives the same rows: the plan, and the files it reads with their sizes and times. None if
    it doesn't read files alone."""
    files, spark = sorted(df.inputFiles()), df.sparkSession
    if not files:
        return None
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    seen = []
    for file in files:
        path = jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(conf).getFileStatus(path)
        seen.append((file, status.getLen(), status.getModificationTime()))
    return spark.sparkContext.applicationId, df.semanticHash(), hash(tuple(seen)), len(seen)


def write_records(df: DataFrame, path: str, *, by: str = "deal", kind: str = "json", mode: str = "overwrite") -> None:
    """Records as one folder per deal."""
    df.write.mode(mode).partitionBy(by).format(kind).save(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, *, kind: str = "json", deals: list | None = None, by: str = "deal") -> DataFrame:
    """Records of the given schema; only the given deals' folders are read."""
    df = spark.read.schema(schema).format(kind).load(path)
    return df if deals is None else df.filter(F.col(by).isin(deals))


def fingerprint(df: DataFrame, *order: str) -> str:
    """SHA-256 over the rows as canonical JSON. Rows are hashed where they are; only hashes of groups of rows are put in order,
    by prefix, so that no task holds all of them."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    rows = df.select(row.alias("h")).withColumn("p", F.substring("h", 1, 4))
    groups = rows.groupBy("p").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return groups.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("p", "h"))), ""), 256)).first()[0]  # 65,536 groups at most


def masked(conf: dict[str, str]) -> dict[str, str]:
    """Settings for printing: values of secrets hidden."""
    return {k: "***" if any(s in k.lower() for s in ("key", "secret", "password", "token")) and v else v for k, v in conf.items()}


def setting(conf: dict[str, str], name: str, default):
    """A typed setting: blank is unset, what can't be read is the default."""
    raw = (conf.get(name) or "").strip()
    if not raw:
        return default
    if isinstance(default, bool):
        return raw.lower() in ("1", "true", "yes", "on")
    try:
        return type(default)(raw)
    except ValueError:
        return default
