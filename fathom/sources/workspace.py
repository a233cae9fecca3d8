"""Intermediate tables, in the folder that every executor and the driver share, and rows dealt out to all cores."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_left: list[tuple[SparkSession, str]] = []

#: Up to so many bytes (Spark's estimate) a table is dealt out anew before heavy work on each row.
SPREAD = 1 << 30


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a temporary folder, for sessions of one machine only."""
    found = (spark.conf.get("spark.checkpoint.dir", "") or "").rstrip("/")
    if found:
        return found
    if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: executors and driver need a folder that all of them see")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="fathom-")
    return _own["dir"]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that nothing uses yet; it is removed when Python ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _left.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet; it is removed when Python ends."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Frames that are cached at a time; the oldest goes first, and would be computed again if it were still in use.
CACHED = 4
_cached: list[DataFrame] = []


def cached(df: DataFrame) -> DataFrame:
    """``df`` kept by the executors, in memory or on disk, with its partitioning; for frames that one plan reads more than once."""
    while len(_cached) >= CACHED:
        old = _cached.pop(0)
        if old.sparkSession.sparkContext._jsc is not None:
            old.unpersist()
    _cached.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def dealt(df: DataFrame) -> DataFrame:
    """Few rows, such as hits of queries, dealt out to all cores before heavy work on each."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Small tables dealt out to all cores (``by`` columns): a file of one row group would be read, and worked on, by one task.

    Beyond ``SPREAD`` bytes, or with a file for each core, the scan has tasks enough, and moving the rows would cost more than it gives.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if read_bytes(df) > SPREAD or len(df.inputFiles()) >= cores else df.repartition(cores, *by)


def read_bytes(df: DataFrame) -> int:
    """Spark's estimate of the tables that are read: the one for a join is the product of its sides."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(n).stats().sizeInBytes())) for n in range(leaves.size()))


@atexit.register
def _remove_all() -> None:
    for spark, path in _left:
        try:
            if spark.sparkContext._jsc is not None:
                where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone by now  # noqa: BLE001
            return
