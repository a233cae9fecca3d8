"""Tables that cut lineage, in the folder that every executor and the driver share.

The folder is ``spark.checkpoint.dir`` of the session. Where that is unset, a session with a local
master (tests on one machine) gets a temporary folder, and any other is refused. Tables are plain Parquet, so that a lost executor costs
nothing but the task it was running.
"""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.sources import workspace

_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI, without a slash at its end."""
    return workspace.folder(spark)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; it is removed when Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a frame over the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table of ``materialize`` that no later plan reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _left:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the JVM may be gone by now  # noqa: BLE001
            return


#: Rows that go to Python at once where they carry whole texts.
TEXTS = 1000


def limit_batches(spark: SparkSession, rows: int = TEXTS) -> None:
    """From now on rows go to Python in batches of at most ``rows``.

    For operators whose plans run later than they are made; a worker holds one batch, and texts are
    of any length. The setting of the session is lowered, never raised.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with lines put before it where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def least_by_hash(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` rows of the smallest hash of ``key``, or all if there are fewer; ``rows`` is a written table.

    The rows are counted, and only those under a hash below which somewhat more than ``k`` are expected
    go on to be sorted, so that no task hands on more than its share. If these are too few after all
    (keys that repeat very often), all go on.
    """
    hashed, n = F.xxhash64(key), rows.count()
    part = (k + 8 * k**0.5 + 64) / max(1, n)
    if part < 1:
        below = rows.where(hashed < F.lit(int(part * 2**64) - 2**63))
        rows = below if below.count() >= k else rows
    return rows.orderBy(hashed, key).limit(k)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Within this, rows go to Python in batches of at most ``rows``; for rows that carry whole texts or sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows of a key table that may be broadcast: at 8 to 24 bytes a key, less than 50 MB.
BROADCAST_KEYS = 2_000_000


def keyed_join(df: DataFrame, keys: DataFrame, on: str, how: str, limit: int = BROADCAST_KEYS) -> DataFrame:
    """``left_semi`` or ``left_anti`` join against a written key table.

    The table is counted first. Up to ``limit`` rows it is broadcast, so that the wide side stays
    where it is; beyond it both sides are shuffled.
    """
    if keys.count() <= limit:
        keys = F.broadcast(keys)
    return df.join(keys, on, how)
