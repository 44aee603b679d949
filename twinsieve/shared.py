"""Tables that cut lineage, kept in the folder the cluster shares.

``spark.checkpoint.dir`` names the shared folder. Where it is unset and Spark runs on one machine a
temporary folder is used, removed when Python ends; on a cluster the setting has to be there.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_made: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared one; nothing is created yet."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines of the cluster share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="twinsieve-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        base = f"file://{_local[app]}"
    path = f"{base.rstrip('/')}/twinsieve-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark reads; nothing happens where there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _made:
        _made.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_twinsieve_path", None)
        if path:
            remove(df.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Delete every folder this process made and did not discard; call it once no result of the library is read any more."""
    for path in list(_made):
        remove(spark, path)


BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python BATCH_ROWS at a time, unless the session names a number of its own: Spark's 10,000 whole texts are too much for an executor's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Actions inside remove their shuffle files as they end, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Later reads cost a scan, never a recomputation, and survive the loss of any executor.
    """
    spark = df.sparkSession
    folder = work_dir(spark)
    with freeing_shuffles(spark):
        df.write.parquet(f"{folder}/{tag}")
    out = spark.read.schema(df.schema).parquet(f"{folder}/{tag}")
    out._twinsieve_path = folder
    return out
