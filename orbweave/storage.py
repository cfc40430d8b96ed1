"""Shared intermediate storage: how the engine cuts lineage so that jobs outlive their executors.

Every intermediate goes, as Parquet, under the folder named by ``spark.checkpoint.dir``, which all
executors and the driver share. Where the session names none, only a local session (tests, one machine) gets a folder of
its own, removed when its process ends; on a cluster that is an error, since executors would write to their own disks.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="orbweave-checkpoint-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(f"file://{own}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path of its own under the shared folder."""
    return f"{shared_dir(spark)}/orbweave/{label}-{uuid.uuid4().hex}"


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """While it is open, jobs of the session send ``size`` bytes to Python at a time, whatever the length of their rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, label: str, by: tuple[str, ...] = (), batch: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a durable cut of its lineage. ``by`` names partition columns,
    ``batch`` the bytes of an Arrow batch where the session's are too many."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    with batches_of(spark, batch) if batch else nullcontext():
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    for kept in _open:
        kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


_open: list[list[str]] = []


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Everything that ``materialize`` writes inside is deleted at the end: for callers that have written their result."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield
    finally:
        _open.remove(paths)
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, through Hadoop's file system of that path."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
