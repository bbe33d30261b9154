"""Tables that cut a lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and the master is local (tests) a temporary one is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.mkdtemp(prefix="strataseek-")
        atexit.register(shutil.rmtree, _LOCAL[key], ignore_errors=True)
    return f"file://{_LOCAL[key]}"


def new_dir(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/strataseek/{what}-{uuid.uuid4().hex}"
    for held in _OPEN[-1:]:
        held.append(path)
    return path


def stash(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that
    outlives any executor."""
    path = new_dir(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stashed inside is removed at the end, so only what was written elsewhere
    may be read after it."""
    _OPEN.append([])
    try:
        yield
    finally:
        remove(spark, _OPEN.pop())
