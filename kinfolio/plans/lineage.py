"""Cutting lineage through the shared folder that the cluster names.

``spark.checkpoint.dir`` is the only place that the driver and all executors
see, so intermediate tables go there as Parquet: they survive the loss of any
executor, are compressed, and keep their statistics for the planner.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where it is unset
    and all tasks run on this machine."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    own = spark.conf.get("kinfolio.shared.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="kinfolio-")
        spark.conf.set("kinfolio.shared.dir", own)
    return own.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, among the tables that were cut."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession) -> str:
    scope = spark.conf.get("kinfolio.scope", "")
    return f"{shared_dir(spark)}/kinfolio/{spark.sparkContext.applicationId}" + (f"/{scope}" if scope else "")


@contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[None]:
    """What is cut in here goes when it ends; for work that repeats, as a stream's batches do."""
    spark.conf.set("kinfolio.scope", f"{name}-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        clear(spark)
        spark.conf.unset("kinfolio.scope")


def clear(spark: SparkSession) -> bool:
    """Removes all that this application has cut (in a scope: what was cut there); call it when
    no result that is still to be read depends on it. True if there was anything."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
