"""Tables written to the folder that driver and executors share.

Iterative jobs cut their lineage with a written table, so a lost executor costs
a re-read and not a recomputation of every earlier round.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, whose tasks share it, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is removed at the end of the JVM."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


class Table:
    """A written DataFrame that is removed by ``drop`` or at the end of the JVM."""

    def __init__(self, df: DataFrame, name: str):
        self._spark = df.sparkSession
        self.path = fresh_path(self._spark, name)
        df.write.parquet(self.path)
        self.df = self._spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        place = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back."""
    return Table(df, name).df


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Here what is written leaves no shuffle files; else they stay until the driver happens to collect its garbage, which many rounds can't wait for."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where it comes from fewer files than there are; what is read from many files stays where it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
