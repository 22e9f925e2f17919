"""Session helpers: reading a table folder, and cutting lineage in shared storage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, wherever they run; once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is taken in local mode only: executors on other machines could not
    read it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if context.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


class Written:
    """A table written to the shared folder: ``df`` reads it, ``drop`` removes its files when it is superseded.

    ``told`` are aggregates of its rows by name, taken while they are written; ``values`` has them.
    """

    def __init__(self, df: DataFrame, **told: Column) -> None:
        spark = df.sparkSession
        self.path = f"{shared_folder(spark)}/tallyloom-{uuid.uuid4().hex}"
        seen = Observation()
        (df.observe(seen, *[c.alias(name) for name, c in told.items()]) if told else df).write.parquet(self.path)
        self.values = seen.get if told else {}
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        context = self.df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage: written to the shared folder now, read from there afterwards."""
    return Written(df).df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    For inputs of few files whose rows are expensive to process; larger inputs stay as they are scanned.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
