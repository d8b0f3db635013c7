"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where everything runs in one process (a ``local`` master, as in tests)
    a temporary folder becomes the checkpoint folder; elsewhere executors would
    write to disks of their own, so a session that names no folder is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="metrascope-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def spread(scan: DataFrame, *keys: str, tasks: int = 1) -> DataFrame:
    """The rows of a scan over all cores, ``tasks`` to each, dealt by keys, where its files make fewer than twice as many; where they make enough, as they are.

    For work that costs much more than a shuffle of its input.
    """
    n = scan.sparkSession.sparkContext.defaultParallelism * tasks
    return scan.repartition(n, *keys) if scan.rdd.getNumPartitions() < 2 * n else scan


def stored(spark: SparkSession, path: str):
    """(path, file system) of Hadoop for a folder or file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def written(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders in ``root`` whose writing has ended, in order; a folder of a writer that was lost has no mark of success."""
    path, files = stored(spark, root)
    if not files.exists(path):
        return []
    names = sorted(x.getPath().getName() for x in files.listStatus(path) if x.isDirectory())
    return [x for x in names if files.exists(stored(spark, f"{root}/{x}/_SUCCESS")[0])]


class Workspace:
    """Intermediate tables as Parquet in the shared folder.

    A saved table cuts the lineage: a lost executor costs the tasks that read
    it, never the work that made it. Results read from these tables, so they
    stay until the application ends, which deletes them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path, files = stored(spark, self.path)
        files.deleteOnExit(path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = stored(self.spark, f"{self.path}/{name}")
            files.delete(path, True)
