"""Reading tables and cutting lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`; a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, row_id: str) -> DataFrame:
    """df, a scan, as at least as many partitions as the session has cores, for work that is heavy per row.

    A file of one row group is read by one task, however many cores there are. Scans of fewer partitions than cores, and
    only those, are shuffled by row_id: at most a partition's bytes (spark.sql.files.maxPartitionBytes) per core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, row_id) if df.rdd.getNumPartitions() < cores else df


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where none is set, a local master (tests) gets a folder of its own; on a cluster that is an error, since executors
    cannot share a folder of the driver's machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether path is a folder, as the file system that Spark reads it from sees it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
