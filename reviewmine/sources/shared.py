"""Cutting lineage with tables written to the shared work folder.

Iterative operators must not grow one endless plan, and they must survive the
loss of executors. So each round is written as Parquet to a folder that all
executors share and read back: nothing is pinned to an executor, a lost task
re-reads a file, and Spark knows the true size of what it reads (which is what
decides about broadcasting it).
"""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: set[str] = set()
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go when the job that wrote them is done


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one in the warehouse, which is shared too."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    local = f"{folder}/{spark.sparkContext.applicationId}".removeprefix("file:")
    if local.startswith("/") and local not in _OWN:
        _OWN.add(local)
        atexit.register(shutil.rmtree, local, ignore_errors=True)
    return folder


def new_path(spark: SparkSession) -> str:
    """A place for a table of this application."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, write it to the shared folder and return a scan of it.

    Nothing reads the shuffles of this job again, so their files do not wait for the driver's garbage collection: the
    disk holds those of one job at a time.
    """
    spark = df.sparkSession
    path, before = new_path(spark), spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more, where they are this application's own."""
    spark = table.sparkSession
    own = f"/{spark.sparkContext.applicationId}/"
    jvm = spark.sparkContext._jvm
    for folder in {file.rpartition("/")[0] for file in table.inputFiles() if own in file}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(spark: SparkSession) -> None:
    """Delete the tables this application has written; results that read them must be saved before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def attach(rows: DataFrame, per_key: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` with a table that has one row per key, for keys of any skew.

    The table is written first. The join then reads two plain inputs, so Spark
    broadcasts the table if its written size allows, and otherwise can split a
    key that holds a large share of the rows over many tasks. It could do
    neither with an aggregate computed inside the join's own stage.
    """
    return rows.join(materialize(per_key), keys, how)


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Hash ``df`` into the session's number of shuffle partitions, if it has fewer, and fewer than there are cores.

    For tables that are small by size but start heavy work: sized by bytes
    alone, they would end up in a few tasks. A large table has enough splits of
    its own and is not moved.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    enough = min(n, df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= enough else df.repartition(n, *keys)
