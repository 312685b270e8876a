"""Tables that a plan reads more than once, and the cluster's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and all of it is one machine, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where unset, a local one is set, if there is no other machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = LOCAL_CHECKPOINTS
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends if not before."""
    path = f"{shared_folder(spark)}/attesta/{name}-{uuid.uuid4().hex}"
    place, files = _files(spark, path)
    files.deleteOnExit(place)
    return path


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    place, files = _files(spark, path)
    files.delete(place, True)


def written(df: DataFrame, name: str, small: bool = True) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage and plans. A table that is small beside the input is
    written by an eighth of the shuffle's tasks.
    """
    spark = df.sparkSession
    path = temporary(spark, name)
    few = df.coalesce(max(8, partitions(spark) // 8)) if small else df
    few.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """Keep ``df`` on the executors' disks, as it is read more than once.

    What a lost executor held is computed again from the inputs; no memory is
    taken, and no file but Spark's own blocks is written.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that no later plan reads."""
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/attesta/" in top:
            delete(df.sparkSession, top)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
