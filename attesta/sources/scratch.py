"""New folders for tables that live as long as the session, where all machines see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, deleted when the session's JVM ends.

    Where that is unset and the session is one machine, as in tests, a temporary
    folder is taken; on a cluster it is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        top = tempfile.gettempdir()
    path = f"{top.rstrip('/')}/attesta/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path
