"""Streaming forms of the evidence store, beyond what the batch engine asks for.

A stream of captured pages is made unique by content within a watermark, or
appended exactly once to a ledger, whose manifest names each micro-batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import derived_id
from ..sources.ledger import Ledger


def captured(spark: SparkSession, path: str, schema, files: int = 16) -> DataFrame:
    """A stream of captured files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def addressed(rows: DataFrame, url: str = "url", body: str = "html", prefix: str = "evidence") -> DataFrame:
    return rows.withColumn("evidence_id", derived_id(prefix, F.col(url), F.col(body)))


def once(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Each content once within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["evidence_id"])


def counted(stream: DataFrame, time: str, delay: str, width: str, *by: str) -> DataFrame:
    """Tumbling counts; late rows beyond the delay are dropped."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def appended(stream: DataFrame, ledger: Ledger, checkpoint: str, by: str | None = None) -> StreamingQuery:
    """Append to a ledger what it does not hold yet.

    A micro-batch reads only the buckets that its keys fall into. One that is run
    again after a failure has the id of the first try, and adds nothing if that was
    committed. ``by`` names the stream, where several share a ledger.
    """
    name = by or uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex
    key = ledger.manifest().key

    def add(batch: DataFrame, number: int) -> None:
        Ledger(batch.sparkSession, ledger.folder).append(batch.dropDuplicates([key]), f"{name}-{number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
