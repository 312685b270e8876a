"""What labelled pairs say of company resolution: one table that anyone with labelled rows can make again.

Labelled pairs have an id, a label and two records as structs l and r with any
of the columns that ``resolution.prepared`` takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import resolution as rs

SCHEMA = "id string, label boolean, left {0}, right {0}".format("struct<name: string, registry_id: string, domain: string, phone: string, address: string, city: string, state: string, cnae: string>")
THRESHOLDS = tuple(x / 100 for x in range(70, 97, 2))


def read(spark: SparkSession, path: str, namespace: str = "br:cnpj") -> DataFrame:
    """(id, label, side, record columns) of a JSON array of labelled pairs; a registry id without namespace gets one."""
    pairs = spark.read.schema(SCHEMA).json(path, multiLine=True)
    each = pairs.select("id", "label", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("x")) for s in ("left", "right")])).alias("y"))
    rows = each.select("id", "label", F.col("y.side").alias("side"), "y.x.*")
    return rows.withColumn("registry_namespace", F.when(F.col("registry_id").isNotNull(), namespace))


def company_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs with label, l and r; all prepared records), a record being named by pair and side."""
    named = rows.withColumn("record_id", F.concat_ws(":", "id", "side"))
    records = rs.prepared(named)
    labels = rows.select("id", "label").distinct().select("label", F.concat_ws(":", "id", F.lit("left")).alias("left_id"), F.concat_ws(":", "id", F.lit("right")).alias("right_id"))
    return rs.with_sides(labels, records), records


def company_report(rows: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(strategy, threshold, tp, fp, tn, fn, precision, recall, f1, false_merge_rate) of labelled pairs."""
    pairs, _ = company_pairs(rows)
    known = rs.features(pairs)
    tries = [(s, None, rs.matched(s)) for s in ("REGISTRY_ONLY", "EXACT_EVIDENCE")] + [("WEIGHTED", t, rs.matched("WEIGHTED", t)) for t in thresholds]
    each = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(t).cast("double").alias("threshold"), m.alias("matched")) for s, t, m in tries])
    flat = known.select("label", F.explode(each).alias("x")).select("label", "x.*")
    return rs.confusion(flat, F.col("label"), F.col("matched"), ["strategy", "threshold"])


def company_triage(rows: DataFrame) -> DataFrame:
    """(disposition, duplicates, negatives) of labelled pairs."""
    pairs, _ = company_pairs(rows)
    return rs.triaged(pairs).groupBy("disposition").agg(F.count_if(F.col("label")).alias("duplicates"), F.count_if(~F.col("label")).alias("negatives"))


def company_blocking(rows: DataFrame) -> DataFrame:
    """Recall and reduction of the blocking keys over all records of the labelled pairs."""
    pairs, records = company_pairs(rows)
    truth = pairs.where("label").select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"))
    return rs.blocking_quality(rs.blocked_pairs(records.withColumn("keys", rs.keys())), truth, records.count())
