"""Connected components of an edge table, without gathering edges anywhere.

Alternating large-star and small-star steps turn every component into a star
around its smallest node. Each step is one aggregation with map-side combining
and one join, so a node with very many edges is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """edges: from the larger node u to the smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Rows (node, component) for every node with an edge to another; component is its smallest node.

    Self loops and null ends are dropped; an empty table gives an empty table.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    start = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = _store.written(start, "edges")
    mark = _mark(now)
    while mark[0]:
        large = _large(now).where("u > v").distinct()
        after = _store.written(_small(large).where("u > v").distinct(), "edges")
        _store.drop(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    got = edges.agg(
        F.count("u"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        F.bit_xor(F.xxhash64("v", "u")),
    ).first()
    return tuple(got)
