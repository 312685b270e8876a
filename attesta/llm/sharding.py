"""Sharding by jump consistent hashing, with DataFrame functions only.

The id and the number of shards decide; one more shard takes documents only
into itself, as many as an even share. There is no ring and no table: the jumps
are computed from the id by the published linear congruential generator, held
as two 32-bit halves so that no product overflows.

A document's slot in its shard is its rank by (lane, id), the lane being a hash
of the id and of the text modulo a fixed number; ranks are taken within a lane
and moved by the counts of the lanes before it. So no task ranks a whole shard,
whatever the ids' pattern and how many rows share one, and the slots do not
depend on the number of partitions.

Defined results: a null id counts as id -1, a null text as no bytes; rows of
one id are in one shard, with a slot each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _store

#: The multiplier of the published generator, 2862933555777941757, in its 32-bit halves.
_HIGH, _LOW = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF
_MASK = 0xFFFFFFFF


def _low32(x: Column, by: int) -> Column:
    """x * by mod 2**32 for x and by below 2**32."""
    rest = (x * F.lit(by >> 16)).bitwiseAND(F.lit(0xFFFF))
    return (x * F.lit(by & 0xFFFF) + F.shiftleft(rest, 16)).bitwiseAND(F.lit(_MASK))


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """Both halves of key * multiplier + 1 mod 2**64."""
    upper = low * F.lit(_LOW >> 16)
    sums = low * F.lit(_LOW & 0xFFFF) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(sums, 32) + F.shiftright(upper, 16)
    return (carry + _low32(high, _LOW) + _low32(low, _HIGH)).bitwiseAND(F.lit(_MASK)), sums.bitwiseAND(F.lit(_MASK))


def jump(key: Column, shards: int) -> tuple[Column, Column]:
    """The shard of a long key among ``shards``, and among one more."""

    def step(s: Column, i: Column) -> Column:
        high, low = _next(s["high"], s["low"])
        after = F.floor((s["j"] + 1).cast("double") * (F.lit(2.0**31) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(
            high.alias("high"),
            low.alias("low"),
            after.alias("j"),
            F.when(after < shards, after).otherwise(s["at"]).alias("at"),
            F.when(after < shards + 1, after).otherwise(s["grown"]).alias("grown"),
        )
        return F.when(s["j"] <= shards, moved).otherwise(s)

    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(_MASK)).alias("low"),
        F.lit(0).cast("long").alias("j"),
        F.lit(0).cast("long").alias("at"),
        F.lit(0).cast("long").alias("grown"),
    )
    # a jump goes at least one shard further, so this many steps are enough
    steps = F.sequence(F.lit(0), F.lit(shards))
    done = F.aggregate(steps, start, step)
    return done["at"].cast("int"), done["grown"].cast("int")


def sharded(docs: DataFrame, shards: int = 16, lanes: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-1))
    at, grown = jump(F.col("_key"), shards)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        key.alias("_key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).select("*", at.alias("shard"), grown.alias("grown_shard"), F.pmod(F.xxhash64("_key", "size", "text_crc32"), F.lit(lanes)).alias("_lane"))
    rows = _store.kept(rows)
    counts = rows.groupBy("shard", "_lane").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_lane", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_lane").orderBy("_key", "text_crc32", "size")
    # at most shards * lanes rows
    placed = rows.withColumn("_rank", F.row_number().over(within)).join(F.broadcast(offsets), ["shard", "_lane"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_before") + F.col("_rank") - 1).cast("long").alias("slot"),
        "grown_shard",
    )
