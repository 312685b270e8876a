"""Evidence store: content addresses, idempotent append, integrity and scans.

Errors are data: checks return the rows that fail them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import derived_id, digest


def content_id(prefix: str, *parts: Column) -> Column:
    """The id of an observation from what was observed."""
    return derived_id(prefix, *parts)


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by ``order``.

    The least row is found by an aggregate, which combines before the shuffle;
    a window would sort every row of a key in one task.
    """
    rest = [c for c in rows.columns if c not in keys]
    least = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return rows.groupBy(*keys).agg(least).select(*[F.col(k) if k in keys else F.col(f"_first.{k}").alias(k) for k in rows.columns])


def duplicates(rows: DataFrame, text: str, order: str) -> DataFrame:
    """Each row with the id of the first row of equal content, and whether it is that row."""
    keyed = rows.withColumn("content_digest", digest(F.coalesce(F.col(text), F.lit(""))))
    first = keyed.groupBy("content_digest").agg(F.min(order).alias("first_id"), F.count("*").alias("copies"))
    return keyed.join(first, "content_digest").withColumn("is_first", F.col(order) == F.col("first_id"))


def append(stored: DataFrame, new: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(to insert, already there, conflicts) of an append that never changes a row.

    Of rows that repeat a key in ``new`` the first by payload is taken, and the
    others with another payload are conflicts.
    """
    marked = new.withColumn("_d", digest(F.col(payload)))
    held = stored.select(F.col(key), digest(F.col(payload)).alias("_held"))
    own = marked.groupBy(key).agg(F.min("_d").alias("_own"))
    seen = marked.join(own, key).join(held, key, "left").withColumn("_keep", F.coalesce("_held", "_own"))
    conflicts = seen.where("_d <> _keep").select(*new.columns)
    same = seen.where("_d = _keep")
    inserted = same.where("_held is null").dropDuplicates([key]).select(*new.columns)
    return inserted, same.where("_held is not null").select(*new.columns), conflicts


def dangling(rows: DataFrame, reference: str, targets: DataFrame, target: str) -> DataFrame:
    """Rows whose reference names no target; a null reference names none."""
    return rows.join(targets.select(F.col(target).alias("_t")).distinct(), rows[reference] == F.col("_t"), "left_anti")


def dangling_elements(rows: DataFrame, references: str, targets: DataFrame, target: str) -> DataFrame:
    """As :func:`dangling` for a column of reference lists: (row columns, missing id)."""
    each = rows.withColumn("missing_id", F.explode(references))
    return dangling(each, "missing_id", targets, target)


def dangling_owner(rows: DataFrame, owner: str, *tables: tuple[DataFrame, str]) -> DataFrame:
    """Rows whose owner is in none of several tables."""
    every = None
    for table, key in tables:
        one = table.select(F.col(key).alias("_o"))
        every = one if every is None else every.unionByName(one)
    return rows.join(every.distinct(), rows[owner] == F.col("_o"), "left_anti")


def other_scope(rows: DataFrame, reference: str, targets: DataFrame, target: str, scope: list[str]) -> DataFrame:
    """Rows whose reference has another scope, such as subject and field."""
    named = targets.select(F.col(target).alias("_t"), *[F.col(c).alias(f"_{c}") for c in scope])
    differs = F.lit(False)
    for c in scope:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(named, rows[reference] == F.col("_t")).where(differs).select(*rows.columns)


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """(key, count) of keys that are not unique."""
    return rows.groupBy(key).agg(F.count("*").alias("count")).where("count > 1")


def tampered(rows: DataFrame, payload: str, stored_digest: str) -> DataFrame:
    """Rows whose payload no longer has its digest."""
    return rows.where(~F.col(stored_digest).eqNullSafe(digest(F.col(payload))))


def scan(rows: DataFrame, time: str, key: str, source: Column | None = None) -> DataFrame:
    """Rows in order of time and id, of one source if given."""
    return (rows if source is None else rows.where(source)).orderBy(time, key)


def positions(rows: DataFrame, partition: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Each row's place within its partition, from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
