"""Rules that a plan keeps while it runs: a row that breaks one fails the query, by the rule's name.

A failing expression is not deterministic to the optimiser, so no rule of it
takes the check away, even where nothing reads the rows' columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def required(rows: DataFrame, name: str, rule: Column, key: Column | None = None) -> DataFrame:
    """The rows as they are; one for which the rule does not hold, or is null, is an error that names it."""
    what = F.lit(name) if key is None else F.concat(F.lit(f"{name}: "), F.coalesce(key.cast("string"), F.lit("null")))
    return rows.where(F.when(F.coalesce(rule, F.lit(False)), True).otherwise(F.raise_error(what).cast("boolean")))


def at_most(rows: DataFrame, most: int, name: str) -> DataFrame:
    """The rows as they are, if there are no more than ``most``, which is a small number; never fewer rows than there are."""
    if most < 1:
        raise ValueError(f"{name} must be >= 1")
    few = rows.limit(most + 1).withColumn("_nth", F.row_number().over(Window.orderBy(F.lit(1))))
    return required(few, f"more than {name}={most}", F.col("_nth") <= most).drop("_nth")


def while_at_most(rows: DataFrame, others: DataFrame, most: int, name: str) -> DataFrame:
    """The rows as they are, if another table has no more than ``most`` rows.

    The other table's count, one row, goes beside each row: a join that only brings
    checked rows would be left out of a plan that needs none of their columns.
    """
    if most < 1:
        raise ValueError(f"{name} must be >= 1")
    count = others.limit(most + 1).agg(F.count("*").alias("_n"))
    return required(rows.crossJoin(F.broadcast(count)), f"more than {name}={most}", F.col("_n") <= most).drop("_n")


def unique(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The rows as they are; a key that occurs twice is an error. A null key is one, too."""
    counts = rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    both = rows.join(counts, rows[key].eqNullSafe(F.col("_k")))
    return required(both, name, (F.col("_n") == 1) & F.col("_k").isNotNull(), F.col("_k")).drop("_k", "_n")


def sound_plan(plan: DataFrame) -> DataFrame:
    """Planned actions, each once, whose disposition agrees with what they carry."""
    ready = F.col("disposition") == "READY"
    filled = F.col("action_kind").isNotNull() & F.col("cache_key").isNotNull() & (F.col("max_attempts") >= 1) & (F.col("min_interval_seconds") >= 0)
    empty = F.col("action_kind").isNull() & F.col("cache_key").isNull()
    told = required(plan, "disposition is READY or BLOCKED", F.col("disposition").isin("READY", "BLOCKED"), F.col("action_id"))
    told = required(told, "a READY action has a kind, a cache key, attempts and an interval", ~ready | filled, F.col("action_id"))
    told = required(told, "a BLOCKED action has neither kind nor cache key", ready | empty, F.col("action_id"))
    return unique(told, "action_id", "an action is planned twice")


def sound_results(results: DataFrame) -> DataFrame:
    """Normalization results: a success has a value and a rule, another outcome has no value."""
    good = F.col("status") == "SUCCESS"
    return required(results, "a success has a value and a rule, and nothing else has a value", F.when(good, F.col("value").isNotNull() & F.col("rule_id").isNotNull()).otherwise(F.col("value").isNull()))


def sound_batch(hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """Search hits of one batch: named, placed from 1, and each with evidence of the same batch."""
    text = lambda c: F.coalesce(F.col(c).rlike(r"(?U)\S"), F.lit(False))
    for c in ("query_id", "title", "url", "evidence_id"):
        hits = required(hits, f"{c} must be non-blank", text(c))
    hits = required(hits, "position must be >= 1 when supplied", F.col("position").isNull() | (F.col("position") >= 1))
    there = evidence.select(F.col("evidence_id").alias("_e")).distinct().withColumn("_there", F.lit(True))
    both = hits.join(there, hits["evidence_id"] == F.col("_e"), "left")
    return required(both, "every search hit must reference evidence returned in the same batch", F.col("_there"), F.col("evidence_id")).drop("_e", "_there")
