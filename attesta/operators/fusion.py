"""Fusion of candidate facts: unanimous values become canonical, others conflict.

Support counts and the majority are diagnostics; they never decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fusion_id

#: How a canonical fact was resolved, and why a conflict is one.
METHOD = "unanimous-effective-value-v1"
RATIONALE = "candidate effective values disagree; V1 does not choose majority truth"


def supports(facts: DataFrame, value: str = "value_key", subject: str = "subject_id", field: str = "field_name", fact: str = "fact_id", evidence: str | None = None) -> DataFrame:
    """A row for each value of a subject's field: its facts, evidence, count and share.

    The share needs the group's total, which is summed from the supports and
    joined back, so facts are shuffled once.
    """
    found = [F.sort_array(F.collect_list(fact)).alias("fact_ids"), F.count("*").alias("support_count")]
    if evidence:
        found.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list(evidence)))).alias("evidence_ids"))
    own = facts.groupBy(subject, field, value).agg(*found)
    totals = own.groupBy(subject, field).agg(F.sum("support_count").alias("_total"))
    return own.join(totals, [subject, field]).withColumn("support_ratio", F.col("support_count") / F.col("_total")).drop("_total")


def outcomes(facts: DataFrame, value: str = "value_key", subject: str = "subject_id", field: str = "field_name") -> DataFrame:
    """A row for each subject's field: status, number of values and facts, and the majority.

    One aggregate by value and one by field; the second finds the value of most
    facts, of equal ones the smallest.
    """
    by_value = facts.groupBy(subject, field, value).agg(F.count("*").alias("_n"))
    return (
        by_value.groupBy(subject, field)
        .agg(
            F.count("*").alias("distinct_values"),
            F.sum("_n").alias("candidates"),
            F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_top"),
        )
        .select(
            subject,
            field,
            F.when(F.col("distinct_values") == 1, "CANONICAL").otherwise("CONFLICT").alias("status"),
            "distinct_values",
            "candidates",
            F.col("_top.v").alias("majority_value"),
            (-F.col("_top.n") / F.col("candidates")).alias("majority_ratio"),
        )
    )


def fused(facts: DataFrame, value: str = "value_key", subject: str = "subject_id", field: str = "field_name", fact: str = "fact_id", evidence: str = "evidence_ids", time: str = "observed_at") -> DataFrame:
    """Canonical facts and conflicts with their ids, provenance and evidence.

    ``value`` is the typed key of the effective value.
    """
    groups = facts.groupBy(subject, field).agg(
        F.sort_array(F.collect_list(fact)).alias("candidate_fact_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(evidence)))).alias("evidence_ids"),
        F.max(time).alias("generated_at"),
        F.min(value).alias("_low"),
        F.max(value).alias("_high"),
    )
    one = F.col("_low") == F.col("_high")
    args = (F.col(subject), F.col(field), F.col("candidate_fact_ids"))
    return groups.select(
        subject,
        field,
        F.when(one, "CANONICAL").otherwise("CONFLICT").alias("status"),
        F.when(one, F.col("_low")).alias("value_key"),
        "candidate_fact_ids",
        "evidence_ids",
        F.when(one, F.col("generated_at")).alias("generated_at"),
        F.when(one, fusion_id("canonical:fusion:v1", *args, F.col("_low"))).alias("canonical_fact_id"),
        F.when(one, fusion_id("prov:fusion:v1", *args, F.col("_low"))).alias("provenance_id"),
        F.when(~one, fusion_id("conflict:fusion:v1", *args)).alias("conflict_id"),
        F.when(one, METHOD).alias("resolution_method"),
        F.when(~one, RATIONALE).alias("rationale"),
    )


def improper(facts: DataFrame, fact: str = "fact_id") -> DataFrame:
    """Fact ids that occur more than once, which no fusion accepts."""
    return facts.groupBy(fact).agg(F.count("*").alias("count")).where("count > 1")


def fused_by_id(facts: DataFrame, ids: DataFrame, fact: str = "fact_id", **names: str) -> tuple[DataFrame, DataFrame]:
    """(fusion of the listed facts, listed ids that name none)."""
    wanted = ids.select(F.col(fact)).distinct()
    return fused(facts.join(wanted, fact, "left_semi"), fact=fact, **names), wanted.join(facts.select(fact), fact, "left_anti")
