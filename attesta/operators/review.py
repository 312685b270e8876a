"""Review items from ambiguous records, merged into one ordered queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hashing import digest, joined


def _items(rows: DataFrame, kind: str, priority: Column, records: Column, reason: Column, evidence: Column | None = None) -> DataFrame:
    """Items of one kind; the id is that of kind, records and reason, so evidence does not change it."""
    clean = tx.collapse(reason)
    none = F.array().cast("array<string>")
    proof = none if evidence is None else F.array_sort(F.array_distinct(F.filter(F.transform(evidence, F.trim), lambda e: e != "")))
    return rows.select(
        F.concat(F.lit("review:v1:"), digest(joined(F.concat(F.array(F.lit(kind)), records, F.array(clean))))).alias("review_id"),
        F.lit(kind).alias("kind"),
        priority.alias("priority"),
        records.alias("record_ids"),
        clean.alias("reason"),
        proof.alias("evidence_ids"),
    )



def company_matches(pairs: DataFrame) -> DataFrame:
    """Pairs (left_id, right_id, disposition, reasons) that triage sent to review."""
    rows = pairs.where("disposition = 'REVIEW'")
    reason = F.concat(F.lit("company ER requires review: "), F.array_join("reasons", "; "))
    return _items(rows, "COMPANY_MATCH", F.lit("NORMAL"), F.array_sort(F.array("left_id", "right_id")), reason)


def person_matches(pairs: DataFrame) -> DataFrame:
    """Pairs (left_id, right_id, company_id, reason, evidence_ids) of unresolved people."""
    rows = pairs.where((F.col("left_id") != F.col("right_id")) & (F.size("evidence_ids") > 0))
    records = F.concat(F.array("company_id"), F.array_sort(F.array("left_id", "right_id")))
    return _items(rows, "PERSON_MATCH", F.lit("NORMAL"), records, F.concat(F.lit("person identity unresolved: "), "reason"), F.col("evidence_ids"))


def conflicts(rows: DataFrame) -> DataFrame:
    """Open conflicts (conflict_id, subject_id, field_name, status, candidate_fact_ids, high_impact, evidence_ids)."""
    records = F.concat(F.array("subject_id", "conflict_id"), F.array_sort("candidate_fact_ids"))
    priority = F.when(F.col("high_impact"), "HIGH").otherwise("NORMAL")
    return _items(rows.where("status = 'OPEN'"), "DATA_CONFLICT", priority, records, F.concat(F.lit("open field conflict: "), "field_name"), F.col("evidence_ids"))


def uncertain_contacts(rows: DataFrame) -> DataFrame:
    """Contacts (contact_id, owner_id, status, evidence_ids) that are only discovered, or unknown."""
    some = rows.where(F.col("status").isin("DISCOVERED", "UNKNOWN"))
    return _items(some, "CONTACT", F.lit("NORMAL"), F.array("owner_id", "contact_id"), F.concat(F.lit("uncertain contact state: "), "status"), F.col("evidence_ids"))


def qualifications(rows: DataFrame) -> DataFrame:
    """Leads (lead_id, company_id, qualification_status, qualification_reasons, high_value) that are valuable and unknown."""
    some = rows.where((F.col("qualification_status") == "UNKNOWN") & F.col("high_value"))
    known = F.array_join(F.filter("qualification_reasons", lambda r: F.trim(r) != ""), "; ")
    why = F.when(known != "", known).otherwise("qualification policy/evidence remains unresolved")
    return _items(some, "QUALIFICATION", F.lit("HIGH"), F.array("company_id", "lead_id"), F.concat(F.lit("high-value qualification ambiguity: "), why))


def queue(*items: DataFrame) -> DataFrame:
    """Items merged by id: the highest priority and all evidence, in order of priority, kind and id."""
    every = items[0]
    for other in items[1:]:
        every = every.unionByName(other)
    merged = every.groupBy("review_id").agg(
        F.first("kind").alias("kind"),
        F.min("priority").alias("priority"),  # HIGH is before NORMAL
        F.first("record_ids").alias("record_ids"),
        F.first("reason").alias("reason"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"),
    )
    return merged.orderBy("priority", "kind", "review_id")


def collisions(items: DataFrame) -> DataFrame:
    """Ids that stand for items of different meaning."""
    return items.groupBy("review_id").agg(F.count_distinct("kind", "record_ids", "reason").alias("meanings")).where("meanings > 1")


def counts(items: DataFrame) -> DataFrame:
    return items.agg(F.count_if(F.col("priority") == "HIGH").alias("high_priority"), F.count_if(F.col("priority") == "NORMAL").alias("normal_priority"))
