"""Person resolution: assembled records, overlaps, triage and its measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as idn
from ..functions import text as tx
from .normalize import effective_nonblank

NAME_FIELD, ROLE_FIELD = "person_name", "professional_role_title"
SIGNALS = ("names", "roles", "emails", "phones", "profiles")


def assembled(people: DataFrame, facts: DataFrame, contacts: DataFrame) -> DataFrame:
    """A row for each person: comparable names, roles, e-mails, phones and profiles, and all evidence.

    people: person_id, company_id, relationship_evidence_ids; facts: subject_id,
    field_name, raw_value, normalized_value, evidence_ids; contacts: owner_id,
    kind, value, evidence_ids.
    """
    value = effective_nonblank(F.col("normalized_value"), F.col("raw_value"))
    said = facts.where(F.col("field_name").isin(NAME_FIELD, ROLE_FIELD)).select(
        F.col("subject_id").alias("person_id"), F.col("field_name").alias("kind"), F.nullif(tx.folded_person(value), F.lit("")).alias("v"), "evidence_ids"
    )
    reached = contacts.where(F.col("kind").isin("EMAIL", "PHONE", "PROFESSIONAL_PROFILE")).select(
        F.col("owner_id").alias("person_id"),
        "kind",
        F.when(F.col("kind") == "EMAIL", idn.email_key(F.col("value")))
        .when(F.col("kind") == "PHONE", idn.phone_key(F.col("value"), 8))
        .otherwise(tx.on_strings(idn.profile_key)(F.col("value")))
        .alias("v"),
        "evidence_ids",
    )
    own = lambda kind: F.array_compact(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("v")))))
    signals = said.unionByName(reached).groupBy("person_id").agg(
        own(NAME_FIELD).alias("names"),
        own(ROLE_FIELD).alias("roles"),
        own("EMAIL").alias("emails"),
        own("PHONE").alias("phones"),
        own("PROFESSIONAL_PROFILE").alias("profiles"),
        F.flatten(F.collect_list("evidence_ids")).alias("_evidence"),
    )
    empty = F.array().cast("array<string>")
    out = people.join(signals, "person_id", "left")
    return out.select(
        "person_id",
        "company_id",
        "relationship_evidence_ids",
        *[F.coalesce(c, empty).alias(c) for c in SIGNALS],
        F.array_sort(F.array_union(F.coalesce("_evidence", empty), "relationship_evidence_ids")).alias("evidence_ids"),
    )


def features(pairs: DataFrame) -> DataFrame:
    """Pairs (with structs l and r of assembled records) and their three-valued overlaps."""
    over = lambda c: tx.overlap(F.col(f"l.{c}"), F.col(f"r.{c}"))
    return pairs.select(
        "*",
        (F.col("l.company_id") == F.col("r.company_id")).alias("same_company"),
        over("names").alias("name_exact"),
        over("roles").alias("role_exact"),
        over("emails").alias("email_overlap"),
        over("phones").alias("phone_overlap"),
        over("profiles").alias("profile_overlap"),
        F.arrays_overlap("l.relationship_evidence_ids", "r.relationship_evidence_ids").alias("relationship_evidence_overlap"),
    )


def _yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def triage() -> Column:
    """struct<disposition, reasons>: any reason is a review, none is not enough evidence."""
    name, profile = _yes("name_exact"), _yes("profile_overlap")
    whole = _yes("same_company") & name & profile
    rules = (
        (whole, ("same_company", "normalized_name_exact", "professional_profile_exact", "auto_match_not_authorized")),
        (~whole & profile, ("professional_profile_exact",)),
        (name & _yes("email_overlap"), ("normalized_name_exact", "email_exact")),
        (name & _yes("phone_overlap"), ("normalized_name_exact", "phone_exact")),
        (name & _yes("role_exact"), ("normalized_name_exact", "role_exact")),
        (_yes("email_overlap") & _yes("phone_overlap"), ("email_exact", "phone_exact")),
    )
    # the first occurrence of a reason is the one that stays
    found = F.array_distinct(F.array_compact(F.concat(*[F.array(*[F.when(test, r) for r in reasons]) for test, reasons in rules])))
    enough = F.size(found) > 0
    return F.struct(
        F.when(enough, "REVIEW").otherwise("INSUFFICIENT_EVIDENCE").alias("disposition"),
        F.when(enough, found).otherwise(F.array(F.lit("no_v1_review_rule"))).alias("reasons"),
    )


def experimental_match() -> Column:
    """A diagnostic without authority."""
    return _yes("same_company") & _yes("name_exact") & _yes("profile_overlap")


def measures(pairs: DataFrame, truth: str, disposition: Column) -> DataFrame:
    review, same = disposition == "REVIEW", F.col(truth)
    counted = pairs.agg(
        F.count("*").alias("pairs"), F.count_if(same).alias("same_person_pairs"), F.count_if(review).alias("reviews"), F.count_if(review & same).alias("same_person_reviews")
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n = F.col("pairs")
    return (
        counted.withColumn("insufficient", n - F.col("reviews"))
        .withColumn("review_rate", share(F.col("reviews"), n))
        .withColumn("insufficient_rate", share(F.col("insufficient"), n))
        .withColumn("positive_review_recall", share(F.col("same_person_reviews"), F.col("same_person_pairs")))
    )


def experimental_measures(pairs: DataFrame, truth: str) -> DataFrame:
    """Precision is null where nothing matched."""
    hit, same = experimental_match(), F.col(truth)
    counted = pairs.agg(F.count_if(hit & same).alias("tp"), F.count_if(hit & ~same).alias("fp"), F.count_if(same).alias("same"), F.count_if(~same).alias("distinct"))
    tp, fp = F.col("tp"), F.col("fp")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counted.select("*", F.try_divide(tp, tp + fp).alias("precision"), share(tp, F.col("same")).alias("recall"), share(fp, F.col("distinct")).alias("false_merge_rate"))
