"""Record schemas and the rules that every row must keep.

A schema is Spark DDL. A rule is a name and a SQL condition; a row that does
not fulfil it - null counts as not - is a violation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "sources": "source_id string, source_type string, locator string, name string",
    "evidence": "evidence_id string, source_id string, locator string, captured_at timestamp, captured_at_iso string, http_status int, raw_payload string, content_digest string, metadata map<string, string>",
    "provenance": "provenance_id string, subject_id string, field_name string, evidence_ids array<string>, activity string, generated_at timestamp, agent string, derived_from_fact_ids array<string>",
    "candidate_facts": "fact_id string, subject_id string, field_name string, raw_type string, raw_json string, norm_type string, norm_json string, evidence_ids array<string>, provenance_id string, confidence double, decision_class string, observed_at timestamp, observed_at_iso string, seq bigint",
    "canonical_facts": "fact_id string, subject_id string, field_name string, value_key string, candidate_fact_ids array<string>, provenance_id string, resolution_method string, decision_class string",
    "conflicts": "conflict_id string, subject_id string, field_name string, candidate_fact_ids array<string>, status string, rationale string",
    "companies": "company_id string, candidate_fact_ids array<string>, canonical_fact_ids array<string>, person_ids array<string>, contact_point_ids array<string>",
    "person_identities": "person_id string",
    "relationships": "relationship_id string, person_id string, company_id string, evidence_ids array<string>, role_title string, relationship_type string, status string, started_at timestamp, ended_at timestamp",
    "registrations": "registration_id string, person_id string, authority string, number string, status string, evidence_ids array<string>",
    "contacts": "contact_id string, owner_id string, kind string, value string, discovery_evidence_ids array<string>, status string, discovered_at timestamp, validation_evidence_ids array<string>, validated_at timestamp, seq bigint",
    "relationship_contact_links": "link_id string, relationship_id string, contact_id string, evidence_ids array<string>, status string",
    "leads": "lead_id string, company_id string, stage string, qualification_status string, qualification_reasons array<string>, created_at timestamp",
    "statements": "statement_id string, subject_id string, field_name string, value_key string, provenance_id string, resolution_method string",
    "statement_evidence": "link_id string, statement_id string, evidence_ids array<string>",
    "qualification_decisions": "decision_id string, lead_id string, qualification_status string, reasons array<string>, evidence_ids array<string>, decided_at timestamp",
}

#: What enumerated columns may hold.
VALUES = {
    "decision_class": ("EVIDENCE_BACKED", "HYPOTHESIS", "ENGINEERING_CHOICE", "LOCALLY_VERIFIED", "UNKNOWN"),
    "contact_kind": ("EMAIL", "PHONE", "WHATSAPP", "CONTACT_FORM", "LINKEDIN", "INSTAGRAM", "PROFESSIONAL_PROFILE", "OTHER"),
    "contact_status": ("DISCOVERED", "VALIDATED", "STALE", "INVALID", "UNKNOWN"),
    "conflict_status": ("OPEN", "RESOLVED", "DEFERRED"),
    "lead_stage": ("CANDIDATE", "REVIEW", "QUALIFIED", "DISQUALIFIED"),
    "qualification_status": ("UNKNOWN", "QUALIFIED", "NOT_QUALIFIED"),
}

_PRESENT = "{0} is not null and {0} rlike '(?U)\\\\S'"
_LISTED = "size({0}) > 0 and forall({0}, x -> x is not null and x rlike '(?U)\\\\S')"
_SOUND = "{0} is null or forall({0}, x -> x is not null and x rlike '(?U)\\\\S')"
_ONCE = "{0} is null or size(array_distinct({0})) = size({0})"
_SINCE = "{0} is not null"


def _oneof(column: str, kind: str) -> str:
    return f"{column} in ({', '.join(repr(v) for v in VALUES[kind])})"


def _rules(present: str = "", listed: str = "", once: str = "", since: str = "", sound: str = "", **more: str) -> dict[str, str]:
    out = {}
    for names, form, what in ((present, _PRESENT, "is not blank"), (listed, _LISTED, "is a list without blanks"), (once, _ONCE, "has no repeats"), (since, _SINCE, "is a time"), (sound, _SOUND, "has no blanks")):
        out |= {f"{c} {what}": form.format(c) for c in names.split()}
    return out | {k.replace("_", " "): v for k, v in more.items()}


_ASSESSED = "status in ('VALIDATED', 'INVALID', 'STALE')"
RULES = {
    "sources": _rules("source_id source_type locator"),
    "evidence": _rules("evidence_id source_id locator", since="captured_at", status_is_one_of_HTTP="http_status is null or http_status between 100 and 599"),
    "provenance": _rules("provenance_id subject_id field_name activity", "evidence_ids", "evidence_ids derived_from_fact_ids", "generated_at", "derived_from_fact_ids"),
    "candidate_facts": _rules(
        "fact_id subject_id field_name provenance_id", "evidence_ids", "evidence_ids", "observed_at", confidence_is_a_share="confidence is null or confidence between 0 and 1", decision_class_is_known=_oneof("decision_class", "decision_class")
    ),
    "canonical_facts": _rules("fact_id subject_id field_name provenance_id resolution_method", "candidate_fact_ids", "candidate_fact_ids", decision_class_is_known=_oneof("decision_class", "decision_class")),
    "conflicts": _rules("conflict_id subject_id field_name", "candidate_fact_ids", two_candidates="size(array_distinct(candidate_fact_ids)) >= 2", status_is_known=_oneof("status", "conflict_status")),
    "companies": _rules("company_id"),
    "person_identities": _rules("person_id"),
    "relationships": _rules("relationship_id person_id company_id", "evidence_ids"),
    "registrations": _rules("registration_id person_id authority number status", "evidence_ids"),
    "contacts": _rules(
        "contact_id owner_id value",
        "discovery_evidence_ids",
        since="discovered_at",
        kind_is_known=_oneof("kind", "contact_kind"),
        status_is_known=_oneof("status", "contact_status"),
        assessed_has_proof=f"not {_ASSESSED} or (coalesce(size(validation_evidence_ids), 0) > 0 and validated_at is not null)",
        discovered_is_not_assessed="status <> 'DISCOVERED' or (coalesce(size(validation_evidence_ids), 0) <= 0 and validated_at is null)",
    ),
    "relationship_contact_links": _rules("link_id relationship_id contact_id", "evidence_ids"),
    "leads": _rules(
        "lead_id company_id",
        since="created_at",
        stage_agrees_with_status="qualification_status = case stage when 'CANDIDATE' then 'UNKNOWN' when 'REVIEW' then 'UNKNOWN' when 'QUALIFIED' then 'QUALIFIED' when 'DISQUALIFIED' then 'NOT_QUALIFIED' end",
    ),
    "statements": _rules("statement_id subject_id field_name provenance_id resolution_method"),
    "statement_evidence": _rules("link_id statement_id", "evidence_ids"),
    "qualification_decisions": _rules("decision_id lead_id", since="decided_at", sound="reasons evidence_ids", status_is_known=_oneof("qualification_status", "qualification_status")),
}


def schema(record: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[record])


def checked(rows: DataFrame, record: str) -> DataFrame:
    """Rows with the names of the rules that they break."""
    broken = [F.when(~F.coalesce(F.expr(rule), F.lit(False)), name) for name, rule in RULES[record].items()]
    return rows.withColumn("violations", F.array_compact(F.array(*broken)))


def violations(rows: DataFrame, record: str) -> DataFrame:
    return checked(rows, record).where(F.size("violations") > 0)


def with_defaults(rows: DataFrame, record: str, **defaults) -> DataFrame:
    """Rows in a record's schema: missing columns are null, nulls have their default."""
    out = []
    for f in schema(record):
        value = F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(value, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else value).alias(f.name))
    return rows.select(*out)
