"""Reference tables of release gates, sources and authorities, and look-ups in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: External gates with who decides, the decision, its reason and what it needs.
GATES = (
    ("EXT-BRASILAPI-001", "EXTERNAL_SOURCE", "REVIEW_REQUIRED", "SOURCE_CERTIFIED_WITH_LIMITATIONS_REVALIDATE_BEFORE_USE", ["fresh response evidence", "response-shape validation", "integrity digest"], []),
    ("EXT-SERPRO-001", "ENGINEERING", "NOT_REQUIRED", "NOT_ON_MINIMUM_COMMERCIAL_CRITICAL_PATH", [], ["AUTH-SERPRO-001"]),
    ("EXT-CFO-001", "HUMAN_REVIEW", "REVIEW_REQUIRED", "PERSON_SPECIFIC_CURRENT_STATUS_REQUIRED", ["professional identifier", "current consultation result", "capture timestamp", "evidence digest"], ["AUTH-CFO-001"]),
    ("LEGAL-001", "LEGAL_REVIEW", "REVIEW_REQUIRED", "CONTROLLER_LEGAL_BASIS_AND_BALANCING_DECISION_REQUIRED", ["campaign purpose", "contact class", "channel", "minimization rationale", "suppression/opt-out controls", "retention policy"], ["AUTH-LGPD-001", "AUTH-ANPD-001"]),
    ("AUTH-CAMPAIGN-001", "CAMPAIGN_OWNER", "BLOCKED", "MANUAL_AUTHORIZATION_NOT_GRANTED", ["approved policy version", "approved bounded audience", "authorization timestamp", "authorizer identity"], []),
)
#: Authorities that gates refer to: issuer, title, address and jurisdiction.
AUTHORITIES = (
    ("AUTH-LGPD-001", "Presidencia da Republica / Planalto", "Lei 13.709/2018 - LGPD, texto compilado", "https://www.planalto.gov.br/ccivil_03/_ato2015-2018/2018/lei/l13709compilado.htm", "BR"),
    ("AUTH-ANPD-001", "Autoridade Nacional de Protecao de Dados", "Guia Orientativo - Hipoteses Legais de Tratamento de Dados Pessoais - Legitimo Interesse", "https://www.gov.br/anpd/pt-br/centrais-de-conteudo/materiais-educativos-e-publicacoes/guia_orientativo_hipoteses_legais_tratamento_de_dados_pessoais_legitimo_interesse", "BR"),
    ("AUTH-CFO-001", "Conselho Federal de Odontologia", "Consulta de Profissionais", "https://website.cfo.org.br/busca-profissionais/", "BR"),
    ("AUTH-SERPRO-001", "Servico Federal de Processamento de Dados - SERPRO", "Consulta CNPJ - Servico Serpro API", "https://www.serpro.gov.br/menu/suporte/css", "BR"),
)
#: What a legal review is asked, and under which authorities.
LEGAL_PACKET = {
    "packet_id": "legal-review:commercial-pilot:v1",
    "jurisdiction": "BR",
    "campaign_purpose": "bounded B2B dental lead outreach",
    "contact_class": "published corporate or business-personalized contact",
    "channel": "email",
    "decision": "REVIEW_REQUIRED",
    "reason": "LEGAL_REVIEW_REQUIRED",
    "questions": [
        "Which LGPD legal basis is approved for this exact campaign purpose and contact class?",
        "If legitimate interest is relied upon, is the documented purpose/necessity/balancing analysis sufficient for the controller?",
        "What notice, opposition, suppression and opt-out controls are required before first contact?",
        "What retention/deletion period is approved for contact data and raw evidence?",
        "Are any contact classes, source classes or professional-registration uses prohibited or review-only?",
    ],
    "authorities": ["AUTH-LGPD-001", "AUTH-ANPD-001"],
}
#: Who clears a blocker, and how.
ACTIONS = (
    ("LEGAL-001", "LEGAL_COMPLIANCE", "record a scoped legal/compliance decision for the exact campaign policy, jurisdiction, channel and campaign"),
    ("EXT-CFO-001", "PROFESSIONAL_REVIEWER", "perform and record a person-specific current CFO/CRO verification with evidence when policy requires it"),
    ("AUTH-CAMPAIGN-001", "CAMPAIGN_OWNER", "record campaign-specific authorization after all prerequisite gates are satisfied"),
    ("EXT-BRASILAPI-001", "SOURCE_OPERATOR", "repeat the bounded read-only BrasilAPI revalidation immediately before approved use"),
)
DEFAULT_ACTION = "resolve the explicitly reported external gate before execution"
#: Sources, how critical they are, when they must be checked again and how they stand.
SOURCES = (
    ("source:brasilapi:cnpj-v1", "public-api", "PRODUCT_CRITICAL", "REVALIDATE_BEFORE_USE", "CERTIFIED_WITH_LIMITATIONS"),
    ("source:serpro:transparency", "public-web", "PRODUCT_CRITICAL", "REVALIDATE_ON_CHANGE", "SOURCE_UNAVAILABLE"),
    ("source:cfo:registration", "public-web", "CAMPAIGN_CRITICAL", "REVALIDATE_ON_EXPIRY", "BLOCKED_HUMAN_VERIFICATION"),
    ("source:dns-http:contact-path", "technical-validation", "OPTIONAL_BREADTH", "REVALIDATE_ON_CHANGE", "OPTIONAL_NOT_RUN"),
)
#: What blocks compliance until it is settled.
COMPLIANCE_BLOCKERS = (
    ("CB-001", "campaign legal review", "campaign legal review remains unresolved"),
    ("CB-002", "jurisdiction-specific rules", "jurisdiction-specific send rules are not yet certified"),
    ("CB-003", "contact-use authorization", "explicit contact-use authorization is not yet documented"),
    ("CB-004", "suppression and opt-out", "suppression and opt-out handling is not yet certified"),
    ("CB-005", "send authorization", "send authorization remains separate from qualification"),
    ("CB-006", "retention", "retention and deletion policy still needs explicit owner"),
)
#: What a live certification records.
CERTIFICATION_FIELDS = (
    "certification_id", "source", "source_type", "official_endpoint_or_surface", "timestamp", "tested_commit_sha", "request_class",
    "request_identifier", "http_status", "response_contract", "raw_evidence_id", "integrity_digest", "expected_semantics",
    "observed_semantics", "result", "failure_classification", "revalidation_due",
)
#: What an internal release needs, in order, and what is missing without it.
RELEASE_CHECKS = (
    ("installation_verified", "INSTALLATION_UNVERIFIED"),
    ("installed_import_verified", "IMPORT_UNVERIFIED"),
    ("regression_verified", "REGRESSION_UNVERIFIED"),
    ("schema_verified", "SCHEMA_UNVERIFIED"),
    ("recovery_verified", "RECOVERY_UNVERIFIED"),
    ("evidence_integrity_verified", "EVIDENCE_INTEGRITY_UNVERIFIED"),
    ("configuration_safe", "CONFIGURATION_UNSAFE"),
    ("send_boundary_safe", "SEND_BOUNDARY_UNSAFE"),
    ("documentation_synced", "DOCUMENTATION_DIVERGENT"),
    ("ci_verified", "CI_UNVERIFIED"),
)


def gates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GATES), "gate_id string, authority string, decision string, reason string, required_evidence array<string>, authorities array<string>")


def authorities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(AUTHORITIES), "authority_id string, issuer string, title string, url string, jurisdiction string")


def legal_packet(spark: SparkSession) -> DataFrame:
    """One row: what a legal review decides on. It never allows anything by itself."""
    kinds = ", ".join(f"{c} {'array<string>' if isinstance(v, list) else 'string'}" for c, v in LEGAL_PACKET.items())
    return spark.createDataFrame([tuple(LEGAL_PACKET.values())], kinds)


def referred(blockers: DataFrame) -> DataFrame:
    """Blockers (blocker) with the authorities of their gate, a row for each; those of no gate, or without authorities, have null."""
    known = gates(blockers.sparkSession).select(F.col("gate_id").alias("blocker"), F.explode("authorities").alias("authority_id"))
    known = known.join(F.broadcast(authorities(blockers.sparkSession)), "authority_id")
    return blockers.join(F.broadcast(known), "blocker", "left")


def critical_gates(spark: SparkSession) -> DataFrame:
    return gates(spark).where("decision <> 'NOT_REQUIRED'").select("gate_id")


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCES), "source_id string, source_type string, scope string, freshness_policy string, status string")


def compliance_blockers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COMPLIANCE_BLOCKERS), "blocker_id string, area string, detail string")


def required_actions(blockers: DataFrame) -> DataFrame:
    """Blockers (blocker) with who clears them and how; unknown ones have nobody and the default."""
    known = blockers.sparkSession.createDataFrame(list(ACTIONS), "blocker string, owner string, required_action string")
    out = blockers.join(F.broadcast(known), "blocker", "left")
    return out.withColumns({"owner": F.coalesce("owner", F.lit("NONE")), "required_action": F.coalesce("required_action", F.lit(DEFAULT_ACTION))})


def release_candidate(rows: DataFrame) -> DataFrame:
    """Rows with the columns of RELEASE_CHECKS: state and blockers in order."""
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), reason) for c, reason in RELEASE_CHECKS]))
    return rows.withColumn("blockers", missing).withColumn("state", F.when(F.size(missing) > 0, "BLOCKED").otherwise("READY"))
