"""Release gates: each is an ordered cascade over a row of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(*tests: tuple[Column, Column | str]) -> Column:
    """The names of the tests that hold, in order, each once."""
    named = [F.when(F.coalesce(test, F.lit(False)), F.lit(n) if isinstance(n, str) else n) for test, n in tests]
    return F.array_distinct(F.array_compact(F.array(*named)))


def in_force(now: Column, granted: Column, expires: Column, revoked: Column) -> Column:
    """Granted, and neither expired nor revoked; the instant of either counts as past."""
    past = lambda t: F.coalesce(t <= now, F.lit(False))
    return F.coalesce(granted, F.lit(False)) & ~past(expires) & ~past(revoked)


def preflight(source_fresh: Column, signed_off: Column, needs_verification: Column, verified: Column, authorized: Column) -> Column:
    """struct<state, blockers> of a campaign."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    blockers = listed(
        (no(source_fresh), "EXT-BRASILAPI-001"),
        (no(signed_off), "LEGAL-001"),
        (needs_verification & no(verified), "EXT-CFO-001"),
        (no(authorized), "AUTH-CAMPAIGN-001"),
    )
    return F.struct(F.when(F.size(blockers) > 0, "BLOCKED").otherwise("READY_FOR_AUTHORIZED_EXECUTION").alias("state"), blockers.alias("blockers"))


def release(blockers: DataFrame, actions: DataFrame, default: str) -> DataFrame:
    """The action that each blocker asks for, by look-up with a default."""
    return blockers.join(F.broadcast(actions), "blocker", "left").withColumn("required_action", F.coalesce("required_action", F.lit(default)))


def send_ready(blockers: Column, review: Column, *steps: tuple[Column, str, str]) -> Column:
    """struct<state, ready, missing>: the state names the step that is missing.

    steps: (done, state, what is missing) from the first to the last.
    """
    out = F.struct(F.lit("SEND_READY").alias("state"), F.lit(True).alias("ready"), F.lit(None).cast("string").alias("missing"))
    cases = [(F.size(F.filter(blockers, lambda b: F.trim(b) != "")) > 0, "COMPLIANCE_BLOCKED", "compliance blockers present"), (review, "REVIEW_REQUIRED", "review required")]
    cases += [(~done, state, missing) for done, state, missing in steps]
    for test, state, missing in reversed(cases):
        out = F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(state).alias("state"), F.lit(False).alias("ready"), F.lit(missing).alias("missing"))).otherwise(out)
    return out


#: The steps to sending, with the columns that say they are done.
STEPS = (
    ("discovered", "DISCOVERED"),
    ("validated", "VALIDATED"),
    ("qualified", "QUALIFIED"),
    ("compliance_cleared", "COMPLIANCE_PENDING"),
    ("live_certified", "LIVE_CERTIFICATION_PENDING"),
)


def send_ready_of(rows: DataFrame) -> DataFrame:
    """Rows with compliance_blockers, review_required and the columns of STEPS."""
    state = send_ready(F.col("compliance_blockers"), F.col("review_required"), *[(F.col(c), s, c) for c, s in STEPS])
    return rows.withColumn("assessment", state)


def send_ready_proof(rows: DataFrame) -> DataFrame:
    """As :func:`send_ready_of`, but an authorization that is not active blocks."""
    inactive = F.struct(F.lit("COMPLIANCE_BLOCKED").alias("state"), F.lit(False).alias("ready"), F.lit("authorization inactive").alias("missing"))
    proof = F.concat(F.lit("proof:"), "evaluation_id")
    return send_ready_of(rows).withColumn("assessment", F.when(~F.col("authorization_active"), inactive).otherwise(F.col("assessment"))).withColumn("proof_id", proof)


def suppressed(contacts: DataFrame, rules: DataFrame) -> DataFrame:
    """Contacts with whether an active rule names them; a rule matches by contact only."""
    active = rules.where("active").select(F.col("subject_id").alias("contact_id")).distinct().withColumn("suppressed", F.lit(True))
    return contacts.join(active, "contact_id", "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))


def contact_use(suppressed: Column, compliance: Column, reason: Column, published: Column) -> Column:
    """struct<decision, reason_code>: suppressed, blocked, review, allowed if published, review if published, unknown."""
    out = lambda d, r: F.struct(F.lit(d).alias("decision"), (r if isinstance(r, Column) else F.lit(r)).alias("reason_code"))
    return (
        F.when(suppressed, out("SUPPRESSED", "SUPPRESSED"))
        .when(compliance == "BLOCKED", out("BLOCKED", reason))
        .when(compliance == "REVIEW_REQUIRED", out("REVIEW_REQUIRED", reason))
        .when((compliance == "ALLOWED_BY_POLICY") & published, out("ALLOWED_BY_POLICY", "ALLOWED_BY_POLICY"))
        .when(published, out("REVIEW_REQUIRED", "REVIEW_REQUIRED"))
        .otherwise(out("UNKNOWN", "CONTACT_USE_UNKNOWN"))
    )


def compliance(suppressed: Column, legal_review: Column, certification_blocked: Column) -> Column:
    """struct<decision, reason_code>."""
    out = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason_code"))
    review = legal_review | certification_blocked
    return F.when(suppressed, out("BLOCKED", "SUPPRESSED")).when(review, out("REVIEW_REQUIRED", "LEGAL_REVIEW_REQUIRED")).otherwise(out("ALLOWED_BY_POLICY", "ALLOWED_BY_POLICY"))


#: What a pilot needs, in order.
PILOT = (
    "operational_ready", "live_sources_certified", "send_ready", "policy_version_fixed", "suppression_ready",
    "review_path_ready", "audit_export_ready", "measurement_ready",
)


def pilot(rows: DataFrame) -> DataFrame:
    """Rows with the columns of PILOT, compliance and use decisions with reasons, active suppression and authorization."""
    allowed = lambda c: F.col(c).isNull() | (F.col(c) == "ALLOWED_BY_POLICY")
    blockers = listed(
        *[(~F.col(c), c) for c in PILOT],
        (~allowed("compliance_decision"), F.col("compliance_reason")),
        (~allowed("use_decision"), F.col("use_reason")),
        (F.col("active_suppression"), "active_suppression_present"),
    )
    pending = F.col("authorization_required") & ~F.col("authorization_granted")
    state = F.when(F.size(blockers) > 0, "NOT_READY").when(pending, "READY_PENDING_MANUAL_AUTHORIZATION").otherwise("READY")
    return rows.withColumn("blockers", blockers).withColumn("state", state)


def all_hold(rows: DataFrame, flags: list[str]) -> DataFrame:
    """Whether every flag holds, and which do not, in order."""
    out = rows.withColumn("blockers", listed(*[(~F.col(c), c) for c in flags]))
    return out.withColumn("approved", F.size("blockers") == 0)


def freshness(policy: Column, certified_at: Column, expired: Column) -> Column:
    return (
        F.when(policy == "STALE", "STALE")
        .when(certified_at.isNull(), "UNKNOWN")
        .when(expired, "EXPIRED")
        .when(policy.isin("REVALIDATE_BEFORE_USE", "REVALIDATE_ON_CHANGE"), policy)
        .otherwise("REVALIDATE_ON_EXPIRY")
    )


def drift(expected: Column, observed: Column) -> Column:
    """struct<status, missing, unexpected> of a source's fields, in their order."""
    missing, extra = F.array_except(expected, observed), F.array_except(observed, expected)
    status = F.when((F.size(missing) > 0) | (F.size(extra) > 0), "CONTRACT_FAIL").otherwise("CERTIFIED")
    return F.struct(status.alias("status"), missing.alias("missing"), extra.alias("unexpected"))


#: What looks like a secret in a text.
SECRETS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36}",
    "assigned_secret": r"(?i)\b(api[_-]?key|secret|token|password)\b\s*[:=]\s*[\"'][^\"'\s]{12,}[\"']",
}


def secrets(rows: DataFrame, text: str) -> DataFrame:
    """Rows with a flag for each kind of secret."""
    return rows.withColumns({k: F.coalesce(F.col(text).rlike(p), F.lit(False)) for k, p in SECRETS.items()})
