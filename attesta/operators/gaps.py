"""Gaps of a company's record, and the actions that could fill them. Runs are in ``gap_runs``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identifiers as idn
from ..functions import text as tx
from ..functions.hashing import digest, digest_of, joined

ROLE_FIELD = "professional_role_title"
#: Which source has which field.
LOOKUP_FIELDS = ("business_registry_id", "legal_name", "trade_name", "registration_status", "primary_cnae_code", "primary_cnae_description", "city", "state")
LOCATION_FIELDS = ("street_address", "postal_code", "activity_start_date")
#: Attempts and seconds between them, for actions that use the network and others.
NETWORK, LOCAL = (3, 60), (1, 0)


def _gap(rows: DataFrame, kind: str, key: Column, reason: Column) -> DataFrame:
    clean = tx.collapse(key)
    gap_id = F.concat(F.lit("gap:v1:"), digest_of(F.col("company_id"), F.lit(kind), clean))
    return rows.select("company_id", gap_id.alias("gap_id"), F.lit(kind).alias("kind"), clean.alias("key"), tx.collapse(reason).alias("reason"))


def detected(companies: DataFrame, canonicals: DataFrame, contacts: DataFrame, roles: DataFrame, leads: DataFrame) -> DataFrame:
    """Gaps of companies (company_id, company_fields, require_validated_contact, require_person_role, require_qualification).

    canonicals: subject_id, field_name; contacts: owner_id, status; roles: the
    company_id of people with a role fact; leads: company_id, qualification_status.
    """
    wanted = companies.select("company_id", F.explode(F.array_distinct(F.transform("company_fields", F.trim))).alias("field_name"))
    present = canonicals.select(F.col("subject_id").alias("company_id"), "field_name")
    fields = wanted.join(present, ["company_id", "field_name"], "left_anti")
    valid = contacts.where("status = 'VALIDATED'").select(F.col("owner_id").alias("company_id"))
    settled = leads.where("qualification_status <> 'UNKNOWN'").select("company_id")
    without = lambda flag, there: companies.where(flag).join(there, "company_id", "left_anti")
    found = _gap(fields, "COMPANY_FIELD", F.col("field_name"), F.concat(F.lit("missing required canonical company field: "), "field_name"))
    for flag, there, kind, key, reason in (
        ("require_validated_contact", valid, "VALIDATED_COMPANY_CONTACT", "validated_company_contact", "no validated company-owned contact is present"),
        ("require_person_role", roles.select("company_id"), "PERSON_ROLE", "person_role", "no evidence-backed person role fact is present for this company"),
        ("require_qualification", settled, "QUALIFICATION", "qualification", "qualification remains absent or UNKNOWN"),
    ):
        found = found.unionAll(_gap(without(flag, there), kind, F.lit(key), F.lit(reason)))
    return found


def _normalized_lists(lists: pd.Series) -> pd.Series:
    one = lambda own: None if own is None else sorted({u for x in own if (u := idn.url_or_none(x, idn.PLAN_URL))})
    return lists.map(one, na_action=None)


_plan_urls = F.pandas_udf(_normalized_lists, T.ArrayType(T.StringType()))


def actions(gaps: DataFrame, inputs: DataFrame, policy: str, lookup_url: str, location_url: str) -> DataFrame:
    """What could fill each gap, ready or blocked.

    inputs: company_id, known_key, contact_urls, people_url, contact_ids,
    person_id, policy_id; a company without a row has no inputs. A contact gap has
    an action for each page that is known.
    """
    g = gaps.join(inputs, "company_id", "left")
    key = idn.registry_key(F.col("known_key"))
    none = F.array().cast("array<string>")
    ids = F.array_sort(F.array_distinct(F.coalesce("contact_ids", none)))
    urls = F.coalesce(_plan_urls(F.col("contact_urls")), none)
    people = idn.normalized_url(F.col("people_url"), idn.PLAN_URL)
    is_kind = lambda k: F.col("kind") == k
    field = lambda fields: is_kind("COMPANY_FIELD") & F.col("key").isin(*fields)
    make = lambda kind, locator, own, network: F.struct(
        F.lit("READY").alias("disposition"),
        F.lit(kind).alias("action_kind"),
        (locator if isinstance(locator, Column) else F.lit(locator)).cast("string").alias("locator"),
        own.alias("input_ids"),
        F.lit(network[0]).alias("max_attempts"),
        F.lit(network[1]).alias("min_interval_seconds"),
    )
    nothing = F.lit(None).cast("string")
    blocked = F.struct(
        F.lit("BLOCKED").alias("disposition"), nothing.alias("action_kind"), nothing.alias("locator"), none.alias("input_ids"), F.lit(0).alias("max_attempts"), F.lit(0).alias("min_interval_seconds")
    )
    one = lambda x: F.array(x)
    own_key = F.array(key)
    each_url = F.transform(urls, lambda u: make("COMPANY_CONTACT_PAGE_INGEST", u, none, NETWORK))
    known_policy = F.col("person_id").isNotNull() & (F.col("policy_id") == policy)
    planned = (
        F.when(field(LOOKUP_FIELDS) & key.isNotNull(), one(make("BRASILAPI_POINT_LOOKUP", F.concat(F.lit(lookup_url), key), own_key, NETWORK)))
        .when(field(LOCATION_FIELDS) & key.isNotNull(), one(make("OFFICIAL_COMPANY_LOCATION_INGEST", location_url, own_key, NETWORK)))
        .when(is_kind("VALIDATED_COMPANY_CONTACT") & (F.size(ids) >= 2), one(make("CONTACT_PUBLICATION_VALIDATION", nothing, ids, LOCAL)))
        .when(is_kind("VALIDATED_COMPANY_CONTACT") & (F.size(urls) > 0), each_url)
        .when(is_kind("PERSON_ROLE") & people.isNotNull(), one(make("PERSON_ROLE_PAGE_INGEST", people, none, NETWORK)))
        .when(is_kind("QUALIFICATION") & known_policy, one(make("DENTAL_QUALIFICATION_EVALUATION", nothing, F.array_sort(F.array("person_id", "policy_id")), LOCAL)))
        .otherwise(one(blocked))
    )
    out = g.select("company_id", "gap_id", F.explode(planned).alias("a")).select("company_id", "gap_id", "a.*")
    ready = F.col("disposition") == "READY"
    parts = F.concat(F.array("company_id", "gap_id", "action_kind", F.coalesce("locator", F.lit(""))), "input_ids")
    material = F.when(ready, digest(joined(parts))).otherwise(digest_of(F.col("company_id"), F.col("gap_id"), F.lit("BLOCKED")))
    out = out.withColumn("_m", material)
    out = out.withColumn("action_id", F.concat(F.lit("automation:v1:"), "_m")).withColumn("cache_key", F.when(ready, F.concat(F.lit("automation-cache:v1:"), "_m")))
    return out.drop("_m")


def ordered(plan: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return plan.orderBy("gap_id", "disposition", blank("action_kind"), blank("locator"), "action_id")


def status(plan: DataFrame, state: DataFrame, now: Column, handled: list[str]) -> DataFrame:
    """What a run would do with each action: BLOCKED, CACHE_HIT, SCHEDULED, or DUE.

    state: cache_key, succeeded, last_attempt_at.
    """
    s = plan.join(state, "cache_key", "left")
    eligible = F.col("last_attempt_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("min_interval_seconds").cast("decimal(18,6)"))
    waits = (F.col("min_interval_seconds") > 0) & (now < eligible)
    outcome = (
        F.when(F.col("disposition") == "BLOCKED", "BLOCKED")
        .when(F.coalesce("succeeded", F.lit(False)), "CACHE_HIT")
        .when(F.coalesce(waits, F.lit(False)), "SCHEDULED")
        .when(~F.col("action_kind").isin(*handled), "BLOCKED")
        .otherwise("DUE")
    )
    return s.withColumn("status", outcome).withColumn("next_eligible_at", F.when(F.col("status") == "SCHEDULED", eligible))
