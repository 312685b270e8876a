"""Qualification of people under the approved policy, as one aggregate row and a cascade.

All facts of a person and their company are reduced to a few sets, and the
decision is columns over them. Canonical values of a field replace candidate
values. The first matching rule decides; reasons are kept in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hashing import digest, joined
from .normalize import effective_nonblank

#: The fields that count.
TITLE_FIELDS = ("professional_role_title", "professional_title", "specialty")
RELEVANCE_FIELDS = (*TITLE_FIELDS, "practice_focus", "procedure")
GEO_FIELDS = ("country", "state")
INTENT_FIELD = "education_intent"
FIELDS = (*RELEVANCE_FIELDS, *GEO_FIELDS, INTENT_FIELD)
SPECIAL = ("CEOF", "BUCOMAXILLOFACIAL", "HOF_OR_FACIAL_ACTIVITY")
HOME = ("BR", "BRAZIL", "BRASIL")
HIGH_INTENT = ("PROCEDURE_LEARNING", "COURSE_INTEREST")
MEDIUM_INTENT = ("TRAINING_PARTICIPATION", "CONTINUING_EDUCATION", "EDUCATION_CONTENT_ENGAGEMENT")
NO_INTENT = "EXPLICIT_NO_INTEREST"
COMPLEMENTARY = "COMPLEMENTARY_EXCLUSIVE_CEOF"
#: Why.
REASONS = {
    "geo_conflict": "conflicting country evidence prevents geographic qualification",
    "geo_outside": "evidence-backed geography is outside Brazil",
    "geo_missing": "Brazil geography evidence is missing",
    "title_missing": "professional dental title evidence is missing",
    "title_outside": "observed professional title is outside the approved dentistry target",
    "conflict": "unresolved required conflict: ",
    "intent_conflict": "learning-intent evidence is conflicted",
    "intent_none": "explicit evidence of no current learning interest",
    "intent_high": "explicit evidence of procedure/course learning interest",
    "intent_medium": "evidence of continuing education/training activity",
    "intent_unknown": "no evidence-backed learning-intent signal is available",
    "contact": "validated professional contact is required by the active campaign selection",
    "special": "target dental specialty/title is evidence-backed",
    "facial": "facial surgery/aesthetics relevance is evidence-backed",
    "eligible": "evidence-backed dentist profile is eligible; facial relevance not yet observed",
    "offer_unknown": "CEOF specialist eligibility cannot be resolved while required evidence is unknown",
    "offer_backed": "explicit CEOF title supports the complementary exclusive-procedure offer track",
    "offer_missing": "complementary exclusive CEOF offer requires explicit CEOF-specialist evidence",
}


def chosen(candidates: DataFrame, canonicals: DataFrame) -> DataFrame:
    """(subject_id, field_name, value, settled): canonical values of a subject's field replace candidate values.

    Country and state keep both, as a person and their company are asked for them
    together; :func:`profiles` takes the settled ones of either.
    """
    said = candidates.where(F.col("field_name").isin(*FIELDS)).select(
        "subject_id", "field_name", effective_nonblank(F.col("normalized_value"), F.col("raw_value")).alias("value"), F.lit(False).alias("settled")
    )
    settled = canonicals.where(F.col("field_name").isin(*FIELDS)).select("subject_id", "field_name", "value", F.lit(True).alias("settled"))
    geo = F.col("field_name").isin(*GEO_FIELDS)
    other = said.where(~geo).join(settled.select("subject_id", "field_name").distinct(), ["subject_id", "field_name"], "left_anti")
    return settled.unionByName(other).unionByName(said.where(geo))


def profiles(people: DataFrame, values: DataFrame, conflicts: DataFrame, contacts: DataFrame) -> DataFrame:
    """One row for each person and company with what the cascade asks.

    people: person_id, company_id, offer_track, require_validated_contact;
    values as from :func:`chosen`; conflicts: subject_id, field_name, status;
    contacts: owner_id, status. Settled countries and states of either subject
    replace those that were only said of both.
    """
    pair = ["person_id", "company_id"]
    subjects = people.select(*pair, F.explode(F.array_distinct(F.array("person_id", "company_id"))).alias("subject_id"))
    folded = values.withColumn("f", tx.folded_rule(F.col("value")))
    held = subjects.join(folded, "subject_id")
    own, where = F.col("subject_id") == F.col("person_id"), F.col("field_name")
    upper = F.upper(F.btrim(F.col("value")))
    is_title = own & where.isin(*TITLE_FIELDS)
    country = lambda flag: F.array_sort(F.collect_set(F.when((where == "country") & flag, F.upper("f"))))
    home = lambda flag: F.bool_or(F.when((where == "state") & flag, upper.isin(*tx.STATES)))
    known, said = F.col("settled"), ~F.col("settled")
    facts = held.groupBy(*pair).agg(
        F.when(F.size(country(known)) > 0, country(known)).otherwise(country(said)).alias("countries"),
        F.coalesce(home(known), home(said)).alias("home_state"),
        F.count_if(is_title).alias("titles"),
        F.array_sort(F.collect_set(F.when(is_title, tx.title_class(F.col("f"))))).alias("title_groups"),
        F.bool_or(F.when(own & where.isin(*RELEVANCE_FIELDS), tx.facially_relevant(F.col("f")))).alias("facial"),
        F.collect_set(F.when(own & (where == INTENT_FIELD), upper)).alias("intents"),
    )
    opened = conflicts.where(F.col("status") == "OPEN").where(F.col("field_name").isin(*FIELDS))
    blocked = subjects.join(opened, "subject_id").groupBy(*pair).agg(
        F.array_sort(F.collect_set(F.when(where.isin(*TITLE_FIELDS, *GEO_FIELDS), where))).alias("conflict_fields"), F.bool_or(where == INTENT_FIELD).alias("intent_conflict")
    )
    reached = subjects.join(contacts.select(F.col("owner_id").alias("subject_id"), F.col("status").alias("s")), "subject_id").groupBy(*pair).agg(F.bool_or(F.col("s") == "VALIDATED").alias("validated_contact"))
    out = people.join(facts, pair, "left").join(blocked, pair, "left").join(reached, pair, "left")
    none, no = F.array().cast("array<string>"), F.lit(False)
    filled = {c: F.coalesce(c, none) for c in ("countries", "title_groups", "intents", "conflict_fields")}
    filled |= {c: F.coalesce(c, no) for c in ("home_state", "facial", "intent_conflict", "validated_contact")}
    return out.withColumns(filled | {"titles": F.coalesce("titles", F.lit(0))})


def _some(values: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(values, F.array(*map(F.lit, wanted)))


def priority(fit: Column, intent: Column) -> Column:
    high = fit == "HIGH"
    return (
        F.when(fit == "LOW", "EXCLUDE")
        .when(fit == "UNKNOWN", "REVIEW")
        .when(high & (intent == "HIGH"), "P1")
        .when((high & intent.isin("MEDIUM", "UNKNOWN")) | ((fit == "MEDIUM") & (intent == "HIGH")), "P2")
        .otherwise("P3")
    )


def decided(rows: DataFrame) -> DataFrame:
    """Profiles with status, fit, intent, priority and reasons."""
    c = F.col
    home = _some(c("countries"), HOME)
    abroad = F.size(F.array_except("countries", F.array(*map(F.lit, HOME)))) > 0
    state = c("home_state")
    geo_conflict, geo_outside = home & abroad, ~home & abroad & ~state
    geo_missing = ~home & ~abroad & ~state
    title_missing, title_outside = c("titles") == 0, (c("titles") > 0) & (F.size("title_groups") == 0)
    conflict = F.size("conflict_fields") > 0
    special, facial = _some(c("title_groups"), SPECIAL), c("facial")
    high, medium, none = _some(c("intents"), HIGH_INTENT), _some(c("intents"), MEDIUM_INTENT), F.array_contains("intents", NO_INTENT)
    torn = c("intent_conflict") | (none & (high | medium))
    intent = F.when(torn, "UNKNOWN").when(none, "LOW").when(high, "HIGH").when(medium, "MEDIUM").otherwise("UNKNOWN")
    uncontacted = c("require_validated_contact") & ~c("validated_contact")
    unknown = conflict | geo_conflict | geo_missing | title_missing
    refused = geo_outside | title_outside | uncontacted
    before = F.when(unknown, "UNKNOWN").when(refused, "NOT_QUALIFIED").otherwise("QUALIFIED")
    complementary = (c("offer_track") == COMPLEMENTARY) & (before != "NOT_QUALIFIED")
    ceof = F.array_contains("title_groups", "CEOF")
    offer_missing = complementary & (before == "QUALIFIED") & ~ceof
    status = F.when(offer_missing, "NOT_QUALIFIED").otherwise(before)
    fit = F.when(status == "UNKNOWN", "UNKNOWN").when(status == "NOT_QUALIFIED", "LOW").when(special | facial, "HIGH").otherwise("MEDIUM")
    good = before == "QUALIFIED"
    order = (
        (geo_conflict, "geo_conflict"),
        (geo_outside, "geo_outside"),
        (geo_missing, "geo_missing"),
        (title_missing, "title_missing"),
        (title_outside, "title_outside"),
        (conflict, "conflict"),
        (torn, "intent_conflict"),
        (~torn & none, "intent_none"),
        (~torn & ~none & high, "intent_high"),
        (~torn & ~none & ~high & medium, "intent_medium"),
        (~torn & ~none & ~high & ~medium, "intent_unknown"),
        (uncontacted, "contact"),
        (good & special, "special"),
        (good & facial, "facial"),
        (good & ~special & ~facial, "eligible"),
        (complementary & (before == "UNKNOWN"), "offer_unknown"),
        (complementary & good & ceof, "offer_backed"),
        (offer_missing, "offer_missing"),
    )
    text = lambda r: F.concat(F.lit(REASONS[r]), F.array_join("conflict_fields", ", ")) if r == "conflict" else F.lit(REASONS[r])
    reasons = F.array_compact(F.array(*[F.when(test, text(r)) for test, r in order]))
    return rows.withColumns({"qualification_status": status, "fit": fit, "intent": intent, "reasons": reasons}).withColumn("priority", priority(c("fit"), c("intent")))


def decision_id(policy: Column, *references: Column) -> Column:
    """From person, company, policy, track, outcome and sorted reference lists."""
    parts = F.array("person_id", "company_id", policy, "offer_track", "qualification_status", "fit", "intent", "priority")
    return F.concat(F.lit("qualification:v1:"), digest(joined(F.concat(parts, *[F.array_sort(r) for r in references]))))


def leads(decisions: DataFrame, policy: str, created_at: Column) -> DataFrame:
    """The lead of each decision, with its audit trail."""
    stage = F.when(F.col("qualification_status") == "QUALIFIED", "QUALIFIED").when(F.col("qualification_status") == "NOT_QUALIFIED", "DISQUALIFIED").otherwise("REVIEW")
    named = F.array(F.col("person_id"), F.col("company_id"), F.lit(policy), F.col("offer_track"))
    audit = F.array(
        F.lit(f"policy_id={policy}"),
        *[F.concat(F.lit(f"{c}="), F.col(c)) for c in ("person_id", "offer_track", "fit", "intent", "priority")],
    )
    return decisions.select(
        F.concat(F.lit("lead:v1:"), digest(joined(named))).alias("lead_id"),
        "company_id",
        stage.alias("stage"),
        "qualification_status",
        F.concat(audit, "reasons").alias("qualification_reasons"),
        created_at.alias("created_at"),
    )


def rebased(facts: DataFrame, relationships: DataFrame) -> DataFrame:
    """Facts about a relationship as facts about its person."""
    own = relationships.select(F.col("relationship_id").alias("subject_id"), F.col("person_id").alias("_p"))
    return facts.join(own, "subject_id", "left").withColumn("subject_id", F.coalesce("_p", "subject_id")).drop("_p").select(*facts.columns)


def split_people(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(identities, relationships) of people that embed their company."""
    relation = F.concat_ws(":", F.lit("relationship"), "person_id", "company_id").alias("relationship_id")
    return people.select("person_id").distinct(), people.select(relation, "person_id", "company_id", "relationship_evidence_ids")


def people_of_company(relationships: DataFrame) -> DataFrame:
    return relationships.groupBy("company_id").agg(F.array_sort(F.collect_set("person_id")).alias("person_ids"))


def with_registrations(relationships: DataFrame, registrations: DataFrame) -> DataFrame:
    """Relationships whose evidence is joined by that of their person's registrations.

    registrations: person_id, evidence_ids. Their ids are united for each person
    before the join, so a person's many registrations multiply no row.
    """
    own = registrations.select("person_id", F.explode("evidence_ids").alias("_e")).groupBy("person_id").agg(F.collect_set("_e").alias("_more"))
    both = F.array_union("relationship_evidence_ids", F.coalesce("_more", F.array().cast("array<string>")))
    return relationships.join(own, "person_id", "left").withColumn("relationship_evidence_ids", F.array_sort(both)).select(*relationships.columns)


def of_relationships(
    relationships: DataFrame,
    policy: str,
    candidates: DataFrame,
    canonicals: DataFrame,
    conflicts: DataFrame,
    contacts: DataFrame,
    links: DataFrame,
    registrations: DataFrame,
) -> DataFrame:
    """A decision for each relationship of a person and a company, with the evidence behind it.

    relationships: relationship_id, person_id, company_id, offer_track,
    require_validated_contact, relationship_evidence_ids. Facts, candidate
    (fact_id and evidence_ids too) and canonical (canonical_fact_id and
    candidate_fact_ids too), are about the relationship, its person or its
    company; those of another relationship of the same person say nothing here.
    Conflicts (conflict_id and candidate_fact_ids too) are about the person or the
    company. Contacts count where a link leads to them, whoever owns them.
    Registrations: person_id, evidence_ids. Evidence is that of the relationship,
    the registrations and all facts asked, be it through a canonical fact or a
    conflict.

    The relationship stands for its person while the cascade runs, so what was
    said of the person comes to each of their relationships.
    """
    own = relationships.select("relationship_id", "person_id")

    def scoped(rows: DataFrame) -> DataFrame:
        """What is said of a person, at each of their relationships; other rows as they are."""
        met = rows.join(own.withColumnRenamed("person_id", "subject_id"), "subject_id", "left")
        return met.withColumn("subject_id", F.coalesce("relationship_id", "subject_id")).drop("relationship_id")

    people = relationships.select(
        F.col("relationship_id").alias("person_id"), "company_id", "offer_track", "require_validated_contact", F.col("person_id").alias("_person")
    )
    # a conflict about a relationship itself is not asked for
    opened = scoped(conflicts.join(own.select(F.col("relationship_id").alias("subject_id")), "subject_id", "left_anti"))
    linked = links.join(own, "relationship_id").join(contacts.drop("owner_id"), "contact_id").select(F.col("relationship_id").alias("owner_id"), "contact_id", "status")
    facts, settled = scoped(candidates), scoped(canonicals)
    out = decided(profiles(people, chosen(facts, settled), opened, linked))

    subjects = relationships.select("relationship_id", F.explode(F.array_distinct(F.array("relationship_id", "company_id"))).alias("subject_id"))

    def asked(rows: DataFrame, *columns: str) -> DataFrame:
        """Rows of the fields that count, at each relationship whose subjects they are about."""
        return subjects.join(rows.where(F.col("field_name").isin(*FIELDS)).select("subject_id", *columns), "subject_id")

    def named(rows: DataFrame, key: str, into: str) -> DataFrame:
        return rows.groupBy("relationship_id").agg(F.array_sort(F.collect_set(key)).alias(into))

    known = subjects.join(facts.select("subject_id", "fact_id", "evidence_ids", F.col("field_name").isin(*FIELDS).alias("_counts")), "subject_id")
    held, torn = asked(settled, "canonical_fact_id", "candidate_fact_ids"), asked(opened.where("status = 'OPEN'"), "conflict_id", "candidate_fact_ids")
    behind = lambda rows, listed: rows.select("relationship_id", F.explode("candidate_fact_ids").alias("fact_id"), F.lit(listed).alias("_listed"))
    # facts behind a conflict are listed, those behind a canonical fact give evidence only
    tagged = behind(held, False).unionAll(behind(torn, True)).groupBy("relationship_id", "fact_id").agg(F.bool_or("_listed").alias("_listed"))
    met = known.join(tagged, ["relationship_id", "fact_id"], "left").where(F.col("_counts") | F.col("_listed").isNotNull())
    proof = met.groupBy("relationship_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("_counts") | F.col("_listed"), F.col("fact_id")))).alias("candidate_fact_ids"),
        F.array_distinct(F.flatten(F.collect_list("evidence_ids"))).alias("_evidence"),
    )
    used = [
        proof,
        named(held, "canonical_fact_id", "canonical_fact_ids"),
        named(torn, "conflict_id", "conflict_ids"),
        named(linked.withColumnRenamed("owner_id", "relationship_id"), "contact_id", "contact_ids"),
        with_registrations(relationships, registrations).select("relationship_id", "relationship_evidence_ids"),
    ]
    names = ("candidate_fact_ids", "canonical_fact_ids", "conflict_ids", "contact_ids", "evidence_ids")
    out = out.withColumnRenamed("person_id", "relationship_id").withColumnRenamed("_person", "person_id")
    for more in used:
        out = out.join(more, "relationship_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("evidence_ids", F.array_sort(F.array_union(F.coalesce("relationship_evidence_ids", none), F.coalesce("_evidence", none))))
    out = out.drop("relationship_evidence_ids", "_evidence").withColumns({c: F.coalesce(c, none) for c in names})
    return out.withColumn("decision_id", decision_id(F.lit(policy), *map(F.col, names)))
