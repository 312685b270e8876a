"""Integrity, rule cascades, planning and gates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import export as xp
from ..operators import gaps as gp
from ..operators import gates as gt
from ..operators import qualification as ql
from ..operators import review as rv
from .catalog import query


@query(
    """
SELECT 'orders' AS reference, count(*) AS dangling FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'owner', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AND user_id NOT IN (SELECT s_suppkey FROM supplier)
"""
)
def integrity_anti(t):
    """References that name nothing; an owner may be in either of two tables."""
    count = lambda rows, name: rows.agg(F.count("*").alias("dangling")).select(F.lit(name).alias("reference"), "dangling")
    l = t.lineitem  # noqa: E741
    return (
        count(ev.dangling(l, "l_orderkey", t.orders, "o_orderkey"), "orders")
        .unionAll(count(ev.dangling(l, "l_partkey", t.part, "p_partkey"), "part"))
        .unionAll(count(ev.dangling(l, "l_suppkey", t.supplier, "s_suppkey"), "supplier"))
        .unionAll(count(ev.dangling_owner(t.events, "user_id", (t.customer.where("c_custkey % 2 = 0"), "c_custkey"), (t.supplier, "s_suppkey")), "owner"))
    )


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_linestatus <> o_orderstatus
"""
)
def semantic_scope(t):
    """Lines whose order has another scope."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_linestatus").alias("scope"))
    orders = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("scope"))
    return ev.other_scope(lines, "l_orderkey", orders, "o_orderkey", ["scope"]).drop("scope")


_NEED = ("status", "priority", "segment", "street_address")


def _company_gaps(t):
    companies = t.customer.select(
        F.col("c_custkey").cast("string").alias("company_id"),
        F.array(*map(F.lit, _NEED)).alias("company_fields"),
        (F.col("c_custkey") % 2 == 0).alias("require_validated_contact"),
        (F.col("c_custkey") % 3 == 0).alias("require_person_role"),
        (F.col("c_custkey") % 5 == 0).alias("require_qualification"),
    )
    facts = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").cast("string").alias("subject_id"), F.lit("status").alias("field_name"))
    facts = facts.unionAll(t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string"), F.lit("priority")))
    facts = facts.unionAll(t.customer.where("c_acctbal > 0").select(F.col("c_custkey").cast("string"), F.lit("segment")))
    own = lambda rows: rows.select(F.col("user_id").cast("string").alias("owner_id"))
    contacts = own(t.events.where("event_type = 'signup'")).withColumn("status", F.lit("VALIDATED")).unionAll(own(t.events).withColumn("status", F.lit("DISCOVERED")))
    roles = t.events.where("event_type = 'purchase' AND value > 95").select(F.col("user_id").cast("string").alias("company_id"))
    leads = t.customer.select(F.col("c_custkey").cast("string").alias("company_id"), F.when(F.col("c_mktsegment") == "MACHINERY", "QUALIFIED").otherwise("UNKNOWN").alias("qualification_status"))
    return gp.detected(companies, facts, contacts, roles, leads)


_GAPS = """
WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, * FROM customer),
f AS (SELECT CAST(o_custkey AS VARCHAR) AS id, 'status' AS f FROM orders WHERE o_totalprice > 400000 UNION SELECT CAST(o_custkey AS VARCHAR), 'priority' FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION SELECT id, 'segment' FROM c WHERE c_acctbal > 0),
n AS (SELECT id, unnest(['status', 'priority', 'segment', 'street_address']) AS f FROM c),
g AS (
  SELECT id, 'COMPANY_FIELD' AS kind, f AS key FROM n WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.id = n.id AND f.f = n.f)
  UNION ALL SELECT id, 'VALIDATED_COMPANY_CONTACT', 'validated_company_contact' FROM c WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')
  UNION ALL SELECT id, 'PERSON_ROLE', 'person_role' FROM c WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95)
  UNION ALL SELECT id, 'QUALIFICATION', 'qualification' FROM c WHERE c_custkey % 5 = 0 AND c_mktsegment <> 'MACHINERY'),
d AS (SELECT id AS company_id, kind, key, 'gap:v1:' || sha256(id || chr(0) || kind || chr(0) || key) AS gap_id FROM g)
"""


@query(f"{_GAPS} SELECT company_id, kind, key, gap_id FROM d")
def gap_detect(t):
    """Four kinds of gaps of companies."""
    return _company_gaps(t).select("company_id", "kind", "key", "gap_id")


@query(
    f"""
{_GAPS}, i AS (SELECT id AS company_id, CASE WHEN c_custkey % 2 = 1 THEN lpad(id, 14, '0') END AS known_key, c_custkey % 4 AS k, c_custkey AS n FROM c),
a AS (SELECT d.company_id, d.gap_id, CASE
    WHEN kind = 'COMPANY_FIELD' AND key = 'street_address' AND known_key IS NOT NULL THEN ['OFFICIAL_COMPANY_LOCATION_INGEST']
    WHEN kind = 'VALIDATED_COMPANY_CONTACT' AND k = 0 THEN ['CONTACT_PUBLICATION_VALIDATION']
    WHEN kind = 'VALIDATED_COMPANY_CONTACT' AND k = 2 THEN ['COMPANY_CONTACT_PAGE_INGEST', 'COMPANY_CONTACT_PAGE_INGEST']
    WHEN kind = 'PERSON_ROLE' AND k <> 3 THEN ['PERSON_ROLE_PAGE_INGEST']
    WHEN kind = 'QUALIFICATION' AND n % 10 = 0 THEN ['DENTAL_QUALIFICATION_EVALUATION'] ELSE ['-'] END AS kinds FROM d JOIN i USING (company_id))
SELECT action_kind, CASE WHEN action_kind = '-' THEN 'BLOCKED' ELSE 'READY' END AS disposition, count(*) AS actions, count(DISTINCT gap_id) AS gaps FROM (SELECT company_id, gap_id, unnest(kinds) AS action_kind FROM a) GROUP BY 1, 2
"""
)
def gap_actions(t):
    """Planned actions of all gaps by kind."""
    k, none = F.col("c_custkey"), F.array().cast("array<string>")
    key = k.cast("string")
    inputs = t.customer.select(
        key.alias("company_id"),
        F.when(k % 2 == 1, F.lpad(key, 14, "0")).alias("known_key"),
        F.when(k % 4 == 2, F.array(F.lit("https://a.example/contact"), F.lit("https://b.example/contact"))).otherwise(none).alias("contact_urls"),
        F.when(k % 4 != 3, F.lit("https://a.example/people")).alias("people_url"),
        F.when(k % 4 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x"))).alias("contact_ids"),
        F.concat(F.lit("p"), key).alias("person_id"),
        F.when(k % 10 == 0, "policy-1").otherwise("policy-0").alias("policy_id"),
    )
    plan = gp.actions(_company_gaps(t), inputs, "policy-1", "https://registry.example/", "https://offices.example/")
    return plan.groupBy(F.coalesce("action_kind", F.lit("-")).alias("action_kind"), "disposition").agg(F.count("*").alias("actions"), F.count_distinct("gap_id").alias("gaps"))


@query(
    """
WITH i AS (
  SELECT 'DATA_CONFLICT' AS kind, CAST(o_custkey AS VARCHAR) || chr(0) || 'x' || o_custkey AS records, 'open field conflict: status' AS reason, o_totalprice > 400000 AS high FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT 'CONTACT', 'u' || user_id || chr(0) || 'c' || event_type, 'uncertain contact state: DISCOVERED', false FROM events WHERE event_type IN ('view', 'click'))
SELECT 'review:v1:' || sha256(kind || chr(0) || records || chr(0) || reason) AS review_id, kind, CASE WHEN bool_or(high) THEN 'HIGH' ELSE 'NORMAL' END AS priority, reason, least(count(*), 1) AS merged
FROM i GROUP BY kind, records, reason
"""
)
def review_queue(t):
    """Items from conflicts and contacts, merged by id with the highest priority."""
    none = F.array().cast("array<string>")
    conflicts = t.orders.where("o_orderstatus = 'P'").select(
        F.concat(F.lit("x"), "o_custkey").alias("conflict_id"),
        F.col("o_custkey").cast("string").alias("subject_id"),
        F.lit("status").alias("field_name"),
        F.lit("OPEN").alias("status"),
        none.alias("candidate_fact_ids"),
        (F.col("o_totalprice") > 400000).alias("high_impact"),
        F.array(F.col("o_orderkey").cast("string")).alias("evidence_ids"),
    )
    contacts = t.events.select(
        F.concat(F.lit("c"), "event_type").alias("contact_id"),
        F.concat(F.lit("u"), "user_id").alias("owner_id"),
        F.when(F.col("event_type").isin("view", "click"), "DISCOVERED").otherwise("VALIDATED").alias("status"),
        none.alias("evidence_ids"),
    )
    return rv.queue(rv.conflicts(conflicts), rv.uncertain_contacts(contacts)).select("review_id", "kind", "priority", "reason", F.lit(1).cast("long").alias("merged"))


@query(
    """
WITH p AS (SELECT c_custkey AS k, c_nationkey % 5 AS g, c_custkey % 7 AS t, c_custkey % 11 AS i, c_custkey % 6 = 0 AS rv, c_custkey % 4 = 0 AS vc, c_custkey % 9 = 0 AS comp FROM customer),
q AS (SELECT *, g = 1 AS outside, g = 2 AS geo_unknown, t = 6 AS no_title, t = 5 AS other_title, t IN (0, 1, 2) AS special, t = 0 AS ceof,
  CASE WHEN i = 0 THEN 'HIGH' WHEN i = 1 THEN 'MEDIUM' WHEN i = 2 THEN 'LOW' ELSE 'UNKNOWN' END AS intent FROM p),
s AS (SELECT *, CASE WHEN geo_unknown OR no_title THEN 'UNKNOWN' WHEN outside OR other_title OR (rv AND NOT vc) THEN 'NOT_QUALIFIED' ELSE 'QUALIFIED' END AS before FROM q),
u AS (SELECT *, CASE WHEN comp AND before = 'QUALIFIED' AND NOT ceof THEN 'NOT_QUALIFIED' ELSE before END AS status FROM s),
v AS (SELECT *, CASE status WHEN 'UNKNOWN' THEN 'UNKNOWN' WHEN 'NOT_QUALIFIED' THEN 'LOW' ELSE CASE WHEN special THEN 'HIGH' ELSE 'MEDIUM' END END AS fit FROM u)
SELECT 'p' || k AS person_id, status AS qualification_status, fit, intent,
  CASE WHEN fit = 'LOW' THEN 'EXCLUDE' WHEN fit = 'UNKNOWN' THEN 'REVIEW' WHEN fit = 'HIGH' AND intent = 'HIGH' THEN 'P1'
    WHEN (fit = 'HIGH' AND intent IN ('MEDIUM', 'UNKNOWN')) OR (fit = 'MEDIUM' AND intent = 'HIGH') THEN 'P2' ELSE 'P3' END AS priority FROM v
"""
)
def qualify_cascade(t):
    """The whole cascade from facts to priority."""
    c = t.customer
    k = F.col("c_custkey")
    person, company = F.concat(F.lit("p"), k), F.concat(F.lit("co"), k)
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    country = pick(F.col("c_nationkey") % 5, "Brasil", "Chile", None, "BR", "Brazil")
    title = pick(k % 7, "Especialista CEOF", "Cirurgião Bucomaxilofacial", "Harmonização Orofacial", "Cirurgião-Dentista", "Ortodontista", "Advogado", None)
    intent = F.when(k % 11 == 0, "course_interest").when(k % 11 == 1, "CONTINUING_EDUCATION").when(k % 11 == 2, "EXPLICIT_NO_INTEREST")
    fact = lambda subject, field, value: c.select(subject.alias("subject_id"), F.lit(field).alias("field_name"), value.alias("raw_value"), F.lit(None).cast("string").alias("normalized_value")).where("raw_value is not null")
    facts = fact(company, "country", country).unionAll(fact(person, "professional_title", title)).unionAll(fact(person, "education_intent", intent))
    none = t.region.limit(0)
    canonicals = none.select(F.lit("").alias("subject_id"), F.lit("").alias("field_name"), F.lit("").alias("value"))
    conflicts = none.select(F.lit("").alias("subject_id"), F.lit("").alias("field_name"), F.lit("").alias("status"))
    contacts = c.select(company.alias("owner_id"), F.when(k % 4 == 0, "VALIDATED").otherwise("DISCOVERED").alias("status"))
    people = c.select(
        person.alias("person_id"), company.alias("company_id"), F.when(k % 9 == 0, ql.COMPLEMENTARY).otherwise("CEOF_SPECIALIZATION").alias("offer_track"), (k % 6 == 0).alias("require_validated_contact")
    )
    out = ql.decided(ql.profiles(people, ql.chosen(facts, canonicals), conflicts, contacts))
    return out.select("person_id", "qualification_status", "fit", "intent", "priority")


@query(
    """
WITH r AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS company, CAST(substr(o_orderpriority, 1, 1) AS INT) AS g, o_orderstatus = 'P' AS settled, o_custkey % 13 = 0 AS torn, o_custkey % 11 AS i,
  o_orderkey % 6 = 0 AS rv, o_orderkey % 9 = 0 AS comp, o_orderkey % 2 = 0 AS linked, o_custkey % 3 = 0 AS valid, o_orderkey % 7 AS t FROM orders),
q AS (SELECT *, g = 2 AS outside, g = 3 AS geo_unknown, (NOT settled AND t = 6) AS no_title, (NOT settled AND t = 5) AS other_title, (settled OR t IN (0, 1, 2)) AS special, (settled OR t = 0) AS ceof,
  CASE WHEN i = 0 THEN 'HIGH' WHEN i = 1 THEN 'MEDIUM' WHEN i = 2 THEN 'LOW' ELSE 'UNKNOWN' END AS intent FROM r),
s AS (SELECT *, CASE WHEN geo_unknown OR no_title OR torn THEN 'UNKNOWN' WHEN outside OR other_title OR (rv AND NOT (linked AND valid)) THEN 'NOT_QUALIFIED' ELSE 'QUALIFIED' END AS before FROM q),
u AS (SELECT *, CASE WHEN comp AND before = 'QUALIFIED' AND NOT ceof THEN 'NOT_QUALIFIED' ELSE before END AS status FROM s),
v AS (SELECT *, CASE status WHEN 'UNKNOWN' THEN 'UNKNOWN' WHEN 'NOT_QUALIFIED' THEN 'LOW' ELSE CASE WHEN special THEN 'HIGH' ELSE 'MEDIUM' END END AS fit FROM u),
w AS (SELECT *, CASE WHEN fit = 'LOW' THEN 'EXCLUDE' WHEN fit = 'UNKNOWN' THEN 'REVIEW' WHEN fit = 'HIGH' AND intent = 'HIGH' THEN 'P1'
    WHEN (fit = 'HIGH' AND intent IN ('MEDIUM', 'UNKNOWN')) OR (fit = 'MEDIUM' AND intent = 'HIGH') THEN 'P2' ELSE 'P3' END AS priority,
  list_sort(list_filter([CASE WHEN g <> 3 THEN 'fg' || company END, CASE WHEN t <> 6 THEN 'ft' || k END, CASE WHEN i < 3 THEN 'fi' || c END], lambda x: x IS NOT NULL)) AS facts,
  list_filter([CASE WHEN settled THEN 'k' || k END], lambda x: x IS NOT NULL) AS canonical, list_filter([CASE WHEN torn THEN 'x' || c END], lambda x: x IS NOT NULL) AS conflicts,
  list_filter([CASE WHEN linked THEN 'c' || c END], lambda x: x IS NOT NULL) AS contacts, list_sort(list_filter(['e' || k, CASE WHEN c % 5 = 0 THEN 'g' || c END, CASE WHEN g <> 3 THEN 'wg' END, CASE WHEN t <> 6 THEN 'wt' || (k % 10) END, CASE WHEN i < 3 THEN 'wi' || c END,
    CASE WHEN settled AND t <> 6 THEN 'wn' || k END], lambda x: x IS NOT NULL)) AS evidence FROM v)
SELECT 'r' || k AS relationship_id, 'p' || c AS person_id, company AS company_id, status AS qualification_status, fit, intent, priority,
  'qualification:v1:' || sha256(array_to_string(['p' || c, company, 'policy-1', CASE WHEN comp THEN 'COMPLEMENTARY_EXCLUSIVE_CEOF' ELSE 'CEOF_SPECIALIZATION' END, status, fit, intent, priority]
    || facts || canonical || conflicts || contacts || evidence, chr(0))) AS decision_id FROM w
"""
)
def qualify_relationships(t):
    """Orders as relationships of their customers: each is judged by its own facts and contacts, its person's and its company's."""
    o = t.orders
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    relation, person, company = F.concat(F.lit("r"), k), F.concat(F.lit("p"), c), F.col("o_orderpriority")
    none = F.lit(None).cast("string").alias("normalized_value")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    fact = lambda rows, key, subject, field, value, proof: rows.select(key.alias("fact_id"), subject.alias("subject_id"), F.lit(field).alias("field_name"), value.alias("raw_value"), none, F.array(proof).alias("evidence_ids")).where("raw_value is not null")
    customers = t.customer.withColumnRenamed("c_custkey", "o_custkey")
    title = pick(k % 7, "Especialista CEOF", "Cirurgião Bucomaxilofacial", "Harmonização Orofacial", "Cirurgião-Dentista", "Ortodontista", "Advogado", None)
    intent = F.when(c % 11 == 0, "course_interest").when(c % 11 == 1, "CONTINUING_EDUCATION").when(c % 11 == 2, "EXPLICIT_NO_INTEREST")
    country = pick(F.substring(company, 1, 1).cast("int") - 1, "Brasil", "Chile", None, "BR", "Brazil")
    facts = (
        fact(o, F.concat(F.lit("ft"), k), relation, "professional_title", title, F.concat(F.lit("wt"), k % 10))
        # not a field that counts: only its evidence does, where a canonical fact rests on it
        .unionAll(fact(o.where(k % 7 != 6), F.concat(F.lit("fn"), k), relation, "person_name", F.lit("Ana"), F.concat(F.lit("wn"), k)))
        .unionAll(fact(customers, F.concat(F.lit("fi"), c), person, "education_intent", intent, F.concat(F.lit("wi"), c)))
        .unionAll(fact(o.select("o_orderpriority").distinct(), F.concat(F.lit("fg"), company), company, "country", country, F.lit("wg")))
    )
    canonicals = o.where("o_orderstatus = 'P'").select(F.concat(F.lit("k"), k).alias("canonical_fact_id"), relation.alias("subject_id"), F.lit("professional_title").alias("field_name"), F.lit("Especialista CEOF").alias("value"), F.array(F.concat(F.lit("fn"), k), F.lit("nowhere")).alias("candidate_fact_ids"))
    torn = customers.where(c % 13 == 0).select(F.concat(F.lit("x"), c).alias("conflict_id"), person.alias("subject_id"))
    # one about a relationship itself is not asked for
    torn = torn.unionAll(o.where(k % 17 == 0).select(F.concat(F.lit("y"), k), relation)).withColumns({"field_name": F.lit("professional_title"), "status": F.lit("OPEN"), "candidate_fact_ids": F.array().cast("array<string>")})
    contacts = customers.select(F.concat(F.lit("c"), c).alias("contact_id"), F.lit("someone").alias("owner_id"), F.when(c % 3 == 0, "VALIDATED").otherwise("DISCOVERED").alias("status"))
    links = o.where(k % 2 == 0).select(relation.alias("relationship_id"), F.concat(F.lit("c"), c).alias("contact_id"))
    registrations = customers.where(c % 5 == 0).select(person.alias("person_id"), F.array(F.concat(F.lit("g"), c)).alias("evidence_ids"))
    relations = o.select(
        relation.alias("relationship_id"), person.alias("person_id"), company.alias("company_id"), F.when(k % 9 == 0, ql.COMPLEMENTARY).otherwise("CEOF_SPECIALIZATION").alias("offer_track"),
        (k % 6 == 0).alias("require_validated_contact"), F.array(F.concat(F.lit("e"), k)).alias("relationship_evidence_ids"),
    )
    out = ql.of_relationships(relations, "policy-1", facts, canonicals, torn, contacts, links, registrations)
    return out.select("relationship_id", "person_id", "company_id", "qualification_status", "fit", "intent", "priority", "decision_id")


@query(
    """
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderpriority = '5-LOW' THEN 'EXT-BRASILAPI-001' END,
  CASE WHEN NOT (o_totalprice > 100000 AND o_orderdate + INTERVAL 400 DAY > TIMESTAMP '1998-01-01') THEN 'LEGAL-001' END,
  CASE WHEN o_custkey % 2 = 0 AND o_orderstatus <> 'F' THEN 'EXT-CFO-001' END,
  CASE WHEN o_custkey % 10 = 0 THEN 'AUTH-CAMPAIGN-001' END], lambda x: x IS NOT NULL), ',') AS blockers FROM orders
"""
)
def preflight_blockers(t):
    now = F.lit("1998-01-01").cast("timestamp_ntz")
    expires = F.col("o_orderdate") + F.expr("interval 400 days")
    signed = gt.in_force(now, F.col("o_totalprice") > 100000, expires, F.lit(None).cast("timestamp_ntz"))
    got = gt.preflight(F.col("o_orderpriority") != "5-LOW", signed, F.col("o_custkey") % 2 == 0, F.col("o_orderstatus") == "F", F.col("o_custkey") % 10 != 0)
    return t.orders.select("o_orderkey", F.array_join(got["blockers"], ",").alias("blockers"))


@query(
    """
WITH b AS (SELECT o_orderkey, unnest(['LEGAL-001', 'X-' || o_orderstatus]) AS blocker FROM orders)
SELECT o_orderkey, blocker, CASE blocker WHEN 'LEGAL-001' THEN 'obtain sign-off' WHEN 'X-F' THEN 'close' ELSE 'review' END AS required_action FROM b
"""
)
def pilot_release_actions(t):
    rows = t.orders.select("o_orderkey", F.explode(F.array(F.lit("LEGAL-001"), F.concat(F.lit("X-"), "o_orderstatus"))).alias("blocker"))
    actions = t.spark.createDataFrame([("LEGAL-001", "obtain sign-off"), ("X-F", "close")], "blocker string, required_action string")
    return gt.release(rows, actions, "review").select("o_orderkey", "blocker", "required_action")


@query(
    """
WITH s AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 450000)
SELECT c_custkey, CASE WHEN s.o_custkey IS NOT NULL THEN 'SUPPRESSED' WHEN c_custkey % 5 = 0 THEN 'BLOCKED' WHEN c_custkey % 5 = 1 THEN 'REVIEW_REQUIRED'
  WHEN c_custkey % 5 = 2 AND c_acctbal > 0 THEN 'ALLOWED_BY_POLICY' WHEN c_acctbal > 0 THEN 'REVIEW_REQUIRED' ELSE 'UNKNOWN' END AS decision,
  CASE WHEN s.o_custkey IS NOT NULL THEN 'SUPPRESSED' WHEN c_custkey % 5 = 0 THEN 'R0' WHEN c_custkey % 5 = 1 THEN 'R1'
  WHEN c_custkey % 5 = 2 AND c_acctbal > 0 THEN 'ALLOWED_BY_POLICY' WHEN c_acctbal > 0 THEN 'REVIEW_REQUIRED' ELSE 'CONTACT_USE_UNKNOWN' END AS reason_code
FROM customer LEFT JOIN s ON s.o_custkey = c_custkey
"""
)
def suppression_contact_use(t):
    contacts = t.customer.withColumnRenamed("c_custkey", "contact_id")
    rules = t.orders.select(F.col("o_custkey").alias("subject_id"), ((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 450000)).alias("active"))
    k = F.col("contact_id") % 5
    compliance = F.when(k == 0, "BLOCKED").when(k == 1, "REVIEW_REQUIRED").when(k == 2, "ALLOWED_BY_POLICY")
    got = gt.contact_use(F.col("suppressed"), compliance, F.concat(F.lit("R"), k), F.col("c_acctbal") > 0)
    return gt.suppressed(contacts, rules).select(F.col("contact_id").alias("c_custkey"), got["decision"].alias("decision"), got["reason_code"].alias("reason_code"))


@query(
    """
SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'COMPLIANCE_BLOCKED' WHEN c_custkey % 11 = 0 THEN 'REVIEW_REQUIRED' WHEN c_custkey % 2 = 1 THEN 'DISCOVERED'
  WHEN c_custkey % 3 = 1 THEN 'VALIDATED' WHEN c_custkey % 5 = 1 THEN 'QUALIFIED' WHEN c_custkey % 7 = 1 THEN 'COMPLIANCE_PENDING' WHEN c_acctbal < 0 THEN 'LIVE_CERTIFICATION_PENDING' ELSE 'SEND_READY' END AS state FROM customer
"""
)
def send_ready_state(t):
    k = F.col("c_custkey")
    rows = t.customer.select(
        k,
        F.when(k % 13 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit(" "))).alias("compliance_blockers"),
        (k % 11 == 0).alias("review_required"),
        (k % 2 != 1).alias("discovered"),
        (k % 3 != 1).alias("validated"),
        (k % 5 != 1).alias("qualified"),
        (k % 7 != 1).alias("compliance_cleared"),
        (F.col("c_acctbal") >= 0).alias("live_certified"),
    )
    return gt.send_ready_of(rows).select("c_custkey", F.col("assessment.state").alias("state"))


_FLAGS = ", ".join(f"CASE WHEN c_custkey % {p} = 0 THEN '{f}' END" for p, f in zip((2, 3, 5, 7, 11, 13, 17, 19), gt.PILOT))


@query(
    f"""
WITH b AS (SELECT c_custkey, c_acctbal, list_filter([{_FLAGS}, CASE WHEN c_custkey % 23 = 0 THEN 'active_suppression_present' END], lambda x: x IS NOT NULL) AS b FROM customer)
SELECT c_custkey, CASE WHEN len(b) > 0 THEN 'NOT_READY' WHEN c_acctbal < 5000 THEN 'READY_PENDING_MANUAL_AUTHORIZATION' ELSE 'READY' END AS state, array_to_string(b, ',') AS blockers FROM b
"""
)
def pilot_readiness(t):
    k = F.col("c_custkey")
    nothing = F.lit(None).cast("string")
    rows = t.customer.select(
        k,
        *[(k % p != 0).alias(f) for p, f in zip((2, 3, 5, 7, 11, 13, 17, 19), gt.PILOT)],
        *[nothing.alias(c) for c in ("compliance_decision", "compliance_reason", "use_decision", "use_reason")],
        (k % 23 == 0).alias("active_suppression"),
        F.lit(True).alias("authorization_required"),
        (F.col("c_acctbal") >= 5000).alias("authorization_granted"),
    )
    return gt.pilot(rows).select("c_custkey", "state", F.array_join("blockers", ",").alias("blockers"))


@query(
    """
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'STALE' WHEN s_suppkey % 5 = 0 THEN 'UNKNOWN' WHEN s_acctbal < 0 THEN 'EXPIRED' WHEN s_suppkey % 4 = 1 THEN 'REVALIDATE_BEFORE_USE'
  WHEN s_suppkey % 4 = 2 THEN 'REVALIDATE_ON_CHANGE' ELSE 'REVALIDATE_ON_EXPIRY' END AS freshness FROM supplier
"""
)
def source_freshness(t):
    k = F.col("s_suppkey")
    policy = F.element_at(F.array(*map(F.lit, ("STALE", "REVALIDATE_BEFORE_USE", "REVALIDATE_ON_CHANGE", "REVALIDATE_ON_EXPIRY"))), (k % 4 + 1).cast("int"))
    certified = F.when(k % 5 != 0, F.lit("2024-01-01").cast("timestamp"))
    return t.supplier.select(k, gt.freshness(policy, certified, F.col("s_acctbal") < 0).alias("freshness"))


@query("SELECT 'CONTRACT_FAIL' AS status, 'o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS missing, 'l_partkey,l_suppkey' AS unexpected")
def schema_drift(t):
    """One table's columns against what another's were expected to be."""
    expected = F.array(*map(F.lit, t.orders.columns))
    observed = F.array(F.lit("o_orderkey"), F.lit("l_partkey"), F.lit("l_suppkey"))
    got = gt.drift(expected, observed)
    return t.spark.range(1).select(got["status"].alias("status"), F.array_join(got["missing"], ",").alias("missing"), F.array_join(got["unexpected"], ",").alias("unexpected"))


_RE = {"private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "aws_key": r"\bAKIA[0-9A-Z]{16}\b", "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36}", "assigned_secret": gt.SECRETS["assigned_secret"].replace("'", "''")}


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{p}') AS {k}" for k, p in _RE.items()) + " FROM documents")
def secret_scan(t):
    return gt.secrets(t.documents.select("doc_id", "text"), "text").drop("text")


@query(
    """
SELECT o_custkey AS company_id, string_agg('p' || o_orderkey, ',' ORDER BY 'p' || o_orderkey) AS person_ids FROM orders GROUP BY 1
"""
)
def person_ids_projection(t):
    rows = t.orders.select(F.col("o_custkey").alias("company_id"), F.concat(F.lit("p"), "o_orderkey").alias("person_id"))
    return ql.people_of_company(rows).withColumn("person_ids", F.array_join("person_ids", ","))


@query(
    """
SELECT c_custkey, '{"company":{"id":' || c_custkey || ',"name":"' || c_name || '"},"orders":[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']}' AS json
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name
"""
)
def export_bundle(t):
    """Canonical JSON of each customer with their orders in order."""
    orders = xp.section(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey", "orders").withColumnRenamed("o_custkey", "c_custkey")
    owners = t.customer.select("c_custkey", F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).alias("company"))
    rows = xp.bundles(owners, "c_custkey", orders).where("orders is not null")
    return xp.as_json(rows.select("company", "orders", F.col("c_custkey").alias("_k")).select(F.col("_k").alias("c_custkey"), "company", "orders").withColumnRenamed("c_custkey", "zz"), "zz").select(
        F.col("zz").alias("c_custkey"), F.regexp_replace("json", r',"zz":\d+\}$', "}").alias("json")
    )


@query(
    """
SELECT 'fact_company' AS "check", (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS violations
UNION ALL SELECT 'fact_provenance', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
UNION ALL SELECT 'provenance_evidence', (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey % 1000 = 7)
UNION ALL SELECT 'fact_ids', 0
"""
)
def export_closure(t):
    """References of a bundle that leave it."""
    s = lambda c, n: F.col(c).cast("string").alias(n)
    facts = t.orders.select(s("o_orderkey", "fact_id"), s("o_custkey", "company_id"), s("o_orderkey", "provenance_id"))
    provenance = t.lineitem.select(s("l_orderkey", "provenance_id")).distinct().withColumn("evidence_ids", F.array("provenance_id"))
    evidence = t.lineitem.where("l_orderkey % 1000 <> 7").select(s("l_orderkey", "evidence_id")).distinct()
    return xp.closure(t.customer.select(s("c_custkey", "company_id")), facts, provenance, evidence)


@query(
    """
WITH l AS (SELECT user_id, event_type, max(ts) AS last FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2)
SELECT event_id, CASE WHEN event_type = 'error' THEN 'BLOCKED' WHEN event_type = 'purchase' THEN 'CACHE_HIT'
  WHEN l.last IS NOT NULL AND TIMESTAMP '2024-01-20' < l.last + INTERVAL 60 SECOND THEN 'SCHEDULED' WHEN event_type = 'signup' THEN 'BLOCKED' ELSE 'DUE' END AS status
FROM events LEFT JOIN l USING (user_id, event_type) WHERE event_id % 2 = 1
"""
)
def rate_limited_attempts(t):
    """What is due now, given the last attempt of each key."""
    key = F.concat(F.col("user_id"), F.lit("|"), F.col("event_type"))
    e = t.events.withColumn("cache_key", key)
    state = e.where("event_id % 2 = 0").groupBy("cache_key").agg(F.max("ts").alias("last_attempt_at")).withColumn("succeeded", F.split("cache_key", r"\|")[1] == "purchase")
    succeeded = e.select("cache_key", "event_type").distinct()
    state = succeeded.join(state, "cache_key", "left").select("cache_key", "last_attempt_at", (F.col("event_type") == "purchase").alias("succeeded"))
    plan = e.where("event_id % 2 = 1").select("event_id", "cache_key", F.when(F.col("event_type") == "error", "BLOCKED").otherwise("READY").alias("disposition"), F.col("event_type").alias("action_kind"), F.lit(60).alias("min_interval_seconds"))
    return gp.status(plan, state, F.lit("2024-01-20").cast("timestamp_ntz"), ["view", "click", "purchase"]).select("event_id", "status")


