"""People, gates, plans and stores over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import digest, joined
from ..operators import contacts as ct
from ..operators import discovery as dc
from ..operators import evidence as ev
from ..operators import export as xp
from ..operators import fusion as fu
from ..operators import gates as gt
from ..operators import governance as gv
from ..operators import people as pp
from ..operators import qualification as ql
from ..operators import review as rv
from .catalog import query
from .form_queries import _cases

# --- people --------------------------------------------------------------------


def _people(t):
    """Customers as people of their nation, with facts, contacts and relationship evidence."""
    k = F.col("c_custkey")
    person = F.concat(F.lit("p"), k)
    people = t.customer.select(person.alias("person_id"), F.concat(F.lit("n"), "c_nationkey").alias("company_id"), F.array(F.concat(F.lit("rel"), k)).alias("relationship_evidence_ids"))
    fact = lambda field, raw, normal, e: t.customer.select(person.alias("subject_id"), F.lit(field).alias("field_name"), raw.alias("raw_value"), normal.alias("normalized_value"), F.array(F.concat(F.lit(e), k)).alias("evidence_ids"))
    facts = (
        fact("person_name", F.concat(F.lit("Áná  "), (k % 100).cast("string")), F.lit(" "), "n")
        .unionAll(fact("professional_role_title", F.lit("x"), F.lower("c_mktsegment"), "r"))
        .unionAll(fact("city", F.lit("x"), F.lit("y"), "c"))
    )
    contact = lambda kind, value, e: t.customer.select(person.alias("owner_id"), F.lit(kind).alias("kind"), value.alias("value"), F.array(F.concat(F.lit(e), k)).alias("evidence_ids"))
    contacts = (
        contact("EMAIL", F.when(k % 3 == 0, F.concat(F.lit("A"), k % 50, F.lit("@X.com"))).otherwise("none"), "e")
        .unionAll(contact("PHONE", F.concat(F.lit("+55 "), 1000000 + k % 40), "p"))
        .unionAll(contact("PROFESSIONAL_PROFILE", F.concat(F.lit("https://www.linkedin.com/in/A"), k % 30, F.lit("/")), "l"))
        .unionAll(contact("CONTACT_FORM", F.lit("x"), "f"))
    )
    return pp.assembled(people, facts, contacts)


_RECORDS = """
r AS (SELECT c_custkey AS k, c_nationkey AS company, 'ana ' || (c_custkey % 100) AS name, lower(c_mktsegment) AS role, CASE WHEN c_custkey % 3 = 0 THEN 'a' || (c_custkey % 50) || '@x.com' END AS email,
  '55' || (1000000 + c_custkey % 40) AS phone, 'linkedin.com/in/a' || (c_custkey % 30) AS profile FROM customer)
"""


@query(
    f"""
WITH {_RECORDS}
SELECT 'p' || k AS person_id, name AS names, role AS roles, coalesce(email, '') AS emails, phone AS phones, profile AS profiles,
  list_aggregate(list_sort(['rel' || k, 'n' || k, 'r' || k, 'e' || k, 'p' || k, 'l' || k]), 'string_agg', ',') AS evidence FROM r
"""
)
def person_records(t):
    """People with their comparable names, roles, e-mails, phones and profiles, and the evidence of all."""
    return _people(t).select("person_id", *[F.array_join(c, ",").alias(c) for c in pp.SIGNALS], F.array_join("evidence_ids", ",").alias("evidence"))


_PEOPLE_PAIRS = f"""
WITH {_RECORDS},
p AS (SELECT a.k AS ak, b.k AS bk, a.company = b.company AS c, a.name = b.name AS n, a.role = b.role AS t, coalesce(a.email = b.email, FALSE) AS e, a.phone = b.phone AS f, a.profile = b.profile AS l, (a.k + b.k) % 4 = 0 AS same
  FROM r a JOIN r b ON b.k = a.k + 20 OR b.k = a.k + 100 OR b.k = a.k + 120 OR b.k = a.k + 300),
d AS (SELECT *, l OR (n AND (e OR f OR t)) OR (e AND f) AS review FROM p)
"""


def _pairs(t):
    """Each person with those 20, 100, 120 and 300 ids further on."""
    sides = _people(t).withColumn("k", F.expr("CAST(substr(person_id, 2) AS BIGINT)"))
    record = F.struct("company_id", "relationship_evidence_ids", *pp.SIGNALS)
    left = sides.select(F.col("k").alias("ak"), record.alias("l"), F.explode(F.array(*map(F.lit, (20, 100, 120, 300)))).alias("step"))
    right = sides.select(F.col("k").alias("bk"), record.alias("r"))
    return pp.features(left.join(right, F.col("bk") == F.col("ak") + F.col("step"))).withColumn("same", (F.col("ak") + F.col("bk")) % 4 == 0)


@query(
    f"""{_PEOPLE_PAIRS}
SELECT ak, bk, CASE WHEN review THEN 'REVIEW' ELSE 'INSUFFICIENT_EVIDENCE' END AS disposition, CASE WHEN NOT review THEN 'no_v1_review_rule' ELSE array_to_string(list_filter([
  CASE WHEN c AND n AND l THEN 'same_company,normalized_name_exact,professional_profile_exact,auto_match_not_authorized' WHEN l THEN 'professional_profile_exact' END,
  CASE WHEN n AND (e OR f OR t) AND NOT (c AND l) THEN 'normalized_name_exact' END,
  CASE WHEN n AND e THEN 'email_exact' END, CASE WHEN n AND f THEN 'phone_exact' END, CASE WHEN n AND t THEN 'role_exact' END,
  CASE WHEN e AND f AND NOT n THEN 'email_exact,phone_exact' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM d
"""
)
def person_triage(t):
    """Pairs of people by the review rules, with each reason once."""
    return _pairs(t).withColumn("x", pp.triage()).select("ak", "bk", "x.disposition", F.array_join("x.reasons", ",").alias("reasons"))


@query(
    f"""{_PEOPLE_PAIRS}
SELECT count(*) AS pairs, count(*) FILTER (same) AS same_person_pairs, count(*) FILTER (review) AS reviews, count(*) FILTER (review AND same) AS same_person_reviews, count(*) FILTER (NOT review) AS insufficient,
  round(count(*) FILTER (review) / count(*), 6) AS review_rate, round(count(*) FILTER (NOT review) / count(*), 6) AS insufficient_rate,
  round(count(*) FILTER (review AND same) / nullif(count(*) FILTER (same), 0), 6) AS positive_review_recall FROM d
"""
)
def person_review_measures(t):
    rows = pp.measures(_pairs(t), "same", pp.triage()["disposition"])
    return rows.withColumns({c: F.round(c, 6) for c in ("review_rate", "insufficient_rate", "positive_review_recall")})


@query(
    f"""{_PEOPLE_PAIRS}, h AS (SELECT *, c AND n AND l AS hit FROM d)
SELECT count(*) FILTER (hit AND same) AS tp, count(*) FILTER (hit AND NOT same) AS fp, count(*) FILTER (same) AS same, count(*) FILTER (NOT same) AS "distinct",
  round(count(*) FILTER (hit AND same) / nullif(count(*) FILTER (hit), 0), 6) AS precision, round(coalesce(count(*) FILTER (hit AND same) / nullif(count(*) FILTER (same), 0), 0), 6) AS recall,
  round(coalesce(count(*) FILTER (hit AND NOT same) / nullif(count(*) FILTER (NOT same), 0), 0), 6) AS false_merge_rate FROM h
"""
)
def person_experimental_measures(t):
    """The diagnostic match; its precision is null where nothing matched."""
    rows = pp.experimental_measures(_pairs(t), "same")
    return rows.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "false_merge_rate")})


# --- relationships ---------------------------------------------------------------


def _relationships(t):
    return t.orders.select(F.concat(F.lit("r"), "o_orderkey").alias("relationship_id"), F.concat(F.lit("p"), "o_custkey").alias("person_id"))


@query("SELECT l_orderkey, l_linenumber, 'p' || o_custkey AS subject_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber % 2 = 0 UNION ALL SELECT l_orderkey, l_linenumber, 'x' || l_orderkey FROM lineitem WHERE l_linenumber % 2 = 1")
def rebased_facts(t):
    """Facts about a relationship become facts about its person; others stay."""
    odd = F.col("l_linenumber") % 2 == 1
    facts = t.lineitem.select(F.concat(F.when(odd, "x").otherwise("r"), "l_orderkey").alias("subject_id"), "l_orderkey", "l_linenumber")
    return ql.rebased(facts, _relationships(t)).select("l_orderkey", "l_linenumber", "subject_id")


@query(
    """
SELECT 'r' || l_orderkey AS relationship_id, 'c' || l_suppkey AS contact_id, 'p' || o_custkey AS owner_id, 'EMAIL' AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
"""
)
def relationship_contacts(t):
    """Contacts linked to a relationship, owned by its person."""
    contacts = t.supplier.select(F.concat(F.lit("c"), "s_suppkey").alias("contact_id"), F.lit("EMAIL").alias("kind"), F.lit("company").alias("owner_id"))
    links = t.lineitem.select(F.concat(F.lit("r"), "l_orderkey").alias("relationship_id"), F.concat(F.lit("c"), "l_suppkey").alias("contact_id"))
    return ct.of_relationship(contacts, links, _relationships(t)).select("relationship_id", "contact_id", "owner_id", "kind")


@query(
    """
WITH u AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)
SELECT 'identity' AS part, 'p' || o_custkey AS id, NULL AS company_id FROM (SELECT DISTINCT o_custkey FROM u) UNION ALL SELECT 'relationship', 'relationship:p' || o_custkey || ':' || o_orderpriority, o_orderpriority FROM u
"""
)
def people_split(t):
    """People that embed a company, as identities and relationships."""
    people = t.orders.select(F.concat(F.lit("p"), "o_custkey").alias("person_id"), F.col("o_orderpriority").alias("company_id")).distinct().withColumn("relationship_evidence_ids", F.array(F.lit("e")))
    one, two = ql.split_people(people)
    none = F.lit(None).cast("string").alias("company_id")
    return one.select(F.lit("identity").alias("part"), F.col("person_id").alias("id"), none).unionAll(two.select(F.lit("relationship"), "relationship_id", "company_id"))


@query(
    """
SELECT 'p' || o_custkey AS person_id, list_aggregate(list_sort(list_distinct(list('e' || o_orderkey) || list('g' || (o_orderkey % 7)) FILTER (o_orderstatus = 'F'))), 'string_agg', ',') AS evidence
FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'F') > 0
UNION ALL SELECT 'p' || o_custkey, list_aggregate(list_sort(list('e' || o_orderkey)), 'string_agg', ',') FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'F') = 0
"""
)
def registration_evidence(t):
    """Evidence of a relationship with that of its person's registrations."""
    person = F.concat(F.lit("p"), "o_custkey").alias("person_id")
    relations = t.orders.groupBy(person).agg(F.collect_list(F.concat(F.lit("e"), "o_orderkey")).alias("relationship_evidence_ids"))
    registrations = t.orders.where("o_orderstatus = 'F'").select(person, F.array(F.concat(F.lit("g"), F.col("o_orderkey") % 7)).alias("evidence_ids"))
    return ql.with_registrations(relations, registrations).select("person_id", F.array_join("relationship_evidence_ids", ",").alias("evidence"))


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND event_id % 3 <> 0 AND event_id % 5 <> 0")
def qualifying_evidence(t):
    """Evidence that may confirm a contact: a page of two kinds of sources, read as text."""
    kind = F.when(F.col("event_type") == "view", ct.PAGE_SOURCES[0]).when(F.col("event_type") == "click", ct.PAGE_SOURCES[1]).otherwise("public-api")
    sources = t.events.select(F.col("event_type").alias("source_id"), kind.alias("source_type")).distinct()
    k = F.col("event_id")
    evidence = t.events.select("event_id", F.col("event_type").alias("source_id"), F.when(k % 3 == 0, 404).otherwise(200).alias("http_status"), F.when(k % 5 != 0, F.col("props")).alias("raw_payload"))
    return ct.qualifying(evidence, sources).select("event_id")


@query(
    """
WITH d AS (SELECT c_custkey, ['QUALIFIED', 'NOT_QUALIFIED', 'UNKNOWN'][c_custkey % 3 + 1] AS s, 'p' || c_custkey AS p, 'n' || c_nationkey AS n FROM customer)
SELECT 'lead:v1:' || sha256(p || chr(0) || n || chr(0) || 'v1' || chr(0) || 'A') AS lead_id, n AS company_id, ['QUALIFIED', 'DISQUALIFIED', 'REVIEW'][c_custkey % 3 + 1] AS stage, s AS qualification_status,
  'policy_id=v1|person_id=' || p || '|offer_track=A|fit=HIGH|intent=LOW|priority=P3|why' AS reasons FROM d
"""
)
def lead_rows(t):
    """The lead of each decision, with its audit trail."""
    k = F.col("c_custkey")
    decisions = t.customer.select(
        F.concat(F.lit("p"), k).alias("person_id"), F.concat(F.lit("n"), "c_nationkey").alias("company_id"), F.lit("A").alias("offer_track"),
        _cases(k, "QUALIFIED", "NOT_QUALIFIED", "UNKNOWN").alias("qualification_status"), *[F.lit(v).alias(c) for c, v in (("fit", "HIGH"), ("intent", "LOW"), ("priority", "P3"))], F.array(F.lit("why")).alias("reasons"),
    )
    return ql.leads(decisions, "v1", F.current_timestamp()).select("lead_id", "company_id", "stage", "qualification_status", F.array_join("qualification_reasons", "|").alias("reasons"))


# --- gates -----------------------------------------------------------------------


@query(
    """
SELECT c_custkey, 'proof:' || c_custkey AS proof_id, CASE WHEN c_custkey % 7 = 0 THEN 'COMPLIANCE_BLOCKED' WHEN c_custkey % 5 = 0 THEN 'COMPLIANCE_BLOCKED' WHEN c_custkey % 3 = 0 THEN 'REVIEW_REQUIRED' WHEN c_custkey % 2 = 0 THEN 'QUALIFIED' ELSE 'SEND_READY' END AS state,
  c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 2 <> 0 AS ready,
  CASE WHEN c_custkey % 7 = 0 THEN 'authorization inactive' WHEN c_custkey % 5 = 0 THEN 'compliance blockers present' WHEN c_custkey % 3 = 0 THEN 'review required' WHEN c_custkey % 2 = 0 THEN 'qualified' END AS missing FROM customer
"""
)
def send_ready_proofs(t):
    """Assessments with their proofs; an authorization that is not active blocks before all else."""
    k = F.col("c_custkey")
    yes = F.lit(True)
    rows = t.customer.select(
        "c_custkey", k.cast("string").alias("evaluation_id"), (k % 7 != 0).alias("authorization_active"), F.when(k % 5 == 0, F.array(F.lit("CB-001"))).otherwise(F.array(F.lit(" "))).alias("compliance_blockers"),
        (k % 3 == 0).alias("review_required"), yes.alias("discovered"), yes.alias("validated"), (k % 2 != 0).alias("qualified"), yes.alias("compliance_cleared"), yes.alias("live_certified"),
    )
    return gt.send_ready_proof(rows).select("c_custkey", "proof_id", "assessment.state", "assessment.ready", "assessment.missing")


@query(
    """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'BLOCKED' WHEN s_suppkey % 2 = 0 OR s_suppkey % 5 = 0 THEN 'REVIEW_REQUIRED' ELSE 'ALLOWED_BY_POLICY' END AS decision,
  CASE WHEN s_suppkey % 3 = 0 THEN 'SUPPRESSED' WHEN s_suppkey % 2 = 0 OR s_suppkey % 5 = 0 THEN 'LEGAL_REVIEW_REQUIRED' ELSE 'ALLOWED_BY_POLICY' END AS reason_code FROM supplier
"""
)
def compliance_decisions(t):
    k = F.col("s_suppkey")
    return t.supplier.select("s_suppkey", gt.compliance(k % 3 == 0, k % 2 == 0, k % 5 == 0).alias("x")).select("s_suppkey", "x.*")


@query(
    f"""
WITH c AS (SELECT c_custkey, list_filter(list_transform(range(10), lambda i: CASE WHEN (c_custkey >> i) % 2 = 1 THEN {[reason for _, reason in gv.RELEASE_CHECKS]}[i + 1] END), lambda x: x IS NOT NULL) AS b FROM customer)
SELECT c_custkey, array_to_string(b, ',') AS blockers, CASE WHEN len(b) > 0 THEN 'BLOCKED' ELSE 'READY' END AS state FROM c
"""
)
def release_candidates(t):
    """Ten checks in order; the bits of a key say which fail."""
    rows = t.customer.select("c_custkey", *[(F.shiftright("c_custkey", i) % 2 == 0).alias(c) for i, (c, _) in enumerate(gv.RELEASE_CHECKS)])
    return gv.release_candidate(rows).select("c_custkey", F.array_join("blockers", ",").alias("blockers"), "state")


@query(
    """
SELECT n_nationkey, ['EXT-BRASILAPI-001', 'EXT-CFO-001', 'LEGAL-001', 'AUTH-CAMPAIGN-001', 'OTHER-1'][n_nationkey % 5 + 1] AS blocker, ['SOURCE_OPERATOR', 'PROFESSIONAL_REVIEWER', 'LEGAL_COMPLIANCE', 'CAMPAIGN_OWNER', 'NONE'][n_nationkey % 5 + 1] AS owner, n_nationkey % 5 < 4 AS critical FROM nation
"""
)
def gate_owners(t):
    """Who clears each blocker, and whether it is on the critical path."""
    blockers = t.nation.select("n_nationkey", _cases(F.col("n_nationkey"), "EXT-BRASILAPI-001", "EXT-CFO-001", "LEGAL-001", "AUTH-CAMPAIGN-001", "OTHER-1").alias("blocker"))
    critical = gv.critical_gates(t.spark).select(F.col("gate_id").alias("blocker"), F.lit(True).alias("critical"))
    return gv.required_actions(blockers).join(F.broadcast(critical), "blocker", "left").select("n_nationkey", "blocker", "owner", F.coalesce("critical", F.lit(False)).alias("critical"))


# --- plans, reviews, stores --------------------------------------------------------


@query(
    """
WITH r AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT count(*) FILTER (o_orderpriority = '1-URGENT') AS high_priority, count(*) FILTER (o_orderpriority <> '1-URGENT') AS normal_priority FROM r
"""
)
def review_counts(t):
    """Items of a queue by priority."""
    items = t.orders.select(
        F.concat("o_orderpriority", F.lit("/"), "o_orderstatus").alias("review_id"), F.lit("CONFLICT").alias("kind"), F.when(F.col("o_orderpriority") == "1-URGENT", "HIGH").otherwise("NORMAL").alias("priority"),
        F.array(F.lit("x")).alias("record_ids"), F.lit("why").alias("reason"), F.array(F.col("o_orderkey").cast("string")).alias("evidence_ids"),
    )
    return rv.counts(rv.queue(items))


@query("SELECT 'f' || (l_orderkey % 1000) AS fact_id, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def repeated_fact_ids(t):
    """Fact ids that no fusion accepts, as they occur more than once."""
    return fu.improper(t.lineitem.select(F.concat(F.lit("f"), F.col("l_orderkey") % 1000).alias("fact_id")))


@query("SELECT s_suppkey, s_nationkey % 2 = 0 AS succeeded, CASE WHEN s_nationkey % 2 = 0 THEN n_name END AS body FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def acquired_seeds(t):
    """Each seed with its response; a seed without one stays, as not acquired."""
    responses = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("body"))
    return dc.acquired(t.supplier.select("s_suppkey", "s_nationkey"), responses, "s_nationkey").select("s_suppkey", "succeeded", "body")


@query(
    """
SELECT 'attempted' AS measure, count(*) AS n FROM supplier UNION ALL SELECT 'succeeded', count(*) FROM supplier WHERE s_nationkey % 2 = 0 UNION ALL SELECT 'failed', count(*) FROM supplier WHERE s_nationkey % 2 = 1
"""
)
def acquisition_counts(t):
    """How many seeds were tried, acquired and not."""
    responses = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("body"))
    counted = dc.acquisition_counts(dc.acquired(t.supplier.select("s_suppkey", "s_nationkey"), responses, "s_nationkey"))
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("n")) for c in ("attempted", "succeeded", "failed")])).alias("x")).select("x.*")


@query("SELECT 'company' AS csv_column, CAST(c_custkey AS VARCHAR) AS id, '{\"id\":\"' || c_custkey || '\",\"name\":\"' || c_name || '\"}' AS cell FROM customer")
def export_cells(t):
    """Nested values of an export row as canonical JSON cells."""
    rows = t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name")).alias("company"))
    return xp.as_cells(rows).select(F.lit("company").alias("csv_column"), "id", F.col("company").alias("cell"))


@query("SELECT doc_id, sha256(CAST(doc_id AS VARCHAR) || chr(0) || coalesce(text, '') || chr(0) || source) AS storage_digest, doc_id % 11 = 0 AS damaged FROM documents")
def storage_digests(t):
    """Digests of stored rows, and which rows no longer have theirs."""
    made = digest(joined([F.col("doc_id"), F.col("text"), F.col("source")]))
    rows = t.documents.select("doc_id", made.alias("storage_digest"), F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("now"), digest(F.col("text")).alias("d"))
    bad = ev.tampered(rows, "now", "d").select("doc_id", F.lit(True).alias("damaged"))
    return rows.select("doc_id", "storage_digest").join(bad, "doc_id", "left").withColumn("damaged", F.coalesce("damaged", F.lit(False)))
