"""Evidence, normalisation, extraction and fusion over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..functions import identifiers as idn
from ..functions import text as tx
from ..operators import contacts as ct
from ..operators import discovery as dc
from ..operators import evidence as ev
from ..operators import fusion as fu
from ..operators import normalize as nm
from ..sources import captured as cp
from .catalog import query

HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), ':(80|443)$', '')"
URL = rf"lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || {HOST} || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1)"


@query(f"SELECT page_id, {URL} AS normalized FROM pages")
def norm_url(t):
    return t.pages.select("page_id", idn.checked_url(tx.clean(F.col("url")))["value"].alias("normalized"))


@query(f"SELECT page_id, {HOST} AS domain FROM pages")
def norm_domain(t):
    return t.pages.select("page_id", idn.checked_domain(tx.clean(F.col("url")))["value"].alias("domain"))


@query(
    f"""
SELECT status, rule, count(*) AS facts FROM (
  SELECT CASE WHEN {URL} = url THEN 'UNCHANGED' ELSE 'NORMALIZED' END AS status, 'url_scheme_host_fragment_v1' AS rule FROM pages
  UNION ALL SELECT 'UNCHANGED', 'company_name_nfkc_whitespace_v1' FROM part
  UNION ALL SELECT CASE WHEN upper(lang) = lang THEN 'UNCHANGED' ELSE 'NORMALIZED' END, 'state_two_letter_upper_v1' FROM documents
  UNION ALL SELECT 'INVALID', NULL FROM nation
  UNION ALL SELECT 'UNSUPPORTED', NULL FROM region
) GROUP BY status, rule
"""
)
def norm_status_summary(t):
    """Outcomes by rule: URLs, names, two-letter codes, codes that are no CNAE, and a field without a rule."""
    fact = lambda rows, field, value: rows.select(F.lit(field).alias("field_name"), F.col(value).cast("string").alias("raw_value"))
    facts = (
        fact(t.pages, "website", "url")
        .unionAll(fact(t.part, "legal_name", "p_name"))
        .unionAll(fact(t.documents, "state", "lang"))
        .unionAll(fact(t.nation, "cnae_code", "n_name"))
        .unionAll(fact(t.region, "weather", "r_name"))
    )
    return nm.normalized(facts).groupBy("status", "rule").agg(F.count("*").alias("facts"))


@query(
    """
SELECT s_suppkey, CASE WHEN regexp_full_match(k, '[0-9A-Z]{14}') THEN k END AS registry_key FROM (
  SELECT s_suppkey, upper(regexp_replace('12.' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') || '.678/' || right(s_name, 4) || '-' || right(s_name, 2), '[.\\-/\\s]', '', 'g')) AS k FROM supplier)
"""
)
def registry_key(t):
    name, key = F.col("s_name"), F.col("s_suppkey").cast("string")
    raw = F.concat(F.lit("12."), F.lpad(key, 3, "0"), F.lit(".678/"), F.right(name, F.lit(4)), F.lit("-"), F.right(name, F.lit(2)))
    return t.supplier.select("s_suppkey", idn.registry_key(raw).alias("registry_key"))


@query(
    """
SELECT p_partkey AS id, list_aggregate(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'string_agg', ' ') AS tokens FROM part
UNION ALL SELECT c_custkey, list_aggregate(regexp_extract_all(lower(c_name), '[a-z0-9]+'), 'string_agg', ' ') FROM customer
"""
)
def tokenize_name(t):
    words = lambda c: F.array_join(tx.tokens(tx.folded_entity(F.col(c))), " ").alias("tokens")
    return t.part.select(F.col("p_partkey").alias("id"), words("p_name")).unionAll(t.customer.select(F.col("c_custkey").alias("id"), words("c_name")))


@query(
    """
SELECT doc_id, sha256(replace(strip_accents(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 'ß', 'ss')) AS folded_sha256 FROM documents
"""
)
def fold_documents(t):
    """The record fold over whole texts."""
    return t.documents.select("doc_id", F.sha2(tx.folded_person(F.col("text")).cast("binary"), 256).alias("folded_sha256"))


@query(
    """
SELECT doc_id, sha256(text) AS content_digest, 'evidence:' || sha256('doc://' || doc_id || chr(0) || text) AS evidence_id FROM documents
"""
)
def evidence_content_address(t):
    url = F.concat(F.lit("doc://"), F.col("doc_id"))
    return t.documents.select("doc_id", hs.digest(F.col("text")).alias("content_digest"), ev.content_id("evidence", url, F.col("text")).alias("evidence_id"))


@query(
    """
SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id, count(*) OVER (PARTITION BY sha256(text)) AS copies,
  doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) AS is_first FROM documents
"""
)
def evidence_exact_duplicates(t):
    return ev.duplicates(t.documents.select("doc_id", "text"), "text", "doc_id").select("doc_id", "first_id", "copies", "is_first")


@query(
    """
SELECT 'inserted' AS outcome, count(*) AS records FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark))
UNION ALL SELECT 'unchanged', count(*) FROM documents d JOIN benchmark b ON d.doc_id = b.item_id WHERE d.text = b.text
UNION ALL SELECT 'conflict', count(*) FROM documents d JOIN benchmark b ON d.doc_id = b.item_id WHERE d.text <> b.text
"""
)
def evidence_append(t):
    """Documents appended to a store that holds the benchmark under its own ids."""
    stored = t.benchmark.select(F.col("item_id").alias("id"), "text")
    inserted, same, conflict = ev.append(stored, t.documents.select(F.col("doc_id").alias("id"), "text"), "id", "text")
    count = lambda rows, name: rows.agg(F.count("*").alias("records")).select(F.lit(name).alias("outcome"), "records")
    return count(inserted, "inserted").unionAll(count(same, "unchanged")).unionAll(count(conflict, "conflict"))


@query("SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events WHERE event_type = 'purchase'")
def evidence_scan_ordered(t):
    """An ordered scan of one source, with the place of each row among its user's in the order of the scan."""
    scanned = ev.scan(t.events, "ts", "event_id", F.col("event_type") == "purchase").withColumn("_at", F.monotonically_increasing_id())
    return ev.positions(scanned, ["user_id"], ["_at"], "nth").select("event_id", "user_id", "event_type", F.col("nth").cast("long").alias("nth"))


@query("SELECT count(*) AS tampered FROM documents WHERE doc_id % 97 = 0")
def evidence_tampered(t):
    """Rows whose stored digest is that of another text."""
    stored = F.when(F.col("doc_id") % 97 == 0, hs.digest(F.concat("text", F.lit("!")))).otherwise(hs.digest(F.col("text")))
    return ev.tampered(t.documents.withColumn("d", stored), "text", "d").agg(F.count("*").alias("tampered"))


_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"


@query(f"SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{_EMAIL}'))) AS email FROM documents")
def contact_email_extract(t):
    found = t.documents.select("doc_id", F.explode(idn.emails_in(F.col("text"))).alias("e"))
    return found.select("doc_id", F.lower("e").alias("email")).distinct()


@query(
    """
SELECT doc_id, d AS digits FROM (
  SELECT DISTINCT doc_id, regexp_replace(unnest(regexp_extract_all(coalesce(text, '') || ' Telefone: +55 (11) ' || (90000000 + doc_id) || '; fone 12-3; Tel. ' || (5550000 + doc_id % 100), '(?i)(?:telefone|fone|tel\\.?|phone)\\s*:?[\\s ]*(\\+?\\d[\\d\\s()./-]{5,}\\d)', 1)), '[^0-9]', '', 'g') AS d FROM documents)
WHERE length(d) BETWEEN 7 AND 15
"""
)
def contact_phone_extract(t):
    """Phones of whole texts that end in a long one, one that is too short, and one that documents share."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" Telefone: +55 (11) "), F.lit(90000000) + F.col("doc_id"), F.lit("; fone 12-3; Tel. "), F.lit(5550000) + F.col("doc_id") % 100)
    found = t.documents.select("doc_id", F.explode(idn.phones_in(text)).alias("p"))
    return found.select("doc_id", idn.digits(F.col("p")).alias("digits")).distinct()


@query(
    f"""
WITH e AS (SELECT doc_id, source, lower(unnest(regexp_extract_all(text, '{_EMAIL}'))) AS email FROM documents)
SELECT source, email, min(doc_id) AS first_doc FROM e GROUP BY source, email
"""
)
def contact_dedupe_first(t):
    """The first document of each address within a source."""
    found = t.documents.select("doc_id", "source", F.explode(idn.emails_in(F.col("text"))).alias("e")).withColumn("email", F.lower("e"))
    return ev.first_seen(found.select("source", "email", "doc_id"), ["source", "email"], ["doc_id"]).withColumnRenamed("doc_id", "first_doc")


@query(
    """
WITH c AS (SELECT user_id AS owner_id, event_type AS kind, ts, event_id,
  CASE event_id % 5 WHEN 0 THEN 'DISCOVERED' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'STALE' WHEN 3 THEN 'INVALID' ELSE 'VALIDATED' END AS status FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY owner_id, kind ORDER BY date_trunc('day', ts) DESC, event_id % 5 DESC, event_id) AS n FROM c)
SELECT owner_id, kind, status, event_id FROM r WHERE n = 1
"""
)
def contact_latest_logical(t):
    status = F.element_at(F.array(*map(F.lit, ct.STATUS_RANK)), (F.col("event_id") % 5 + 1).cast("int"))
    contacts = t.events.select(
        F.col("user_id").alias("owner_id"),
        F.col("event_type").alias("kind"),
        F.lit("value").alias("value"),
        status.alias("status"),
        F.date_trunc("day", F.col("ts")).alias("discovered_at"),
        F.lit(None).cast("timestamp").alias("validated_at"),
        "event_id",
    )
    return ct.latest(contacts, "event_id").select("owner_id", "kind", "status", "event_id")


@query(
    """
SELECT user_id AS owner_id, event_type AS kind, count(*) AS confirmations, count(DISTINCT event_id % 3) AS places,
  CASE WHEN count(*) >= 2 AND (count(DISTINCT event_id % 3) > 1 OR count(DISTINCT ts) > 1) THEN 'VALIDATED' ELSE 'INSUFFICIENT_EVIDENCE' END AS disposition
FROM events WHERE value > 50 GROUP BY 1, 2
"""
)
def contact_corroboration(t):
    """Independent confirmations of a user's event type, by place and time."""
    seen = t.events.where("value > 50")
    contacts = seen.select(
        F.col("event_id").cast("string").alias("contact_id"),
        F.concat(F.col("user_id"), F.lit("|"), F.col("event_type")).alias("owner_id"),
        F.lit("PHONE").alias("kind"),
        F.lit("+55 11 1234-5678").alias("value"),
        F.lit("DISCOVERED").alias("status"),
        F.array(F.col("event_id").cast("string")).alias("discovery_evidence_ids"),
    )
    pages = seen.select(F.col("event_id").cast("string").alias("evidence_id"), (F.col("event_id") % 3).alias("locator"), F.col("ts").alias("captured_at"))
    found = ct.corroborated(contacts, pages)
    own = F.split("owner_id", r"\|")
    return found.select(own[0].cast("long").alias("owner_id"), own[1].alias("kind"), "confirmations", F.size("locators").cast("long").alias("places"), "disposition")


@query(
    """
WITH v AS (SELECT o_custkey AS s, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, v) AS k, count(*) OVER (PARTITION BY s) AS d, sum(n) OVER (PARTITION BY s) AS c FROM v)
SELECT s AS subject_id, 'order_priority' AS field_name, CASE WHEN d = 1 THEN 'CANONICAL' ELSE 'CONFLICT' END AS status,
  d AS distinct_values, CAST(c AS BIGINT) AS candidates, v AS majority_value, round(n / c, 6) AS majority_ratio FROM r WHERE k = 1
"""
)
def fusion_conflicts(t):
    """Which customers' order priorities agree; the majority is a diagnostic."""
    facts = t.orders.select(F.col("o_custkey").alias("subject_id"), F.lit("order_priority").alias("field_name"), F.col("o_orderpriority").alias("value_key"))
    return fu.outcomes(facts).withColumn("majority_ratio", F.round("majority_ratio", 6))


@query(
    """
SELECT o_custkey AS subject_id, o_orderstatus AS value_key, count(*) AS support_count,
  round(count(*) / sum(count(*)) OVER (PARTITION BY o_custkey), 6) AS support_ratio,
  string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS fact_ids FROM orders GROUP BY 1, 2
"""
)
def fusion_support(t):
    facts = t.orders.select(F.col("o_custkey").alias("subject_id"), F.lit("status").alias("field_name"), F.col("o_orderstatus").alias("value_key"), F.col("o_orderkey").alias("fact_id"))
    found = fu.supports(facts)
    return found.select("subject_id", "value_key", "support_count", F.round("support_ratio", 6).alias("support_ratio"), F.array_join(F.transform("fact_ids", lambda x: x.cast("string")), ",").alias("fact_ids"))


@query(
    """
WITH v AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS k FROM v)
SELECT p_brand, p_type AS majority_value FROM r WHERE k = 1
"""
)
def fusion_majority(t):
    facts = t.part.select(F.col("p_brand").alias("subject_id"), F.lit("type").alias("field_name"), F.col("p_type").alias("value_key"))
    return fu.outcomes(facts).select(F.col("subject_id").alias("p_brand"), "majority_value")


@query(
    """
WITH g AS (SELECT CAST(o_custkey AS VARCHAR) AS s, string_agg('["str","order:' || o_orderkey || '"]', ',' ORDER BY 'order:' || o_orderkey) AS ids,
  min(o_orderstatus) AS lo, max(o_orderstatus) AS hi, max(o_orderdate) AS m FROM orders GROUP BY 1),
j AS (SELECT *, '["dict",[[["str","candidate_fact_ids"],["list",[' || ids || ']]],[["str","field_name"],["str","status"]],[["str","subject_id"],["str","' || s || '"]],[["str","value"],' AS head FROM g)
SELECT s AS subject_id, CASE WHEN lo = hi THEN 'CANONICAL' ELSE 'CONFLICT' END AS status,
  CASE WHEN lo = hi THEN 'canonical:fusion:v1:' || left(sha256(head || '["str","' || lo || '"]]]]'), 24) END AS canonical_fact_id,
  CASE WHEN lo <> hi THEN 'conflict:fusion:v1:' || left(sha256(head || '["NoneType",null]]]]'), 24) END AS conflict_id,
  CASE WHEN lo = hi THEN strftime(m, '%Y-%m-%d') END AS generated_on FROM j
"""
)
def fusion_ids(t):
    """Canonical facts and conflicts with the ids that their contents give."""
    order = F.concat(F.lit("order:"), F.col("o_orderkey"))
    facts = t.orders.select(
        F.col("o_custkey").cast("string").alias("subject_id"),
        F.lit("status").alias("field_name"),
        order.alias("fact_id"),
        F.array(order).alias("evidence_ids"),
        hs.typed_key(F.lit("str"), hs.json_text(F.col("o_orderstatus"))).alias("value_key"),
        F.col("o_orderdate").alias("observed_at"),
    )
    return fu.fused(facts).select("subject_id", "status", "canonical_fact_id", "conflict_id", F.date_format("generated_at", "yyyy-MM-dd").alias("generated_on"))


@query(
    """
SELECT CAST(c_custkey AS VARCHAR) AS subject_id, unnest(['legal_name', 'segment', 'nation']) AS field_name,
  unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS raw_value FROM customer
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), unnest(['legal_name', 'nation']), unnest([s_name, CAST(s_nationkey AS VARCHAR)]) FROM supplier
"""
)
def field_unpivot(t):
    customers = nm.unpivoted(t.customer, "c_custkey", {"c_name": "legal_name", "c_mktsegment": "segment", "c_nationkey": "nation"})
    return customers.unionAll(nm.unpivoted(t.supplier, "s_suppkey", {"s_name": "legal_name", "s_nationkey": "nation"}))


@query(
    """
WITH a AS (SELECT upper(lpad(CAST(s_suppkey AS VARCHAR), 14, '0')) AS k, s_name, s_nationkey FROM supplier WHERE s_suppkey % 10 <> 3 AND s_suppkey % 10 <> 5)
SELECT 'company:' || k AS subject_id, unnest(['business_registry_id', 'legal_name', 'city']) AS field_name, unnest([k, s_name, 'CITY ' || s_nationkey]) AS raw_value FROM a
"""
)
def lookup_facts(t):
    """Registry answers as JSON: usable ones give facts, an error status and a wrong key do not."""
    key = F.lpad(F.col("s_suppkey").cast("string"), 14, "0")
    wrong = F.when(F.col("s_suppkey") % 10 == 5, F.lit("99999999999999")).otherwise(key)
    body = F.to_json(F.struct(wrong.alias("cnpj"), F.col("s_name").alias("razao_social"), F.lit(" ").alias("nome_fantasia"), F.concat(F.lit("CITY "), F.col("s_nationkey")).alias("municipio")))
    seen = t.supplier.select(
        key.alias("requested_key"), F.concat(F.lit("https://registry.example/"), key).alias("url"), body.alias("body"), F.when(F.col("s_suppkey") % 10 == 3, 500).otherwise(200).alias("http_status")
    )
    return cp.lookup_facts(cp.lookups(seen)).select("subject_id", "field_name", "raw_value")


@query(
    """
SELECT source AS merge_key, min(doc_id) AS seq, arg_min(lang, doc_id) AS display,
  arg_min(CASE WHEN n_chars > 2000 THEN lang END, CASE WHEN n_chars > 2000 THEN doc_id END) AS known_group,
  list_aggregate(list_sort(list_distinct(list(lang))), 'string_agg', ',') AS terms FROM documents GROUP BY source
"""
)
def candidate_merge(t):
    """First value, first known value and union within a key."""
    rows = t.documents.select(
        F.col("source").alias("merge_key"), F.col("doc_id").alias("seq"), F.col("lang").alias("display"), F.when(F.col("n_chars") > 2000, F.col("lang")).alias("known_group"), F.array("lang").alias("terms")
    )
    return dc.merged(rows, "merge_key", "seq", ["display"], ["known_group"], ["terms"]).withColumn("terms", F.array_join("terms", ","))


@query(
    """
WITH q AS (SELECT n_nationkey, 'dentista ' || n_name AS query, 'query:' || n_nationkey AS query_id FROM nation),
i AS (SELECT 'Dentista   NATION_' || (s_nationkey % 30) AS query, s_suppkey, unnest([1, 2]) AS pos FROM supplier)
SELECT s_suppkey, pos - 1 AS position, query_id FROM i LEFT JOIN q ON lower(q.query) = lower(regexp_replace(i.query, '\\s+', ' ', 'g'))
"""
)
def search_hits(t):
    """Search results by the query that they answer, looked up by folded text."""
    queries = t.nation.select(F.concat(F.lit("dentista "), "n_name").alias("query"), F.concat(F.lit("query:"), "n_nationkey").alias("query_id"))
    items = t.supplier.select("s_suppkey", F.concat(F.lit("Dentista   NATION_"), F.col("s_nationkey") % 30).alias("query"), F.array(F.lit("a"), F.lit("b")).alias("organic_results"))
    return dc.observed(items, queries).select("s_suppkey", "position", "query_id")


@query(
    """
SELECT r_name AS state, n_name AS professional_group, n_name || ' CRO ' || r_name AS query FROM region, nation WHERE r_name <> 'ASIA' ORDER BY upper(r_name), n_nationkey LIMIT 40
"""
)
def query_plan_limit(t):
    """A bounded, ordered plan of place by group."""
    states = t.region.where("r_name <> 'ASIA'").select(F.col("r_name").alias("state"))
    groups = t.nation.select(F.col("n_name").alias("professional_group"), F.concat("n_name", F.lit(" CRO")).alias("template"), F.col("n_nationkey").alias("group_order"))
    return dc.query_plan(states, groups, "plan", 40).select("state", "professional_group", "query")


@query(
    """
SELECT o_orderkey, 'gap:v1:' || sha256(CAST(o_custkey AS VARCHAR) || chr(0) || o_orderstatus || chr(0) || '') AS gap_id FROM orders
"""
)
def deterministic_ids(t):
    """Ids from parts joined by NUL, where a missing part keeps its place."""
    return t.orders.select("o_orderkey", hs.derived_id("gap:v1", F.col("o_custkey"), F.col("o_orderstatus"), F.lit(None)).alias("gap_id"))
