"""Ledgers and runs over the driver's tables, each in a new folder of the session."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from ..functions import typed as ty
from ..functions.hashing import digest
from ..operators import evidence as ev
from ..operators import gap_runs as gr
from ..operators import gaps as gp
from ..sources import acquired as aq
from ..sources import readers, scratch
from ..sources.ledger import Ledger
from .catalog import query


def _documents(t):
    return t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "source")


def _filled(t, name: str) -> Ledger:
    """Documents in three batches, of which each overlaps the one before, and the second is tried twice."""
    docs = _documents(t)
    ledger = Ledger.made(t.spark, scratch.folder(t.spark, name), "doc_id", docs.schema, buckets=16)
    ledger.append(docs.where("cast(doc_id as long) % 3 = 0"), "thirds")
    ledger.append(docs.where("cast(doc_id as long) % 2 = 0"), "halves")
    ledger.append(docs.where("cast(doc_id as long) % 2 = 0"), "halves")
    ledger.append(docs, "all")
    return ledger


@query(
    """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'thirds' WHEN doc_id % 2 = 0 THEN 'halves' ELSE 'all' END AS batch, sha256(coalesce(text, '')) AS content
FROM documents
"""
)
def ledger_appends(t):
    """Which of several overlapping and repeated batches added each document, and its content as read back."""
    ledger = _filled(t, "appends")
    return ledger.history().join(ledger.rows().select("doc_id", digest(F.col("text")).alias("content")), "doc_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, length(coalesce(text, '')) AS n FROM documents JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id)")
def ledger_lookups(t):
    """The stored documents that labels of good quality name, from the buckets of their keys."""
    ledger = _filled(t, "lookups")
    wanted = t.labels.where("quality = 1").select(F.col("doc_id").cast("string").alias("doc_id"))
    return ledger.found(wanted).select("doc_id", "source", F.length("text").cast("long").alias("n"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(coalesce(text, '')) AS content_digest, length(coalesce(text, '')) AS n_chars FROM documents")
def ledger_restored(t):
    """All documents after a compaction, two formats forward, a backup, and a checked restore from it."""
    ledger = _filled(t, "formats")
    ledger.compact()
    ledger.migrated(3, {1: lambda r: r.withColumn("content_digest", digest(F.col("text"))), 2: lambda r: r.withColumn("n_chars", F.length("text").cast("long")).drop("source")})
    backup = ledger.copied(scratch.folder(t.spark, "backup"))
    restored = backup.copied(scratch.folder(t.spark, "restored"))
    return restored.rows().select("doc_id", "content_digest", "n_chars")


@query(
    """
WITH a AS (SELECT o_custkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 3 ELSE 1 END AS m, o_orderkey % 7 + 1 AS r FROM orders WHERE o_orderstatus = 'O'),
k AS (SELECT *, (r + m - 1) // m AS k FROM a),
c AS (SELECT c_custkey, count(k) AS n, count(*) FILTER (k = 1) AS m1, count(*) FILTER (k = 2) AS m2, count(*) FILTER (k = 3) AS m3 FROM customer LEFT JOIN k ON o_custkey = c_custkey GROUP BY 1),
s AS (SELECT c_custkey, n, CASE WHEN n = 0 THEN 0 WHEN n = m1 OR m1 = 0 THEN 1 WHEN n = m1 + m2 OR m2 = 0 THEN 2 ELSE 3 END AS cycles,
  CASE WHEN n = 0 THEN 'NO_GAPS' WHEN n = m1 OR (m1 > 0 AND n = m1 + m2) OR (m1 > 0 AND m2 > 0 AND n = m1 + m2 + m3) THEN 'GAPS_RESOLVED'
    WHEN m1 = 0 OR m2 = 0 OR m3 = 0 THEN 'NO_PROGRESS_OR_SCHEDULED' ELSE 'MAX_CYCLES_REACHED' END AS stop FROM c)
SELECT CAST(c_custkey AS VARCHAR) AS company_id, stop, cycles, count(*) FILTER (k > cycles) AS open_gaps,
  coalesce(sum(CASE WHEN k <= cycles THEN r ELSE m * cycles END), 0)::BIGINT AS attempts
FROM s LEFT JOIN k ON o_custkey = c_custkey GROUP BY c_custkey, stop, cycles
"""
)
def gap_runs(t):
    """Runs of all customers at once: an open order is a gap, closed by as many tries as its key says, in three cycles at most."""
    network = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    key = F.col("o_orderkey").cast("string")
    plan = t.orders.where("o_orderstatus = 'O'").select(
        F.col("o_custkey").cast("string").alias("company_id"), F.concat(F.lit("gap:"), key).alias("gap_id"), F.lit("READY").alias("disposition"), F.when(network, "PAGE").otherwise("LOCAL").alias("action_kind"),
        F.lit(None).cast("string").alias("locator"), F.when(network, 3).otherwise(1).alias("max_attempts"), F.when(network, 60).otherwise(0).alias("min_interval_seconds"),
        F.concat(F.lit("action:"), key).alias("action_id"), F.concat(F.lit("key:"), key).alias("cache_key"),
    )
    tries = t.orders.select(F.concat(F.lit("action:"), key).alias("action_id"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("try"), F.lit(True).alias("succeeded"), F.lit(None).cast("string").alias("error"))
    companies = t.customer.select(F.col("c_custkey").cast("string").alias("company_id"))
    runs = gr.Runs(t.spark, scratch.folder(t.spark, "runs"))

    def planner():
        left = plan.join(runs.state().where("succeeded").select("cache_key"), "cache_key", "left_anti")
        return left.select("company_id", "gap_id"), left.select(*plan.columns)

    times = iter(datetime(2026, 1, 1, tzinfo=timezone.utc) + i * timedelta(seconds=90) for i in range(3))
    stops = runs.until_stable(companies, planner, gr.captured(tries), ["PAGE", "LOCAL"], lambda: next(times), 3)
    open_ = planner()[0].groupBy("company_id").agg(F.count("*").alias("open_gaps"))
    spent = runs.records().groupBy("company_id").agg(F.sum("attempts").alias("attempts"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return stops.join(open_, "company_id", "left").join(spent, "company_id", "left").select("company_id", "stop", "cycles", zero("open_gaps"), zero("attempts"))


@query(
    """
WITH k AS (SELECT c_custkey AS k, c_name, c_nationkey AS n FROM customer),
r AS (SELECT k, 'v' || k AS verification_id, CASE k % 7 WHEN 1 THEN 'person_id is required' WHEN 2 THEN 'verified_at must be timezone-aware' WHEN 3 THEN 'evidence_refs must be a non-empty list of non-blank strings'
  WHEN 4 THEN 'decision must be one of: CONFLICT, NOT_FOUND, VERIFIED_ACTIVE, VERIFIED_INACTIVE' WHEN 5 THEN 'payload must be an object' END AS reason, c_name, n FROM k)
SELECT k AS c_custkey, reason, CASE WHEN reason IS NULL THEN verification_id END AS verification_id, CASE WHEN reason IS NULL THEN c_name END AS person_id,
  CASE WHEN reason IS NULL THEN TIMESTAMP '2026-01-01 03:00:00' + to_days(n::INT) END AS verified_at, CASE WHEN reason IS NULL THEN 1 + n % 2 END::BIGINT AS refs FROM r
"""
)
def payload_reads(t):
    """Verification payloads made of customers, read into typed records or refused with a reason."""
    k = F.col("c_custkey")
    fault = k % 7
    body = F.struct(
        F.concat(F.lit(" v"), k).alias("verification_id"),
        F.when(fault == 1, "  ").otherwise(F.col("c_name")).alias("person_id"),
        F.lit("CRO").alias("council"),
        F.lit("1").alias("registration_number"),
        F.lit("r").alias("reviewer_reference"),
        F.concat(F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), F.col("c_nationkey").cast("int")), "yyyy-MM-dd"), F.when(fault == 2, "T00:00:00").otherwise("T00:00:00-03:00")).alias("verified_at"),
        F.when(fault == 3, F.array(F.lit(""))).when(F.col("c_nationkey") % 2 == 1, F.array(F.lit("e1"), F.lit(" e2 "))).otherwise(F.array(F.lit("e1"))).alias("evidence_refs"),
        F.when(fault == 4, "MAYBE").otherwise("VERIFIED_ACTIVE").alias("decision"),
    )
    payloads = t.customer.select("c_custkey", F.when(fault == 5, "[1]").otherwise(F.to_json(body)).alias("body"))
    read = readers.parsed(payloads, readers.VERIFICATION)
    fine = F.size("reasons") == 0
    own = lambda c: F.when(fine, F.col(f"record.{c}"))
    refs = F.when(fine, F.size("record.evidence_refs").cast("long"))
    return read.select("c_custkey", F.nullif(F.array_join("reasons", ";"), F.lit("")).alias("reason"), own("verification_id").alias("verification_id"), own("person_id").alias("person_id"), own("verified_at").cast("timestamp_ntz").alias("verified_at"), refs.alias("refs"))


@query(
    """
SELECT o_orderkey, '["dict",[[["str","at"],["datetime","' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '"]],[["str","key"],["int",' || o_orderkey || ']],[["str","parts"],["tuple",[["bytes","' || lower(hex(o_orderpriority)) || '"],["NoneType",null]]]],'
  || '[["str","price"],["float",' || o_totalprice || ']],[["str","tags"],["dict",[[["str","' || o_orderstatus || '"],["list",[["bool",' || (o_orderkey % 2 = 0) || '],["bool",true]]]]]]]]]' AS typed_key FROM orders
"""
)
def typed_row_keys(t):
    """Typed keys of nested values of all kinds, made of each order."""
    value = F.struct(
        F.col("o_orderkey").alias("key"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("at"),
        F.create_map(F.col("o_orderstatus"), F.array(F.col("o_orderkey") % 2 == 0, F.lit(True))).alias("tags"),
        F.struct(F.col("o_orderpriority").cast("binary").alias("_1"), F.lit(None).cast("string").alias("_2")).alias("parts"),
    )
    rows = t.orders.select("o_orderkey", value.alias("v"))
    return rows.select("o_orderkey", ty.key(F.col("v"), rows.schema["v"].dataType).alias("typed_key"))


@query(
    """
WITH p AS (SELECT 'g' || l_orderkey % 100 AS gap_id, CASE WHEN l_linenumber % 3 = 0 THEN 'BLOCKED' ELSE 'READY' END AS disposition, CASE WHEN l_linenumber % 3 > 0 THEN l_linestatus END AS kind,
  CASE WHEN l_linenumber % 3 = 1 THEN l_returnflag END AS locator, l_orderkey || '/' || l_linenumber || '/' || l_partkey AS action_id, l_suppkey FROM lineitem)
SELECT action_id, l_suppkey AS company_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY gap_id, disposition, coalesce(kind, ''), coalesce(locator, ''), action_id) AS nth FROM p
"""
)
def action_order(t):
    """The place of each planned action among its company's, in the order of the whole plan."""
    line = F.col("l_linenumber")
    plan = t.lineitem.select(
        F.col("l_suppkey").alias("company_id"),
        F.concat(F.lit("g"), F.col("l_orderkey") % 100).alias("gap_id"),
        F.when(line % 3 == 0, "BLOCKED").otherwise("READY").alias("disposition"),
        F.when(line % 3 > 0, F.col("l_linestatus")).alias("action_kind"),
        F.when(line % 3 == 1, F.col("l_returnflag")).alias("locator"),
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("action_id"),
    )
    placed = gp.ordered(plan).withColumn("_at", F.monotonically_increasing_id())
    return ev.positions(placed, ["company_id"], ["_at"], "nth").select("action_id", "company_id", F.col("nth").cast("long").alias("nth"))


@query(
    """
SELECT 'evidence:p' || page_id AS evidence_id, regexp_extract(url, '^https?://([^/]+)', 1) AS source_id, url AS locator, 200 + page_id % 300 AS http_status, sha256(html) AS payload_digest,
  'refresh ' || page_id AS purpose, '[["a","' || page_id || '"],["content-type","text/html"]]' AS headers FROM pages WHERE page_id % 5 > 0
"""
)
def request_evidence(t):
    """Evidence of the responses to requests for pages; every fifth request has none."""
    key = F.concat(F.lit("p"), "page_id")
    source = F.regexp_extract("url", "^https?://([^/]+)", 1)
    requests = t.pages.select(key.alias("request_id"), source.alias("source_id"), "url", F.concat(F.lit("refresh "), "page_id").alias("purpose"))
    headers = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("a"), F.col("page_id").cast("string"))
    responses = t.pages.where("page_id % 5 > 0").select(key.alias("request_id"), "url", (200 + F.col("page_id") % 300).alias("status_code"), F.col("html").alias("raw_payload"), F.lit("2026-01-01").cast("timestamp").alias("captured_at"), headers.alias("headers"))
    found = aq.materialized(requests, responses)
    return found.select("evidence_id", "source_id", "locator", "http_status", digest(F.col("raw_payload")).alias("payload_digest"), F.col("metadata")["purpose"].alias("purpose"), F.col("metadata")["headers"].alias("headers"))
