"""Measures over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery as dc
from ..operators import metrics as mt
from .catalog import query


def _flat(rows, *names):
    """The value and reason of each measure."""
    out = []
    for n in names:
        out += [F.round(F.col(f"{n}.value"), 6).alias(n), F.col(f"{n}.reason").alias(f"{n}_reason")]
    return out


@query(
    """
WITH r AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0), d AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1),
b AS (SELECT r.k AS rk, d.k AS dk, n FROM r FULL JOIN d ON r.k = d.k)
SELECT count(rk) AS reference_count, count(dk) AS discovered_count, count(*) FILTER (rk IS NOT NULL AND dk IS NOT NULL) AS matched, count(*) FILTER (dk IS NULL) AS missed,
  count(*) FILTER (rk IS NULL) AS unexpected, CAST(sum(n - 1) AS BIGINT) AS duplicate_observations FROM b
"""
)
def coverage_metrics(t):
    reference = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"))
    found = dc.coverage(reference, t.orders.where("o_custkey % 5 <> 0").select(F.col("o_custkey").alias("k")), "k")
    return found.select("reference_count", "discovered_count", "matched", "missed", "unexpected", "duplicate_observations")


@query(
    """
WITH f AS (SELECT DISTINCT o_custkey AS s, o_orderstatus AS f FROM orders WHERE o_totalprice > 250000), c AS (SELECT DISTINCT o_custkey AS s, o_orderstatus AS f FROM orders WHERE o_totalprice < 20000)
SELECT round((SELECT count(*) FROM f WHERE f IN ('F', 'O') AND s IN (SELECT c_custkey FROM customer)) / (2 * (SELECT count(*) FROM customer)), 6) AS field_coverage, CAST(NULL AS VARCHAR) AS field_coverage_reason,
  round((SELECT count(*) FROM c) / (SELECT count(*) FROM (SELECT * FROM f UNION SELECT * FROM c)), 6) AS conflict_rate, CAST(NULL AS VARCHAR) AS conflict_rate_reason
"""
)
def enrichment_metrics(t):
    fact = lambda rows: rows.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderstatus").alias("field_name"))
    fields = t.spark.createDataFrame([("F",), ("O",)], "field_name string")
    found = mt.enrichment(t.customer.select(F.col("c_custkey").alias("subject_id")), fields, fact(t.orders.where("o_totalprice > 250000")), fact(t.orders.where("o_totalprice < 20000")))
    return found.select(*_flat(found, "field_coverage", "conflict_rate"))


@query(
    """
WITH e AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS observations, count(*) AS entities, round((sum(n) - count(*)) / sum(n), 6) AS duplicate_rate, CAST(NULL AS VARCHAR) AS duplicate_rate_reason,
  round(count(*) FILTER (user_id IN (SELECT c_custkey FROM customer)) / (SELECT count(*) FROM customer), 6) AS coverage, CAST(NULL AS VARCHAR) AS coverage_reason,
  CAST(NULL AS DOUBLE) AS precision, 'discovery relevance ground truth is not supplied' AS precision_reason FROM e
"""
)
def discovery_metrics(t):
    found = mt.discovery(t.events.where("event_type = 'view'").select("user_id"), "user_id", t.customer.select(F.col("c_custkey").alias("user_id")))
    return found.select("observations", "entities", *_flat(found, "duplicate_rate", "coverage", "precision"))


@query(
    """
WITH l AS (SELECT o_custkey AS owner_id, CASE o_orderstatus WHEN 'F' THEN 'VALIDATED' WHEN 'O' THEN 'DISCOVERED' ELSE 'STALE' END AS status FROM orders)
SELECT count(*) AS logical_contacts, round(count(DISTINCT owner_id) FILTER (owner_id IN (SELECT c_custkey FROM customer)) / (SELECT count(*) FROM customer), 6) AS contact_discovery_rate, CAST(NULL AS VARCHAR) AS contact_discovery_rate_reason,
  round(count(*) FILTER (status = 'VALIDATED') / count(*), 6) AS validation_rate, CAST(NULL AS VARCHAR) AS validation_rate_reason,
  round(count(*) FILTER (status = 'INVALID') / count(*), 6) AS invalid_rate, CAST(NULL AS VARCHAR) AS invalid_rate_reason,
  round(count(*) FILTER (status = 'STALE') / count(*), 6) AS stale_rate, CAST(NULL AS VARCHAR) AS stale_rate_reason FROM l
"""
)
def contact_metrics(t):
    status = F.when(F.col("o_orderstatus") == "F", "VALIDATED").when(F.col("o_orderstatus") == "O", "DISCOVERED").otherwise("STALE")
    found = mt.contacts(t.orders.select(F.col("o_custkey").alias("owner_id"), status.alias("status")), t.customer.select(F.col("c_custkey").alias("owner_id")))
    return found.select("logical_contacts", *_flat(found, "contact_discovery_rate", "validation_rate", "invalid_rate", "stale_rate"))


@query(
    """
WITH c AS (SELECT count(*) FILTER (quality = 1 AND n_chars > 1000) AS tp, count(*) FILTER (quality = 0 AND n_chars > 1000) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 1000) AS fn FROM labels JOIN documents USING (doc_id))
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision_m, CAST(NULL AS VARCHAR) AS precision_m_reason, round(tp / (tp + fn), 6) AS recall_m, CAST(NULL AS VARCHAR) AS recall_m_reason FROM c
"""
)
def qualification_metrics(t):
    predicted = t.documents.select(F.col("doc_id").alias("lead_id"), F.when(F.col("n_chars") > 1000, "QUALIFIED").otherwise("UNKNOWN").alias("qualification_status"))
    found = mt.qualification(predicted, t.labels.select(F.col("doc_id").alias("lead_id"), (F.col("quality") == 1).alias("label")))
    return found.select("tp", "fp", "fn", *_flat(found, "precision_m", "recall_m"))


@query(
    """
SELECT l_suppkey, count(*) AS units, count(*) FILTER (l_returnflag = 'R') AS returned, round(100.0 / count(*), 6) AS cost, CAST(NULL AS VARCHAR) AS cost_reason,
  round(CASE WHEN count(*) FILTER (l_returnflag = 'R' AND l_quantity > 49) > 0 THEN 100.0 / count(*) FILTER (l_returnflag = 'R' AND l_quantity > 49) END, 6) AS cost_returned,
  CASE WHEN count(*) FILTER (l_returnflag = 'R' AND l_quantity > 49) = 0 THEN 'no returned units' END AS cost_returned_reason,
  CAST(NULL AS DOUBLE) AS time, 'elapsed-time telemetry is not supplied' AS time_reason FROM lineitem GROUP BY 1
"""
)
def unit_costs(t):
    back = F.col("l_returnflag") == "R"
    rows = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("units"), F.count_if(back).alias("returned"), F.count_if(back & (F.col("l_quantity") > 49)).alias("many"))
    found = rows.select(
        "l_suppkey",
        "units",
        "returned",
        mt.per_unit(F.lit(100.0), F.col("units"), "cost telemetry is not supplied", "no units").alias("cost"),
        mt.per_unit(F.lit(100.0), F.col("many"), "cost telemetry is not supplied", "no returned units").alias("cost_returned"),
        mt.per_unit(F.lit(None).cast("double"), F.col("units"), "elapsed-time telemetry is not supplied", "no units").alias("time"),
    )
    return found.select("l_suppkey", "units", "returned", *_flat(found, "cost", "cost_returned", "time"))


@query(
    """
WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 0 AND quality = 1) AS tn, count(*) FILTER (toxic = 1 AND quality = 1) AS fn FROM labels),
m AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM c)
SELECT 'whole corpus' AS scope, (SELECT count(*) FROM events) AS observations, (SELECT count(DISTINCT user_id) FROM events) AS entities, tp, fp, tn, fn,
  round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 6) AS f1 FROM m
"""
)
def measurement_report(t):
    """One row with a struct for each section, here flattened."""
    toxic, bad = F.col("toxic") == 1, F.col("quality") == 0
    counts = t.labels.agg(F.count_if(toxic & bad).alias("tp"), F.count_if(~toxic & bad).alias("fp"), F.count_if(~toxic & ~bad).alias("tn"), F.count_if(toxic & ~bad).alias("fn"))
    whole = mt.report("whole corpus", discovery=mt.discovery(t.events.select("user_id"), "user_id"), resolution=mt.resolution(counts))
    rounded = [F.round(f"resolution.{c}_m.value", 6).alias(c) for c in ("precision", "recall", "f1")]
    return whole.select("scope", "discovery.observations", "discovery.entities", *[f"resolution.{c}" for c in ("tp", "fp", "tn", "fn")], *rounded)
