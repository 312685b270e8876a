import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from attesta.operators import bounds as bd
from attesta.operators import discovery as dc
from attesta.sources import acquired as aq
from attesta.sources import readers as rd

GOOD = {"authorization_id": " a1 ", "campaign_id": "c", "policy_id": "p", "policy_version": "1", "authorizer_reference": "r", "authorized_at": "2026-01-01T00:00:00Z"}
SIGNED = {"signoff_id": "s", "reviewer_reference": "r", "policy_id": "p", "policy_version": "1", "jurisdiction": "br", "channel": "e", "campaign_id": "c", "decided_at": "2026-01-01T00:00:00-03:00", "decision": "APPROVED"}
CASES = [
    (GOOD, []),
    (GOOD | {"valid_until": None, "extra": [1]}, []),
    (GOOD | {"campaign_id": "  "}, ["campaign_id is required"]),
    (GOOD | {"campaign_id": 7}, ["campaign_id is required"]),
    ({k: v for k, v in GOOD.items() if k != "authorized_at"}, ["authorized_at is required"]),
    (GOOD | {"authorized_at": 5}, ["authorized_at must be an ISO-8601 string"]),
    (GOOD | {"authorized_at": "soon", "valid_until": "2026-01-01T00:00:00"}, ["authorized_at must be a valid ISO-8601 timestamp", "valid_until must be timezone-aware"]),
    ([1], ["payload must be an object"]),
    ("no", ["payload must be an object"]),
]
SIGNED_CASES = [
    (SIGNED, []),
    (SIGNED | {"conditions": ["x", " y "], "authority_evidence_refs": []}, []),
    (SIGNED | {"conditions": "x"}, ["conditions must be a list of strings"]),
    (SIGNED | {"conditions": ["x", " "], "decision": "YES"}, ["conditions must contain only non-blank strings", "decision must be one of: APPROVED, APPROVED_WITH_CONDITIONS, MORE_REVIEW_REQUIRED, REJECTED"]),
    (SIGNED | {"conditions": ["x", 3]}, ["conditions must contain only non-blank strings"]),
]


def payloads(spark, bodies):
    return spark.createDataFrame([(b,) for b in bodies], "body string")


def test_reasons(spark):
    for record, cases in ((rd.AUTHORIZATION, CASES), (rd.SIGNOFF, SIGNED_CASES)):
        rows = spark.createDataFrame([(i, json.dumps(b)) for i, (b, _) in enumerate(cases)], "i int, body string")
        got = [r.reasons for r in rd.parsed(rows, record).orderBy("i").collect()]
        assert got == [r for _, r in cases]
    assert rd.parsed(payloads(spark, ["{broken", None]), rd.SIGNOFF).select("reasons").distinct().collect()[0].reasons == ["payload must be an object"]
    kept = rd.good(rd.parsed(payloads(spark, [json.dumps(SIGNED | {"conditions": ["x", " y "]})]), rd.SIGNOFF)).first()
    assert kept.conditions == ["x", "y"] and kept.authority_evidence_refs == [] and kept.expires_at is None


def test_good_and_refused_add_up_in_batch_and_stream(spark, tmp_path):
    bodies = [json.dumps(b) for b, _ in CASES] + ["{", None]
    told = rd.ingest(payloads(spark, bodies), rd.AUTHORIZATION, str(tmp_path / "one"), "first")
    assert told == {"rows": 11, "accepted": 2, "refused": 9, "added": 1, "quarantined": 9}
    again = rd.ingest(payloads(spark, bodies), rd.AUTHORIZATION, str(tmp_path / "one"), "first")
    assert again["added"] == again["quarantined"] == 0
    kept, bad = rd.ledgers(spark, str(tmp_path / "one"), rd.AUTHORIZATION)
    assert [r.authorization_id for r in kept.rows().collect()] == ["a1"] and bad.rows().count() == 9
    source = str(tmp_path / "in")
    payloads(spark, bodies).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("body string").parquet(source)
    query, counts = rd.ingested(stream, rd.AUTHORIZATION, str(tmp_path / "two"), str(tmp_path / "state"))
    query.awaitTermination()
    assert counts == [told | {"batch": 0}]


def fails(rows, name):
    with pytest.raises(Exception, match=name):
        rows.count()
    with pytest.raises(Exception, match=name):
        rows.select(F.lit(1)).collect()


def test_bounds_fail_and_never_cut(spark):
    assert bd.at_most(spark.range(5), 5, "max_items").count() == 5
    fails(bd.at_most(spark.range(6), 5, "max_items"), "more than max_items=5")
    with pytest.raises(ValueError):
        bd.at_most(spark.range(1), 0, "max_items")
    queries = spark.createDataFrame([("q1", "a"), ("q2", "b")], "query_id string, query string")
    items = spark.createDataFrame([("a", [("t", "u")])], "query string, organic_results array<struct<title: string, url: string>>")
    assert dc.answered(items, queries, 2, 1).first().query_id == "q1"
    fails(dc.answered(items, queries, 1, 1), "max_queries=1")


def test_plans_results_and_batches_keep_their_rules(spark):
    schema = "action_id string, disposition string, action_kind string, cache_key string, max_attempts int, min_interval_seconds int"
    plan = lambda *rows: bd.sound_plan(spark.createDataFrame(list(rows), schema))
    ready, blocked = ("a", "READY", "GO", "k", 1, 0), ("b", "BLOCKED", None, None, 0, 0)
    assert plan(ready, blocked).count() == 2
    fails(plan(ready, ready), "an action is planned twice: a")
    fails(plan(("c", "READY", "GO", None, 1, 0)), "a READY action .*: c")
    fails(plan(("c", "BLOCKED", "GO", None, 1, 0)), "a BLOCKED action .*: c")
    fails(plan(("c", "MAYBE", None, None, 1, 0)), "READY or BLOCKED: c")
    results = lambda *r: bd.sound_results(spark.createDataFrame(list(r), "status string, value string, rule_id string"))
    assert results(("SUCCESS", "v", "r"), ("INVALID", None, None)).count() == 2
    fails(results(("SUCCESS", None, "r")), "a success")
    hit = "query_id string, title string, url string, position int, evidence_id string"
    evidence = spark.createDataFrame([("e",)], "evidence_id string")
    hits = lambda *r: bd.sound_batch(spark.createDataFrame(list(r), hit), evidence)
    assert hits(("q", "t", "u", None, "e"), ("q", "t", "u", 1, "e")).count() == 2
    fails(hits(("q", "t", "u", 1, "f")), "same batch: f")
    fails(hits(("q", "t", "u", 0, "e")), "position")
    fails(hits(("q", " ", "u", 1, "e")), "title")


def test_evidence_carries_the_id_of_its_request(spark):
    asked = lambda *r: spark.createDataFrame(list(r), aq.REQUEST)
    answered = lambda *r: spark.createDataFrame(list(r), aq.RESPONSE)
    now = datetime(2026, 1, 1)
    one, two = ("r1", "s", "u1", "look"), ("r2", "s", "u2", "look")
    reply = ("r1", "u1/", 404, "x", now, {"B": "2", "A": "1"})
    got = aq.materialized(asked(one, two), answered(reply)).collect()
    assert [(r.evidence_id, r.source_id, r.locator, r.http_status, r.raw_payload) for r in got] == [("evidence:r1", "s", "u1/", 404, "x")]
    assert got[0].metadata == {"purpose": "look", "request_id": "r1", "status_code": "404", "headers": '[["A","1"],["B","2"]]'}
    assert [r.request_id for r in aq.unanswered(asked(one, two), answered(reply)).collect()] == ["r2"]
    fails(aq.materialized(asked(two), answered(reply)), "share the same request_id: r1")
    fails(aq.materialized(asked(one, one), answered(reply)), "a request id is used twice: r1")
    fails(aq.materialized(asked(one), answered(reply, reply)), "a request is answered twice: r1")
    fails(aq.materialized(asked(one), answered(("r1", "u", 99, "x", now, None))), "HTTP status: r1")
    fails(aq.materialized(asked(one), answered(("r1", " ", 200, "x", now, None))), "url must not be blank")
    fails(aq.of_source(asked(one, ("r3", "t", "u", None)), "s"), "configured source: r3")
    assert aq.materialized(asked(one), answered(("r1", "u", 200, None, now, None))).first().metadata["headers"] == "[]"
