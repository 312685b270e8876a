from datetime import datetime

import pytest
from pyspark.sql import functions as F

from attesta.operators import contacts as ct
from attesta.operators import discovery as dc
from attesta.operators import evidence as ev
from attesta.operators import extraction as ex
from attesta.operators import fusion as fu
from attesta.operators import gaps as gp
from attesta.operators import gates as gt
from attesta.operators import governance as gv
from attesta.operators import metrics as mt
from attesta.operators import normalize as nm
from attesta.operators import people as pp
from attesta.operators import qualification as ql
from attesta.operators import resolution as rs
from attesta.operators import review as rv
from attesta.sources import captured as cp


def test_normalisation_is_data(spark):
    rows = [
        ("legal_name", "  ACME  Ltda "), ("legal_name", " "), ("state", "sp"), ("state", "São Paulo"), ("primary_cnae_code", "62.01-5/01"), ("cnae_code", "12"),
        ("domain", "Exemplo.COM.br."), ("domain", "www.acme.com.br"), ("domain", "1.2.3"), ("website", "HTTP://A.co:80/x#y"), ("website", "a.co"), ("phone", "+55 (11) 3333-4444"), ("weather", "x"), ("city", None),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, field_name string, raw_value string")
    got = [(r.status, r.normalized_value, r.reason) for r in nm.normalized(frame).orderBy("i").collect()]
    assert got == [
        ("NORMALIZED", "ACME Ltda", None),
        ("INVALID", None, "company name is blank"),
        ("NORMALIZED", "SP", None),
        ("UNCHANGED", "São Paulo", None),
        ("NORMALIZED", "6201501", None),
        ("INVALID", None, "CNAE code must contain exactly 7 digits"),
        ("NORMALIZED", "exemplo.com.br", None),
        ("UNCHANGED", "www.acme.com.br", None),
        ("INVALID", None, "host looks like an invalid IP literal"),
        ("NORMALIZED", "http://a.co/x", None),
        ("INVALID", None, "URL must contain an explicit http/https scheme"),
        ("NORMALIZED", "+551133334444", None),
        ("UNSUPPORTED", None, "no V1 normalizer for field 'weather'"),
        ("INVALID", None, "text value must be text"),
    ]


def test_append_never_changes_a_row(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, body string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4"), ("c", "4"), ("d", "5"), ("d", "6")], "id string, body string")
    inserted, same, conflicts = ev.append(stored, new, "id", "body")
    assert sorted(r.id for r in inserted.collect()) == ["c", "d"]
    assert [r.id for r in same.collect()] == ["a"]
    assert sorted(r.id for r in conflicts.collect()) == ["b", "d"]


def test_integrity(spark):
    rows = spark.createDataFrame([("f1", "p1", ["e1"]), ("f2", "p9", ["e1", "e9"]), ("f2", None, [])], "fact string, prov string, ev array<string>")
    prov = spark.createDataFrame([("p1",)], "prov string")
    proof = spark.createDataFrame([("e1",)], "id string")
    assert ev.dangling(rows, "prov", prov, "prov").count() == 2
    assert [r.missing_id for r in ev.dangling_elements(rows, "ev", proof, "id").collect()] == ["e9"]
    assert [(r.fact, r["count"]) for r in ev.repeated(rows, "fact").collect()] == [("f2", 2)]


def test_fusion_never_takes_the_majority(spark):
    rows = [("s", "f", f"x{i}", "A" if i < 3 else "B", ["e"], datetime(2026, 1, i + 1)) for i in range(4)] + [("s", "g", "y", "C", ["e2", "e1"], datetime(2026, 1, 1))]
    facts = spark.createDataFrame(rows, "subject_id string, field_name string, fact_id string, value_key string, evidence_ids array<string>, observed_at timestamp")
    got = {r.field_name: r for r in fu.outcomes(facts).collect()}
    assert (got["f"].status, got["f"].majority_value, got["f"].majority_ratio) == ("CONFLICT", "A", 0.75)
    assert got["g"].status == "CANONICAL"
    ids = {r.field_name: r for r in fu.fused(facts.withColumn("value_key", F.concat(F.lit('["str","'), "value_key", F.lit('"]')))).collect()}
    assert ids["f"].conflict_id.startswith("conflict:fusion:v1:") and ids["f"].canonical_fact_id is None
    assert ids["g"].evidence_ids == ["e1", "e2"] and len(ids["g"].canonical_fact_id) == len("canonical:fusion:v1:") + 24


COMPANY = "record_id string, name string, registry_namespace string, registry_id string, domain string, phone string, address string, city string, state string, cnae string"


def company(i, name=None, key=None, domain=None, phone=None, address=None, city=None, state=None, cnae=None):
    return (i, name, "br:cnpj" if key else None, key, domain, phone, address, city, state, cnae)


def test_company_triage(spark):
    rows = [
        company("a", "Acme Software Ltda", "12.345.678/0001-90", "acme.com.br", city="São Paulo", state="SP"),
        company("b", "ACME SOFTWARE", "12345678000190", "acme.com.br"),
        company("c", "Acme Software Ltda", "99345678000190", "acme.com.br"),
        company("d", "Acme Software", None, "ACME.com.br.", "+55 11 3333-4444", city="Sao Paulo", state="sp"),
        company("e", "Padaria Sol", None, None, "551133334444"),
        company("f", "Acme", None, "www.acme.com.br"),
    ]
    records = rs.prepared(spark.createDataFrame(rows, COMPANY))
    pairs = rs.with_sides(rs.blocked_pairs(records.withColumn("keys", rs.keys())), records)
    got = {(r.left_id, r.right_id): r for r in rs.features(pairs).withColumn("t", rs.triage()).withColumn("w", rs.weighted()).withColumn("m", rs.matched("EXACT_EVIDENCE")).collect()}
    assert got["a", "b"].t.disposition == "AUTO_MATCH" and got["a", "c"].t.disposition == "DISTINCT"
    assert got["a", "d"].t.disposition == "REVIEW" and got["a", "d"].t.reasons[:2] == ["domain_exact", "location_exact"] and got["a", "d"].location_exact
    assert got["a", "f"].t.disposition == "INSUFFICIENT_EVIDENCE" and got["a", "f"].domain_exact is False
    assert ("d", "e") not in got or got["d", "e"].t.disposition == "INSUFFICIENT_EVIDENCE"
    assert got["a", "c"].m is False and got["a", "f"].location_exact is None


def test_confusion_is_zero_where_undefined(spark):
    frame = spark.createDataFrame([(True, False), (False, False)], "t boolean, p boolean")
    r = rs.confusion(frame, F.col("t"), F.col("p")).first()
    assert (r.tp, r.fp, r.tn, r.fn, r.precision, r.recall, r.f1, r.false_merge_rate) == (0, 0, 1, 1, 0.0, 0.0, 0.0, 0.0)


def test_person_triage(spark):
    people = spark.createDataFrame([("p1", "c", ["e1"]), ("p2", "c", ["e2"]), ("p3", "d", ["e3"])], "person_id string, company_id string, relationship_evidence_ids array<string>")
    facts = spark.createDataFrame(
        [("p1", "person_name", "Ana Sá", None, ["e1"]), ("p2", "person_name", "ANA SA", " ", ["e2"]), ("p3", "person_name", "Bia", None, ["e3"])],
        "subject_id string, field_name string, raw_value string, normalized_value string, evidence_ids array<string>",
    )
    contacts = spark.createDataFrame(
        [("p1", "PROFESSIONAL_PROFILE", "https://linkedin.com/in/ana", ["e1"]), ("p2", "PROFESSIONAL_PROFILE", "https://www.linkedin.com/in/Ana/", ["e2"]), ("p1", "EMAIL", "A@x.co", ["e1"]), ("p3", "EMAIL", "a@x.co", ["e3"])],
        "owner_id string, kind string, value string, evidence_ids array<string>",
    )
    sides = pp.assembled(people, facts, contacts)
    left = sides.select(F.col("person_id").alias("left_id"), F.struct("*").alias("l"))
    right = sides.select(F.col("person_id").alias("right_id"), F.struct("*").alias("r"))
    pairs = left.join(right, F.col("left_id") < F.col("right_id"))
    got = {(r.left_id, r.right_id): r for r in pp.features(pairs).withColumn("t", pp.triage()).collect()}
    assert got["p1", "p2"].t.reasons == ["same_company", "normalized_name_exact", "professional_profile_exact", "auto_match_not_authorized"]
    assert got["p1", "p3"].t.disposition == "INSUFFICIENT_EVIDENCE" and got["p1", "p3"].email_overlap and got["p1", "p3"].phone_overlap is None


def test_corroboration(spark):
    contacts = spark.createDataFrame(
        [("c1", "o", "EMAIL", "A@x.co", "DISCOVERED", ["e1"]), ("c2", "o", "EMAIL", "a@x.co ", "DISCOVERED", ["e2"]), ("c3", "o", "EMAIL", "b@x.co", "DISCOVERED", ["e1"]), ("c4", "o", "EMAIL", "a@x.co", "INVALID", ["e3"])],
        "contact_id string, owner_id string, kind string, value string, status string, discovery_evidence_ids array<string>",
    )
    proof = spark.createDataFrame([("e1", "u1", datetime(2026, 1, 1)), ("e2", "u1", datetime(2026, 1, 2)), ("e3", "u2", datetime(2026, 1, 3))], "evidence_id string, locator string, captured_at timestamp")
    got = {r.equivalence_key: r for r in ct.corroborated(contacts, proof).collect()}
    assert got["a@x.co"].disposition == "VALIDATED" and got["a@x.co"].contact_ids == ["c1", "c2"] and got["a@x.co"].validated_at == datetime(2026, 1, 2)
    assert got["b@x.co"].disposition == "INSUFFICIENT_EVIDENCE" and got["b@x.co"].validated_contact_id is None


PAGE = """<html><script>x@hidden.co</script><h2>Office</h2><p>Diretora Comercial</p><p>Maria da Silva</p>
<a href="mailto:maria%2Bx@acme.co?subject=hi">mail</a><p>Tel: 11 3333-4444</p><a href="https://br.linkedin.com/in/maria?x=1">in</a>
<p>Gerente</p><p>sem nome</p><a href="https://wa.me/5511988887777">w</a><a href="/rel">r</a><form></form>
<h3>Unit</h3><p>CNPJ: 12.345.678/0001-90</p><p>Rua das Flores, 10</p><p>São Paulo / SP</p><p>CEP 01234-567</p><p>Início das Atividades: 3/6/1967</p></html>"""


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "https://acme.co/p", PAGE, "12345678000190"), (2, "https://acme.co/q", None, "1"), (3, "https://acme.co/r", "<p>nothing</p>", "12345678000190")], "page_id long, url string, html string, expected_key string")
    found = {(r.page_id, r.kind): r.value for r in ex.contacts(pages).collect() if r.error is None}
    assert found == {(1, "EMAIL"): "maria+x@acme.co", (1, "PHONE"): "11 3333-4444", (1, "WHATSAPP"): "+5511988887777", (1, "CONTACT_FORM"): "https://acme.co/p"}
    people = [r for r in ex.people(pages).collect() if r.error is None]
    assert [(r.ordinal, r.name, r.title) for r in people] == [(1, "Maria da Silva", "Diretora Comercial")]
    assert {c.kind for c in people[0].contacts} == {"EMAIL", "PHONE", "PROFESSIONAL_PROFILE"}
    assert [(r.registry_key, r.label, r.city, r.state) for r in ex.seeds(pages).collect() if r.error is None] == [("12345678000190", "Unit", "São Paulo", "SP")]
    assert ex.contacts_of("https://acme.co/", "<p>Fone (11) 3333-4444</p>") == []
    facts = {r.field_name: r.raw_value for r in ex.locations(pages).collect() if r.error is None}
    assert facts == {"business_registry_id": "12.345.678/0001-90", "street_address": "Rua das Flores, 10", "city": "São Paulo", "state": "SP", "postal_code": "01234-567", "activity_start_date": "3/6/1967"}
    assert {r.page_id for r in ex.locations(pages).collect() if r.error} == {2, 3}


def test_candidates_and_coverage(spark):
    seen = spark.createDataFrame(
        [(1, "Dra. Ana", "CRO-SP 12345 harmonização orofacial", "https://A.co/x/?q"), (2, "Ana", "dentista CRO SP 12345", "https://b.co"), (3, "News", "weather", "https://c.co")],
        "seq int, title string, snippet string, url string",
    )
    rows = dc.candidates(seen, "recipe").withColumn("key", dc.merge_key(F.col("cro_state"), F.col("cro_number"), F.col("source_url")))
    got = dc.merged(rows, "key", "seq", ["display_name_hint", "source_url"], ["observed_professional_group"], ["facial_relevance_terms"]).collect()
    assert [(r.key, r.source_url, r.observed_professional_group, r.facial_relevance_terms) for r in got] == [("CRO:SP:12345", "https://a.co/x", "HOF_OR_FACIAL_ACTIVITY", ["harmonizacao orofacial"])]
    ref, found = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a",), ("a",), ("c",)], "k string")
    r = dc.coverage(ref, found, "k").first()
    assert (r.matched, r.missed, r.unexpected, r.duplicate_observations, r.precision, r.coverage) == (1, 1, 1, 1, 0.5, 0.5)
    assert dc.coverage(ref, found.limit(0), "k").first().precision is None


def qualified(spark, facts, conflicts=(), contacts=(), track="CEOF_SPECIALIZATION", required=False, canonicals=()):
    people = spark.createDataFrame([("p", "c", track, required)], "person_id string, company_id string, offer_track string, require_validated_contact boolean")
    said = spark.createDataFrame([(s, f, v, None) for s, f, v in facts], "subject_id string, field_name string, raw_value string, normalized_value string")
    settled = spark.createDataFrame(list(canonicals), "subject_id string, field_name string, value string")
    torn = spark.createDataFrame(list(conflicts), "subject_id string, field_name string, status string")
    reached = spark.createDataFrame(list(contacts), "owner_id string, status string")
    return ql.decided(ql.profiles(people, ql.chosen(said, settled), torn, reached)).first()


HOME, DENTIST = ("c", "country", "Brasil"), ("p", "professional_title", "Cirurgião-Dentista")


@pytest.mark.parametrize(
    "facts,extra,expected",
    [
        ([HOME, DENTIST], {}, ("QUALIFIED", "MEDIUM", "UNKNOWN", "P3")),
        ([HOME, ("p", "specialty", "CEOF")], {}, ("QUALIFIED", "HIGH", "UNKNOWN", "P2")),
        ([HOME, DENTIST, ("p", "procedure", "Blefaroplastia"), ("p", "education_intent", "course_interest")], {}, ("QUALIFIED", "HIGH", "HIGH", "P1")),
        ([("c", "country", "Chile"), DENTIST], {}, ("NOT_QUALIFIED", "LOW", "UNKNOWN", "EXCLUDE")),
        ([("c", "country", "Chile"), ("c", "state", "SP"), DENTIST], {}, ("QUALIFIED", "MEDIUM", "UNKNOWN", "P3")),
        ([DENTIST], {}, ("UNKNOWN", "UNKNOWN", "UNKNOWN", "REVIEW")),
        ([HOME], {}, ("UNKNOWN", "UNKNOWN", "UNKNOWN", "REVIEW")),
        ([HOME, ("p", "specialty", "Advogado")], {}, ("NOT_QUALIFIED", "LOW", "UNKNOWN", "EXCLUDE")),
        ([HOME, DENTIST], {"conflicts": [("c", "state", "OPEN")]}, ("UNKNOWN", "UNKNOWN", "UNKNOWN", "REVIEW")),
        ([HOME, DENTIST], {"conflicts": [("c", "state", "RESOLVED")]}, ("QUALIFIED", "MEDIUM", "UNKNOWN", "P3")),
        ([HOME, DENTIST, ("p", "education_intent", "EXPLICIT_NO_INTEREST")], {}, ("QUALIFIED", "MEDIUM", "LOW", "P3")),
        ([HOME, DENTIST], {"required": True}, ("NOT_QUALIFIED", "LOW", "UNKNOWN", "EXCLUDE")),
        ([HOME, DENTIST], {"required": True, "contacts": [("c", "VALIDATED")]}, ("QUALIFIED", "MEDIUM", "UNKNOWN", "P3")),
        ([HOME, DENTIST], {"track": ql.COMPLEMENTARY}, ("NOT_QUALIFIED", "LOW", "UNKNOWN", "EXCLUDE")),
        ([HOME, ("p", "specialty", "CEOF")], {"track": ql.COMPLEMENTARY}, ("QUALIFIED", "HIGH", "UNKNOWN", "P2")),
        ([HOME, DENTIST], {"canonicals": [("c", "country", "Peru")]}, ("NOT_QUALIFIED", "LOW", "UNKNOWN", "EXCLUDE")),
        ([HOME, DENTIST], {"canonicals": [("p", "country", "Peru")]}, ("NOT_QUALIFIED", "LOW", "UNKNOWN", "EXCLUDE")),
        ([HOME, DENTIST], {"canonicals": [("p", "professional_title", "Advogado")]}, ("NOT_QUALIFIED", "LOW", "UNKNOWN", "EXCLUDE")),
    ],
)
def test_qualification(spark, facts, extra, expected):
    r = qualified(spark, facts, **extra)
    assert (r.qualification_status, r.fit, r.intent, r.priority) == expected and r.reasons


def test_review_queue(spark):
    rows = spark.createDataFrame(
        [("x", "s", "f", "OPEN", ["b", "a"], False, ["e1"]), ("x", "s", "f", "OPEN", ["a", "b"], True, ["e2"]), ("y", "s", "f", "RESOLVED", [], True, [])],
        "conflict_id string, subject_id string, field_name string, status string, candidate_fact_ids array<string>, high_impact boolean, evidence_ids array<string>",
    )
    leads = spark.createDataFrame([("l", "c", "UNKNOWN", ["why"], True), ("m", "c", "UNKNOWN", [], False)], "lead_id string, company_id string, qualification_status string, qualification_reasons array<string>, high_value boolean")
    got = rv.queue(rv.conflicts(rows), rv.qualifications(leads)).collect()
    assert [(r.kind, r.priority, r.evidence_ids) for r in got] == [("DATA_CONFLICT", "HIGH", ["e1", "e2"]), ("QUALIFICATION", "HIGH", [])]


def test_gates(spark):
    frame = spark.range(1)
    first = lambda c: frame.select(c.alias("x")).first().x
    t, f = F.lit(True), F.lit(False)
    assert first(gt.preflight(f, f, t, f, t)).blockers == ["EXT-BRASILAPI-001", "LEGAL-001", "EXT-CFO-001"]
    assert first(gt.preflight(t, t, f, f, t)).state == "READY_FOR_AUTHORIZED_EXECUTION"
    now = F.lit(datetime(2026, 1, 1))
    assert first(gt.in_force(now, t, now, F.lit(None).cast("timestamp"))) is False
    assert first(gt.contact_use(f, F.lit("ALLOWED_BY_POLICY"), F.lit("x"), f)).decision == "UNKNOWN"
    assert first(gt.compliance(f, t, f)).reason_code == "LEGAL_REVIEW_REQUIRED"
    assert first(gt.freshness(F.lit("REVALIDATE_ON_CHANGE"), F.lit(None), f)) == "UNKNOWN"
    d = first(gt.drift(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))))
    assert (d.status, d.missing, d.unexpected) == ("CONTRACT_FAIL", ["a"], ["c"])
    assert first(mt.rate(F.lit(1), F.lit(0), "none")).reason == "none"


def test_lookups(spark):
    body = '{"cnpj":"12345678000190","razao_social":"Acme","nome_fantasia":" ","uf":"SP"}'
    rows = [("12.345.678/0001-90", "u", body, 200), ("12345678000190", "u", body, 500), ("99", "u", body, 200), ("12345678000190", "u", "[]", 200), ("12345678000190", "u", None, 200)]
    seen = cp.lookups(spark.createDataFrame(rows, "requested_key string, url string, body string, http_status int"))
    assert [r.error is None for r in seen.collect()] == [True, False, False, False, False]
    facts = {r.field_name: r.raw_value for r in cp.lookup_facts(seen).collect()}
    assert facts == {"business_registry_id": "12345678000190", "legal_name": "Acme", "state": "SP"}


def test_reference_tables(spark):
    assert [r.gate_id for r in gv.critical_gates(spark).collect()] == ["EXT-BRASILAPI-001", "EXT-CFO-001", "LEGAL-001", "AUTH-CAMPAIGN-001"]
    got = {r.blocker: r.owner for r in gv.required_actions(spark.createDataFrame([("LEGAL-001",), ("X",)], "blocker string")).collect()}
    assert got == {"LEGAL-001": "LEGAL_COMPLIANCE", "X": "NONE"}
    flags = {c: c != "ci_verified" for c, _ in gv.RELEASE_CHECKS}
    r = gv.release_candidate(spark.createDataFrame([flags])).first()
    assert (r.state, r.blockers) == ("BLOCKED", ["CI_UNVERIFIED"])
    assert gv.sources(spark).count() == 4 and gv.compliance_blockers(spark).count() == 6


def test_enrichment_measures(spark):
    one = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    got = mt.enrichment(
        one([("a",), ("b",)], "subject_id string"),
        one([("f",), ("g",)], "field_name string"),
        one([("a", "f", "p1"), ("a", "h", "p2")], "subject_id string, field_name string, provenance_id string"),
        one([("b", "f")], "subject_id string, field_name string"),
        one([(["e"],), ([],)], "evidence_ids array<string>"),
        one([("p1", ["e"]), ("p2", [])], "provenance_id string, evidence_ids array<string>"),
        one([("a", "f", True), ("b", "g", False)], "subject_id string, field_name string, correct boolean"),
    ).first()
    assert (got.field_coverage.value, got.field_accuracy.value, got.provenance_coverage.value) == (0.25, 1.0, 0.5)
    assert got.conflict_rate.value == pytest.approx(1 / 3)


def test_an_entity_cut_before_its_semicolon_stays_as_written(spark):
    pages = spark.createDataFrame([(1, "<title>a &amp; b&amp</title><p>c &lt d &lt;e&gt;&#33; f & g</p><p>h&am</p>")], "page_id long, html string")
    texts = lambda **how: ex.visible_blocks(pages, **how).first().texts
    assert texts(terminated=True) == ["a & b&amp", "c &lt d <e>! f & g", "h&am"]
    assert texts() == ["a & b&", "c < d <e>! f & g", "h&am"]
