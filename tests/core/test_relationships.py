from urllib.parse import urlsplit

from pyspark.sql import functions as F

from attesta.functions import identifiers as idn
from attesta.operators import governance as gv
from attesta.operators import qualification as ql
from attesta.sources import captured as cp


def decisions(spark, **more):
    """Two relationships of one person, p, at companies a and b."""
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    own = {
        "relationships": [("ra", "p", "a", "CEOF_SPECIALIZATION", False, ["ea"]), ("rb", "p", "b", "CEOF_SPECIALIZATION", True, ["eb"])],
        "candidates": [],
        "canonicals": [],
        "conflicts": [],
        "contacts": [],
        "links": [],
        "registrations": [],
    } | more
    schemas = {
        "relationships": "relationship_id string, person_id string, company_id string, offer_track string, require_validated_contact boolean, relationship_evidence_ids array<string>",
        "candidates": "fact_id string, subject_id string, field_name string, raw_value string, normalized_value string, evidence_ids array<string>",
        "canonicals": "canonical_fact_id string, subject_id string, field_name string, value string, candidate_fact_ids array<string>",
        "conflicts": "conflict_id string, subject_id string, field_name string, status string, candidate_fact_ids array<string>",
        "contacts": "contact_id string, owner_id string, status string",
        "links": "relationship_id string, contact_id string",
        "registrations": "person_id string, evidence_ids array<string>",
    }
    frames = {c: f(own[c], s) for c, s in schemas.items()}
    out = ql.of_relationships(frames.pop("relationships"), "policy", **frames)
    return {r.relationship_id: r for r in out.collect()}


HOME = [("h1", "a", "country", "Brasil", None, ["wa"]), ("h2", "b", "country", "BR", None, ["wb"])]


def test_facts_stay_at_their_relationship(spark):
    got = decisions(spark, candidates=HOME + [("t", "ra", "professional_title", "Especialista CEOF", None, ["wt"]), ("i", "p", "education_intent", "COURSE_INTEREST", None, ["wi"])])
    a, b = got["ra"], got["rb"]
    assert (a.person_id, a.company_id, a.qualification_status, a.fit, a.intent, a.priority) == ("p", "a", "QUALIFIED", "HIGH", "HIGH", "P1")
    # the title is that of the other relationship; the intent is the person's
    assert (b.qualification_status, b.intent, b.priority) == ("UNKNOWN", "HIGH", "REVIEW")
    assert a.candidate_fact_ids == ["h1", "i", "t"] and b.candidate_fact_ids == ["h2", "i"]
    assert a.evidence_ids == ["ea", "wa", "wi", "wt"] and b.evidence_ids == ["eb", "wb", "wi"]
    assert a.decision_id != b.decision_id and a.decision_id.startswith("qualification:v1:")


def test_only_linked_contacts_count(spark):
    titles = [("t", "p", "professional_title", "Cirurgião-Dentista", None, ["w"])]
    contacts = [("c1", "b", "VALIDATED"), ("c2", "x", "VALIDATED")]
    without = decisions(spark, candidates=HOME + titles, contacts=contacts)["rb"]
    assert (without.qualification_status, without.contact_ids) == ("NOT_QUALIFIED", [])
    linked = decisions(spark, candidates=HOME + titles, contacts=contacts, links=[("rb", "c2"), ("rb", "gone"), ("ra", "c1")])
    assert (linked["rb"].qualification_status, linked["rb"].contact_ids) == ("QUALIFIED", ["c2"])
    assert linked["ra"].contact_ids == ["c1"]


def test_canonical_facts_conflicts_and_registrations(spark):
    facts = HOME + [
        ("t1", "ra", "professional_title", "Advogado", None, ["w1"]),
        ("n", "ra", "person_name", "Ana", None, ["wn"]),
        ("t2", "rb", "professional_title", "Ortodontista", None, ["w2"]),
        ("n2", "p", "person_name", "Ana", None, ["wn2"]),
    ]
    got = decisions(
        spark,
        candidates=facts,
        canonicals=[("k", "ra", "professional_title", "Especialista CEOF", ["n", "nowhere"])],
        conflicts=[("x", "b", "professional_title", "OPEN", ["n2"]), ("y", "ra", "professional_title", "OPEN", []), ("z", "p", "education_intent", "RESOLVED", [])],
        registrations=[("p", ["g"]), ("q", ["other"])],
    )
    a, b = got["ra"], got["rb"]
    # a conflict about a relationship itself is not asked for, nor a resolved one
    assert (a.qualification_status, a.canonical_fact_ids, a.conflict_ids) == ("QUALIFIED", ["k"], [])
    assert a.candidate_fact_ids == ["h1", "t1"] and a.evidence_ids == ["ea", "g", "w1", "wa", "wn"]
    assert (b.qualification_status, b.conflict_ids, b.candidate_fact_ids) == ("UNKNOWN", ["x"], ["h2", "n2", "t2"])
    assert b.evidence_ids == ["eb", "g", "w2", "wb", "wn2"] and any("professional_title" in r for r in b.reasons)


def test_no_relationships_and_repeated_links(spark):
    assert decisions(spark, relationships=[]) == {}
    got = decisions(spark, contacts=[("c", "b", "VALIDATED")], links=[("rb", "c"), ("rb", "c")])
    assert got["rb"].contact_ids == ["c"] and len(got) == 2


def plain(text, page):
    try:
        parts, known = urlsplit(text.strip()), urlsplit(page)
        port = parts.port
    except ValueError:
        return None
    same = parts.scheme.lower() == "https" and (parts.hostname or "") == known.hostname and parts.path.rstrip("/") == known.path.rstrip("/")
    return page if same and port in (None, 443) and not parts.username and not parts.password else None


def test_listed_pages_are_those_of_a_plain_reading(spark):
    page = cp.LOCATION_PAGE
    host, path = urlsplit(page).netloc, urlsplit(page).path
    texts = [page, f"  {page}/ ", page + "//", page + "?a=1#b", page + "#x", page.upper(), f"HTTPS://{host.upper()}{path}", f"https://{host}:443{path}", f"https://{host}:0443{path}"]
    texts += [f"https://{host}:{path}", f"https://{host}:8443{path}", f"http://{host}{path}", f"https://u@{host}{path}", f"https://u:p@{host}{path}", f"https://@{host}{path}", f"https://{host}", page + "/x", page + ".", f"https://{host}.{path}", f"https://x{host}{path}", host + path, "", "https://[", page.replace(".", "x")]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    got = {r.i: r.x for r in frame.select("i", idn.listed_page(F.col("t"), page).alias("x")).collect()}
    assert got == {i: plain(t, page) for i, t in enumerate(texts)} | {99: None}
    assert sum(x is not None for x in got.values()) == 10


def test_sources_and_addresses(spark):
    frame = spark.createDataFrame([("33.683.111/0002-80", cp.LOCATION_PAGE + "/"), ("x", "https://a.example/")], "k string, u string")
    one, two = frame.select(cp.lookup_address(F.col("k")).alias("a"), cp.location_source(F.col("u")).alias("s")).collect()
    assert one.a == "https://brasilapi.com.br/api/cnpj/v1/33683111000280" and two.a is None and two.s is None
    import hashlib

    assert one.s.source_id == "source:official-company-location:" + hashlib.sha256(cp.LOCATION_PAGE.encode()).hexdigest()[:24] and one.s.locator == cp.LOCATION_PAGE


def test_authorities_of_blockers(spark):
    rows = spark.createDataFrame([("LEGAL-001",), ("EXT-CFO-001",), ("AUTH-CAMPAIGN-001",), ("other",)], "blocker string")
    got = sorted((r.blocker, r.authority_id or "") for r in gv.referred(rows).collect())
    assert got == [("AUTH-CAMPAIGN-001", ""), ("EXT-CFO-001", "AUTH-CFO-001"), ("LEGAL-001", "AUTH-ANPD-001"), ("LEGAL-001", "AUTH-LGPD-001"), ("other", "")]
    known = {r.authority_id for r in gv.authorities(spark).collect()}
    packet = gv.legal_packet(spark).first()
    assert set(packet.authorities) <= known and packet.decision == "REVIEW_REQUIRED" and len(packet.questions) == 5
    assert {a for r in gv.gates(spark).collect() for a in r.authorities} <= known
