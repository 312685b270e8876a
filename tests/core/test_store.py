from datetime import datetime

import pytest
from pyspark.sql import functions as F

from attesta import schemas
from attesta.sources.store import Conflict, Damaged, Store

NOW = datetime(2026, 1, 1)


def rows(spark, record, *values):
    names = list(values[0])
    types = {f.name: f.dataType.simpleString() for f in schemas.schema(record)}
    return spark.createDataFrame([tuple(v[n] for n in names) for v in values], ", ".join(f"{n} {types[n]}" for n in names))


def evidence(i, payload="x", time=NOW):
    return {"evidence_id": i, "source_id": "s", "locator": "u", "captured_at": time, "captured_at_iso": time.isoformat(), "http_status": 200, "raw_payload": payload}


def test_a_row_is_written_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    both = rows(spark, "evidence", evidence("e1"), evidence("e2", "y"))
    assert store.save("evidence", both) == 2 and store.save("evidence", both) == 0
    with pytest.raises(Conflict):
        store.save("evidence", rows(spark, "evidence", evidence("e1", "other"), evidence("e3")))
    assert store.table("evidence").count() == 2
    assert store.load("evidence", "e1").first().raw_payload == "x" and store.load("evidence", "e9").count() == 0
    assert bytes(store.raw("e2").first().raw) == b"y" and store.damaged("evidence").count() == 0


def test_scans_backups_and_references(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.save("evidence", rows(spark, "evidence", evidence("b", time=datetime(2026, 1, 2)), evidence("a", time=datetime(2026, 1, 2)), evidence("z")))
    assert [r.evidence_id for r in store.scan("s").collect()] == ["z", "a", "b"] and store.scan("t").count() == 0
    store.backup(str(tmp_path / "copy"))
    assert Store(spark, str(tmp_path / "copy")).table("evidence").count() == 3
    assert Store.restored(spark, str(tmp_path / "copy"), str(tmp_path / "again")).load("evidence", "a").count() == 1
    with pytest.raises(FileNotFoundError):
        Store.restored(spark, str(tmp_path / "nothing"), str(tmp_path / "other"))
    assert sorted(r.evidence_id for r in store.loaded("evidence", spark.createDataFrame([("a",), ("q",), ("z",)], "k string")).collect()) == ["a", "z"]
    missing = {r.check: r.violations for r in store.missing_references().collect()}
    assert missing["evidence.source"] == 3 and missing["lead.company"] == 0


def test_plain_tables_are_carried_forward(spark, tmp_path):
    old = str(tmp_path / "old")
    rows(spark, "evidence", evidence("e1"), evidence("e2", "y")).write.parquet(f"{old}/evidence")
    new = Store.upgraded(spark, old, str(tmp_path / "new"))
    assert len(new.load("evidence", "e2").first().content_digest) == 64 and new.problems() == []
    second = schemas.with_defaults(rows(spark, "evidence", evidence("e1"), evidence("e2", "y")), "evidence")
    own = [f.name for f in schemas.schema("evidence")]
    sealed = second.withColumn("record_digest", F.sha2(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), 256))
    sealed.write.parquet(str(tmp_path / "second/evidence"))
    assert Store.upgraded(spark, str(tmp_path / "second"), str(tmp_path / "three")).table("evidence").count() == 2
    sealed.withColumn("raw_payload", F.lit("forged")).write.parquet(str(tmp_path / "forged/evidence"))
    with pytest.raises(Damaged):
        Store.upgraded(spark, str(tmp_path / "forged"), str(tmp_path / "four"))


@pytest.mark.parametrize(
    "record,row,broken",
    [
        ("sources", {"source_id": "\t", "source_type": "t", "locator": "l"}, ["source_id is not blank"]),
        ("evidence", evidence("e") | {"http_status": 99}, ["status is one of HTTP"]),
        ("leads", {"lead_id": "l", "company_id": "c", "stage": "QUALIFIED", "qualification_status": "UNKNOWN", "created_at": NOW}, ["stage agrees with status"]),
        ("leads", {"lead_id": "l", "company_id": "c", "stage": "REVIEW", "qualification_status": "UNKNOWN", "created_at": NOW}, []),
        ("contacts", {"contact_id": "c", "owner_id": "o", "kind": "EMAIL", "value": "v", "discovery_evidence_ids": ["e"], "status": "VALIDATED", "discovered_at": NOW}, ["assessed has proof"]),
        ("contacts", {"contact_id": "c", "owner_id": "o", "kind": "FAX", "value": "v", "discovery_evidence_ids": [], "status": "DISCOVERED", "discovered_at": NOW}, ["discovery_evidence_ids is a list without blanks", "kind is known"]),
        ("conflicts", {"conflict_id": "c", "subject_id": "s", "field_name": "f", "candidate_fact_ids": ["a", "a"], "status": "OPEN"}, ["two candidates"]),
        ("candidate_facts", {"fact_id": "f", "subject_id": "s", "field_name": "n", "evidence_ids": ["a", "a"], "provenance_id": "p", "confidence": 2.0, "decision_class": "UNKNOWN", "observed_at": NOW}, ["evidence_ids has no repeats", "confidence is a share"]),
    ],
)
def test_rules(spark, record, row, broken):
    got = schemas.checked(schemas.with_defaults(rows(spark, record, row), record), record).first().violations
    assert got == broken


def test_every_schema_parses():
    assert set(schemas.SCHEMAS) == set(schemas.RULES)
    for record in schemas.SCHEMAS:
        assert schemas.schema(record).fields
