"""An append-only store of records: a ledger for each kind of record in one folder.

A row is written once. Writing it again changes nothing; writing another row
under its id is a conflict, and then nothing of the batch is written.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.hashing import digest
from ..operators import evidence as ev
from .ledger import DIGEST, Conflict, Damaged, Files, Ledger, digest_of_columns

__all__ = ["Conflict", "Damaged", "Store", "fixture"]

#: Format of the tables. Before it rows lay in plain Parquet: in 1 without digests, in 2 with one.
FORMAT = 3


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def key(self, record: str) -> str:
        return schemas.schema(record)[0].name

    def ledger(self, record: str) -> Ledger:
        return Ledger.made(self.spark, f"{self.folder}/{record}", self.key(record), schemas.schema(record), self.buckets, FORMAT)

    def there(self, record: str) -> bool:
        return bool(Ledger(self.spark, f"{self.folder}/{record}").versions())

    def table(self, record: str) -> DataFrame:
        if self.there(record):
            return self.ledger(record).rows()
        return self.spark.createDataFrame([], schemas.schema(record).add(DIGEST, "string"))

    def save(self, record: str, rows: DataFrame, batch: str | None = None) -> int:
        """Append new rows and say how many; Conflict names an id with other content, or a broken rule.

        A batch that is tried again under its name adds nothing.
        """
        rows = schemas.with_defaults(rows, record)
        bad = schemas.violations(rows, record).select("violations").first()
        if bad is not None:
            raise ValueError(f"{record}: {', '.join(bad.violations)}")
        return self.ledger(record).append(rows, batch)

    def _sound(self, rows: DataFrame, record: str) -> DataFrame:
        """Rows that still have their digest, which is compared within the row."""
        own = [f.name for f in schemas.schema(record)]
        held = rows.withColumnRenamed(DIGEST, "_held")
        return _with_digest(held, own).where(F.col(DIGEST).eqNullSafe(F.col("_held"))).select(*own)

    def load(self, record: str, key: str) -> DataFrame:
        """The row with an id, from the files of its bucket, if its content still has its digest."""
        if not self.there(record):
            return self.spark.createDataFrame([], schemas.schema(record))
        return self._sound(self.ledger(record).lookup(key), record)

    def loaded(self, record: str, keys: DataFrame) -> DataFrame:
        """The rows of many ids, in a column of any name."""
        return self._sound(self.ledger(record).found(keys), record)

    def damaged(self, record: str) -> DataFrame:
        """Ids of rows whose content no longer has its digest."""
        own = [f.name for f in schemas.schema(record)]
        held = self.table(record).withColumnRenamed(DIGEST, "_held")
        return _with_digest(held, own).where(~F.col(DIGEST).eqNullSafe(F.col("_held"))).select(self.key(record))

    def scan(self, source: str | None = None) -> DataFrame:
        """Evidence in order of its time's text and its id, of one source if given."""
        rows = self.table("evidence")
        return ev.scan(rows, "captured_at_iso", "evidence_id", None if source is None else F.col("source_id") == source)

    def raw(self, evidence_id: str) -> DataFrame:
        """The bytes of a payload, for reading it again."""
        return self.load("evidence", evidence_id).select(F.col("raw_payload").cast("binary").alias("raw"))

    def problems(self) -> list[str]:
        """What is not as its manifest says, over all tables."""
        return [f"{r}: {p}" for r in schemas.SCHEMAS if self.there(r) for p in self.ledger(r).problems()]

    def backup(self, folder: str) -> Store:
        """Copy every table to a folder that holds none; each is checked before and after."""
        for record in schemas.SCHEMAS:
            if self.there(record):
                self.ledger(record).copied(f"{folder.rstrip('/')}/{record}")
        return Store(self.spark, folder, self.buckets)

    @staticmethod
    def restored(spark: SparkSession, backup: str, folder: str, buckets: int = 16) -> Store:
        """A store from a backup, whose tables must all be as their manifests say before any is copied."""
        held = Store(spark, backup, buckets)
        if not any(held.there(r) for r in schemas.SCHEMAS):
            raise FileNotFoundError(backup)
        if found := held.problems():
            raise Damaged("; ".join(found))
        return held.backup(folder)

    @staticmethod
    def upgraded(spark: SparkSession, old: str, folder: str, buckets: int = 16) -> Store:
        """A store from plain Parquet tables of format 1 or 2.

        Rows of format 1 get their digests. In format 2 a digest that is missing or
        not its row's is damage, never made anew.
        """
        files, new = Files(spark), Store(spark, folder, buckets)
        for record in schemas.SCHEMAS:
            path = f"{old.rstrip('/')}/{record}"
            if not files.exists(path):
                continue
            if files.exists(f"{path}/manifests"):
                raise ValueError(f"{path} has its format already")
            held = spark.read.parquet(path)
            own = [f.name for f in schemas.schema(record)]
            rows = schemas.with_defaults(held, record)
            if DIGEST in held.columns:
                written = digest(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}))
                bad = held.where(~F.col(DIGEST).eqNullSafe(written)).select(own[0]).first()
                if bad is not None:
                    raise Damaged(f"{record} {bad[0]} has not its digest")
            elif record == "evidence":
                rows = rows.withColumn("content_digest", F.coalesce("content_digest", digest(F.coalesce("raw_payload", F.lit("")))))
            new.save(record, rows, f"upgrade of {record}")
        return new

    def missing_references(self) -> DataFrame:
        """(check, violations) of references that name nothing."""
        t = self.table
        owners = ((t("companies"), "company_id"), (t("person_identities"), "person_id"))
        found = {
            "evidence.source": ev.dangling(t("evidence"), "source_id", t("sources"), "source_id"),
            "provenance.evidence": ev.dangling_elements(t("provenance"), "evidence_ids", t("evidence"), "evidence_id"),
            "candidate.provenance": ev.dangling(t("candidate_facts"), "provenance_id", t("provenance"), "provenance_id"),
            "candidate.evidence": ev.dangling_elements(t("candidate_facts"), "evidence_ids", t("evidence"), "evidence_id"),
            "canonical.candidates": ev.dangling_elements(t("canonical_facts"), "candidate_fact_ids", t("candidate_facts"), "fact_id"),
            "conflict.candidates": ev.dangling_elements(t("conflicts"), "candidate_fact_ids", t("candidate_facts"), "fact_id"),
            "relationship.person": ev.dangling(t("relationships"), "person_id", t("person_identities"), "person_id"),
            "relationship.company": ev.dangling(t("relationships"), "company_id", t("companies"), "company_id"),
            "registration.person": ev.dangling(t("registrations"), "person_id", t("person_identities"), "person_id"),
            "contact.owner": ev.dangling_owner(t("contacts"), "owner_id", *owners),
            "link.relationship": ev.dangling(t("relationship_contact_links"), "relationship_id", t("relationships"), "relationship_id"),
            "link.contact": ev.dangling(t("relationship_contact_links"), "contact_id", t("contacts"), "contact_id"),
            "lead.company": ev.dangling(t("leads"), "company_id", t("companies"), "company_id"),
            "statement.provenance": ev.dangling(t("statements"), "provenance_id", t("provenance"), "provenance_id"),
            "decision.lead": ev.dangling(t("qualification_decisions"), "lead_id", t("leads"), "lead_id"),
        }
        scope = ["subject_id", "field_name"]
        found["candidate.scope"] = ev.other_scope(t("candidate_facts"), "provenance_id", t("provenance"), "provenance_id", scope)
        found["canonical.scope"] = ev.other_scope(t("canonical_facts"), "provenance_id", t("provenance"), "provenance_id", scope)
        out = None
        for name, rows in found.items():
            one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
            out = one if out is None else out.unionByName(one)
        return out


def _with_digest(rows: DataFrame, own: list[str]) -> DataFrame:
    return rows.withColumn(DIGEST, digest_of_columns(own))


def fixture(spark: SparkSession, path: str) -> dict:
    """A JSON object that spans a whole file."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
