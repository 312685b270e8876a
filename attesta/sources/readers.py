"""Typed records from JSON payloads, and what was refused with its reasons.

A payload is parsed once, as a variant, and each field is taken from it by its
rule. Good and refused rows add up to the input, in batch and in a stream; both
are counted by the action that writes them, without a second pass.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import aware_time, digest
from .ledger import Ledger


@dataclass(frozen=True)
class Record:
    """Fields by their rule: texts that must be there, times that must or may, lists, and a choice."""

    texts: tuple[str, ...]
    times: tuple[str, ...]
    optional_times: tuple[str, ...] = ()
    lists: tuple[str, ...] = ()
    filled_lists: tuple[str, ...] = ()
    choices: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def key(self) -> str:
        return self.texts[0]

    def columns(self) -> list[str]:
        return [*self.texts, *self.times, *self.optional_times, *self.lists, *self.filled_lists, *(c for c, _ in self.choices)]

    def ddl(self) -> str:
        kinds = [(c, "string") for c in self.texts] + [(c, "timestamp") for c in (*self.times, *self.optional_times)]
        kinds += [(c, "array<string>") for c in (*self.lists, *self.filled_lists)] + [(c, "string") for c, _ in self.choices]
        return ", ".join(f"{c} {k}" for c, k in kinds)


#: Fields of governance and verification payloads, and the decisions they may name.
SIGNOFF = Record(
    ("signoff_id", "reviewer_reference", "policy_id", "policy_version", "jurisdiction", "channel", "campaign_id"),
    ("decided_at",),
    ("expires_at", "revoked_at"),
    ("conditions", "authority_evidence_refs"),
    choices=(("decision", ("APPROVED", "APPROVED_WITH_CONDITIONS", "REJECTED", "MORE_REVIEW_REQUIRED")),),
)
AUTHORIZATION = Record(("authorization_id", "campaign_id", "policy_id", "policy_version", "authorizer_reference"), ("authorized_at",), ("valid_until", "revoked_at"))
VERIFICATION = Record(
    ("verification_id", "person_id", "council", "registration_number", "reviewer_reference"),
    ("verified_at",),
    ("expires_at",),
    filled_lists=("evidence_refs",),
    choices=(("decision", ("VERIFIED_ACTIVE", "VERIFIED_INACTIVE", "NOT_FOUND", "CONFLICT")),),
)

_BLANK = r"^(?U)\s*$"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _kind(v: Column, field: str) -> Column:
    """What JSON has under a field: null where there is nothing or a null."""
    x = F.try_variant_get(v, f"$.{field}", "variant")
    return F.when(~F.coalesce(F.is_variant_null(x), F.lit(True)), F.schema_of_variant(x))


def parsed(payloads: DataFrame, record: Record, body: str = "body") -> DataFrame:
    """The payloads with ``record``, a struct of its fields, and ``reasons``, why it is refused."""
    rows = payloads.withColumn("_v", F.try_parse_json(F.col(body)))
    v = F.col("_v")
    values: dict[str, Column] = {}
    reasons: list[Column] = []
    whole = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    for c in record.texts:
        text = F.when(_kind(v, c) == "STRING", _trimmed(F.try_variant_get(v, f"$.{c}", "string")))
        values[c] = text
        reasons.append(F.when(F.coalesce(text.rlike(_BLANK), F.lit(True)), f"{c} is required"))
    for c in (*record.times, *record.optional_times):
        there = _kind(v, c)
        text = F.when(there == "STRING", _trimmed(F.try_variant_get(v, f"$.{c}", "string")))
        time = aware_time(text)
        values[c] = time
        missing = F.when(there.isNull(), f"{c} is required") if c in record.times else F.when(there.isNull(), F.lit(None).cast("string"))
        known = F.try_to_timestamp(text).isNotNull()
        reasons.append(
            missing.when(F.coalesce(text.rlike(_BLANK), F.lit(True)), f"{c} must be an ISO-8601 string").when(~known, f"{c} must be a valid ISO-8601 timestamp").when(time.isNull(), f"{c} must be timezone-aware")
        )
    for c in (*record.lists, *record.filled_lists):
        there = _kind(v, c)
        items = F.try_variant_get(v, f"$.{c}", "array<variant>")
        texts = F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", _trimmed(F.try_variant_get(x, "$", "string"))))
        values[c] = F.coalesce(texts, F.array().cast("array<string>")) if c in record.lists else texts
        broken = F.exists(texts, lambda x: F.coalesce(x.rlike(_BLANK), F.lit(True)))
        if c in record.filled_lists:
            bad = F.coalesce(~there.startswith("ARRAY") | (F.size(items) == 0) | broken, F.lit(True))
            reasons.append(F.when(bad, f"{c} must be a non-empty list of non-blank strings"))
        else:
            reasons.append(F.when(there.isNotNull() & ~there.startswith("ARRAY"), f"{c} must be a list of strings").when(F.coalesce(broken, F.lit(False)), f"{c} must contain only non-blank strings"))
    for c, allowed in record.choices:
        text = F.when(_kind(v, c) == "STRING", _trimmed(F.try_variant_get(v, f"$.{c}", "string")))
        values[c] = text
        reasons.append(F.when(F.coalesce(text.rlike(_BLANK), F.lit(True)), f"{c} is required").when(~text.isin(*allowed), f"{c} must be one of: {', '.join(sorted(allowed))}"))
    found = F.when(whole, F.array_compact(F.array(*reasons))).otherwise(F.array(F.lit("payload must be an object")))
    made = F.struct(*[values[c].alias(c) for c in record.columns()])
    return rows.withColumn("record", made).withColumn("reasons", found).drop("_v")


def good(read: DataFrame) -> DataFrame:
    return read.where(F.size("reasons") == 0).select("record.*")


def refused(read: DataFrame) -> DataFrame:
    return read.where(F.size("reasons") > 0).drop("record")


def counted(read: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The rows, and counts of them that are there once an action has run: rows, accepted, refused, and each reason's start."""
    seen = Observation(name)
    bad = F.size("reasons") > 0
    return read.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("refused")), seen


def ledgers(spark, folder: str, record: Record, buckets: int = 16) -> tuple[Ledger, Ledger]:
    """(records, quarantine) of a folder."""
    top = folder.rstrip("/")
    return Ledger.made(spark, f"{top}/records", record.key, record.ddl(), buckets), Ledger.made(spark, f"{top}/quarantine", "refusal_id", "refusal_id string, body string, reasons array<string>", buckets)


def ingest(payloads: DataFrame, record: Record, folder: str, batch: str | None = None, body: str = "body") -> dict[str, int]:
    """Read payloads into a ledger of records and one of refusals; say what was counted on the way.

    A batch that is tried again under its name adds nothing. Payloads that repeat
    a record are one; a refusal is named by its payload.
    """
    kept, quarantine = ledgers(payloads.sparkSession, folder, record)
    batch = batch or uuid.uuid4().hex
    if all(batch in ledger.manifest().known for ledger in (kept, quarantine)):
        return dict.fromkeys(("rows", "accepted", "refused", "added", "quarantined"), 0)
    read, seen = counted(parsed(payloads.select(F.col(body).alias("body")), record), f"ingest-{uuid.uuid4().hex}")
    read = read.persist(StorageLevel.DISK_ONLY)
    try:
        bad = refused(read).select(digest(F.coalesce("body", F.lit(""))).alias("refusal_id"), "body", "reasons").dropDuplicates(["refusal_id"])
        added = kept.append(good(read).distinct(), batch), quarantine.append(bad, batch)
        return dict(seen.get) | {"added": added[0], "quarantined": added[1]}
    finally:
        read.unpersist()


def ingested(stream: DataFrame, record: Record, folder: str, checkpoint: str, body: str = "body") -> tuple[StreamingQuery, list[dict[str, int]]]:
    """As :func:`ingest` for each micro-batch of a stream, with the list that gets each one's counts."""
    told: list[dict[str, int]] = []
    name = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex

    def add(batch: DataFrame, number: int) -> None:
        told.append(ingest(batch, record, folder, f"{name}-{number}", body) | {"batch": number})

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), told
