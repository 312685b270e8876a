"""Contacts: corroborated publication, and the latest state of a logical contact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers as idn
from ..functions.hashing import digest, joined

#: Sources whose pages confirm a contact, and the method's name.
PAGE_SOURCES = ("company-web-page", "company-people-page")
METHOD = "PUBLICATION_CORROBORATION_V1"
#: Which status wins at equal times.
STATUS_RANK = {"DISCOVERED": 0, "UNKNOWN": 1, "STALE": 2, "INVALID": 3, "VALIDATED": 4}


def qualifying(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence that can confirm a contact: a page that was read as text."""
    pages = sources.where(F.col("source_type").isin(*PAGE_SOURCES)).select("source_id")
    return evidence.join(pages, "source_id", "left_semi").where((F.col("http_status") == 200) & F.col("raw_payload").isNotNull())


def keyed(contacts: DataFrame) -> DataFrame:
    """Discovered contacts with the key that equivalent ones share."""
    return contacts.where("status = 'DISCOVERED'").withColumn("equivalence_key", idn.equivalence_key(F.col("kind"), F.col("value")))


def independent() -> Column:
    """Of a group of confirmations: two that differ in place or time."""
    return (F.count_distinct("locator") > 1) | (F.count_distinct("captured_at") > 1)


def corroborated(contacts: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row for each owner, kind and key: whether its observations corroborate each other.

    ``evidence`` is qualifying evidence. A pair of independent confirmations
    exists exactly if places or times differ within the group, so no pairs are
    formed. Invalid values are not validatable, each a row of its own.
    """
    known = keyed(contacts)
    each = known.where("equivalence_key is not null").select("contact_id", "owner_id", "kind", "equivalence_key", F.explode("discovery_evidence_ids").alias("evidence_id"))
    met = each.join(evidence.select("evidence_id", "locator", "captured_at"), "evidence_id")
    once = met.dropDuplicates(["owner_id", "kind", "equivalence_key", "evidence_id"])
    held = once.groupBy("owner_id", "kind", "equivalence_key").agg(
        F.count("*").alias("confirmations"),
        independent().alias("_independent"),
        F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"),
        F.array_sort(F.collect_set("locator")).alias("locators"),
        F.max("captured_at").alias("_latest"),
    )
    own = met.groupBy("owner_id", "kind", "equivalence_key").agg(F.array_sort(F.collect_set("contact_id")).alias("contact_ids"))
    valid = (F.col("confirmations") >= 2) & F.col("_independent")
    material = F.concat(F.array(F.lit(METHOD), F.col("owner_id"), F.col("kind"), F.col("equivalence_key")), F.col("evidence_ids"))
    return held.join(own, ["owner_id", "kind", "equivalence_key"]).select(
        "owner_id",
        "kind",
        "equivalence_key",
        F.when(valid, "VALIDATED").otherwise("INSUFFICIENT_EVIDENCE").alias("disposition"),
        F.when(valid, F.concat(F.lit("contact:validated:"), digest(joined(material)))).alias("validated_contact_id"),
        F.when(valid, F.col("_latest")).alias("validated_at"),
        "confirmations",
        "contact_ids",
        "evidence_ids",
        "locators",
    )


def status_rank(status: Column) -> Column:
    out = F.lit(-1)
    for name, rank in STATUS_RANK.items():
        out = F.when(status == name, rank).otherwise(out)
    return out


def latest(contacts: DataFrame, order: str = "seq") -> DataFrame:
    """The latest row of each logical contact: by time, then status, then the first.

    One aggregate with map-side combining; contacts have owner_id, kind, value,
    status, discovered_at, validated_at and ``order``.
    """
    when = F.coalesce("validated_at", "discovered_at")
    ranked = contacts.withColumn("logical_value", idn.logical_value(F.col("kind"), F.col("value"))).withColumn("effective_at", when)
    rest = [c for c in ranked.columns if c not in ("owner_id", "kind", "logical_value")]
    best = F.max_by(F.struct(*rest), F.struct("effective_at", status_rank(F.col("status")).alias("r"), (-F.col(order)).alias("o"))).alias("x")
    return ranked.groupBy("owner_id", "kind", "logical_value").agg(best).select("owner_id", "kind", "logical_value", "x.*")


def first_by_key(found: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """The first contact of each key within a page or a person."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def of_relationship(contacts: DataFrame, links: DataFrame, relationships: DataFrame) -> DataFrame:
    """Contacts linked to a relationship, owned by its person; :func:`unlinked` names links to no contact."""
    own = relationships.select("relationship_id", "person_id")
    return links.join(own, "relationship_id").join(contacts.drop("owner_id"), "contact_id").withColumnRenamed("person_id", "owner_id")


def unlinked(contacts: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose contact is not there; an assembly leaves them out."""
    return links.join(contacts.select("contact_id"), "contact_id", "left_anti")
