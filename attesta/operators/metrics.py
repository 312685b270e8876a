"""Measures: a rate is available with its value, or unavailable with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(numerator: Column, denominator: Column, zero_reason: str) -> Column:
    """struct<availability, value, numerator, denominator, reason>."""
    there = F.coalesce(denominator > 0, F.lit(False))
    return F.struct(
        F.when(there, "AVAILABLE").otherwise("UNAVAILABLE").alias("availability"),
        F.when(there, F.try_divide(numerator.cast("double"), denominator.cast("double"))).alias("value"),
        numerator.cast("double").alias("numerator"),
        denominator.cast("double").alias("denominator"),
        F.when(~there, zero_reason).alias("reason"),
    )


def unavailable(reason: str) -> Column:
    nothing = F.lit(None).cast("double")
    return F.struct(F.lit("UNAVAILABLE").alias("availability"), nothing.alias("value"), nothing.alias("numerator"), nothing.alias("denominator"), F.lit(reason).alias("reason"))


def discovery(observed: DataFrame, key: str, universe: DataFrame | None = None, relevant: DataFrame | None = None) -> DataFrame:
    """Observations, entities, repeats, and shares of a universe and of the relevant ones if known."""
    each = observed.groupBy(key).agg(F.count("*").alias("n"))
    flagged = each
    for name, table in (("u", universe), ("r", relevant)):
        if table is not None:
            flagged = flagged.join(table.select(F.col(key)).distinct().withColumn(name, F.lit(1)), key, "left")
    sums = [F.coalesce(F.sum("n"), F.lit(0)).alias("observations"), F.count("*").alias("entities")]
    sums += [F.count(n).alias(n) for n in ("u", "r") if n in flagged.columns]
    out = flagged.agg(*sums)
    if universe is not None:
        out = out.join(universe.agg(F.count_distinct(key).alias("universe")))
    repeats = rate(F.col("observations") - F.col("entities"), F.col("observations"), "no discovery observations")
    cover = unavailable("bounded discovery universe / denominator is not supplied") if universe is None else rate(F.col("u"), F.col("universe"), "bounded discovery universe is empty")
    precise = unavailable("discovery relevance ground truth is not supplied") if relevant is None else rate(F.col("r"), F.col("entities"), "no discovered entities")
    return out.select("observations", "entities", repeats.alias("duplicate_rate"), cover.alias("coverage"), precise.alias("precision"))


def resolution(confusion: DataFrame) -> DataFrame:
    """Rates of a row of counts tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = confusion.select(
        "*",
        rate(tp, tp + fp, "no predicted matches").alias("precision_m"),
        rate(tp, tp + fn, "no labeled duplicate pairs").alias("recall_m"),
        rate(fp, fp + tn, "no labeled distinct pairs").alias("false_merge_m"),
        rate(fn, tp + fn, "no labeled duplicate pairs").alias("false_split_m"),
    )
    p, r = F.col("precision_m.value"), F.col("recall_m.value")
    f1 = F.try_divide(2 * p * r, p + r)
    missing = unavailable("precision/recall are unavailable or both zero")
    known = F.struct(F.lit("AVAILABLE").alias("availability"), f1.alias("value"), F.lit(None).cast("double").alias("numerator"), F.lit(None).cast("double").alias("denominator"), F.lit(None).cast("string").alias("reason"))
    return out.withColumn("f1_m", F.when(F.coalesce(p + r, F.lit(0.0)) > 0, known).otherwise(missing))


def enrichment(
    subjects: DataFrame,
    fields: DataFrame,
    canonicals: DataFrame,
    conflicts: DataFrame,
    candidates: DataFrame | None = None,
    provenance: DataFrame | None = None,
    labels: DataFrame | None = None,
) -> DataFrame:
    """Field coverage and accuracy, provenance coverage, and the share of evaluated fields that conflict.

    Slots are counted by multiplication, not built: a slot is covered if the
    subject and the field are asked and the fact is there. candidates:
    evidence_ids; canonicals then need provenance_id; provenance: provenance_id,
    evidence_ids; labels: subject_id, field_name, correct.
    """
    asked = subjects.select("subject_id").distinct()
    wanted = fields.select("field_name").distinct()
    present = canonicals.select("subject_id", "field_name").distinct()
    covered = present.join(asked, "subject_id", "left_semi").join(wanted, "field_name", "left_semi").agg(F.count("*").alias("covered"))
    torn = conflicts.select("subject_id", "field_name").distinct()
    evaluated = present.union(torn).distinct().agg(F.count("*").alias("evaluated"))
    out = covered.join(asked.agg(F.count("*").alias("s"))).join(wanted.agg(F.count("*").alias("f"))).join(torn.agg(F.count("*").alias("torn"))).join(evaluated)
    accuracy, backing = unavailable("field-accuracy ground truth is not supplied"), unavailable("no facts to measure")
    if labels is not None:
        out = out.join(labels.join(present, ["subject_id", "field_name"], "left_semi").agg(F.count("*").alias("labelled"), F.count_if("correct").alias("correct")))
        accuracy = rate(F.col("correct"), F.col("labelled"), "no labeled present fields")
    if candidates is not None and provenance is not None:
        own = candidates.agg(F.count("*").alias("n1"), F.count_if(F.size("evidence_ids") > 0).alias("b1"))
        proof = provenance.where(F.size("evidence_ids") > 0).select("provenance_id").distinct().withColumn("_p", F.lit(True))
        settled = canonicals.join(proof, "provenance_id", "left").agg(F.count("*").alias("n2"), F.count("_p").alias("b2"))
        out = out.join(own).join(settled)
        backing = rate(F.col("b1") + F.col("b2"), F.col("n1") + F.col("n2"), "no facts to measure")
    return out.select(
        rate(F.col("covered"), F.col("s") * F.col("f"), "no subject/field slots defined").alias("field_coverage"),
        accuracy.alias("field_accuracy"),
        backing.alias("provenance_coverage"),
        rate(F.col("torn"), F.col("evaluated"), "no canonical/conflicting fields evaluated").alias("conflict_rate"),
    )


def contacts(latest: DataFrame, owners: DataFrame) -> DataFrame:
    """Rates over the latest logical contacts (owner_id, status)."""
    own = owners.select("owner_id").distinct()
    reached = latest.select("owner_id").distinct().join(own, "owner_id", "left_semi").agg(F.count("*").alias("reached"))
    status = lambda s: F.count_if(F.col("status") == s)
    sums = latest.agg(F.count("*").alias("n"), status("VALIDATED").alias("v"), status("INVALID").alias("i"), status("STALE").alias("s"))
    out = sums.join(reached).join(own.agg(F.count("*").alias("owners")))
    none = "no contacts discovered"
    return out.select(
        F.col("n").alias("logical_contacts"),
        rate(F.col("reached"), F.col("owners"), "no owners supplied").alias("contact_discovery_rate"),
        rate(F.col("v"), F.col("n"), none).alias("validation_rate"),
        rate(F.col("i"), F.col("n"), none).alias("invalid_rate"),
        rate(F.col("s"), F.col("n"), none).alias("stale_rate"),
    )


def qualification(predicted: DataFrame, truth: DataFrame, key: str = "lead_id") -> DataFrame:
    """Precision and recall of QUALIFIED over leads that have both a prediction and a label."""
    both = predicted.join(truth, key)
    yes, label = F.col("qualification_status") == "QUALIFIED", F.col("label")
    out = both.agg(F.count_if(yes & label).alias("tp"), F.count_if(yes & ~label).alias("fp"), F.count_if(~yes & label).alias("fn"))
    tp = F.col("tp")
    return out.select("*", rate(tp, tp + F.col("fp"), "no predicted qualified leads").alias("precision_m"), rate(tp, tp + F.col("fn"), "no positive qualification labels").alias("recall_m"))


def disagreement(predicted: DataFrame, human: DataFrame, key: str = "lead_id") -> DataFrame:
    both = predicted.select(key, "qualification_status").join(human.select(key, F.col("qualification_status").alias("_h")), key)
    out = both.agg(F.count("*").alias("n"), F.count_if(F.col("qualification_status") != F.col("_h")).alias("differ"))
    return out.select(rate(F.col("differ"), F.col("n"), "no overlapping human decisions").alias("human_disagreement"))


def per_unit(total: Column, count: Column, missing_reason: str, zero_reason: str) -> Column:
    return F.when(total.isNull(), unavailable(missing_reason)).otherwise(rate(total, count, zero_reason))


def report(scope: str, **sections: DataFrame) -> DataFrame:
    """One row with a struct for each section; every section is one row."""
    out = None
    for name, section in sections.items():
        one = section.select(F.struct("*").alias(name))
        out = one if out is None else out.join(one)
    return out.select(F.lit(scope).alias("scope"), *sections)
