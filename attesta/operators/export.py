"""Export bundles: closed under references, in order of ids, as JSON or CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import canonical_json
from .evidence import dangling, dangling_elements, repeated


def section(rows: DataFrame, owner: str, key: str, name: str) -> DataFrame:
    """The records of each owner as one list in order of their ids."""
    rest = [c for c in rows.columns if c not in (owner, key)]
    return rows.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct(key, *rest))).alias(name))


def bundles(owners: DataFrame, owner: str, *sections: DataFrame) -> DataFrame:
    """One row for each owner with all sections; an owner without records has null lists."""
    out = owners
    for s in sections:
        out = out.join(s, owner, "left")
    return out


def as_json(rows: DataFrame, owner: str) -> DataFrame:
    """(owner, json): keys sorted, no white space, nulls kept."""
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return rows.select(owner, canonical_json(text).alias("json"))


def as_cells(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for a CSV."""
    nested = ("array", "struct", "map")
    return rows.select(*[F.to_json(c).alias(c) if rows.schema[c].dataType.typeName() in nested else F.col(c) for c in rows.columns])


def write_json(rows: DataFrame, owner: str, path: str) -> None:
    as_json(rows, owner).select("json").write.text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    as_cells(rows).write.csv(path, header=True)


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, violations) for each check, whose rows are what is wrong."""
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def closure(companies: DataFrame, facts: DataFrame, provenance: DataFrame, evidence: DataFrame) -> DataFrame:
    """Checks of a bundle: references that name nothing, and ids that repeat."""
    return violations(
        {
            "fact_company": dangling(facts, "company_id", companies, "company_id"),
            "fact_provenance": dangling(facts, "provenance_id", provenance, "provenance_id"),
            "provenance_evidence": dangling_elements(provenance, "evidence_ids", evidence, "evidence_id"),
            "fact_ids": repeated(facts, "fact_id"),
        }
    )


def exportable(value: Column) -> Column:
    """Whether a number can be written as JSON."""
    return ~(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))))
