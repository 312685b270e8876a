"""Normalisation of candidate facts: by field name, with errors as data.

Every fact keeps its raw value. The result says whether a rule changed it, left
it, refused it, or does not exist, and which rule or reason it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as idn
from ..functions import text as tx

#: Which rule a field has.
RULES = {
    "company_name": ("company_name", "legal_name", "trade_name"),
    "domain": ("domain",),
    "url": ("website", "website_url", "url", "linkedin_url", "instagram_url", "social_profile_url"),
    "phone": ("phone", "company_phone"),
    "text": (
        "address", "street_address", "city", "location", "country", "industry", "industry_label",
        "registration_status", "primary_cnae_description",
    ),
    "state": ("state",),
    "cnae": ("primary_cnae_code", "cnae_code"),
}
#: Names of the rules, and of what is wrong with a blank value.
RULE_NAMES = {
    "company_name": ("company_name_nfkc_whitespace_v1", "company name"),
    "text": ("text_nfkc_whitespace_v1", "text value"),
    "domain": ("domain_lower_idna_v1", "domain"),
    "url": ("url_scheme_host_fragment_v1", "URL"),
    "phone": ("phone_punctuation_only_v1", "phone"),
    "state": ("state_two_letter_upper_v1", "state"),
    "cnae": ("cnae_digits7_v1", "CNAE code"),
}


def _result(value: Column, rule: Column | str, error: Column) -> Column:
    named = F.lit(rule) if isinstance(rule, str) else rule
    return F.struct(value.alias("value"), F.when(value.isNotNull(), named).alias("rule"), F.when(value.isNull(), error).alias("error"))


def _rule_of(field: Column) -> Column:
    out = F.lit(None).cast("string")
    for rule, fields in RULES.items():
        out = F.when(field.isin(*fields), rule).otherwise(out)
    return out


def normalized(facts: DataFrame, raw: str = "raw_value", field: str = "field_name", kind: str | None = None) -> DataFrame:
    """Add normalized_value, status, rule and reason; ``kind`` names the column with a value's type.

    Without ``kind`` every value is text. Facts stay as many and in place.
    """
    base = facts.withColumn("_rule", _rule_of(F.col(field))).withColumn("_clean", tx.clean(F.col(raw)))
    text_like = F.lit(True) if kind is None else F.col(kind) == "str"
    number_like = F.lit(False) if kind is None else F.col(kind) == "int"
    c = F.col("_clean")
    # the two vectorised rules see only the values that are theirs
    only = lambda rule: F.when((F.col("_rule") == rule) & text_like, c)
    base = base.withColumn("_domain", idn.checked_domain(only("domain"))).withColumn("_url", idn.checked_url(only("url")))
    some = F.when(F.length(c) > 0, c)
    phone = idn.phone_rule(c)
    state = F.when(c.rlike(r"^\p{L}{2}$"), F.upper(c)).otherwise(some)
    blank = lambda rule: F.lit(f"{RULE_NAMES[rule][1]} is blank")
    cases = {
        "company_name": _result(some, RULE_NAMES["company_name"][0], blank("company_name")),
        "text": _result(some, RULE_NAMES["text"][0], blank("text")),
        "domain": _result(F.col("_domain.value"), RULE_NAMES["domain"][0], F.col("_domain.error")),
        "url": _result(F.col("_url.value"), RULE_NAMES["url"][0], F.col("_url.error")),
        "phone": _result(phone, RULE_NAMES["phone"][0], F.when(F.length(c) == 0, "phone is blank").otherwise("phone has too few digits")),
        "state": _result(state, F.when(c.rlike(r"^\p{L}{2}$"), RULE_NAMES["state"][0]).otherwise(RULE_NAMES["text"][0]), blank("state")),
        "cnae": _result(idn.activity_code(F.col(raw)), RULE_NAMES["cnae"][0], F.lit("CNAE code must contain exactly 7 digits")),
    }
    out = None
    for rule, case in cases.items():
        allowed = (text_like | number_like) if rule == "cnae" else text_like
        wrong = F.lit("CNAE code must be text or integer" if rule == "cnae" else f"{RULE_NAMES[rule][1]} must be text")
        nothing = F.lit(None).cast("string")
        case = F.when(allowed & F.col(raw).isNotNull(), case).otherwise(_result(nothing, RULE_NAMES[rule][0], wrong))
        out = F.when(F.col("_rule") == rule, case) if out is None else out.when(F.col("_rule") == rule, case)
    base = base.withColumn("_out", out)
    value = F.col("_out.value")
    status = (
        F.when(F.col("_rule").isNull(), "UNSUPPORTED")
        .when(value.isNull(), "INVALID")
        .when(value == F.col(raw), "UNCHANGED")
        .otherwise("NORMALIZED")
    )
    unknown = F.concat(F.lit("no V1 normalizer for field '"), F.col(field), F.lit("'"))
    return (
        base.withColumn("normalized_value", value)
        .withColumn("status", status)
        .withColumn("rule", F.col("_out.rule"))
        .withColumn("reason", F.when(F.col("_rule").isNull(), unknown).otherwise(F.col("_out.error")))
        .drop("_rule", "_clean", "_domain", "_url", "_out")
    )


def effective(normalized_value: Column, raw: Column) -> Column:
    """For fusion: what was normalised, else what was found."""
    return F.coalesce(normalized_value, raw)


def effective_nonblank(normalized_value: Column, raw: Column) -> Column:
    """For rules over people: a blank normalised value does not count."""
    return F.coalesce(tx.blank_to_null(normalized_value), raw)


def unpivoted(rows: DataFrame, subject: str, fields: dict[str, str]) -> DataFrame:
    """(subject_id, field_name, raw_value) for each column that is neither null nor blank."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(c).cast("string").alias("raw_value")) for c, f in fields.items()])).alias("x")
    out = rows.select(F.col(subject).cast("string").alias("subject_id"), pairs).select("subject_id", "x.*")
    return out.where(F.col("raw_value").isNotNull() & ~tx.is_blank(F.col("raw_value")))
