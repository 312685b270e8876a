"""Captured payloads as tables: registry look-ups, pages, searches, governance records.

Nothing is fetched here. What transports captured is read from files by Spark,
and what does not parse becomes a row with its error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import aware_time, derived_id
from ..functions.identifiers import listed_page, registry_key
from ..functions.text import is_blank
from ..operators.normalize import unpivoted

#: Fields of a registry answer and the fact fields they give.
LOOKUP_FIELDS = {
    "cnpj": "business_registry_id",
    "razao_social": "legal_name",
    "nome_fantasia": "trade_name",
    "descricao_situacao_cadastral": "registration_status",
    "cnae_fiscal": "primary_cnae_code",
    "cnae_fiscal_descricao": "primary_cnae_description",
    "municipio": "city",
    "uf": "state",
}
#: The registry's source and address, and the only pages of locations and of offices.
LOOKUP_SOURCE, LOOKUP_URL = "source:brasilapi:cnpj-v1", "https://brasilapi.com.br/api/cnpj/v1"
LOCATION_PAGE = "https://www.transparencia.serpro.gov.br/acesso-a-informacao/institucional/enderecos"
OFFICES_PAGE = "https://www.serpro.gov.br/menu/institucional/quem-somos/encontre-o-serpro"
LOOKUP_SCHEMA = ", ".join(f"{c} string" for c in LOOKUP_FIELDS)


def lookups(observations: DataFrame, body: str = "body", status: str = "http_status", key: str = "requested_key", url: str = "url") -> DataFrame:
    """Captured answers with their evidence id, parsed fields, and why an answer is not used.

    The evidence id is that of address and body, without the status.
    """
    parsed = F.from_json(F.col(body), LOOKUP_SCHEMA, {"mode": "PERMISSIVE"})
    rows = observations.withColumn("_p", parsed).withColumn("evidence_id", derived_id("evidence", F.col(url), F.col(body)))
    error = (
        F.when(F.col(status) != 200, F.concat(F.lit("HTTP "), F.col(status)))
        .when(~F.coalesce(F.trim(body).startswith("{"), F.lit(False)), "the answer is not a JSON object")
        .when(~registry_key(F.col("_p.cnpj")).eqNullSafe(registry_key(F.col(key))), "the answer is about another key")
        .when(F.coalesce(is_blank(F.col("_p.razao_social")), F.lit(True)), "the legal name is blank")
    )
    return rows.select(*observations.columns, "evidence_id", "_p.*", error.alias("error"))


def lookup_facts(answers: DataFrame, key: str = "requested_key") -> DataFrame:
    """Candidate facts of usable answers: one for each field that is not blank."""
    company = F.concat(F.lit("company:"), registry_key(F.col(key)))
    used = answers.where("error is null").withColumn("company_id", company)
    facts = unpivoted(used.withColumn("_s", F.concat_ws("|", "company_id", "evidence_id")), "_s", LOOKUP_FIELDS)
    parts = F.split("subject_id", r"\|")
    facts = facts.select(parts[0].alias("subject_id"), "field_name", "raw_value", parts[1].alias("evidence_id"))
    return facts.withColumn("fact_id", derived_id("fact", F.col("subject_id"), F.col("field_name"), F.col("evidence_id"), length=24))


def lookup_address(key: Column) -> Column:
    """Where the registry tells of a key; null for what is no key."""
    return F.concat(F.lit(f"{LOOKUP_URL}/"), registry_key(key))


def location_source(url: Column) -> Column:
    """struct<source_id, locator> of the location page; null for any other address."""
    page = listed_page(url, LOCATION_PAGE)
    return F.when(page.isNotNull(), F.struct(derived_id("source:official-company-location", page, length=24).alias("source_id"), page.alias("locator")))


def captured_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; what does not parse is in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def decoded(body: Column, charset: Column) -> Column:
    """Text of a body in its declared character set, UTF-8 if there is none; null if it does not decode."""
    name = F.upper(F.coalesce(charset, F.lit("UTF-8")))
    known = {c: F.decode(body, c) for c in ("US-ASCII", "ISO-8859-1", "UTF-16BE", "UTF-16LE", "UTF-16")}
    out = F.when(name == "UTF-8", F.try_validate_utf8(body.cast("string")))
    for c, value in known.items():
        out = out.when(name == c, value)
    return out


def headers(names: Column) -> Column:
    """A header map with lower-case names in order."""
    entries = F.transform(F.map_entries(names), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.array_sort(entries))


def envelope_errors(rows: DataFrame, status: str = "http_status", url: str = "url", time: str = "captured_at") -> DataFrame:
    """Observations that break the envelope's rules."""
    good = F.col(status).between(100, 599) & F.col(url).rlike(r"(?i)^https?://[^/\s]+") & F.col(time).isNotNull()
    return rows.where(~F.coalesce(good, F.lit(False)))


def governance(payloads: DataFrame, schema: str, required: list[str], times: list[str], body: str = "body") -> DataFrame:
    """Typed governance records; a missing text or a time without offset is an error."""
    rows = payloads.withColumn("_p", F.from_json(F.col(body), schema)).select(*payloads.columns, "_p.*")
    bad = [F.when(F.coalesce(is_blank(F.col(c)), F.lit(True)), f"{c} is required") for c in required]
    bad += [F.when(F.col(c).isNotNull() & aware_time(F.col(c)).isNull(), f"{c} must name an offset") for c in times]
    return rows.withColumn("errors", F.array_compact(F.array(*bad))).withColumns({f"{c}_at": aware_time(F.col(c)) for c in times})


def coverage_reference(rows: DataFrame, keys: str) -> DataFrame:
    """(key) of a reference list: sorted, each once, and well formed."""
    return rows.select(F.explode(keys).alias("raw")).select(registry_key(F.col("raw")).alias("key")).where("key is not null").distinct().orderBy("key")
