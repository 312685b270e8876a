"""Evidence from requests and the responses that carry their ids.

Who fetches is not said here: responses are captured ones, in a table or a
stream's batch. A rule that a row breaks fails the query by the rule's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.bounds import required, unique

REQUEST = "request_id string, source_id string, url string, purpose string"
RESPONSE = "request_id string, url string, status_code int, raw_payload string, captured_at timestamp, headers map<string, string>"


def _text(c: str) -> Column:
    return F.col(c).rlike(r"(?U)\S")


def sound_requests(requests: DataFrame) -> DataFrame:
    told = requests
    for c in ("request_id", "source_id", "url"):
        told = required(told, f"{c} must not be blank", _text(c))
    return unique(told, "request_id", "a request id is used twice")


def sound_responses(responses: DataFrame) -> DataFrame:
    told = responses
    for c in ("request_id", "url"):
        told = required(told, f"{c} must not be blank", _text(c))
    told = required(told, "status_code must be a valid HTTP status", F.col("status_code").between(100, 599), F.col("request_id"))
    told = required(told, "a response has a time", F.col("captured_at").isNotNull(), F.col("request_id"))
    return unique(told, "request_id", "a request is answered twice")


def materialized(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Evidence of each response, under the id of its request.

    A response to no request is an error; a request without a response has no
    evidence. Headers are kept as JSON with names in order.
    """
    asked = sound_requests(requests).select("request_id", "source_id", "purpose", F.lit(True).alias("_asked"))
    both = sound_responses(responses).join(asked, "request_id", "left")
    both = required(both, "request and response must share the same request_id", F.col("_asked"), F.col("request_id"))
    pairs = F.array_sort(F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.array(e["key"], e["value"])))
    metadata = F.create_map(
        F.lit("purpose"), F.col("purpose"), F.lit("request_id"), F.col("request_id"), F.lit("status_code"), F.col("status_code").cast("string"), F.lit("headers"), F.to_json(pairs)
    )
    return both.select(
        F.concat(F.lit("evidence:"), "request_id").alias("evidence_id"), "source_id", F.col("url").alias("locator"), "captured_at", F.col("status_code").alias("http_status"), "raw_payload", metadata.alias("metadata")
    )


def unanswered(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests without a response."""
    return sound_requests(requests).join(responses.select("request_id"), "request_id", "left_anti")


def of_source(requests: DataFrame, source_id: str) -> DataFrame:
    """The requests, which must all be of one configured source."""
    return required(requests, "request source_id does not match the configured source", F.col("source_id") == source_id, F.col("request_id"))
