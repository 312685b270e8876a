"""Digests, derived ids, typed value keys and canonical JSON."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import on_strings


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def joined(parts: list[Column] | Column) -> Column:
    """Parts joined by NUL; a null part keeps its place."""
    whole = parts if isinstance(parts, Column) else F.array(*[p.cast("string") for p in parts])
    return F.array_join(whole, "\0", "")


def digest_of(*parts: Column) -> Column:
    return digest(joined(list(parts)))


def derived_id(prefix: str, *parts: Column, length: int = 64) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(digest_of(*parts), 1, length))


# --- typed values ------------------------------------------------------------
# A value is a pair of columns: its type name and its JSON. True, 1, 1.0 and "1"
# are four values.


def typed_key(kind: Column, value: Column) -> Column:
    """["type",json] of a scalar value held as JSON text."""
    return F.concat(F.lit('["'), kind, F.lit('",'), value, F.lit("]"))


def json_text(text: Column) -> Column:
    """A text as a JSON string, with other characters than ASCII as they are."""
    return on_strings(lambda x: json.dumps(x, ensure_ascii=False))(text)


def tagged(item: object) -> object:
    """A nested value with the name of each part's type; a fixed format, as ids are made from it."""
    if item is None or isinstance(item, (str, bool, int, float)):
        return [type(item).__name__, item]
    if isinstance(item, list):
        return ["list", [tagged(x) for x in item]]
    if isinstance(item, dict):
        pairs = [(tagged(k), tagged(v)) for k, v in item.items()]
        return ["dict", sorted(pairs, key=lambda p: json.dumps(p[0], sort_keys=True))]
    raise TypeError(f"unsupported value type: {type(item).__name__}")


def compact(item: object) -> str:
    return json.dumps(item, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


#: The typed key of any JSON value.
nested_key = on_strings(lambda x: compact(tagged(json.loads(x))))
#: JSON with sorted keys and no white space.
canonical_json = on_strings(lambda x: compact(json.loads(x)))


def _fusion_id(prefix: str, with_value: bool):
    def run(subject: pd.Series, field: pd.Series, ids: pd.Series, value: pd.Series) -> pd.Series:
        import hashlib

        out = []
        for s, f, own, v in zip(subject, field, ids, value):
            # members of the material are tagged as their own types, in order of their names
            material = ["dict", [
                [["str", "candidate_fact_ids"], ["list", [["str", i] for i in sorted(own)]]],
                [["str", "field_name"], ["str", f]],
                [["str", "subject_id"], ["str", s]],
                [["str", "value"], json.loads(v) if with_value and v is not None else ["NoneType", None]],
            ]]
            out.append(f"{prefix}:{hashlib.sha256(compact(material).encode()).hexdigest()[:24]}")
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, T.StringType())


def fusion_id(prefix: str, subject: Column, field: Column, ids: Column, value_key: Column | None = None) -> Column:
    """The id of a fusion record from its subject, field, candidates and typed value."""
    key = F.lit(None).cast("string") if value_key is None else value_key
    return _fusion_id(prefix, value_key is not None)(subject, field, ids, key)


def finite(value: Column) -> Column:
    """Whether a number may be exported."""
    return ~(F.isnan(value) | (F.abs(value) == F.lit(math.inf)))


# --- time --------------------------------------------------------------------

_ZONED = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$"


def aware_time(text: Column) -> Column:
    """The instant of an ISO text that names its offset; else null."""
    return F.when(text.rlike(_ZONED), F.try_to_timestamp(text))
