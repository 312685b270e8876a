"""Typed values of any Spark type as text: keys that tell types apart, and a stored form that reads back.

Both are built by going over the type once, so what runs is one expression on
the JVM, however deep values are nested. Arrays are lists; structs whose fields
are named _1, _2, ... are tuples, other structs and maps are dictionaries;
binary is bytes; a timestamp is a time in UTC, one without zone a naive time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How a JSON text names the control characters that have a short name.
_SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def _is_tuple(kind: T.StructType) -> bool:
    return bool(kind.names) and kind.names == [f"_{i + 1}" for i in range(len(kind.names))]


def json_string(text: Column) -> Column:
    """A text as a JSON string, with other characters than ASCII as they are."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = plain
    for code in range(32):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(_SHORT.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), escaped).otherwise(plain), F.lit('"'))


def _ascii(quoted: Column) -> Column:
    """A JSON text with every other character than ASCII as its code units."""
    each = F.regexp_extract_all(quoted, F.lit("(?s)."), F.lit(0))
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(....)", r"\\u$1")
    wide = F.array_join(F.transform(each, lambda c: F.when(c.rlike(r"[^\x00-\x7f]"), units(c)).otherwise(c)), "")
    return F.when(quoted.rlike(r"[^\x00-\x7f]"), wide).otherwise(quoted)


def float_text(x: Column) -> Column:
    """A double in the shortest form that reads back: plain from 1e-4 to below 1e16, else with an exponent of two digits or more."""

    def shown(s: Column) -> Column:
        """Of a text with digits and, maybe, an exponent."""
        mantissa = F.split_part(s, F.lit("E"), F.lit(1))
        power = F.coalesce(F.try_to_number(F.nullif(F.split_part(s, F.lit("E"), F.lit(2)), F.lit("")), F.lit("S999")).cast("int"), F.lit(0))
        whole, part = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
        both = F.concat(whole, part)
        digits = F.regexp_replace(F.regexp_replace(both, "^0+", ""), "0+$", "")
        lead = F.length(both) - F.length(F.regexp_replace(both, "^0+", ""))
        e = F.length(whole) + power - lead - 1  # of the first digit
        n = F.length(digits)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        large = F.concat(F.rpad(digits, e + 1, F.lit("0")), F.lit(".0"))
        mid = F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, n))
        point = F.when(n > 1, F.concat(F.substring(digits, F.lit(1), F.lit(1)), F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(digits)
        far = F.concat(point, F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
        return F.when((e < -4) | (e >= 16), far).when(e < 0, small).when(n <= e + 1, large).otherwise(mid)

    def shorter(s: Column) -> Column:
        """The text with a digit less, where that is the same number: the JVM's own text is not always the shortest."""
        whole = F.regexp_replace(F.split_part(s, F.lit("E"), F.lit(1)), r"\.", "")
        digits = F.regexp_replace(whole, "0+$", "")
        power = F.coalesce(F.try_to_number(F.nullif(F.split_part(s, F.lit("E"), F.lit(2)), F.lit("")), F.lit("S999")).cast("int"), F.lit(0))
        behind = F.length(F.split_part(F.split_part(s, F.lit("E"), F.lit(1)), F.lit("."), F.lit(2)))
        rounded = F.floor((digits.cast("long") + 5) / F.lit(10).cast("decimal(2,0)")).cast("string")
        # a whole number is rounded from all of its digits
        more = F.length(exact) - F.length(digits) + 1
        unit = F.concat(F.lit("1"), F.repeat(F.lit("0"), more)).cast("decimal(20,0)")
        rounded = F.when(exact.isNotNull() & (more > 0), F.floor((exact.cast("decimal(20,0)") + unit / 2) / unit).cast("string")).otherwise(rounded)
        less = F.concat(rounded, F.lit("E"), (power - behind + F.length(whole) - F.length(digits) + 1).cast("string"))
        return F.when((F.length(F.regexp_replace(digits, "^0+", "")) > 1) & (less.try_cast("double") == s.try_cast("double")), less).otherwise(s)

    x = x.cast("double")
    exact = F.when((F.abs(x) >= 2.0**53) & (F.abs(x) < 2.0**63), F.abs(x).try_cast("long").cast("string"))
    text = F.transform(F.transform(F.transform(F.array(F.abs(x).cast("string")), shorter), shorter), shown)[0]
    sign = F.when((x < 0) | ((x == 0) & (x.cast("string").startswith("-"))), "-").otherwise("")
    return F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("Infinity"))).when(x == 0, F.concat(sign, F.lit("0.0"))).otherwise(F.concat(sign, text))


def time_text(x: Column, kind: T.DataType) -> Column:
    """ISO text of a time, with microseconds where there are some; one with a zone is in UTC."""
    zoned = isinstance(kind, T.TimestampType)
    if zoned:  # by its distance from the epoch, as local times can be ambiguous
        seconds = (F.unix_micros(x).cast("decimal(24,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(18,6)")
        x = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    base = F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(x, "SSSSSS")
    return F.concat(base, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00" if zoned else ""))


def _scalar(x: Column, kind: T.DataType) -> tuple[str, Column] | None:
    """The name of a scalar's type and its JSON."""
    if isinstance(kind, T.StringType):
        return "str", json_string(x)
    if isinstance(kind, T.BooleanType):
        return "bool", x.cast("string")
    if isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0):
        return "int", x.cast("string")
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return "float", float_text(x)
    if isinstance(kind, T.BinaryType):
        return "bytes", F.concat(F.lit('"'), F.lower(F.hex(x)), F.lit('"'))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime", F.concat(F.lit('"'), time_text(x, kind), F.lit('"'))
    return None


def key(x: Column, kind: T.DataType, comma: str = ",") -> Column:
    """The typed key of a value, in which True, 1, 1.0 and "1" are four values.

    Its bytes are a fixed format, as ids are made from them.
    """
    none = F.lit(f'["NoneType"{comma}null]')
    if isinstance(kind, T.NullType):
        return none
    if one := _scalar(x, kind):
        name, value = one
        return F.when(x.isNull(), none).otherwise(F.concat(F.lit(f'["{name}"{comma}'), value, F.lit("]")))
    if isinstance(kind, T.ArrayType):
        inside = F.array_join(F.transform(x, lambda y: key(y, kind.elementType, comma)), comma)
        name = "list"
    elif isinstance(kind, T.StructType) and _is_tuple(kind):
        inside = F.concat_ws(comma, *[key(x[f.name], f.dataType, comma) for f in kind])
        name = "tuple"
    elif isinstance(kind, T.StructType):
        fields = sorted(kind, key=lambda f: json.dumps(["str", f.name]))
        named = lambda f: F.concat(F.lit(f"[{json.dumps(['str', f.name], ensure_ascii=False, separators=(comma, ':'))}{comma}"), key(x[f.name], f.dataType, comma), F.lit("]"))
        inside, name = F.concat_ws(comma, *[named(f) for f in fields]), "dict"
    elif isinstance(kind, T.MapType):
        # entries go by the text of their key with a space after each comma, and in ASCII
        entry = lambda e: F.struct(
            _ascii(key(e["key"], kind.keyType, ", ")).alias("by"), F.concat(F.lit("["), key(e["key"], kind.keyType, comma), F.lit(comma), key(e["value"], kind.valueType, comma), F.lit("]")).alias("pair")
        )
        inside, name = F.array_join(F.transform(F.array_sort(F.transform(F.map_entries(x), entry)), lambda e: e["pair"]), comma), "dict"
    else:
        raise TypeError(f"unsupported value type: {kind.simpleString()}")
    return F.when(x.isNull(), none).otherwise(F.concat(F.lit(f'["{name}"{comma}['), inside, F.lit("]]")))


# --- stored form -------------------------------------------------------------

#: Fixed value: the member that names the type of what JSON has no type for.
TAG = "__type__"


def stored(x: Column, kind: T.DataType, tag: str = TAG) -> Column:
    """The JSON of a value from which :func:`read` makes it again; finite numbers only, others are null."""
    mark = lambda name, *more: F.concat(F.lit(f'{{"{tag}":"{name}",'), *more, F.lit("}"))
    if isinstance(kind, T.BinaryType):
        value = mark("bytes", F.lit('"base64":"'), F.base64(x), F.lit('"'))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = mark("datetime", F.lit('"value":"'), time_text(x, kind), F.lit('"'))
    elif one := _scalar(x, kind):
        value = F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), one[1]) if one[0] == "float" else one[1]
    elif isinstance(kind, T.ArrayType):
        value = F.concat(F.lit("["), F.array_join(F.transform(x, lambda y: stored(y, kind.elementType, tag)), ","), F.lit("]"))
    elif isinstance(kind, T.StructType) and _is_tuple(kind):
        value = mark("tuple", F.lit('"items":['), F.concat_ws(",", *[stored(x[f.name], f.dataType, tag) for f in kind]), F.lit("]"))
    elif isinstance(kind, T.StructType):
        pairs = [F.concat(F.lit(f"[{json.dumps(f.name, ensure_ascii=False)},"), stored(x[f.name], f.dataType, tag), F.lit("]")) for f in kind]
        value = mark("mapping", F.lit('"items":['), F.concat_ws(",", *pairs), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pair = lambda e: F.concat(F.lit("["), stored(e["key"], kind.keyType, tag), F.lit(","), stored(e["value"], kind.valueType, tag), F.lit("]"))
        value = mark("mapping", F.lit('"items":['), F.array_join(F.transform(F.map_entries(x), pair), ","), F.lit("]"))
    else:
        raise TypeError(f"unsupported value type: {kind.simpleString()}")
    return F.when(x.isNull(), F.lit("null")).otherwise(F.coalesce(value, F.lit("null")))


def read(text: Column, kind: T.DataType, tag: str = TAG) -> Column:
    """The value of a stored JSON text; null where the text is no JSON or its tags are not those of the type."""
    return _read(F.try_parse_json(text), kind, tag)


def _read(v: Column, kind: T.DataType, tag: str) -> Column:
    there = ~F.coalesce(F.is_variant_null(v), F.lit(True))
    tagged = lambda name: there & (F.try_variant_get(v, f"$.{tag}", "string") == name)
    items = F.try_variant_get(v, "$.items", "array<variant>")
    if isinstance(kind, T.BinaryType):
        return F.when(tagged("bytes"), F.unbase64(F.try_variant_get(v, "$.base64", "string")))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.when(tagged("datetime"), F.try_variant_get(v, "$.value", "string").try_cast(kind))
    if isinstance(kind, T.ArrayType):
        return F.when(there, F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda y: _read(y, kind.elementType, tag)))
    if isinstance(kind, T.StructType) and _is_tuple(kind):
        return F.when(tagged("tuple") & (F.size(items) == len(kind)), F.struct(*[_read(F.get(items, F.lit(i)), f.dataType, tag).alias(f.name) for i, f in enumerate(kind)]))
    second = lambda p: F.try_variant_get(p, "$[1]", "variant")
    if isinstance(kind, T.StructType):
        of = lambda f: F.get(F.filter(items, lambda p: F.try_variant_get(p, "$[0]", "string") == f.name), F.lit(0))
        return F.when(tagged("mapping"), F.struct(*[_read(second(of(f)), f.dataType, tag).alias(f.name) for f in kind]))
    if isinstance(kind, T.MapType):
        first = lambda p: F.try_variant_get(p, "$[0]", "variant")
        return F.when(tagged("mapping"), F.map_from_entries(F.transform(items, lambda p: F.struct(_read(first(p), kind.keyType, tag).alias("key"), _read(second(p), kind.valueType, tag).alias("value")))))
    return F.when(there, F.try_variant_get(v, "$", kind.simpleString()))
