"""Semi-structured JSON: payloads in which lists of one collapse to their element and text is wrapped in ``{"$": ...}``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def one_or_many(v: Column) -> Column:
    """Null to an empty list, a list to itself, anything else to a list of it."""
    empty = F.array().cast("array<variant>")
    return F.when(v.isNull() | F.is_variant_null(v), empty).when(_kind(v).startswith("ARRAY"), v.try_cast("array<variant>")).otherwise(F.array(v))


def is_object(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))


def text_of(v: Column) -> Column:
    """A plain value, or what an object has under ``$``; null for other objects and lists."""
    return F.when(is_object(v), F.try_variant_get(v, "$['$']", "string")).when(_kind(v).startswith("ARRAY"), None).otherwise(F.try_variant_get(v, "$", "string"))


def at(v: Column, *path: str) -> Column:
    """The value under a path of keys, as a variant."""
    return F.try_variant_get(v, "$" + "".join(f"['{k}']" for k in path), "variant")


def string_at(v: Column, *path: str) -> Column:
    return F.try_variant_get(v, "$" + "".join(f"['{k}']" for k in path), "string")


def first_of(v: Column) -> Column:
    """A stray list's first element; the value itself if it is no list."""
    return F.when(_kind(v).startswith("ARRAY"), F.try_element_at(v.try_cast("array<variant>"), F.lit(1))).otherwise(v)


def to_bool(v: Column) -> Column:
    """Booleans, numbers (not zero) and words for yes and no; anything else is null."""
    one = first_of(v)
    kind, text = _kind(one), F.lower(F.regexp_replace(F.try_variant_get(one, "$", "string"), r"(?U)^\s+|\s+$", ""))
    word = F.when(text.isin("true", "yes", "1", "y"), True).when(text.isin("false", "no", "0", "n"), False)
    return F.when(kind == "BOOLEAN", F.try_variant_get(one, "$", "boolean")).when(kind == "STRING", word).when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), None).otherwise(F.try_variant_get(one, "$", "double") != 0)


def to_int(v: Column) -> Column:
    """Numbers and numeric strings, cut to whole ones; booleans are no numbers."""
    one = first_of(v)
    return F.when(_kind(one) == "BOOLEAN", None).otherwise(F.try_variant_get(one, "$", "string").try_cast("double").try_cast("bigint"))


def to_string(v: Column) -> Column:
    one = first_of(v)
    return F.when(F.is_variant_null(one), None).otherwise(F.try_variant_get(one, "$", "string"))


def to_strings(v: Column) -> Column:
    return F.transform(F.filter(one_or_many(v), lambda x: ~F.is_variant_null(x)), lambda x: F.try_variant_get(x, "$", "string"))


COERCE = {"boolean": to_bool, "integer": to_int, "string": to_string, "array": to_strings}


def coerced(v: Column, schema: dict[str, str]) -> list[Column]:
    """A column for each field of the schema; other fields of the object are dropped."""
    return [COERCE[kind](at(v, name)).alias(name) for name, kind in schema.items()]


def salvaged(raw: Column) -> Column:
    """JSON from a model's answer: the whole of it, else from the first brace to the last; null if neither parses."""
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0)))


def kinds_of(declared: dict) -> dict[str, str]:
    """Field kinds from a JSON schema's properties; of a set of types the one that is not null."""
    out = {}
    for name, spec in declared["properties"].items():
        kinds = spec["type"] if isinstance(spec["type"], list) else [spec["type"]]
        out[name] = next((k for k in kinds if k != "null"), "string")
    return out
