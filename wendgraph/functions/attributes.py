"""Attributes of JSON payloads: existence, JSON type and typed reads. Missing keys, JSON nulls, values that don't fit and
malformed documents give SQL NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SQL_TYPES = {"string": "string", "str": "string", "int": "bigint", "int64": "bigint", "bigint": "bigint", "double": "double", "float": "double", "float64": "double", "bool": "boolean", "boolean": "boolean"}
JSON_TYPES = ("string", "int", "double", "bool", "object", "array", "null")


def path(key: str) -> str:
    """A root key as a JSON path, whatever characters it has."""
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def text(payload: Column, key: str) -> Column:
    """The value as text: what string comparison and projection see."""
    return F.get_json_object(payload, path(key))


def variant(payload: Column) -> Column:
    """The payload parsed once, for several reads."""
    return F.try_parse_json(payload)


def typed(parsed: Column, key: str, kind: str) -> Column:
    """A typed read of a parsed payload; kind as in SQL_TYPES."""
    return F.try_variant_get(parsed, path(key), SQL_TYPES[kind])


def json_type(parsed: Column, key: str) -> Column:
    """The JSON type of a key, one of JSON_TYPES; NULL if it is missing."""
    name = F.schema_of_variant(F.try_variant_get(parsed, path(key), "variant"))
    return (
        F.when(name == "STRING", "string").when(name == "BIGINT", "int").when(name == "BOOLEAN", "bool").when(name == "VOID", "null")
        .when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name.isNotNull(), "double")
    )


def has(payload: Column, key: str) -> Column:
    """Whether the key is there and not JSON null."""
    return F.coalesce(F.get_json_object(payload, path(key)), F.lit(None)).isNotNull()


def view(parsed: Column, key: str) -> Column:
    """The value if it is a string, else the empty string."""
    return F.when(json_type(parsed, key) == "string", typed(parsed, key, "string")).otherwise(F.lit(""))


def same_type(kind: str, wanted: str) -> bool:
    return kind == {"str": "string", "int64": "int", "bigint": "int", "float": "double", "float64": "double", "boolean": "bool"}.get(wanted, wanted)
