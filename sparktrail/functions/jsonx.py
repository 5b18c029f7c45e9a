"""JSON access that keeps the raw text and knows value types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(line: Column) -> Column:
    """The line as VARIANT; NULL when it is not valid JSON."""
    return F.try_parse_json(line)


def starts_object(line: Column) -> Column:
    return line.rlike(r"^[ \t\r\n]*\{")


def fields(line: Column, typed: tuple[str, ...] = (), raw: tuple[str, ...] = ()) -> Column:
    """Top-level members of a JSON object in one parse.

    ``typed`` members come as VARIANT: an explicit null is a value, an absent
    member is NULL. ``raw`` members come as their text with key order kept (a
    string unquoted). ``_corrupt`` is set when the text is not an object.
    """
    schema = ", ".join([*(f"`{n}` VARIANT" for n in typed), *(f"`{n}` STRING" for n in raw), "_corrupt STRING"])
    return F.from_json(line, schema, {"columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"})


def is_object(line: Column, parsed_fields: str) -> Column:
    """Whether the line as a whole is one JSON object, given its ``fields``."""
    whole = line.rlike(r"^[ \t\r\n]*\{") & F.endswith(F.rtrim(line), F.lit("}"))
    return F.coalesce(whole & F.col(f"{parsed_fields}._corrupt").isNull(), F.lit(False))


def kind(variant: Column) -> Column:
    """'string', 'number', 'null', 'object', 'array', 'boolean'; NULL when absent."""
    schema = F.schema_of_variant(variant)
    return (
        F.when(schema == "STRING", "string")
        .when(schema == "VOID", "null")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.isNotNull(), "number")
    )


def text(variant: Column) -> Column:
    """The value when it is a string, else NULL."""
    return F.when(F.schema_of_variant(variant) == "STRING", F.try_variant_get(variant, "$", "string"))


def scalar(variant: Column) -> Column:
    """A string or number as text, else NULL."""
    return F.when(kind(variant).isin("string", "number"), F.try_variant_get(variant, "$", "string"))


def number(variant: Column) -> Column:
    return F.when(kind(variant) == "number", F.try_variant_get(variant, "$", "bigint"))


def boolean(variant: Column) -> Column:
    return F.when(kind(variant) == "boolean", F.try_variant_get(variant, "$", "boolean"))


def at(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, path, "variant")


def kind_of(variant: Column, path: str) -> Column:
    return kind(at(variant, path))


def string_at(variant: Column, path: str) -> Column:
    """The value at ``path`` when it is a string, else NULL."""
    return F.when(F.schema_of_variant(at(variant, path)) == "STRING", F.try_variant_get(variant, path, "string"))


def raw_at(line: Column, path: str) -> Column:
    """The text of the value at ``path``, key order kept."""
    return F.get_json_object(line, path)
