"""Strict JSON: duplicate keys, NaN and Infinity are rejected, and value types are told apart."""

from pyspark.sql import functions as F


def strict(text):
    """VARIANT of strict JSON text; NULL for malformed text, duplicate keys, NaN or Infinity."""
    return F.try_parse_json(text)


def at(value, path, kind="variant"):
    """The value at a JSON path, or NULL when the path or the type does not fit."""
    return F.try_variant_get(value, path, kind)


_SCHEMA = {"OBJECT": "OBJECT<.*", "ARRAY": "ARRAY<.*", "STRING": "STRING", "BOOLEAN": "BOOLEAN",
           "INTEGER": "BIGINT", "NUMBER": "(DOUBLE|FLOAT|DECIMAL).*", "NULL": "VOID"}


def is_schema(schema, *kinds):
    """Whether the text of ``schema_of_variant`` names one of the given JSON types."""
    return F.coalesce(schema.rlike("(?s)^(" + "|".join(_SCHEMA[k] for k in kinds) + ")$"), F.lit(False))


def is_type(value, *kinds):
    """Whether a present value is an OBJECT, ARRAY, STRING, INTEGER, NUMBER (with a fraction or an
    exponent), BOOLEAN or NULL; a missing value has no type."""
    return is_schema(F.schema_of_variant(value), *kinds)


def keys(value):
    """Key names of a JSON object held as VARIANT; NULL for other values."""
    return F.map_keys(at(value, "$", "map<string,variant>"))


def only_keys(value, allowed):
    """Whether a value is a JSON object that holds no key outside ``allowed``."""
    extra = F.array_except(keys(value), F.array(*[F.lit(name) for name in allowed]))
    return F.coalesce(F.size(extra) == 0, F.lit(False))


def elements(value, path="$"):
    """A JSON array as array<variant>; NULL when it is not an array."""
    return at(value, path, "array<variant>")


def element_schemas(text):
    """Type text of each element of a JSON array given as text; NULL when it is not an array."""
    return F.transform(elements(strict(text)), F.schema_of_variant)
