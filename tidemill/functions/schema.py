"""Payload schemas, and what a payload must be like to fit one.

A schema is checked in two ways that agree: ``fits`` looks at a Python value, ``fits_column`` is the
same test as a Column over JSON text, so whole batches are validated without leaving the JVM.
Nothing is coerced (``"5"`` is no number, ``1.5`` no integer); properties that a schema doesn't
name are let through and kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Schema:
    """Any payload schema."""


@dataclass(frozen=True)
class Scalar(Schema):
    kind: str


STRING, NUMBER, INTEGER, BOOLEAN, NULL = (Scalar(k) for k in ("string", "number", "integer", "boolean", "null"))


@dataclass(frozen=True)
class Literal(Schema):
    value: str | bool | int | float


@dataclass(frozen=True)
class Array(Schema):
    items: Schema


@dataclass(frozen=True)
class Union(Schema):
    options: tuple[Schema, ...]


@dataclass(frozen=True)
class Optional(Schema):
    """A property that may be left out."""

    schema: Schema


@dataclass(frozen=True)
class Object(Schema):
    fields: tuple[tuple[str, Schema], ...]


def obj(**fields: Schema) -> Object:
    return Object(tuple(fields.items()))


def union(*options: Schema) -> Union:
    return Union(options)


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def fits(schema: Schema, value: Any) -> bool:
    match schema:
        case Scalar("string"):
            return isinstance(value, str)
        case Scalar("number"):
            return _is_number(value)
        case Scalar("integer"):
            return isinstance(value, int) and not isinstance(value, bool)
        case Scalar("boolean"):
            return isinstance(value, bool)
        case Scalar("null"):
            return value is None
        case Literal(want):
            return value == want and isinstance(value, bool) == isinstance(want, bool)
        case Array(items):
            return isinstance(value, list) and all(fits(items, x) for x in value)
        case Union(options):
            return any(fits(x, value) for x in options)
        case Object(fields):
            return isinstance(value, dict) and all(
                fits(s.schema if isinstance(s, Optional) else s, value[k]) if k in value else isinstance(s, Optional)
                for k, s in fields
            )
    raise TypeError(f"not a schema: {schema!r}")


_KINDS = {
    "string": "^STRING$",
    "number": "^(BIGINT|FLOAT|DOUBLE|DECIMAL.*)$",
    "integer": "^BIGINT$",
    "boolean": "^BOOLEAN$",
    "null": "^VOID$",
}


def _has_kind(v: Column, pattern: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(pattern), F.lit(False))


def fits_variant(schema: Schema, v: Column) -> Column:
    """Never null: a missing value (SQL null) fits nothing."""
    match schema:
        case Scalar(kind):
            return _has_kind(v, _KINDS[kind])
        case Literal(want):
            kind, sql = (
                ("boolean", "boolean") if isinstance(want, bool) else ("string", "string") if isinstance(want, str) else ("number", "double")
            )
            return _has_kind(v, _KINDS[kind]) & F.coalesce(F.try_variant_get(v, "$", sql) == F.lit(want), F.lit(False))
        case Array(items):
            inside = F.forall(F.try_variant_get(v, "$", "array<variant>"), lambda x: fits_variant(items, x))
            return _has_kind(v, "^ARRAY") & F.coalesce(inside, F.lit(False))
        case Union(options):
            out = F.lit(False)
            for x in options:
                out = out | fits_variant(x, v)
            return out
        case Object(fields):
            out = _has_kind(v, "^OBJECT")
            for name, s in fields:
                part = F.try_variant_get(v, f"$['{name}']", "variant")
                out = out & ((part.isNull() | fits_variant(s.schema, part)) if isinstance(s, Optional) else fits_variant(s, part))
            return out
    raise TypeError(f"not a schema: {schema!r}")


def fits_column(schema: Schema, payload_json: Column) -> Column:
    return fits_variant(schema, F.try_parse_json(payload_json))
