"""Declared schemas. Spark's DDL parser does the work."""

from __future__ import annotations

import re

from pyspark.sql import types as T

ALLOWED = (T.BooleanType, T.IntegerType, T.LongType, T.DoubleType, T.StringType)


def declare(ddl: str, key: str | None = None) -> T.StructType:
    """Schema from column text such as ``id bigint, tags array<varchar>``.

    VARCHAR without a length is a synonym of STRING. ``key`` marks the key
    column in the field's metadata.
    """
    schema = T.StructType.fromDDL(re.sub(r"\bvarchar\b", "string", ddl, flags=re.I))
    for field in schema:
        _check(field.dataType, field.name)
    if key is None:
        return schema
    if key not in schema.names:
        raise ValueError(f"key column {key!r} is not declared")
    return T.StructType([
        T.StructField(f.name, f.dataType, True, {"key": True} if f.name == key else {})
        for f in schema])


def key_columns(schema: T.StructType) -> list[str]:
    return [field.name for field in schema if field.metadata.get("key")]


def _check(kind: T.DataType, name: str) -> None:
    if isinstance(kind, T.ArrayType):
        _check(kind.elementType, name)
    elif isinstance(kind, T.MapType):
        _check(kind.keyType, name)
        _check(kind.valueType, name)
    elif isinstance(kind, T.StructType):
        for field in kind:
            _check(field.dataType, f"{name}.{field.name}")
    elif not isinstance(kind, ALLOWED):
        raise ValueError(f"column {name}: type {kind.simpleString()} is not part of the data model")
