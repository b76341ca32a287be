"""Declared types and their Spark counterparts."""

from __future__ import annotations

import re

from .errors import ParseError

_SPELLINGS = {
    "tinyint": ("i8",),
    "smallint": ("i16",),
    "int": ("i32", "int", "integer"),
    "bigint": ("i64", "long", "bigint"),
    "float": ("f32", "float"),
    "double": ("f64", "double"),
    "boolean": ("bool", "boolean"),
    "string": ("string", "text", "varchar"),
    "date": ("date",),
    "timestamp_ntz": ("timestamp", "datetime"),
}
_BY_NAME = {name: spark for spark, names in _SPELLINGS.items() for name in names}
_DECIMAL = re.compile(r"decimal\(\s*(\d+)\s*,\s*(\d+)\s*\)")

INTEGERS = frozenset({"tinyint", "smallint", "int", "bigint"})
FLOATS = frozenset({"float", "double"})
TEMPORAL = frozenset({"date", "timestamp_ntz"})


def parse_type(text: str) -> str:
    """Spark's name for a declared type, whatever the case it is written in."""
    name = str(text).strip().lower()
    if name in _BY_NAME:
        return _BY_NAME[name]
    if m := _DECIMAL.fullmatch(name):
        precision, scale = int(m[1]), int(m[2])
        if not 1 <= precision <= 38:
            raise ParseError(f"decimal precision {precision} is not within 1 to 38")
        if scale > precision:
            raise ParseError(f"decimal scale {scale} exceeds precision {precision}")
        return f"decimal({precision},{scale})"
    raise ParseError(f"unknown type {text!r}")


def is_numeric(spark: str) -> bool:
    return spark in INTEGERS or spark in FLOATS or spark.startswith("decimal")
