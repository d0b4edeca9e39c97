"""Declared column types, their Spark types, and which of them may be joined."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from .errors import InvalidModel

# The accepted spellings of each type.
_NAMES = {
    "bool boolean": T.BooleanType(),
    "int8 tinyint": T.ByteType(),
    "int16 smallint": T.ShortType(),
    "int32 int integer": T.IntegerType(),
    "int64 bigint": T.LongType(),
    "float32 float real": T.FloatType(),
    "float64 double": T.DoubleType(),
    "string text ntext": T.StringType(),
    "date": T.DateType(),
    "time": T.StringType(),
    "timestamp datetime": T.TimestampNTZType(),
    "timestamptz datetimeoffset": T.TimestampType(),
    "binary blob varbinary": T.BinaryType(),
    "json jsonb": T.StringType(),
    "uuid uniqueidentifier": T.StringType(),
}
SPARK_TYPES = {name: kind for names, kind in _NAMES.items() for name in names.split()}


def parse_type(text: str) -> T.DataType:
    """The Spark type of a declared type; lengths of char types are dropped, as DataFrames have none."""
    name = text.strip().lower()
    if name in SPARK_TYPES:
        return SPARK_TYPES[name]
    if m := re.fullmatch(r"(?:decimal|numeric)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", name):
        return T.DecimalType(int(m[1]), int(m[2] or 0))
    if re.fullmatch(r"n?(?:var)?char\s*(?:\(\s*(?:\d+|max)\s*\))?", name):
        return T.StringType()
    raise InvalidModel(f"unknown type: {text}")


def family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return kind.typeName()


def joinable(a: T.DataType, b: T.DataType) -> bool:
    return family(a) == family(b)
