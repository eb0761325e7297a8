"""Column kinds and native type labels."""

from __future__ import annotations

from pyspark.sql import types as T

# The kinds a column can have.
INTEGER, FLOAT, BOOLEAN, DATE = "integer", "float", "boolean", "date"
TEXT, MIXED, OTHER, EMPTY = "text", "mixed", "other", "empty"

_KIND_BY_TYPE = [
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), INTEGER),
    ((T.FloatType, T.DoubleType, T.DecimalType), FLOAT),
    ((T.BooleanType,), BOOLEAN),
    ((T.DateType, T.TimestampType, T.TimestampNTZType, T.TimeType), DATE),
    ((T.StringType, T.CharType, T.VarcharType), TEXT),
    ((T.NullType,), EMPTY),
]


def kind_of(dtype: T.DataType) -> str:
    """The kind a declared type implies."""
    return next((kind for types, kind in _KIND_BY_TYPE if isinstance(dtype, types)), OTHER)


def is_numeric(dtype: T.DataType) -> bool:
    return kind_of(dtype) in (INTEGER, FLOAT)


def native_type(dtype: T.DataType) -> str:
    """Spark's own name of a type in upper case."""
    return dtype.simpleString().upper().strip()
