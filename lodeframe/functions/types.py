"""The engine's type names, their SQL spellings and their Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Engine type -> Spark type.
SPARK = {
    "bool": T.BooleanType(),
    "i8": T.ByteType(),
    "i16": T.ShortType(),
    "i32": T.IntegerType(),
    "i64": T.LongType(),
    "f32": T.FloatType(),
    "f64": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
}
_SQL = {
    "bool": "bool", "boolean": "bool", "tinyint": "i8", "smallint": "i16", "int2": "i16", "int": "i32", "integer": "i32", "int4": "i32", "bigint": "i64", "int8": "i64",
    "real": "f32", "float4": "f32", "float": "f64", "float8": "f64", "double": "f64", "double precision": "f64", "varchar": "string", "text": "string", "string": "string", "char": "string", "character varying": "string", "character": "string", "date": "date",
}
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType, T.DecimalType)


def spark_type(name: str, exact_decimals: bool = False) -> T.DataType:
    """Spark type of an engine or SQL type name. ``decimal(p, s)`` is double unless ``exact_decimals``;
    types outside the engine's closed set are an error."""
    low = " ".join(name.lower().split())
    if low in SPARK:
        return SPARK[low]
    if m := re.fullmatch(r"(?:decimal|numeric)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", low):
        return T.DecimalType(int(m[1] or 38), int(m[2] or 0)) if exact_decimals else T.DoubleType()
    low = re.sub(r"\s*\(\s*\d+\s*\)$", "", low)
    if low in _SQL:
        return SPARK[_SQL[low]]
    raise ValueError(f"type {name!r} is not supported")


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, INTEGRAL + FLOATING)


def arithmetic_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """Result type of + - *: two integers give BIGINT, a float or decimal operand gives DOUBLE."""
    if not is_numeric(a) or not is_numeric(b):
        raise TypeError(f"no arithmetic on {a.simpleString()} and {b.simpleString()}")
    return T.LongType() if isinstance(a, INTEGRAL) and isinstance(b, INTEGRAL) else T.DoubleType()
