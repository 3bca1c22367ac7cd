"""Canonical names of column types, and the Spark types they stand for.

A StructField may carry the name it came with in its metadata under `arrow_type`; that keeps what Spark lacks
(unsigned numbers, time units, fixed sizes).
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

from driftline.errors import UnsupportedDataType

KEEP = "arrow_type"
#: The plain names and what Spark reads them as.
PLAIN = {
    "Boolean": T.BooleanType(), "Int8": T.ByteType(), "Int16": T.ShortType(), "Int32": T.IntegerType(), "Int64": T.LongType(),
    "UInt8": T.ShortType(), "UInt16": T.IntegerType(), "UInt32": T.LongType(), "UInt64": T.DecimalType(20, 0),
    "Float32": T.FloatType(), "Float64": T.DoubleType(), "Utf8": T.StringType(), "LargeUtf8": T.StringType(),
    "Binary": T.BinaryType(), "LargeBinary": T.BinaryType(), "Date32": T.DateType(), "Date64": T.DateType(),
}
UNITS = ("Second", "Millisecond", "Microsecond", "Nanosecond")
#: The types whose columns have numeric statistics. Decimals aren't among them.
NUMERIC = frozenset({"Int8", "Int16", "Int32", "Int64", "UInt8", "UInt16", "UInt32", "UInt64", "Float32", "Float64"})
#: The types that give drift samples.
SAMPLED = frozenset({"Int16", "Int32", "Int64", "Float32", "Float64"})

_OWN = {"boolean": "Boolean", "tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "binary": "Binary", "date": "Date32", "timestamp_ntz": "Timestamp(Microsecond, None)", "timestamp": 'Timestamp(Microsecond, Some("UTC"))'}


def type_name(field: T.StructField) -> str:
    """The canonical name of a field's type; for a type without one, a form for display only."""
    kept = (field.metadata or {}).get(KEEP)
    kind = field.dataType
    if kept:
        return kept
    if isinstance(kind, T.StringType):
        return "Utf8"
    if isinstance(kind, T.DecimalType):
        return f"Decimal128({kind.precision}, {kind.scale})"
    if kind.simpleString().startswith("time("):
        return "Time64(Microsecond)"
    return _OWN.get(kind.simpleString(), kind.simpleString())


def parse_type(name: str) -> T.DataType:
    """The Spark type of a canonical name, or UnsupportedDataType."""
    if name in PLAIN:
        return PLAIN[name]
    if re.fullmatch(r"FixedSizeBinary\([+-]?\d+\)", name):
        return T.BinaryType()
    if m := re.fullmatch(r"Time(?:32|64)\((\w+)\)", name):
        if m[1] in UNITS:
            return T.LongType()
    elif m := re.fullmatch(r"Decimal(128|256)\((\d{1,3}), (-?\d{1,3})\)", name):
        precision, scale = int(m[2]), int(m[3])
        return T.DecimalType(precision, scale) if 0 <= scale <= precision <= 38 else T.StringType()
    elif m := re.fullmatch(r'Timestamp\((\w+), (?:(None)|Some\("(.*)"\))\)', name, re.DOTALL):
        if m[1] in UNITS:
            return T.TimestampNTZType() if m[2] else T.TimestampType()
    raise UnsupportedDataType(name)


def field_of(name: str, type_text: str, nullable: bool = True, metadata: dict | None = None) -> T.StructField:
    """A StructField of a canonical type; the name is kept in the metadata where Spark's own type doesn't imply it."""
    out = T.StructField(name, parse_type(type_text), nullable, dict(metadata or {}))
    if type_name(out) != type_text:
        out.metadata[KEEP] = type_text
    return out


def own_metadata(field: T.StructField) -> dict:
    """A field's metadata without what this module keeps there."""
    return {k: v for k, v in (field.metadata or {}).items() if k != KEEP}


def is_numeric(field: T.StructField) -> bool:
    return type_name(field) in NUMERIC


def is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType)


#: PostgreSQL type names and their canonical types.
_POSTGRES = {
    "boolean": "Boolean", "bool": "Boolean", "smallint": "Int16", "int2": "Int16", "smallserial": "Int16", "integer": "Int32", "int": "Int32", "int4": "Int32", "serial": "Int32",
    "bigint": "Int64", "int8": "Int64", "bigserial": "Int64", "real": "Float32", "float4": "Float32", "double precision": "Float64", "float8": "Float64", "bytea": "Binary", "date": "Date32",
    "timestamp without time zone": "Timestamp(Nanosecond, None)", "timestamp": "Timestamp(Nanosecond, None)", "timestamp with time zone": 'Timestamp(Nanosecond, Some("+00:00"))', "timestamptz": 'Timestamp(Nanosecond, Some("+00:00"))',
}


def postgres_type(name: str, precision: int | None = None, scale: int | None = None) -> str:
    """The canonical type of a PostgreSQL column."""
    if name in ("numeric", "decimal"):
        return f"Decimal128({precision}, {scale})" if precision is not None and scale is not None and 1 <= precision <= 38 and 0 <= scale <= 38 else "Float64"
    return _POSTGRES.get(name, "Utf8")
