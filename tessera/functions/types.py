"""The field types and the Spark types that hold them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import InvalidSchema

#: Field type to Spark type. Unsigned types widen to hold their range; texts stand for what Spark has no type for.
SPARK_TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(),
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "f32": T.FloatType(), "f64": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(), "uuid": T.StringType(),
    "decimal": T.DecimalType(38, 18), "bigdecimal": T.StringType(),
    "timestamp": T.TimestampType(), "zoned": T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("tz", T.StringType())]),
    "date": T.DateType(), "time": T.TimeType(), "datetime": T.TimestampNTZType(),
    "cidr": T.StringType(), "inet": T.StringType(), "macaddr": T.StringType(), "macaddr8": T.StringType(),
    "json": T.StringType(), "jsonb": T.StringType(),
}

#: Ranges of the unsigned types.
UNSIGNED = {"u8": (1 << 8) - 1, "u16": (1 << 16) - 1, "u32": (1 << 32) - 1, "u64": (1 << 64) - 1}


def spark_type(kind: str | T.DataType) -> T.DataType:
    """``list<x>`` is an array; ``decimal(p,s)`` takes its precision; ``varchar(n)`` and ``binary(n)`` their base type."""
    if isinstance(kind, T.DataType):
        return kind
    kind = kind.strip()
    if kind.startswith("list<") and kind.endswith(">"):
        return T.ArrayType(spark_type(kind[5:-1]))
    name, _, rest = kind.partition("(")
    if rest and name in ("decimal", "numeric"):
        p, s = (int(x) for x in rest.rstrip(")").split(","))
        return T.DecimalType(p, s)
    name = {"varchar": "string", "text": "string", "binary": "bytes", "blob": "bytes", "boolean": "bool", "numeric": "decimal"}.get(name, name)
    if name not in SPARK_TYPES:
        raise InvalidSchema(f"unknown type {kind!r}")
    return SPARK_TYPES[name]


def in_range(kind: str | T.DataType, c: Column) -> Column | None:
    """The condition that a stored value must meet beyond its Spark type's, if any."""
    if isinstance(kind, str) and kind in UNSIGNED:
        return c.between(F.lit(0), F.lit(str(UNSIGNED[kind])).cast("decimal(20,0)"))
    if isinstance(kind, str) and kind.startswith("varchar("):
        return F.length(c) <= int(kind[8:-1])
    if isinstance(kind, str) and kind.startswith("binary("):
        return F.octet_length(c) <= int(kind[7:-1])
    return None


def cast(c: Column, kind: str | T.DataType) -> Column:
    """Checked: a value that doesn't fit is an error (ANSI casts), and unsigned types keep their range."""
    out = c.cast(spark_type(kind))
    ok = in_range(kind, out)
    return out if ok is None else F.when(out.isNull() | ok, out).otherwise(F.raise_error(F.concat(F.lit(f"value out of range for {kind}: "), out.cast("string"))).cast(spark_type(kind)))


def canonical_uuid(c: Column) -> Column:
    """Lower case with hyphens; text order is then byte order."""
    plain = F.lower(F.regexp_replace(c, "-", ""))
    return F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def uuid_to_bytes(c: Column) -> Column:
    return F.unhex(F.regexp_replace(c, "-", ""))


def bytes_to_uuid(c: Column) -> Column:
    return canonical_uuid(F.hex(c))
