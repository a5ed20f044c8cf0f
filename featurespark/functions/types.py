"""Type names as the reference API spells them (its SQL engine's names)."""

from __future__ import annotations

from pyspark.sql import types as T


def type_name(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "BOOLEAN"
    if isinstance(dt, T.ByteType):
        return "TINYINT"
    if isinstance(dt, T.ShortType):
        return "SMALLINT"
    if isinstance(dt, T.IntegerType):
        return "INTEGER"
    if isinstance(dt, T.LongType):
        return "BIGINT"
    if isinstance(dt, T.FloatType):
        return "FLOAT"
    if isinstance(dt, T.DoubleType):
        return "DOUBLE"
    if isinstance(dt, T.DecimalType):
        return f"DECIMAL({dt.precision},{dt.scale})"
    if isinstance(dt, (T.StringType, T.CharType, T.VarcharType)):
        return "VARCHAR"
    if isinstance(dt, T.BinaryType):
        return "BLOB"
    if isinstance(dt, T.DateType):
        return "DATE"
    if isinstance(dt, T.TimestampNTZType):
        return "TIMESTAMP"
    if isinstance(dt, T.TimestampType):
        return "TIMESTAMP WITH TIME ZONE"
    if isinstance(dt, T.ArrayType):
        return f"{type_name(dt.elementType)}[]"
    if isinstance(dt, T.StructType):
        inner = ", ".join(f"{f.name} {type_name(f.dataType)}" for f in dt.fields)
        return f"STRUCT({inner})"
    if isinstance(dt, T.MapType):
        return f"MAP({type_name(dt.keyType)}, {type_name(dt.valueType)})"
    if isinstance(dt, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "INTERVAL"
    return dt.simpleString().upper()
