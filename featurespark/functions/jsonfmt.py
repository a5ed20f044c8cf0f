"""JSON-safe value forms of columns (the reference's ``_jsonable`` rules).

* date / time / timestamp -> ISO-8601 text, fraction only when non-zero; a timestamp
  with a time zone ends in its offset;
* decimal -> double;
* binary -> null;
* intervals -> text; nested values are serialised by ``to_json``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TS = "yyyy-MM-dd'T'HH:mm:ss"


def iso_text(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    # timestamp / timestamp_ntz: seconds, plus microseconds only when non-zero
    frac = F.unix_micros(c.cast("timestamp")) % F.lit(1_000_000)
    base = F.date_format(c, _TS)
    text = F.when(frac == 0, base).otherwise(F.concat(base, F.lit("."), F.date_format(c, "SSSSSS")))
    zone = F.date_format(c, "xxx") if isinstance(dt, T.TimestampType) else F.lit("")
    return F.when(c.isNotNull(), F.concat(text, zone))


def _time_text(c: Column) -> Column:
    """A time of day as ISO text: six digits of fraction or none."""
    text = c.cast("string")
    part = F.regexp_extract(text, r"\.(\d+)$", 1)
    return F.when(part == "", text).otherwise(F.concat(F.substring_index(text, ".", 1), F.lit("."), F.rpad(part, 6, "0")))


def json_value(c: Column, dt: T.DataType) -> Column:
    """Column expression holding the JSON-safe form of ``c``."""
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return iso_text(c, dt)
    if type(dt).__name__ == "TimeType":
        return _time_text(c)
    if isinstance(dt, T.DecimalType):
        return c.cast("double")
    if isinstance(dt, T.BinaryType):
        return F.lit(None).cast("string")
    if isinstance(dt, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return c.cast("string")
    return c


def json_struct(schema: T.StructType, fields: list[str]) -> Column:
    by_name = {f.name: f.dataType for f in schema.fields}
    return F.struct(*[json_value(F.col(f"`{n}`"), by_name[n]).alias(n) for n in fields])


def json_object(schema: T.StructType, fields: list[str]) -> Column:
    """One JSON object per row, NULL members kept (``ignoreNullFields=false``)."""
    if not fields:
        return F.lit("{}")
    return F.to_json(json_struct(schema, fields), {"ignoreNullFields": "false"})


def json_columns(schema: T.StructType, fields: list[str]) -> list[Column]:
    by_name = {f.name: f.dataType for f in schema.fields}
    return [json_value(F.col(f"`{n}`"), by_name[n]).alias(n) for n in fields]
