"""Attribute table of features (one ``field``/``value`` row per attribute)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attribute_table(df: DataFrame, ids: list[str], fields: list[str] | None = None) -> DataFrame:
    """``(ids..., field, value)`` for every attribute (ids included), values as text.

    One generator over an inline array of (name, text) structs: a narrow
    transformation, no shuffle.
    """
    fields = fields or list(df.columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value"))
                      for c in fields])
    return df.select(*[F.col(f"`{c}`") for c in ids], F.inline(pairs))
