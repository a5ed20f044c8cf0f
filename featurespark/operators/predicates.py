"""Structured predicates (B6, B7): built as Columns, never as SQL text.

``build_predicate(field_type, name, op, value)`` reproduces the map client's
query form: ``= != > < >= <= LIKE``; the value is compared as a number only
when the column is numeric and the text parses as a number, otherwise as text
(LIKE always compares text). Values are literals, so no quoting or escaping of
user text into SQL is needed at all.

``match_all`` keeps the features whose attributes all equal those of a
clicked feature (NULL-safe equality) — for many clicked features it is one
``left_semi`` equi-join on every attribute.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurespark.errors import LayerQueryError
from featurespark.operators.distinct import like_escape

# --- fixed values: operators of the client's query form ---
OPERATORS = ("=", "!=", ">", "<", ">=", "<=", "LIKE")
# -----------------------------------------------------------


_DECIMAL = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def _number(text: str):
    """The number that a text is, in decimal notation; None for any other text."""
    t = text.strip()
    if not _DECIMAL.fullmatch(t):
        return None
    return int(t) if t.lstrip("+-").isdigit() else float(t)


def build_predicate(dtype: T.DataType, name: str, op: str, value: str) -> Column:
    if op not in OPERATORS:
        raise LayerQueryError(f"unsupported operator: {op!r}")
    col = F.col("`" + name.replace("`", "``") + "`")
    if op == "LIKE":
        # the text is a pattern (``%``/``_`` wildcards); backslashes are literal
        return col.cast("string").like(like_escape(value))
    num = _number(value) if isinstance(dtype, T.NumericType) else None
    rhs = F.lit(num) if num is not None else F.lit(value)
    return {
        "=": col == rhs, "!=": col != rhs, ">": col > rhs,
        "<": col < rhs, ">=": col >= rhs, "<=": col <= rhs,
    }[op]


def predicate(df: DataFrame, name: str, op: str, value: str) -> DataFrame:
    if name not in df.columns:
        raise LayerQueryError(f"unknown field: {name!r}")
    return df.where(build_predicate(df.schema[name].dataType, name, op, value))


def match_feature(df: DataFrame, properties: dict) -> DataFrame:
    """B7 for one clicked feature: AND of NULL-safe equalities."""
    conds = [F.col(f"`{k}`").eqNullSafe(F.lit(v)) for k, v in properties.items()]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def match_all(df: DataFrame, clicked: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """B7 for a set of clicked features: ``left_semi`` on every attribute.

    NULL-safe keys are still equi-join keys, so Spark hashes / broadcasts as
    for any equi-join (the clicked side is de-duplicated first).
    """
    fields = fields or [c for c in clicked.columns if c in df.columns]
    keys = clicked.select(*[F.col(f"`{c}`") for c in fields]).distinct()
    cond = reduce(lambda a, b: a & b,
                  [df[f"`{c}`"].eqNullSafe(keys[f"`{c}`"]) for c in fields])
    return df.join(keys, cond, "left_semi")
