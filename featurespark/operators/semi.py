"""Cross-layer anti filter as an explicit join.

``IN (SELECT ...)`` / ``EXISTS`` in a predicate become ``left_semi`` joins by
themselves; ``NOT EXISTS`` is a ``left_anti`` join here. Spark picks broadcast or
sort-merge by the size of the right side (AQE re-plans at runtime), so nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def _cond(left: DataFrame, right: DataFrame, on):
    pairs = [(k, k) if isinstance(k, str) else k for k in on]
    return reduce(lambda a, b: a & b, [left[f"`{a}`"] == right[f"`{b}`"] for a, b in pairs])


def anti_filter(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of ``left`` with no match in ``right``."""
    return left.join(right, _cond(left, right, on), "left_anti")
