"""``unique-values``: sorted distinct values of one field.

Plan: prune to the field -> drop NULLs -> optional LIKE search -> distinct ->
``TakeOrderedAndProject(limit)``. Spark's partial aggregate de-duplicates on
the map side, so a task shuffles its distinct values only, and the top-k keeps
at most ``limit`` rows of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurespark import params


def like_escape(text: str) -> str:
    """Double backslashes so they are literal under Spark's default ``\\`` escape.

    ``%`` and ``_`` stay wildcards (the contract does not escape them).
    """
    return text.replace("\\", "\\\\")


def search_pattern(search) -> str | None:
    if search is None or not str(search).strip():
        return None
    return f"%{like_escape(str(search).strip().lower())}%"


def search_condition(col: Column, search) -> Column | None:
    """``lower(CAST(col AS STRING)) LIKE '%term%'``."""
    pat = search_pattern(search)
    if pat is None:
        return None
    return F.lower(col.cast("string")).like(pat)


def distinct_values(df: DataFrame, field: str, search=None, limit: int = params.DEFAULT_VALUES) -> DataFrame:
    """``DataFrame(value)``: the ``limit`` smallest non-null distinct values."""
    q = df.select(F.col("`" + field.replace("`", "``") + "`").alias("value")).where(F.col("value").isNotNull())
    cond = search_condition(F.col("value"), search)
    if cond is not None:
        q = q.where(cond)
    return q.distinct().orderBy(F.col("value").asc_nulls_last()).limit(limit)


def with_rank(values: DataFrame) -> DataFrame:
    """Add the 1-based ``pos`` of each value (<= 200 rows, one task)."""
    return values.withColumn("pos", F.monotonically_increasing_id() + F.lit(1))


def truncated_flag(values: DataFrame, limit: int) -> DataFrame:
    """One row ``(n_values, truncated)``; true when ``n_values >= limit``."""
    return values.agg(F.count(F.lit(1)).alias("n_values")) \
                 .withColumn("truncated", F.col("n_values") >= F.lit(limit))


def _requested(layers, layer, field, search, limit):
    """The request's values, settled against the layer."""
    layers.validate(layer)
    wanted = params.read(params.VALUES, {"field": field, "search": search, "limit": limit})
    params.Columns(layers.schema(layer)).attribute(wanted.field)
    return wanted


def unique_values(layers, layer, field, search=None, limit=None) -> dict:
    """The whole ``unique-values`` response: ``{layer, field, values, truncated}``."""
    w = _requested(layers, layer, field, search, limit)
    vals = [r["value"] for r in distinct_values(layers.read(layer), w.field, w.search, w.limit).collect()]
    return {"layer": layer, "field": w.field, "values": vals, "truncated": len(vals) >= w.limit}


def unique_values_df(layers, layer, field, search=None, limit=None) -> DataFrame:
    w = _requested(layers, layer, field, search, limit)
    return with_rank(distinct_values(layers.read(layer), w.field, w.search, w.limit))


def suggest(layers, layer, field, text=None, limit=params.DEFAULT_VALUES) -> DataFrame:
    """Suggestions as text, in value order."""
    vals = unique_values_df(layers, layer, field, text, limit)
    return vals.select(F.col("value").cast("string").alias("suggestion"), "pos")
