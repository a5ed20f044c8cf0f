"""Statistics of published layers: rows, extent and schema, written once at ingest and kept with the manifest.

A run writes a table for each of its layers with a row a file: where it is, how many rows it has, their extent. Their sums and the schema
are the layer's *facts* in the manifest, so describing, counting and bounding a published layer
reads neither a row nor a footer. A run's files never change, so the facts hold as long as the layer is published.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurespark.sources.manifest import literal_path

STATISTICS = "_statistics"
BOX = ("xmin", "ymin", "xmax", "ymax")


def file_statistics(df: DataFrame) -> DataFrame:
    """``(file, bytes, rows, xmin, ymin, xmax, ymax)`` of a stored layer's files; only the extent columns are read."""
    from featurespark.operators.spatial import extent_column

    box = extent_column(df.schema)
    if box:
        sides = [getattr(F, side[1:])(F.col(f"`{box}`")[side]).alias(side) for side in BOX]
    else:
        sides = [F.lit(None).cast("double").alias(side) for side in BOX]
    return df.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")) \
        .agg(F.count(F.lit(1)).alias("rows"), *sides)


def write_statistics(df: DataFrame, path: str) -> dict:
    """Write the table of a stored layer and return its facts."""
    file_statistics(df).write.mode("overwrite").parquet(path)
    table = df.sparkSession.read.parquet(literal_path(path))
    total = total_statistics(table).first()
    return {"rows": total["rows"], "files": total["files"], "schema": df.schema.jsonValue(),
            "extent": None if total["xmin"] is None else [total[side] for side in BOX]}


def total_statistics(table: DataFrame) -> DataFrame:
    """One row: ``(files, rows, xmin, ymin, xmax, ymax)``."""
    return table.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                     *[getattr(F, side[1:])(side).alias(side) for side in BOX])
