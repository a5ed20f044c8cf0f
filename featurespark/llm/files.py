"""Binary files through Spark's own writers and readers, so any store that Spark reaches will do.

A file's bytes travel as one row. The text writer copies a string's bytes as
they are and ends each row with ``end``; a row a file keeps files apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(df: DataFrame, content_col: str, path: str, end: bytes = b"\n") -> None:
    """Every row's bytes as a file of its own under ``path``, with ``end`` after them."""
    df.select(F.col(content_col).cast("string").alias("value")).write \
        .option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")) \
        .text(path)


def read_files(spark, path: str) -> DataFrame:
    """``(path, content)`` of every file under ``path``; empty files, which empty tasks may leave, are passed over."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path) \
        .filter("length > 0").select("path", "content")
