"""Connected components of an edge table, as iterated joins (large star / small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurespark.llm.shared import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
                    F.bit_xor(F.xxhash64("v", "u")).alias("y")).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is the component's smallest node.

    Each round links every node to the smallest node known in its neighbourhood,
    first seen from the larger and then from the smaller side; rounds needed
    grow with the logarithm of a component's diameter. Every round is written to
    the shared folder, so a lost executor costs no more than one round. Only
    counts reach the driver. Loops and null ends are ignored.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")) \
        .filter("u <> v").distinct()
    e = materialize(e, "edges")
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.*") \
            .filter("u <> v").distinct()
        e = materialize(small, "edges")
        now = _state(e)
        if now == before:
            break
        before = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")) \
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
