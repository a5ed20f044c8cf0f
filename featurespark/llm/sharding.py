"""Shards of near-equal bytes through sampled splitters.

The key of a record is the hash of its text and then a hash of its id, so equal
texts stand together and a large group of them can still be cut. Keys are
sampled with a chance in proportion to the record's size; quantiles of the
sample bound the ranges. The ranges are measured; one that is overfull gets
splitters from a sample of its own until none is overfull or it can't be cut.
With exact totals of the ranges, a running sum inside each range places every
record: shard ``k`` holds the records whose middle byte falls into the k-th
part of all bytes.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurespark.llm.shared import brought_back, materialize, set_aside

RANGE_BYTES = 256 << 20     # intended bytes of a range, for large inputs
PER_RANGE = 32              # expected samples for each range
OVERFULL = 2.0              # times the intended bytes


Key = tuple[int, int]        # the sort key of a record and the hash that orders records of one key


def _sample(rows: DataFrame, rate: float, round_: int) -> list[tuple[Key, float]]:
    """Sorted keys drawn with a chance of size times ``rate``, and their weights; the caller bounds the expected number."""
    chance = F.pmod(F.xxhash64("_key", "_tie", F.lit(round_)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = rows.filter(chance < F.col("_size") * F.lit(rate)) \
        .select("_key", "_tie", F.greatest(F.col("_size") * F.lit(rate), F.lit(1.0)).alias("w")).collect()
    return sorted(((r[0], r[1]), r[2]) for r in got)


def _quantiles(sample: list[tuple[Key, float]], parts: int) -> list[Key]:
    if not sample or parts < 2:
        return []
    upto = np.cumsum([w for _, w in sample])
    return sorted({sample[i][0] for i in np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)})


def _in_ranges(rows: DataFrame, splitters: list[Key]) -> DataFrame:
    """Adds ``_range``: the number of splitters up to the record's key, by a search of two levels."""
    if not splitters:
        return rows.withColumn("_range", F.lit(0))
    wide = max(1, int(len(splitters) ** 0.5))
    groups = [splitters[i:i + wide] for i in range(0, len(splitters), wide)]

    def pairs(some):
        return F.arrays_zip(F.lit([k for k, _ in some]).alias("k"), F.lit([t for _, t in some]).alias("t"))

    def upto(list_):
        return F.size(F.filter(list_, lambda s: (s["k"] < F.col("_key")) | (s["k"] == F.col("_key")) & (s["t"] <= F.col("_tie"))))

    row = upto(pairs([g[0] for g in groups])) - 1
    inner = F.get(F.transform(F.array(F.get(F.array(*[pairs(g) for g in groups]), F.col("_row"))), upto), 0)
    return rows.withColumn("_row", row).withColumn(
        "_range", F.when(F.col("_row") < 0, 0).otherwise(F.col("_row") * wide + inner).cast("int")).drop("_row")


def _totals(rows: DataFrame, splitters: list[Key]) -> np.ndarray:
    """(range, [bytes, rows]): one row for each range reaches the driver."""
    out = np.zeros((len(splitters) + 1, 2), np.int64)
    for r in _in_ranges(rows, splitters).groupBy("_range").agg(F.sum("_size"), F.count("*")).collect():
        out[r[0]] = r[1], r[2]
    return out


def splitters_for(rows: DataFrame, total: int, ranges: int, rounds: int = 8) -> tuple[list[Key], np.ndarray]:
    """Splitters of about ``ranges`` ranges and the exact totals of each range."""
    mean = total / ranges
    splitters = _quantiles(_sample(rows, PER_RANGE / mean, 0), ranges)
    got = _totals(rows, splitters)
    for k in range(1, rounds):
        over = np.flatnonzero((got[:, 0] > OVERFULL * mean) & (got[:, 1] > 1))
        if not len(over):
            break
        drawn = _sample(_in_ranges(rows, splitters).filter(F.col("_range").isin(over.tolist())), PER_RANGE / mean, k)
        more = set(splitters)
        for r in over.tolist():
            own = [(s, w) for s, w in drawn if bisect_right(splitters, s) == r]
            more.update(_quantiles(own, int(np.ceil(got[r, 0] / mean))))
        if len(more) == len(splitters):
            break
        splitters = sorted(more)
        got = _totals(rows, splitters)
    return splitters, got


def shard_by_bytes(rows: DataFrame, size, key, tie, shards: int = 16, narrow: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``_size, shard, slot``: shards of near-equal bytes, slots gapless from 0.

    ``size``, ``key`` and ``tie`` are columns: a positive size, the sort key and a
    hash that orders records of one key. ``narrow`` may hold the same three as
    ``_size, _key, _tie``, stored; else they are taken from ``rows`` and stored here.
    A shard differs from its equal part by no more than a record at either end.
    Columns of ``rows`` called ``_size, _key, _tie, shard, slot`` are replaced or dropped.
    Rows equal in key and tie take neighbouring slots in any order; an empty
    table stays empty; with fewer records than shards some shards stay empty.
    """
    spark = rows.sparkSession
    rows = rows.drop("_size", "_key", "_tie", "shard", "slot")
    wide = rows.withColumns({"_size": size.cast("long"), "_key": key.cast("long"), "_tie": tie.cast("long")})
    if narrow is None:
        narrow = materialize(wide.select("_key", "_tie", "_size"), "sizes")
    total = narrow.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    if not total:
        return wide.drop("_key", "_tie").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    splitters, got = splitters_for(narrow, total, int(max(4 * shards, total // RANGE_BYTES)))
    before = np.cumsum(got, axis=0) - got
    base = F.broadcast(spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(before)],
                                             "_range int, _bytes0 long, _rows0 long"))     # a row for each range
    w = Window.partitionBy("_range").orderBy("_key", "_tie")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def placed(df):
        middle = F.col("_bytes0") + F.sum("_size").over(upto) - F.col("_size") / 2
        return _in_ranges(df, splitters).join(base, "_range") \
            .withColumn("_rank", F.col("_rows0") + F.row_number().over(w) - 1) \
            .withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(total)))).cast("int"))

    starts = placed(narrow).groupBy("shard").agg(F.min("_rank").alias("_rank0")).collect()   # a row for each shard
    starts = F.broadcast(spark.createDataFrame(starts, "shard int, _rank0 long"))
    return placed(wide).join(starts, "shard") \
        .select(*rows.columns, "_size", "shard", (F.col("_rank") - F.col("_rank0")).cast("long").alias("slot"))


def _sizes(id_: Column, text: Column) -> dict:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return {"size": F.octet_length(text) + 1, "key": F.xxhash64(text), "tie": F.xxhash64(id_, F.lit("tie"))}


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot``, which replace columns of those names; no other name is reserved.

    A document weighs the UTF-8 bytes of its text plus 1 (null: empty). Repeated
    rows and rows without an id get a place each. The texts move once, to
    their ranges; splitters and totals come from narrow rows.
    """
    own = set_aside(docs)
    c = _sizes(F.col("_aside")[id_col], F.col("_aside")[text_col])
    return brought_back(shard_by_bytes(own, c["size"], c["key"], c["tie"], shards), docs.columns, "shard", "slot")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = materialize(shard_documents(docs), "shards")       # whole rows; what follows is of the texts that arrived
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                      F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
