"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The documents of a source are dealt by a hash of the id into blocks, which are
thereby a random permutation of the source. A source's target says how many
whole copies of every block the mix holds and how many further blocks, in
permuted order, it draws; the last one is cut at a hash threshold. The exact
block quotas are then split among the output shards: each node of a binary tree
draws, without replacement, which of its blocks go to the left half. A leaf is
a shard; it takes the next blocks of each source's permutation, so the shards
are disjoint, and it shuffles its own rows.

Only block and source totals reach the driver: at most ``max_blocks`` rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurespark.llm.shared import WORD, brought_back, set_aside

WEIGHTS = (5, 2, 1)      # fixed value: weights of the sources in order, repeating
SHARE, MOST = 1.5, 2.0   # fixed values: all targets over all sizes, largest target over its source
MAX_BLOCKS = 1 << 19
PLAN = ("_size", "_source_size", "_target", "_copies", "_shards")      # columns of the plan
PART_ROWS = 5000         # rows of a shard, about, that one task shuffles


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Targets by weight that sum to ``share`` of all sizes; each stops at ``most`` times its size.

    What a stopped source can't take goes to the others by weight, again and
    again until none is above its limit.
    """
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] > most * sizes[i] * total}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ -= over
    return out


def split_quotas(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Block counts (shard, source): shards of equal size drawn without replacement from ``quota``."""
    if shards == 1:
        return quota[None, :]
    half = shards // 2
    left = rng.multivariate_hypergeometric(quota, int(quota.sum()) * half // shards, method="marginals")
    return np.concatenate([split_quotas(left, half, rng), split_quotas(quota - left, shards - half, rng)])


def mix(docs: DataFrame, shards: int = 16, seed: int = 11, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """``(plan, mixed)``: for each input row what the mix takes of it, and the mix itself; see ``deal``."""
    plan, dealt = _dealt(docs, shards, seed, id_col, text_col, source_col, max_blocks)
    return brought_back(plan, docs.columns, *PLAN), brought_back(dealt, docs.columns)


def deal(docs: DataFrame, shards: int = 16, seed: int = 11, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """``(plan, mixed)``: for each input row what the mix takes of it, and the mix with ``_copy`` and ``_shard``.

    plan adds ``_size`` (words), ``_source_size``, ``_target``, ``_copies`` and
    ``_shards`` (an array, a shard for each copy) to the input's columns. mixed
    has the input's columns too, a row for each copy, dealt out by shard and
    shuffled within it. Added columns replace those of their names; no other name is reserved. Sources go by code point, null last. A null text has no
    words; a document without words takes part like any other and takes nothing.
    Rows that repeat an id fall into one block and are drawn together. The
    result depends on the rows and ``seed`` only. Sources are expected to number
    at most ``max_blocks``.
    """
    plan, dealt = _dealt(docs, shards, seed, id_col, text_col, source_col, max_blocks)
    return brought_back(plan, docs.columns, *PLAN), brought_back(dealt, docs.columns, "_copy", "_shard")


def _dealt(docs, shards, seed, id_col, text_col, source_col, max_blocks) -> tuple[DataFrame, DataFrame]:
    """``deal`` with the input's columns in ``_aside``."""
    spark, row = docs.sparkSession, F.col("_aside")
    draw = F.xxhash64(row[id_col], F.lit(seed))
    rows = set_aside(docs).withColumns({
        "_size": F.regexp_count(F.coalesce(row[text_col].cast("string"), F.lit("")), F.lit(WORD)).cast("long"),
        "_draw": draw})
    narrow = rows.select(row[source_col].alias("_source"), "_size", "_draw")
    totals = narrow.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("rows")) \
        .limit(max_blocks + 1).collect()
    if len(totals) > max_blocks:
        raise ValueError(f"more than {max_blocks} sources")
    totals.sort(key=lambda r: (r["_source"] is None, r["_source"]))
    names, sizes = [r["_source"] for r in totals], [r["size"] for r in totals]
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(totals))]
    goal = targets(sizes, weights)
    each = max(1, min(4096, max_blocks // max(1, len(totals))))
    count = [max(1, min(each, r["rows"] // 8)) for r in totals]

    def frame(values, schema):
        return F.broadcast(spark.createDataFrame(values, schema))    # a row for each source or block: bounded

    kind = docs.schema[source_col].dataType.simpleString()
    by_source = frame([(s, z, float(t), n, i) for i, (s, z, t, n) in enumerate(zip(names, sizes, goal, count))],
                      f"_name {kind}, _source_size long, _target double, _n int, _i int")
    in_block = F.pmod(F.shiftrightunsigned("_draw", 20), F.col("_n")).cast("int")

    def placed(df):
        return df.join(by_source, F.col("_src").eqNullSafe(F.col("_name"))).drop("_name", "_src") \
            .withColumn("_block", in_block)

    blocks = placed(narrow.withColumnRenamed("_source", "_src")).groupBy("_i", "_block") \
        .agg(F.sum("_size").alias("size")).collect()
    words = [np.zeros(n, np.int64) for n in count]
    for r in blocks:
        words[r["_i"]][r["_block"]] = r["size"]

    # whole copies of every block, further whole blocks, and what is left for a part of the next
    whole, drawn, need = [], [], []
    for size, want, w in zip(sizes, goal, words):
        c = int(min(MOST, want / size + 1e-9)) if size else 0
        rest = want - c * size
        upto = np.cumsum(w)
        k = int(np.searchsorted(upto, rest, side="right"))
        whole.append(c)
        drawn.append(min(k, len(w)))
        need.append(rest - (upto[k - 1] if k else 0))
    cut = {(i, k): n for i, (k, n) in enumerate(zip(drawn, need)) if k < len(words[i]) and n > 0}
    limits = _thresholds(spark, placed(narrow.withColumnRenamed("_source", "_src")), cut)

    copies = np.array([c * len(w) + k + ((i, k) in limits) for i, (c, k, w) in enumerate(zip(whole, drawn, words))],
                      np.int64)
    quota = split_quotas(copies, shards, np.random.default_rng(seed)) if len(copies) else np.zeros((shards, 0), int)
    dealt = []
    for i, w in enumerate(words):
        items = [(b, 0) for b in range(drawn[i] + ((i, drawn[i]) in limits))]          # the further blocks first
        items += [(b, c + 1) for c in range(whole[i]) for b in range(len(w))]
        order = np.random.default_rng([seed, i]).permutation(len(items))
        shard = np.repeat(np.arange(shards), quota[:, i])
        to: dict[int, list] = {}
        for s, j in zip(shard.tolist(), order.tolist()):
            to.setdefault(items[j][0], []).append((items[j][1], s))
        for b, got in to.items():
            extra = [s for c, s in got if c == 0]
            dealt.append((i, b, limits.get((i, b)) if extra else None, extra, [s for c, s in got if c]))
    by_block = frame(dealt, "_i int, _block int, _below long, _extra array<int>, _always array<int>")
    taken = F.when(F.col("_below").isNull() | (F.col("_draw") <= F.col("_below")), F.col("_extra")) \
        .otherwise(F.array().cast("array<int>"))
    plan = placed(rows.withColumn("_src", row[source_col])).join(by_block, ["_i", "_block"], "left") \
        .withColumn("_shards", F.coalesce(F.concat(taken, F.col("_always")), F.array().cast("array<int>"))) \
        .withColumn("_copies", F.size("_shards")) \
        .select("_aside", *PLAN, "_draw")
    # a shard is dealt to as many tasks as its rows ask for, by the hash that shuffles it
    parts = max(1, int(sum(c * r["rows"] for c, r in zip((g / max(z, 1) for g, z in zip(goal, sizes)), totals)))
                // (shards * PART_ROWS))
    order = F.xxhash64("_draw", "_copy", F.lit(seed))
    mixed = plan.select("_aside", "_draw", F.posexplode("_shards").alias("_copy", "_shard")) \
        .withColumn("_order", order).withColumn("_part", F.pmod(F.shiftrightunsigned("_order", 32), F.lit(parts))) \
        .repartition("_shard", "_part").sortWithinPartitions("_shard", "_part", "_order", "_draw", "_copy") \
        .select("_aside", "_copy", "_shard")
    return plan, mixed


def _thresholds(spark, placed: DataFrame, cut: dict) -> dict:
    """For each ``(source, block)`` the largest draw so that the words up to it come nearest to ``cut``'s."""
    if not cut:
        return {}
    wanted = F.broadcast(spark.createDataFrame([(i, b, float(n)) for (i, b), n in cut.items()],
                                               "_i int, _block int, _need double"))
    w = Window.partitionBy("_i", "_block").orderBy("_draw")
    found = placed.join(wanted, ["_i", "_block"]) \
        .groupBy("_i", "_block", "_need", "_draw").agg(F.sum("_size").alias("_size")) \
        .withColumn("_upto", F.sum("_size").over(w)) \
        .filter("_upto - _size / 2 <= _need").groupBy("_i", "_block").agg(F.max("_draw").alias("d")).collect()
    return {(r["_i"], r["_block"]): r["d"] for r in found}


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    plan, mixed = deal(docs)
    return held(plan, mixed).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), "taken", "copies", "shards")


def held(plan: DataFrame, mixed: DataFrame) -> DataFrame:
    """A row for each of ``plan``'s with what ``mixed`` holds of it: words ``taken``, ``copies`` and their ``shards``.

    Counted from the rows and texts of the mix. Rows equal in id, source and text are drawn
    alike, so each has its part of what their group has.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = ["doc_id", "source", "_hash"]
    rows = plan.withColumn("_hash", F.xxhash64("text")) \
        .groupBy(*key, "_size", "_source_size", "_target").agg(F.count("*").alias("_rows"))
    found = mixed.withColumns({"_hash": F.xxhash64("text"), "_words": F.regexp_count(text, F.lit(WORD)).cast("long")}) \
        .groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(
            F.sum("_words").alias("_words"), F.count("*").alias("_n"), F.collect_set(F.struct("_copy", "_shard")).alias("_at"))
    same = [rows[k].eqNullSafe(found[f"_{k}"]) for k in key]
    return rows.join(found, same[0] & same[1] & same[2], "left") \
        .withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "_rows"))).withColumns({
            "taken": F.expr("coalesce(_words div _rows, 0L)"), "copies": F.expr("cast(coalesce(_n div _rows, 0L) as int)"),
            "shards": F.coalesce(F.transform(F.sort_array("_at"), lambda x: x["_shard"]), F.array().cast("array<int>"))})
