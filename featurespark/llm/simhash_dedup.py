"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within ``max_distance`` bits agree on at least one of
``max_distance + 1`` bit blocks, so each distinct fingerprint is dealt once for
each block, under the block's value: that value is the topmost node of an index
tree. Inside such a group the fingerprints are sorted by Gray rank, which puts
codes with common bits side by side; runs of neighbours become nodes that hold
the bits all members share, and a child keeps only the shared bits its parent
has not yet factored out. The group is joined with itself from the root
downwards: the differences on shared bits accumulate along the way, and a pair
of nodes over the limit is dropped whole. A group leaves a spanning forest of
its links, never all pairs, and components are then joined across groups.

A group over ``max_group`` fingerprints is dealt again by blocks of its
remaining bits, until none is left over the limit or no bits remain.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurespark.llm.components import connected_components
from featurespark.llm.shared import materialize, text_chunks

FAN = 8                  # members of an index node
MAX_GROUP = 1 << 16      # fingerprints that one task indexes together
_ROWS = 1 << 13          # node pairs that are expanded at a time

# each byte value spread over eight 8-bit lanes, to add up bits 255 rows at a time
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little") \
    .copy().view(np.uint64).ravel()


def simhash(text: bytes, shingle: int) -> int:
    """Unsigned 64-bit fingerprint of one text; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist() + [len(joined)]
    starts = [0] + [e + 1 for e in ends[:-1]]
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[k - 1:])], np.uint64)
    lanes = _LANES[h.view(np.uint8).reshape(-1, 8)]
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 255):
        votes += lanes[i:i + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(id, fp)``: the signed 64-bit SimHash of every whole text (null: no words)."""
    def run(batches):
        for b in batches:
            fps = [simhash(buf[s:e].tobytes(), shingle) for _, buf, offsets in text_chunks(b.column(1))
                   for s, e in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))],
                                             names=["id", "fp"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, T.StructType([own.schema["id"], T.StructField("fp", T.LongType())]))


def _gray_rank(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _level(group: np.ndarray, pattern: np.ndarray, mask: np.ndarray):
    """The nodes over the given entries: runs of ``FAN`` neighbours of one group."""
    n = len(group)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    at = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    starts = np.flatnonzero(at % FAN == 0)
    ones = np.bitwise_and.reduceat(pattern & mask, starts)
    zeros = np.bitwise_and.reduceat(~pattern & mask, starts)
    return starts, np.diff(np.r_[starts, n]), group[starts], ones, ones | zeros


def linked_forest(group: np.ndarray, fp: np.ndarray, limit: int):
    """Indices ``(child, parent)`` of a spanning forest of all links inside each group.

    ``group`` is sorted; inside a group the rows are in Gray order of ``fp``.
    """
    full = np.full(len(fp), ~np.uint64(0))
    levels = [(None, None, group, fp, full)]
    while len(levels[-1][2]) > len(np.unique(levels[-1][2])) or len(levels) == 1:
        levels.append(_level(*levels[-1][2:]))
    label = np.arange(len(fp))

    def unite(a, b):
        nonlocal label
        while True:
            x, y = label[a], label[b]
            differs = x != y
            if not differs.any():
                return
            a, b, x, y = a[differs], b[differs], x[differs], y[differs]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up

    roots = np.arange(len(levels[-1][2]))
    stack = [(len(levels) - 1, roots, roots, np.zeros(len(roots), np.int64))]
    grid_a, grid_b = (g.ravel() for g in np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij"))
    while stack:
        depth, a, b, _ = stack.pop()
        if len(a) > _ROWS:
            stack += [(depth, a[i:i + _ROWS], b[i:i + _ROWS], _[i:i + _ROWS]) for i in range(0, len(a), _ROWS)]
            continue
        starts, sizes, _g, up_pattern, up_mask = levels[depth]
        _s, _n, _g, pattern, mask = levels[depth - 1]
        above = up_mask[a] & up_mask[b]                   # bits already compared at the parents
        gone = np.bitwise_count((up_pattern[a] ^ up_pattern[b]) & above).astype(np.int64)
        ok = (grid_a < sizes[a][:, None]) & (grid_b < sizes[b][:, None])
        if depth == 1:
            ok &= (a != b)[:, None] | (grid_a < grid_b)
        else:
            ok &= (a != b)[:, None] | (grid_a <= grid_b)
        pair, cell = np.nonzero(ok)
        x, y = starts[a[pair]] + grid_a[cell], starts[b[pair]] + grid_b[cell]
        rest = mask[x] & mask[y] & ~above[pair]           # what only the children share
        total = gone[pair] + np.bitwise_count((pattern[x] ^ pattern[y]) & rest)
        near = total <= limit
        x, y = x[near], y[near]
        if depth == 1:
            unite(x, y)
        elif len(x):
            stack.append((depth - 1, x, y, total[near]))
    child = np.flatnonzero(label != np.arange(len(fp)))
    return child, label[child]


def _links(limit: int):
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def solve(group, fp):
            order = np.lexsort((_gray_rank(fp), group))
            group, fp = group[order], fp[order]
            child, parent = linked_forest(group, fp, limit)
            return pa.RecordBatch.from_arrays([pa.array(fp[child].view(np.int64)), pa.array(fp[parent].view(np.int64))],
                                              names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)))
            if held[0][0][0] == held[-1][0][-1] and sum(len(g) for g, _ in held) < 1 << 14:
                continue
            group, fp = (np.concatenate(x) for x in zip(*held))
            cut = np.searchsorted(group, group[-1])       # the last group may go on
            if cut:
                yield solve(group[:cut], fp[:cut])
            held = [(group[cut:], fp[cut:])]
        if held:
            yield solve(*(np.concatenate(x) for x in zip(*held)))

    return run


def _deal(rows: DataFrame, bits: int, blocks: int) -> tuple[DataFrame, int]:
    """Each row once for every block of its ``bits`` remaining bits; ``rest`` loses that block.

    All blocks have the same width or one more bit; the widest is taken out of
    the count that remains, so ``rest`` may keep a zero bit too many.
    """
    parts, at = [], 0
    for j in range(blocks):
        width = bits // blocks + (j < bits % blocks)
        value = F.shiftrightunsigned("rest", at).bitwiseAND(F.lit((1 << width) - 1))
        low = F.col("rest").bitwiseAND(F.lit((1 << at) - 1)) if at else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned("rest", at + width), at) if at + width < 64 else F.lit(0).cast("long")
        parts.append(F.struct(F.xxhash64("path", F.lit(j), value).alias("path"),
                              low.bitwiseOR(high).alias("rest")))
        at += width
    dealt = rows.select("fp", F.explode(F.array(*parts)).alias("p")).select("fp", "p.path", "p.rest")
    return dealt, bits - bits // blocks


def near_links(fps: DataFrame, max_distance: int, max_group: int = MAX_GROUP) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints that connect all within ``max_distance`` bits."""
    rows, bits = fps.select("fp", F.lit(0).cast("long").alias("path"), F.col("fp").alias("rest")), 64
    done = []
    while bits > max_distance:
        rows, bits = _deal(rows, bits, max_distance + 1)
        large = rows.groupBy("path").count().filter(F.col("count") > max_group).select("path")
        large = materialize(large, "large-groups")
        if large.isEmpty():
            break
        done.append(rows.join(large, "path", "left_anti").select("path", "fp"))
        rows = materialize(rows.join(large, "path", "left_semi"), "large-rows")
    rows = reduce(DataFrame.unionByName, [*done, rows.select("path", "fp")])
    return rows.repartition("path").sortWithinPartitions("path") \
        .mapInArrow(_links(max_distance), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                       max_distance: int = 4, max_group: int = MAX_GROUP) -> DataFrame:
    """``(id, fp, component)`` for every row; component is the smallest id reachable.

    Words are runs of anything but ASCII white space, lower-cased in A-Z;
    a shingle is ``shingle`` words (or all, when fewer). Texts without words
    (null, empty, blank) have fingerprint zero, which links like any other.
    Repeated rows and ties come out once for each row; a null id is never the
    smallest, and a component of null ids alone has a null component. An empty
    table gives an empty result.
    """
    own = materialize(with_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("id").alias("low"))
    roots = connected_components(near_links(distinct.select("fp"), max_distance, max_group))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component"))
    return own.join(named.join(least, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
             max_distance: int = 4) -> DataFrame:
    """``docs`` with one document for each near-duplicate group: the one with the smallest id.

    Rows equal in id and text count as one. Rows without an id stay, as no id names them.
    """
    found = simhash_components(docs, id_col, text_col, shingle, max_distance)
    kept = found.filter("id = component").select(F.col("id").alias("_kept")).distinct()
    rows = docs.join(kept, docs[id_col] == kept["_kept"], "left_semi").dropDuplicates([id_col, text_col])
    return rows.unionByName(docs.filter(F.col(id_col).isNull()))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"))
