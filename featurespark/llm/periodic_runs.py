"""Runs of repeated words inside a document, found by descending-LCP Kruskal over suffix classes.

A run is a stretch of consecutive words with smallest period ``q`` and at least ``2 * q`` words (and
``min_length``) that cannot be made longer on either side without losing that period.

Method. Suffixes that agree on their first ``h`` words form a class; going from the longest common
prefix (LCP) down, classes merge. The edges between neighbours of the suffix order, taken by decreasing
LCP, are a spanning tree of that process, so union-find takes each once, and every class keeps its
positions in ascending order, the smaller set being put into the larger one. Two positions ``i < j``
that become neighbours in a merged set agree on exactly ``h`` words. If ``j - i <= h`` they seed a
run: words ``i .. j + h`` have period ``j - i``, and cannot be longer to the right. It is maximal to the left
unless the words before ``i`` and ``j`` agree, and then the pair before it seeds it. Its period is the smallest: with a
smaller one ``p`` the position ``i + p`` would have joined ``i`` at a larger LCP already, and ``i`` and ``j`` would
be no neighbours. Every run of period ``q`` from ``s`` on is seeded by ``(s, s + q)``, so the result is exact.

A run of at least ``min_length`` words needs an LCP of half as many, so edges below that are left out, and
so are classes whose positions all lie further apart than their largest LCP.

Every document is worked on alone, in groups of about a megabyte of text; a longer document is a group of its own. Time
is ``n log n`` in its words, memory proportional to its words times the logarithm of its longest repeat.

Defined results: a null or blank text has no runs and an empty ``collapsed`` text; ids may be null or repeat (each
row is judged by itself); other columns are kept, and ``result_col`` replaces a column of that name.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from featurespark.llm.shared import gram_hashes, mix64, text_chunks

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
RESULT = T.StructType([T.StructField("runs", T.ArrayType(RUN, False), False),
                       T.StructField("collapsed", T.StringType(), False)])
_ARROW_RUN = pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")])

MANY = 32           # a set with at least so many positions to add is sorted anew, a smaller one inserted


def suffix_classes(symbols: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Classes of equal stretches of 1, 2, 4, ... symbols, by refinement of the suffix order.

    ``symbols`` ends with a value that occurs once. Each entry is a length and, for every position, the number of
    suffixes in smaller classes; in the last entry all classes are single suffixes, so it is the suffix order.
    """
    n = len(symbols)
    _, inverse, counts = np.unique(symbols, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[inverse]
    levels, m = [(1, rank)], 1
    while True:
        active = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(active):
            return levels
        own = rank[active]
        key = own * np.int64(n + 1) + rank[active + m]      # equal stretches end before the closing value
        order = np.argsort(key, kind="stable")
        key, own, active = key[order], own[order], active[order]
        at = np.arange(len(key))
        new_own, new_key = np.ones(len(key), bool), np.ones(len(key), bool)
        new_own[1:], new_key[1:] = own[1:] != own[:-1], key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new_own, at, 0))
        part = np.maximum.accumulate(np.where(new_key, at, 0))
        rank = rank.copy()
        rank[active] = own + part - first
        m *= 2
        levels.append((m, rank))


def lcp_edges(symbols: np.ndarray, at_least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours of the suffix order with their LCP, where it is ``at_least``: ``(left, right, lcp)`` in that order."""
    levels = suffix_classes(symbols)
    suffixes = np.empty(len(symbols), np.int64)
    suffixes[levels[-1][1]] = np.arange(len(symbols))
    u, v = suffixes[:-1], suffixes[1:]
    enough = [r for m, r in levels if m <= at_least][-1]
    may = enough[u] == enough[v]
    u, v = u[may], v[may]
    lcp = np.zeros(len(u), np.int64)
    for m, r in reversed(levels):
        lcp += m * (r[u + lcp] == r[v + lcp])
    far = lcp >= at_least
    return u[far], v[far], lcp[far]


def _with_seeds(u: np.ndarray, v: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Which edges belong to a class with two positions no further apart than its largest LCP."""
    first = np.ones(len(u), bool)
    first[1:] = u[1:] != v[:-1]                             # edges of a class follow each other
    group = np.cumsum(first) - 1
    top = np.maximum.reduceat(lcp, np.flatnonzero(first))
    position = np.concatenate([u[first], v])
    owner = np.concatenate([group[first], group])
    order = np.lexsort((position, owner))
    position, owner = position[order], owner[order]
    near = (owner[1:] == owner[:-1]) & (position[1:] - position[:-1] <= top[owner[1:]])
    keep = np.zeros(len(top), bool)
    keep[owner[1:][near]] = True
    return keep[group]


def descending_kruskal(u: np.ndarray, v: np.ndarray, lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """Unite classes along edges of decreasing LCP; ``(i, j, lcp)`` of new neighbours with ``j - i <= lcp``."""
    order = np.argsort(-lcp, kind="stable")
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    left, right = ends[:len(u)][order].tolist(), ends[len(u):][order].tolist()
    parent = list(range(len(nodes)))
    members: list[list[int] | None] = [[p] for p in nodes.tolist()]
    seeds = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b, h in zip(left, right, lcp[order].tolist()):
        a, b = root(a), root(b)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large, small = members[a], members[b]
        places = [bisect_left(large, p) for p in small]
        last = len(small) - 1
        for t, (p, k) in enumerate(zip(small, places)):
            if k and (t == 0 or places[t - 1] != k) and p - large[k - 1] <= h:
                seeds.append((large[k - 1], p, h))
            if k < len(large) and (t == last or places[t + 1] != k) and large[k] - p <= h:
                seeds.append((p, large[k], h))
        if len(small) < MANY:
            for p in small:
                insort(large, p)
        else:
            large.extend(small)
            large.sort()
        members[b], parent[b] = None, a
    return seeds


def runs_of(symbols: np.ndarray, min_length: int) -> np.ndarray:
    """Runs ``(start, length, period)`` of a sequence that closes with a value occurring once, by start and period.

    Several sequences may follow each other, each closed by a value of its own: no run crosses one.
    """
    none = np.zeros((0, 3), np.int64)
    u, v, lcp = lcp_edges(symbols, max(1, (min_length + 1) // 2))
    if len(u):
        keep = _with_seeds(u, v, lcp)
        u, v, lcp = u[keep], v[keep], lcp[keep]
    if not len(u):
        return none
    seeds = np.array(descending_kruskal(u, v, lcp), np.int64).reshape(-1, 3)
    i, j, h = seeds.T
    whole = (symbols[i - 1] != symbols[j - 1]) & (j - i + h >= min_length)     # before the first: the closing value
    i, j, h = i[whole], j[whole], h[whole]
    order = np.lexsort((j - i, i))
    return np.stack([i, j - i + h, j - i], axis=1)[order]


def _repeats(ids: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Documents in which some ``n`` consecutive words may occur twice (equal hashes)."""
    grams = gram_hashes(ids, n)
    if not len(grams):
        return np.zeros(0, np.int64)
    inside = docs[:len(grams)] == docs[n - 1:]
    owner = docs[:len(grams)][inside]
    key = mix64(grams[inside] ^ mix64(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    return np.unique(owner[1:][key[1:] == key[:-1]])


def collapse(texts: pa.Array, min_length: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Runs of each text, and its words without those after the first period of a run."""
    runs: list[np.ndarray] = []
    kept: list[bytes] = []
    none = np.zeros((0, 3), np.int64)
    for rows, buf, offsets in text_chunks(texts):
        whole, at = buf.tobytes(), offsets.tolist()
        words = [whole[a:b].split() for a, b in zip(at, at[1:])]     # splits at 0x20 and 0x09-0x0D alone
        own = [none] * len(words)
        kinds: dict[bytes, int] = {}
        ids = np.fromiter((kinds.setdefault(w, len(kinds)) for ws in words for w in ws), np.int64)
        sizes = np.array([len(ws) for ws in words])
        first = np.cumsum(sizes) - sizes
        docs = np.repeat(np.arange(len(words)), sizes)
        some = _repeats(ids.astype(np.uint64), docs, max(1, (min_length + 1) // 2))
        if len(some):
            closed = [x for d in some.tolist() for x in (ids[first[d]:first[d] + sizes[d]], [len(kinds) + d])]
            starts = np.cumsum(sizes[some] + 1) - sizes[some] - 1
            found = runs_of(np.concatenate(closed), min_length)
            cuts = np.searchsorted(found[:, 0], np.append(starts, len(ids) + len(words)))
            for k, d in enumerate(some.tolist()):
                own[d] = found[cuts[k]:cuts[k + 1]] - [starts[k], 0, 0]
        for ws, rs in zip(words, own):
            if len(rs):
                change = np.zeros(len(ws) + 1, np.int64)
                np.add.at(change, rs[:, 0] + rs[:, 2], 1)
                np.add.at(change, rs[:, 0] + rs[:, 1], -1)
                ws = [w for w, c in zip(ws, np.cumsum(change).tolist()) if not c]
            runs.append(rs)
            kept.append(b" ".join(ws))
    return runs, kept


def periodic_runs(docs: DataFrame, text_col: str = "text", result_col: str = "periodic",
                  min_length: int = 12) -> DataFrame:
    """``docs`` with ``result_col``: a struct of ``runs`` (start, length, period, in words; by start, then period) and
    ``collapsed``, the words that no run holds after its first period, joined by one space."""
    def run(texts: pa.Array) -> pa.Array:
        runs, kept = collapse(texts, min_length)
        ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
        flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
        values = pa.StructArray.from_arrays([pa.array(flat[:, c].copy()) for c in range(3)], fields=list(_ARROW_RUN))
        lists = pa.ListArray.from_arrays(pa.array(ends), values)
        return pa.StructArray.from_arrays([lists, pa.array(kept, pa.binary()).cast(pa.string())], ["runs", "collapsed"])

    return docs.withColumn(result_col, arrow_udf(run, RESULT)(F.col(f"`{text_col}`")))


def longest_run(runs: Column) -> Column:
    """The run of greatest length (ties: smallest start, then period); null where there is none."""
    top = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    best = F.aggregate(runs, F.lit(None).cast(RUN), lambda acc, r: F.when(
        acc.isNull() & (r["length"] == top["length"]), r).otherwise(acc))       # in order of start and period
    return best


# -- the query ------------------------------------------------------------------------------
def _plant(texts: pa.Array, gs: pa.Array) -> pa.Array:
    out = []
    for text, g in zip(texts, gs.to_pylist()):
        words = text.as_py().encode().split() if text.is_valid else []
        n = len(words)
        if not n:
            out.append(None)
            continue
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        tail = words[a:a + p]
        words[a:] = (tail * ((n - a) // p + 1))[:n - a]
        out.append(b" ".join(words))
    return pa.array(out, pa.binary()).cast(pa.string())


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Stand-in input of the query: a tenth of the documents, by id, with a periodic tail (null ids: none)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    tail = arrow_udf(_plant, T.StringType())(F.when(h % 10 == 0, F.col("text")), F.floor(h / 10))
    return docs.withColumn("text", F.coalesce(tail, "text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = periodic_runs(with_planted_runs(docs)).select("doc_id", "periodic.runs", "periodic.collapsed")
    out = out.withColumn("top", longest_run(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(
        ",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
