"""Repeated passages by content-defined blocks and an index of single windows.

Documents are cut into blocks by their content: a window of ``WINDOW`` words is
represented by its smallest ``ANCHOR``-gram hash, and the neighbouring windows
with the same anchor make a block, so equal passages are cut alike wherever
they stand. The steps:

1. anchors that only one document has are left out; nothing there repeats;
2. the other blocks are indexed by a 96-bit hash of their words, with the
   smallest document that holds them; a block that a smaller document has is known;
3. windows of unknown blocks are looked up one by one in an index of their own.
   A window repeated from a smaller document is unknown in the smallest one that
   has it, so this index holds every window that can matter. Anchors whose
   blocks are all equal have no such windows and are left out here;
4. words under known blocks and under found windows are the repeated ones.

The factors of a relative Lempel-Ziv parse, runs of known blocks of one reference
document, are counted on the side; they decide nothing.

Only hashes and the text, dealt once by document id, are shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurespark.llm.shared import gram_hashes, mix64, run_hashes, text_chunks, word_bounds, word_hashes

WINDOW, ANCHOR = 13, 6
_ROWS = 256              # documents that are unpacked together
_OTHER = np.uint64(0xA24BAED4963EE407)


class Parsed:
    """Words of a chunk of documents with their windows and content-defined blocks."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, window: int):
        self.starts, self.ends, self.first = word_bounds(buf, offsets)
        self.words = word_hashes(buf, self.starts, self.ends)
        self.window = window
        k = min(ANCHOR, window)
        n = len(self.words)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        at = np.arange(max(0, n - window + 1))
        self.at = at[doc[at] == doc[at + window - 1]] if len(at) else at     # windows inside one document
        self.doc = doc[self.at] if len(self.at) else self.at
        least = gram_hashes(self.words, k)
        span, wide = 1, window - k + 1                     # smallest of ``wide`` neighbours, by doubling
        while span < wide:
            step = min(span, wide - span)
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
            span += step
        self.anchor = least[self.at] >> np.uint64(16)      # equal anchors by chance cost time only
        new = np.ones(len(self.at), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (np.diff(self.at) != 1) | (np.diff(self.doc) != 0)
        self.block = np.flatnonzero(new)                   # first window of every block
        self.size = np.diff(np.append(self.block, len(self.at)))
        self.block_doc = self.doc[self.block]

    def _hash(self, lo, hi):
        return run_hashes(self.words, lo, hi), run_hashes(mix64(self.words ^ _OTHER), lo, hi) >> np.uint64(32)

    def block_hashes(self, blocks):
        lo = self.at[self.block[blocks]]
        return self._hash(lo, lo + self.size[blocks] + self.window - 1)

    def window_hashes(self, windows):
        return self._hash(self.at[windows], self.at[windows] + self.window)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _packed(batches):
    """Texts compressed one by one: what is dealt by id takes under half the bytes."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        for lo in range(0, b.num_rows, _ROWS):
            part = b.slice(lo, _ROWS)
            packed = [squeeze(t) for t in part.column("text").cast("binary").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(packed, pa.binary())], names=["id", "packed"])


def _chunks(batch, window):
    """Rows of a batch, their bytes and words, a part of the batch at a time."""
    open_ = zstandard.ZstdDecompressor().decompress
    for lo in range(0, batch.num_rows, _ROWS):
        part = batch.slice(lo, _ROWS)
        if "packed" in batch.schema.names:
            texts = pa.array([open_(p) for p in part.column("packed").to_pylist()], pa.binary())
        else:
            texts = part.column("text")
        for some, buf, offsets in text_chunks(texts):
            yield np.asarray(some) + lo, buf, Parsed(buf, offsets, window)


def _list(column, row) -> np.ndarray:
    got = column[row].as_py()
    return np.array(got or [], np.int64).view(np.uint64)


def _by_document(p: Parsed, some, column, keys, doc):
    """Whether each key is in the list that its document's row holds."""
    ok = np.zeros(len(keys), bool)
    cuts = np.searchsorted(doc, np.arange(len(some) + 1))
    for i, row in enumerate(some):
        lo, hi = cuts[i], cuts[i + 1]
        if hi > lo and column[row].is_valid:
            ok[lo:hi] = np.isin(keys[lo:hi], _list(column, row))
    return ok


def _anchors(window):
    def run(batches):
        for b in batches:
            for some, _, p in _chunks(b, window):
                doc, anchor = p.block_doc, p.anchor[p.block]
                order = np.lexsort((anchor, doc))
                doc, anchor = doc[order], anchor[order]
                once = np.ones(len(doc), bool)
                once[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(some[doc[once]])), _signed(anchor[once])], names=["id", "a"])
    return _joined(run)


def _joined(run, rows: int = 1 << 14):
    """The same batches in fewer, larger pieces."""
    def whole(batches):
        held, n = [], 0
        for x in run(batches):
            held.append(x)
            n += x.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return whole


def _blocks(window):
    """Hashes of the blocks whose anchor other documents have too."""
    def run(batches):
        for b in batches:
            for some, _, p in _chunks(b, window):
                own = np.flatnonzero(_by_document(p, some, b.column("anchors"), p.anchor[p.block], p.block_doc))
                c1, c2 = p.block_hashes(own)
                ids = b.column("id").take(pa.array(some[p.block_doc[own]]))
                yield pa.RecordBatch.from_arrays([ids, _signed(c1), _signed(c2), _signed(p.anchor[p.block[own]])],
                                                 names=["id", "h1", "h2", "a"])
    return _joined(run)


def _windows(window):
    """Hashes of the windows of blocks with an open anchor that are not known whole."""
    def run(batches):
        for b in batches:
            for some, _, p in _chunks(b, window):
                shared = _by_document(p, some, b.column("open"), p.anchor[p.block], p.block_doc)
                c1, _ = p.block_hashes(np.arange(len(p.block)))
                known = _by_document(p, some, b.column("known"), c1, p.block_doc)
                own = np.flatnonzero(np.repeat(shared & ~known, p.size))
                w1, w2 = p.window_hashes(own)
                ids = b.column("id").take(pa.array(some[p.doc[own]]))
                yield pa.RecordBatch.from_arrays([ids, _signed(w1), _signed(w2)], names=["id", "h1", "h2"])
    return _joined(run)


def _spans(window):
    def run(batches):
        for b in batches:
            for some, buf, p in _chunks(b, window):
                c1, _ = p.block_hashes(np.arange(len(p.block)))
                found = np.repeat(_by_document(p, some, b.column("known"), c1, p.block_doc), p.size)
                loose = np.flatnonzero(~found)
                w1, _ = p.window_hashes(loose)
                found[loose] = _by_document(p, some, b.column("tail"), w1, p.doc[loose])
                edge = np.zeros(len(p.words) + 1, np.int64)
                np.add.at(edge, p.at[found], 1)
                np.add.at(edge, p.at[found] + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                cuts = np.searchsorted(p.block_doc, np.arange(len(some) + 1))
                raw, kept, numbers = buf.tobytes(), [], []
                for i, row in enumerate(some):
                    lo, hi = p.first[i], p.first[i + 1]
                    keep = np.flatnonzero(~gone[lo:hi]) + lo
                    refs = dict(zip(_list(b.column("known"), row).tolist(), b.column("refs")[row].as_py() or []))
                    count, longest = _factors(c1[cuts[i]:cuts[i + 1]], p.size[cuts[i]:cuts[i + 1]], refs, window)
                    kept.append(b" ".join([raw[s:e] for s, e in zip(p.starts[keep].tolist(), p.ends[keep].tolist())]))
                    numbers.append((hi - lo, hi - lo - len(keep), count, longest))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(some)), *[pa.array(np.array(n, np.int64)) for n in zip(*numbers)],
                     pa.array([k.decode() for k in kept], pa.string()),
                     pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                    names=["id", "n_words", "n_removed", "n_factors", "longest_factor", "kept_text", "kept_sha256"])
    return run


def _factors(hashes, sizes, refs, window):
    """Number of factors of a document's parse, and words in the longest."""
    count = longest = length = 0
    current = None
    for h, n in zip(hashes.tolist(), sizes.tolist()):
        ref = refs.get(h)
        if ref is None:
            current = None
        elif ref == current:
            length += n
        else:
            current, length, count = ref, n, count + 1
        if current is not None:
            longest = max(longest, length + window - 1)
    return count, longest


def _first_seen(hits: DataFrame) -> DataFrame:
    """Hashes that occur more than once, with the smallest id that has them."""
    return hits.groupBy("h1", "h2").agg(F.min("id").alias("ref"), F.count("*").alias("n")).filter("n > 1").drop("n")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW) -> DataFrame:
    """``(id, n_words, n_removed, n_factors, longest_factor, kept_text, kept_sha256)`` for each row.

    A word goes when it lies in a run of ``window`` words that also stands in a
    document with a smaller id. Words are runs of anything but ASCII white space,
    unchanged; what is kept is joined by single spaces. Null, empty and blank texts
    have no words. Rows that repeat an id don't count against each other, and
    rows without an id neither lose words nor count for others. The outcome doesn't depend on row order.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = own.schema["id"]
    longs = [T.StructField(c, T.LongType(), False) for c in ("a", "h1", "h2")]
    named, unnamed = own.filter("id is not null"), own.filter("id is null")
    anchors = named.mapInArrow(_anchors(window), T.StructType([kind, longs[0]]))
    shared = anchors.groupBy("a").count().filter("count > 1").select("a")
    wanted = anchors.join(shared, "a", "left_semi").groupBy("id").agg(F.collect_set("a").alias("anchors"))
    # with its filter, so that inner and outer joins find the same frame to deal
    dealt = named.mapInArrow(_packed, T.StructType([kind, T.StructField("packed", T.BinaryType())])) \
        .filter("id is not null")
    texts = dealt.join(wanted, "id", "left")
    blocks = texts.filter("anchors is not null").mapInArrow(
        _blocks(window), T.StructType([kind, longs[1], longs[2], longs[0]]))
    # a row for each different block, dealt once: both uses ask for all of its columns
    firsts = blocks.groupBy("h1", "h2").agg(F.min("id").alias("ref"), F.count("*").alias("n"), F.min("a").alias("a"))
    seen = firsts.filter("n > 1 and a is not null").drop("n", "a")
    known = blocks.drop("a").join(seen, ["h1", "h2"]).filter("id > ref").groupBy("id") \
        .agg(F.collect_set(F.struct("h1", "ref")).alias("k")) \
        .select("id", F.col("k.h1").alias("known"), F.col("k.ref").alias("refs"))
    differ = firsts.filter("n >= 1 and ref is not null").groupBy("a").count().filter("count > 1").select("a")
    opened = blocks.select("id", "a").join(differ, "a", "left_semi").groupBy("id").agg(F.collect_set("a").alias("open"))
    texts = dealt.join(known, "id", "left").join(opened, "id", "left")
    loose = texts.filter("open is not null").mapInArrow(_windows(window), T.StructType([kind, *longs[1:]]))
    tail = loose.join(_first_seen(loose), ["h1", "h2"]).filter("id > ref").groupBy("id") \
        .agg(F.collect_set("h1").alias("tail"))
    nothing = {"known": "array<long>", "refs": f"array<{kind.dataType.simpleString()}>", "open": "array<long>",
               "tail": "array<long>"}
    rows = texts.join(tail, "id", "left").unionByName(
        unnamed.mapInArrow(_packed, dealt.schema).withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()}))
    return rows.mapInArrow(_spans(window), T.StructType([kind, *T.StructType.fromDDL(
        "n_words long, n_removed long, n_factors long, longest_factor long, kept_text string, kept_sha256 string")]))


def op2_substring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, md5_number(array_to_string(list_slice(ws, i, i + 12), ' ')) AS h FROM p WHERE i + 12 <= len(ws)),
f AS (SELECT h, min(doc_id) AS ref FROM g GROUP BY h),
s AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (h) WHERE ref < doc_id),
k AS (SELECT p.doc_id, p.i, list_extract(p.ws, p.i) AS word FROM p ANTI JOIN s ON p.doc_id = s.doc_id AND p.i = s.i),
t AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM k GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(t.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN t ON w.doc_id = t.doc_id
"""
