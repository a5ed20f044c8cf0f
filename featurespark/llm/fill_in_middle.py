"""Fill-in-the-middle transformation of documents, a pyarrow.compute pipeline per batch.

A text is cut into units (lines with their line feed). Its prefix ends after ``min(h1, h2) mod (n + 1)`` of its ``n``
units, its middle after the larger one, the suffix is the rest; ``h1`` to ``h4`` are the first four 32-bit
numbers of ``sha256("<seed>:<id>")``, so reruns agree. Of the documents, ``rate`` per cent are transformed, and of
these ``spm_rate`` per cent as suffix-prefix-middle, the others as prefix-suffix-middle:

* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* plain: the text itself; also of an empty text, and of one that contains a marker, which could not be taken apart again

In a batch: texts are split into list arrays, flattened with their parent indices, ordinals in the document
computed, units filtered by role, lists rebuilt from the counts of each parent, and joined again. No step
loops over rows. A batch is worked on in groups of about 16 MB of text, a longer text in a group of its own.

Defined results: a null text counts as empty (no units, plain); a null id draws like an empty one; rows with equal ids draw
alike; other columns are kept, and ``result_col`` replaces a column of that name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

GROUP_BYTES = 1 << 24
RESULT = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                       T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                       T.StructField("output", T.StringType())])


@dataclass(frozen=True)
class Markers:
    """Three different markers; none may be a part of another, or overlap another's end with its start."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        names = {self.prefix, self.suffix, self.middle}
        meets = any(a[-k:] == b[:k] for a in names for b in names for k in range(1, min(len(a), len(b)) + (a != b)))
        if len(names) < 3 or "" in names or meets or any(a != b and a in b for a in names for b in names):
            raise ValueError("markers must be non-empty and neither contain nor overlap one another")


def split_units(texts: pa.Array) -> pa.Array:
    """Lists of each text's lines, each with its line feed; an empty text has none."""
    parts = pc.split_pattern(texts, "\n")
    flat, parent = parts.flatten(), pc.list_parent_indices(parts)
    sizes = pc.list_value_length(parts)
    closing = pc.equal(ordinals(parts), pc.subtract(pc.take(sizes, parent), 1))
    ends = pc.if_else(closing, pa.scalar("", flat.type), pa.scalar("\n", flat.type))
    units = pc.binary_join_element_wise(flat, ends, pa.scalar("", flat.type))
    real = pc.not_equal(units, pa.scalar("", flat.type))
    return relisted(units, parent, real, len(texts))


def ordinals(lists: pa.Array) -> pa.Array:
    """The index of every flattened value in its own list."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    return pa.array(np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(first, sizes).astype(np.int64))


def relisted(values: pa.Array, parent: pa.Array, keep: pa.Array, n: int) -> pa.Array:
    """Lists, one for each of ``n`` parents, of the values that are kept."""
    values, parent = pc.filter(values, keep), pc.filter(parent, keep)
    counts = np.bincount(parent.to_numpy(zero_copy_only=False), minlength=n)
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64()), values)


def transform(texts: pa.Array, draws: list[np.ndarray], rate: int, spm_rate: int, marks: Markers) -> pa.StructArray:
    """The result of one group of texts (large strings without nulls) with its four draws."""
    n, empty = len(texts), pa.scalar("", pa.large_string())
    units = split_units(texts)
    sizes = pc.list_value_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
    h1, h2, h3, h4 = draws
    cuts = np.stack([h1 % (sizes + 1), h2 % (sizes + 1)])
    low, high = cuts.min(axis=0), cuts.max(axis=0)

    flat, parent, place = units.flatten(), pc.list_parent_indices(units), ordinals(units)
    begin, end = pc.take(pa.array(low), parent), pc.take(pa.array(high), parent)
    role = pc.if_else(pc.less(place, begin), 0, pc.if_else(pc.less(place, end), 1, 2))
    prefix, middle, suffix = [pc.binary_join(relisted(flat, parent, pc.equal(role, k), n), empty) for k in range(3)]

    marked = pc.match_substring(texts, marks.prefix)
    for m in (marks.suffix, marks.middle):
        marked = pc.or_(marked, pc.match_substring(texts, m))
    plain = pc.or_(pc.or_(marked, pa.array(sizes == 0)), pa.array(h3 % 100 >= rate))
    spm = pa.array(h4 % 100 < spm_rate)

    def joined(*pieces):
        pieces = [pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in pieces]
        return pc.binary_join_element_wise(*pieces, empty)

    output = pc.if_else(plain, texts, pc.if_else(
        spm, joined(marks.suffix, suffix, marks.prefix, prefix, marks.middle, middle),
        joined(marks.prefix, prefix, marks.suffix, suffix, marks.middle, middle)))
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, none, pc.utf8_length(p).cast(pa.int64())) for p in (prefix, middle)]
    return pa.StructArray.from_arrays([pa.array(sizes), form.cast(pa.string()), *chars, output.cast(pa.string())],
                                      RESULT.names)


def _groups(texts: pa.Array):
    """Slices of about ``GROUP_BYTES`` of text; a longer text is a slice of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + GROUP_BYTES, side="right")))
        yield lo, hi
        lo = hi


def draws_of(id_col: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of ``sha256("<seed>:<id>")``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", result_col: str = "fim",
                   seed: int = 7, rate: int = 100, spm_rate: int = 50, marks: Markers = Markers()) -> DataFrame:
    """``docs`` with ``result_col``: units ``n``, ``form``, ``prefix_chars`` and ``middle_chars`` (code points, null
    if plain) and the ``output`` text."""
    def run(texts: pa.Array, *draws: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string()).fill_null("")
        numbers = [d.to_numpy(zero_copy_only=False) for d in draws]
        done = [transform(texts.slice(lo, hi - lo), [d[lo:hi] for d in numbers], rate, spm_rate, marks)
                for lo, hi in _groups(texts)]
        return pa.concat_arrays(done) if done else transform(texts, numbers, rate, spm_rate, marks)

    draws = draws_of(F.col(f"`{id_col}`"), seed)
    return docs.withColumn(result_col, arrow_udf(run, RESULT)(F.col(f"`{text_col}`"), *draws))


def restored(output: Column, form: Column, marks: Markers = Markers()) -> Column:
    """The text that an output was made from: the three pieces stand between the first marks of their kinds."""
    def after(mark: str, end: str | None) -> Column:
        start = F.locate(mark, output) + len(mark)
        stop = F.locate(end, output) if end else F.char_length(output) + 1
        return F.substring(output, start, stop - start)

    p, s, m = marks.prefix, marks.suffix, marks.middle
    psm = F.concat(after(p, s), after(m, None), after(s, m))
    spm = F.concat(after(p, m), after(m, None), after(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


# -- the query ------------------------------------------------------------------------------
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fill_in_middle(docs).select("doc_id", "fim.*")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


# the rebuilt text is the text itself: this is what the query's own rebuilding must give
OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id::VARCHAR) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS us,
             [('0x' || substr(h, 1 + 8 * k, 8))::BIGINT FOR k IN range(4)] AS hs FROM d),
c AS (SELECT *, len(us)::BIGINT AS n FROM u),
k AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                  WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT *, array_to_string(us[1:a], '') AS prefix, array_to_string(us[a + 1:b], '') AS middle,
             array_to_string(us[b + 1:], '') AS suffix FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
