"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts are lower-cased and cut at white space and ASCII punctuation. Test items
are cut into passages of at most ``PASSAGE`` words; of a longer item, passages overlap by half, so an
excerpt of half a passage lies whole in one of them wherever it starts. The document frequency of
every n-gram of a passage is counted over the whole corpus. Rare ones become
seeds: those that few documents have, or that are no more frequent than the bulk of
their passage, so a passage that leaked a thousand times still has its seeds, in
edited copies too. Wherever a training text holds a seed, the
surrounding stretch is aligned with the passage: +2 for an equal word, -1 for a
changed, added or missing one. The score over that of a perfect copy must reach
``min_score``, and the alignment must hold at least ``LEAST`` equal words. A shorter passage must
stand there word by word, and one of its n-grams must be rare in the whole corpus: in at most ``FEW``
documents and ``FEW_SHARE`` of all. So a short item of common words, or one that leaked into
more documents than that, matches nothing.

Test sets are small beside the corpus, but nothing is assumed: they are taken
in blocks of at most ``block_words`` words, each of which travels with the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurespark.llm.shared import _SPACE, fresh, gram_hashes, text_chunks, word_bounds, word_hashes

GRAM, PASSAGE, MIN_SCORE = 3, 60, 0.5
FEW, FEW_SHARE = 20, 1e-4    # few documents: so many, and this share of all
LEAST = 8                # equal words of an alignment
BULK = 75                    # percentile of a passage's frequencies; twice that is still rare for it
BLOCK_WORDS = 1 << 20
_POINT = np.int32(1 << 10)
_BATCH = 1 << 11          # alignments that are computed together
_CUT = _SPACE.copy()
_CUT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _words(texts):
    """For each chunk: row indices, word hashes, index of each document's first word."""
    for some, buf, offsets in text_chunks(texts):
        starts, ends, first = word_bounds(buf, offsets, _CUT)
        yield some, word_hashes(buf, starts, ends), first


def passage_bounds(words: int) -> list[tuple[int, int]]:
    """First and last word of the passages of an item: equal parts, and between them parts moved by half."""
    parts = -(-words // PASSAGE)
    cuts = [words * k // (2 * parts) for k in range(2 * parts + 1)] if parts else []
    return [*zip(cuts, cuts[2:])]


class Passages:
    """Passages of test items with their n-grams and, once counted, their seeds."""

    def __init__(self, items: list, texts: list):
        self.items, self.words = [], []
        for some, words, first in _words(pa.array(texts, pa.string())):
            for i, row in enumerate(some):
                own = words[first[i]:first[i + 1]]
                for lo, hi in passage_bounds(len(own)):
                    self.items.append(items[row])
                    self.words.append(own[lo:hi])
        self.grams = [gram_hashes(w, min(GRAM, len(w))) for w in self.words]
        self.sizes = sorted({min(GRAM, len(w)) for w in self.words})
        self.all = np.unique(np.concatenate([*self.grams, np.zeros(0, np.uint64)]))
        self.seed = self.home = self.place = self.rare = None

    def choose(self, df: np.ndarray, documents: int) -> None:
        """Keep each passage's rare n-grams; ``df`` counts the documents of ``all``."""
        seed, home, place, few = [], [], [], FEW + FEW_SHARE * documents
        self.rare = np.zeros(len(self.grams), bool)
        for i, g in enumerate(self.grams):
            own = df[np.searchsorted(self.all, g)]
            self.rare[i] = own.min() <= few
            at = np.flatnonzero(own <= max(few, 2 * np.percentile(own, BULK)))
            seed.append(g[at])
            home.append(np.full(len(at), i))
            place.append(at)
        seed, home, place = (np.concatenate(x) for x in (seed, home, place))
        order = np.argsort(seed, kind="stable")
        self.seed, self.home, self.place = seed[order], home[order], place[order]

    def occurrences(self, words: np.ndarray, first: np.ndarray, wanted: np.ndarray):
        """(position, index in ``wanted``) of every n-gram of the chunk that is wanted."""
        doc_end = np.repeat(first[1:], np.diff(first))
        for n in self.sizes:
            g = gram_hashes(words, n)
            at = np.searchsorted(wanted, g)
            at[at == len(wanted)] = 0
            ok = (wanted[at] == g) & (np.arange(len(g)) + n <= doc_end[:len(g)]) if len(g) else np.zeros(0, bool)
            pos = np.flatnonzero(ok)
            yield pos, at[pos]

    def matches(self, words: np.ndarray, first: np.ndarray):
        """Best alignment of each (document, passage): arrays document, passage, score, from, to.

        The score is 0 where too few words are equal.
        """
        pos, home, diag = [], [], []
        for p, lo in self.occurrences(words, first, self.seed):
            hi = np.searchsorted(self.seed, self.seed[lo], side="right")
            n = hi - lo
            k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            p = np.repeat(p, n)
            pos.append(p)
            home.append(self.home[k])
            diag.append(p - self.place[k])
        pos, home, diag = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (pos, home, diag))
        if not len(pos):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0), none, none
        doc = np.searchsorted(first, pos, side="right") - 1
        length = np.array([len(w) for w in self.words])
        slack = length[home] // 2 + 2
        # stretches overlap by more than the slack, so an alignment lies whole in one of them
        cell = np.unique(np.stack([doc, home, diag // slack], axis=1), axis=0)
        doc, home = cell[:, 0], cell[:, 1]
        slack = length[home] // 2 + 2
        lo = np.maximum(first[doc], cell[:, 2] * slack - slack)
        hi = np.minimum(first[doc + 1], (cell[:, 2] + 2) * slack + length[home])
        score = np.zeros(len(cell))
        order = np.argsort(length[home], kind="stable")
        for i in range(0, len(order), _BATCH):
            own = order[i:i + _BATCH]
            points, equal = self._aligned(words, home[own], lo[own], hi[own])
            size = length[home[own]]
            enough = np.where(size < LEAST, self.rare[home[own]] & (points == 2 * size), equal >= LEAST)
            score[own] = np.where(enough, points / (2 * size), 0)
        best = np.lexsort((-score, home, doc))
        doc, home = doc[best], home[best]
        top = np.r_[True, (doc[1:] != doc[:-1]) | (home[1:] != home[:-1])]
        own = best[top]
        return cell[own, 0], cell[own, 1], score[own], lo[own] - first[cell[own, 0]], hi[own] - first[cell[own, 0]]

    def _align(self, words, home, lo, hi):
        """Smith-Waterman scores of passages against stretches of text."""
        return self._aligned(words, home, lo, hi)[0]

    def _aligned(self, words, home, lo, hi):
        """Scores and equal words of passages against stretches of text, a passage word at a time.

        A cell holds ``_POINT`` times the score, plus the equal words: of alignments of one score, the one with most.
        """
        wide, tall = int((hi - lo).max()), max(len(self.words[h]) for h in home)
        at = lo[:, None] + np.arange(wide)
        text = np.where(at < hi[:, None], words[np.minimum(at, len(words) - 1)], np.uint64(0))
        passage = np.ones((len(home), tall), np.uint64)
        for r, h in enumerate(home):
            passage[r, :len(self.words[h])] = self.words[h]
        col = np.arange(wide, dtype=np.int32) * _POINT
        row = np.zeros((len(home), wide), np.int32)
        best = np.zeros(len(home), np.int32)
        for i in range(tall):
            step = np.where(text == passage[:, i:i + 1], 2 * _POINT + np.int32(1), -_POINT)
            diag = step
            diag[:, 1:] += row[:, :-1]
            now = np.maximum(np.maximum(diag, row - _POINT), 0)
            row = np.maximum.accumulate(now + col, axis=1) - col
            best = np.maximum(best, row.max(axis=1))
        return best // _POINT, best % _POINT


def _prepared(text_col: str, name: str = "_decon") -> Column:
    return F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias(name)


def passage_blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, text_col: str,
                   block_words: int = BLOCK_WORDS):
    """The test items in blocks, with seeds by document frequency over all of ``docs``."""
    items = benchmark.select(F.col(item_col).alias("_item"), _prepared(item_text)) \
        .withColumn("_w", F.octet_length("_decon") / 2 + 1)
    total = items.agg(F.coalesce(F.sum("_w"), F.lit(0.0))).first()[0]
    blocks = int(total // block_words) + 1
    texts = docs.select(_prepared(text_col))
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("_item", "_decon"), F.lit(blocks)) == k) \
            .select("_item", "_decon").collect()                 # at most about block_words words
        passages = Passages([r[0] for r in part], [r[1] for r in part])
        if not len(passages.all):
            continue

        def count(batches, passages=passages):
            found = np.zeros(len(passages.all) + 1, np.int64)      # the last counts the documents
            for b in batches:
                found[-1] += b.num_rows
                for _, words, first in _words(b.column(0)):
                    for pos, gram in passages.occurrences(words, first, passages.all):
                        doc = np.searchsorted(first, pos, side="right") - 1
                        once = np.unique(np.stack([doc, gram], axis=1), axis=0)[:, 1]
                        np.add.at(found, once, 1)
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["gram", "n"])

        df = np.zeros(len(passages.all) + 1, np.int64)
        for gram, n in texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
            df[gram] = n
        passages.choose(df[:-1], int(df[-1]))
        yield passages


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE,
                       block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(id, item, score, from_word, to_word)``: best alignment of each document and passage over the limit.

    from_word and to_word bound the stretch of the document that was aligned. Null
    and empty texts and items, and items without words, match nothing. Repeated
    documents or items give a row each; a pair is listed with its id even when
    that is null. A long item yields a row for each of its passages that is found, and these overlap.
    """
    own = docs.select(F.col(id_col).alias("id"), _prepared(text_col))
    item = T.StructField("item", benchmark.schema[item_col].dataType)
    schema = T.StructType([own.schema["id"], item, *T.StructType.fromDDL("score double, from_word long, to_word long")])
    out = docs.sparkSession.createDataFrame([], schema)
    for passages in passage_blocks(docs, benchmark, item_col, item_text, text_col, block_words):
        def run(batches, passages=passages):
            for b in batches:
                for some, words, first in _words(b.column(1)):
                    doc, home, score, lo, hi = passages.matches(words, first)
                    ok = score >= min_score
                    rows = np.asarray(some)[doc[ok]]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(rows)),
                         pa.array([passages.items[h] for h in home[ok]], pa_type(item)),
                         pa.array(score[ok]), pa.array(lo[ok]), pa.array(hi[ok])], names=schema.names)

        out = out.unionByName(own.mapInArrow(run, schema))
    return out


def pa_type(field: T.StructField):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text: str = "text", min_score: float = MIN_SCORE,
                      block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the rows in which a passage of the benchmark is found; all other rows stay, whatever their columns' names."""
    out, name = docs, fresh(docs, "_decon")
    for passages in passage_blocks(docs, benchmark, item_col, item_text, text_col, block_words):
        wide = out.select("*", _prepared(text_col, name))

        def run(batches, passages=passages, at=len(out.columns)):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for some, words, first in _words(b.column(at)):
                    doc, _, score, _, _ = passages.matches(words, first)
                    keep[np.asarray(some)[doc[score >= min_score]]] = False
                yield pa.RecordBatch.from_arrays(b.columns[:at], names=b.schema.names[:at]).filter(pa.array(keep))

        out = wide.mapInArrow(run, out.schema)
    return out


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contaminated_pairs(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "score", "from_word", "to_word")
