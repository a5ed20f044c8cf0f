"""Document quality from a linear-chain conditional random field over lines.

Every line gets a good/bad label. Its score depends on its own features and on
those of the lines before and after it; a transition matrix couples neighbouring
labels. Forward-backward gives each line's marginal probability of being good;
the document's raw quality is their mean weighted by line length, and a logistic
map fitted on the training documents turns it into a probability.

The field is fitted on at most ``fit_docs`` labelled documents of at most
``fit_lines`` lines, taken in the order of a hash of the id: the bound is a
parameter and holds for the fit only. Every whole text is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurespark.llm.shared import _SPACE, mix64, text_chunks, word_bounds, word_hashes

FIT_DOCS, FIT_LINES = 4000, 2000
_NL = 0x0A


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = _class(bytes(range(65, 91)))
_LETTER = _UPPER | _class(bytes(range(97, 123))) | (np.arange(256) >= 128)
_DIGIT = _class(b"0123456789")
_STOP = _class(b".,;:!?'\"()-")
_SYMBOL = ~(_LETTER | _DIGIT | _STOP | _SPACE)
_BAR = _class(b"|")
_CLASSES = (_LETTER, _UPPER, _DIGIT, _STOP, _SYMBOL, _BAR)
OWN = 15                               # features of one line
WIDTH = 3 * OWN + 3                    # with its neighbours', the chain's ends and a constant


def line_features(buf: np.ndarray, offsets: np.ndarray):
    """Features of every line of a chunk, its length weight, and each document's first line."""
    docs = len(offsets) - 1
    cuts = np.flatnonzero(buf == _NL) + 1
    starts = np.concatenate([offsets[:-1], cuts])
    doc = np.concatenate([np.arange(docs), np.searchsorted(offsets, cuts - 1, side="right") - 1])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    first = np.searchsorted(doc, np.arange(docs + 1))
    ends = np.append(starts[1:], len(buf))
    size = ends - starts

    def inside(flags):
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return (total[ends] - total[starts]).astype(np.float64)

    w0, w1, _ = word_bounds(buf, offsets)
    at = np.searchsorted(w0, starts)
    words = (np.append(at[1:], len(w0)) - at).astype(np.float64)
    h = word_hashes(buf, w0, w1)
    line = np.repeat(np.arange(len(starts)), words.astype(np.int64))
    echo = np.zeros(len(h), bool)
    for back in (1, 2):
        echo[back:] |= (h[back:] == h[:-back]) & (line[back:] == line[:-back])
    echoes = np.bincount(line, weights=echo, minlength=len(starts))
    longest = np.zeros(len(starts))
    np.maximum.at(longest, line, (w1 - w0).astype(np.float64))
    twice = np.zeros(len(buf), bool)
    if len(buf):
        twice[1:] = (buf[1:] == buf[:-1]) & ~_LETTER[buf[1:]] & ~_SPACE[buf[1:]]
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=sums[1:])
    digest = mix64(sums[at + words.astype(np.int64)] - sums[at]) ^ mix64(doc.astype(np.uint64))
    _, back, count = np.unique(digest, return_inverse=True, return_counts=True)
    n, k = np.maximum(size, 1.0), np.maximum(words, 1.0)
    share = [inside(c[buf]) / n for c in _CLASSES]
    own = np.stack([
        *share, np.minimum(share[4] * 10, 1.0), inside(twice) / n, echoes / k, (echoes / k > 0.3) * 1.0,
        np.log1p(words) / 5, np.minimum(n / k, 30.0) / 10, np.minimum(longest, 60.0) / 20,
        (count[back] > 1) * (words > 0), (words < 4) * 1.0], axis=1)
    x = np.zeros((len(starts), WIDTH))
    x[:, :OWN] = own
    is_first, is_last = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    is_first[first[:-1]], is_last[first[1:] - 1] = True, True
    x[1:, OWN:2 * OWN] = own[:-1]
    x[:-1, 2 * OWN:3 * OWN] = own[1:]
    x[is_first, OWN:2 * OWN] = 0
    x[is_last, 2 * OWN:3 * OWN] = 0
    x[:, 3 * OWN], x[:, 3 * OWN + 1], x[:, 3 * OWN + 2] = is_first, is_last, 1
    return x, size + 1.0, first


@dataclass
class Model:
    weights: np.ndarray          # score of label good against bad, for each feature
    trans: np.ndarray            # (2, 2) scores of a label after a label
    slope: float
    shift: float


def _by_rank(first: np.ndarray):
    """Documents from the longest to the shortest, and how many have a line ``t``."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    alive = np.searchsorted(-n[order], -np.arange(1, (n.max() if len(n) else 0) + 1), side="right")
    return order, alive


def forward_backward(score: np.ndarray, trans: np.ndarray, first: np.ndarray):
    """Marginal P(good) of every line, and the expected count of each transition.

    All documents advance together, one line at a time, so memory follows the
    number of lines and the loop the longest document.
    """
    order, alive = _by_rank(first)
    base = first[:-1][order]
    emit = np.stack([np.zeros_like(score), score], axis=1)
    fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
    for t, m in enumerate(alive):
        at = base[:m] + t
        if t:
            fwd[at] = np.logaddexp(fwd[at - 1, :1] + trans[0], fwd[at - 1, 1:] + trans[1])
        fwd[at] += emit[at]
    for t in range(len(alive) - 2, -1, -1):
        at = base[:alive[t + 1]] + t
        nxt = bwd[at + 1] + emit[at + 1]
        bwd[at] = np.logaddexp(nxt[:, :1] + trans[:, 0], nxt[:, 1:] + trans[:, 1])
    both = fwd + bwd
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    inner = np.ones(len(score), bool)
    inner[first[:-1]] = False
    to = np.flatnonzero(inner)
    pair = fwd[to - 1][:, :, None] + trans + (bwd[to] + emit[to])[:, None, :]
    pair -= np.logaddexp(both[to, 0], both[to, 1])[:, None, None]
    return good, np.exp(np.minimum(pair, 0)).sum(axis=0)


def _document_means(good, size, first):
    return np.add.reduceat(good * size, first[:-1]) / np.add.reduceat(size, first[:-1])


def fit(x: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 150) -> Model:
    """Maximum likelihood with an L2 penalty, by Adam; every line bears its document's label."""
    if len(label) == 0 or label.min() == label.max():
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), 0.0, 0.0 if len(label) == 0 else 4.0 * (2 * label[0] - 1))
    y = np.repeat(label, np.diff(first)).astype(np.float64)
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    to = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[to - 1].astype(int), y[to].astype(int)), 1)
    per = np.diff(first)
    # a document counts once, however long: its lines share the weight
    weight = np.repeat(1 / np.maximum(per, 1), per)
    theta = np.zeros(WIDTH + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, tr = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        good, pairs = forward_backward(x @ w, tr, first)
        grad = np.concatenate([x.T @ ((good - y) * weight) / len(label),
                               ((pairs - seen) / max(len(to), 1)).ravel()]) + 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        theta -= 0.15 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    model = Model(theta[:WIDTH].copy(), theta[WIDTH:].reshape(2, 2).copy(), 1.0, 0.0)
    good, _ = forward_backward(x @ model.weights, model.trans, first)
    z = _logit(_document_means(good, size, first))
    a = b = 0.0
    for _ in range(50):                                   # Newton steps of a logistic regression on z
        p = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([((p - label) * z).sum(), (p - label).sum()]) + 1e-2 * np.array([a, b])
        s = p * (1 - p)
        hess = np.array([[(s * z * z).sum(), (s * z).sum()], [(s * z).sum(), s.sum()]]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
    model.slope, model.shift = float(a), float(b)
    return model


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def score_texts(texts, model: Model) -> np.ndarray:
    """Quality of every text of an Arrow array, from 0 to 1."""
    out = np.zeros(len(texts))
    for some, buf, offsets in text_chunks(texts):
        x, size, first = line_features(buf, offsets)
        good, _ = forward_backward(x @ model.weights, model.trans, first)
        z = model.slope * _logit(_document_means(good, size, first)) + model.shift
        out[some] = 1 / (1 + np.exp(-z))
    return out


def _held_out(id_col):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", fit_docs: int = FIT_DOCS, fit_lines: int = FIT_LINES) -> Model:
    """Fit the field on a bounded sample of labelled documents outside the held-out third.

    Held out are ids whose crc32 (of the id as text) leaves 1 modulo 3. Rows
    without id or label are left out; of several labels of an id the smallest counts.
    Without any label every score is 0.5.
    """
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")) \
        .filter(F.col("_id").isNotNull() & F.col("_label").isNotNull() & ~_held_out("_id")) \
        .groupBy("_id").agg(F.min("_label").alias("_label")) \
        .orderBy(F.xxhash64("_id"), "_id").limit(fit_docs)

    def lines(batches):
        for b in batches:
            kept = b.column(1).to_numpy(zero_copy_only=False)
            for some, buf, offsets in text_chunks(b.column(0)):
                x, size, first = line_features(buf, offsets)
                for j, i in enumerate(some):
                    lo, hi = first[j], first[j + 1]
                    if hi - lo <= fit_lines:
                        packed = np.concatenate([x[lo:hi], size[lo:hi, None]], axis=1).astype("<f4")
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([int(kept[i])], pa.int32()), pa.array([packed.tobytes()])], names=["label", "x"])

    # at most fit_docs rows of an id and a label: small enough to broadcast by construction
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")) \
        .join(F.broadcast(chosen), "_id").select("_text", "_label", "_id")
    rows = joined.mapInArrow(lines, "label int, x binary").collect()
    rows = sorted((r["label"], bytes(r["x"])) for r in rows)
    data = [np.frombuffer(x, "<f4").reshape(-1, WIDTH + 1).astype(np.float64) for _, x in rows]
    first = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(d) for d in data], out=first[1:])
    stacked = np.concatenate(data) if data else np.zeros((0, WIDTH + 1))
    label = np.array([int(y > 0) for y, _ in rows])
    return fit(stacked[:, :-1], stacked[:, -1], first, label)


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score",
                  keep_from: float | None = None) -> DataFrame:
    """``docs`` with a score column; with ``keep_from`` only rows that reach it.

    Null and empty texts are one empty line and get its score. Repeated rows
    get equal scores; an empty table stays empty.
    """
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            score = score_texts(b.column(at).cast("string"), model)
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, score_col])
            yield out if keep_from is None else out.filter(pa.array(score >= keep_from))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id", _held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
