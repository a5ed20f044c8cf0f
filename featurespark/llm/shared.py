"""Helpers shared by the operators: scratch tables, word splitting and hashing in NumPy."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"       # fixed value: the word pattern of the contracts

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset a scratch folder is made, in local mode only (tests); a
    cluster without the setting is an error, never a machine-local folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (cuts the lineage)."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Removes the shuffle files of every action inside when it ends, instead of when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def set_aside(df: DataFrame) -> DataFrame:
    """All columns of ``df`` in one struct ``_aside``, so that no other name can clash with them."""
    return df.select(F.struct(*[F.col(_quoted(c)).alias(c) for c in df.columns]).alias("_aside"))


def brought_back(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The columns that ``set_aside`` put into ``_aside``, and ``more``, which replace those of their names."""
    new = {c.lower() for c in more}
    return df.select(*[F.col("_aside")[c].alias(c) for c in columns if c.lower() not in new], *more)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _PRIME)     # a random value for each byte
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))
_up = _down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) < n:
        more, one = max(n, _CHUNK), np.ones(1, np.uint64)
        _up = np.cumprod(np.concatenate([one, np.full(more, _PRIME)]), dtype=np.uint64)
        _down = np.cumprod(np.concatenate([one, np.full(more, _INVERSE)]), dtype=np.uint64)
    return _up[:n], _down[:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of ``values[s:e]`` for every pair, by prefix sums modulo 2**64."""
    up, down = _powers(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * _PRIME)


def text_chunks(texts, limit: int = _CHUNK):
    """Groups of whole documents of about ``limit`` bytes: (indices, UTF-8 bytes, offsets).

    ``texts`` is an Arrow string or binary array, whose memory the bytes share; a null
    counts as an empty text. A longer document is a chunk of its own.
    """
    own = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(own)
    if not n:
        return
    _, offsets, data = own.buffers()
    ends = np.frombuffer(offsets, np.int64)[own.offset:own.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, side="right")) - 1)
        yield range(lo, hi), buf[ends[lo]:ends[hi]], ends[lo:hi + 1] - ends[lo]
        lo = hi


def word_bounds(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE):
    """Start and end byte of every word of a chunk, and for each document its first word's index."""
    if not len(buf):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    sp = space[buf]
    first = np.empty(len(buf), bool)
    first[0] = True
    first[1:] = sp[:-1]
    inner = offsets[:-1][offsets[:-1] < len(buf)]
    first[inner] = True
    last = np.empty(len(buf), bool)
    last[-1] = True
    last[:-1] = sp[1:]
    stop = offsets[1:][offsets[1:] > 0] - 1
    last[stop] = True
    starts = np.flatnonzero(first & ~sp)
    ends = np.flatnonzero(last & ~sp) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return run_hashes(_VALUE[buf], starts, ends)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive entries of ``words``."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(k)
    return run_hashes(words, at, at + n)
