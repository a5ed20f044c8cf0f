"""Token ids in wavelet-matrix files: access, counting and occurrence lookup from a compressed file.

Documents are ordered by id, encoded and cut into shards of about
``shard_tokens`` ids; a document is never split. A shard's file holds, for each
bit of an id from the highest down, the plane of that bit after the ids were
stably sorted by the bits above it. With counts of ones at every ``SAMPLE`` bits
a plane answers rank and select, and the planes together answer
``access``, ``count`` and ``locate`` without the ids.

File layout, little-endian: ``MAGIC``; uint32 length of a JSON header; the header
(partition, number in it, ids, documents, bits, sizes of the parts); the
document ids (int64); a byte each for null ids; their lengths (uint64); for
each plane the zeros (uint64 in the header), the compressed bits and the
compressed samples (uint64). Bytes after the last part are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurespark.llm.files import read_files, write_files
from featurespark.llm.shared import materialize, mix64, run_hashes, scratch_path

MAGIC = b"WVMX0001"
SAMPLE = 512                 # bits between stored ranks
SHARD_TOKENS = 1 << 22
PARTITION_ROWS = 8000        # documents that are dealt to one task
ENCODED = 1 << 21            # bytes of text whose pieces are looked up together
END = 0                      # fixed value: the id that ends a document


class WaveletMatrix:
    """A sequence of unsigned integers as bit planes with rank and select."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], samples: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.samples = n, zeros, planes, samples

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        zeros, planes, samples = [], [], []
        spare = [np.empty_like(values), np.empty_like(values)]
        for level in range(bits - 1, -1, -1):
            on = (values & values.dtype.type(1 << level)).astype(bool)
            packed = np.packbits(on, bitorder="little")
            planes.append(np.concatenate([packed, np.zeros(-len(packed) % (SAMPLE // 8), np.uint8)]))
            per = np.bitwise_count(planes[-1].view(np.uint64)).reshape(-1, SAMPLE // 64).sum(axis=1, dtype=np.uint64)
            samples.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(per, dtype=np.uint64)]))
            zeros.append(len(on) - int(np.count_nonzero(on)))
            sorted_ = spare[level % 2]                      # the other one holds ``values``
            np.compress(on, values, out=sorted_[zeros[-1]:])
            np.compress(~on, values, out=sorted_[:zeros[-1]])
            values = sorted_
        return cls(len(values), zeros, planes, samples)

    def values(self) -> np.ndarray:
        """The whole sequence, by undoing the sorts from the lowest plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level, (z, plane) in enumerate(zip(self.zeros[::-1], self.planes[::-1])):
            on = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            back = np.empty_like(out)
            if z:
                np.place(back, ~on, out[:z])
            if z < self.n:
                np.place(back, on, out[z:] | kind(1 << level))
            out = back
        return out

    def _bit(self, level, at):
        return (self.planes[level][at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def rank1(self, level: int, at) -> np.ndarray:
        """Ones among the first ``at`` bits of a plane."""
        at = np.asarray(at, np.int64)
        words = self.planes[level].view(np.uint64)
        out = self.samples[level][at // SAMPLE].astype(np.int64)
        first = at // SAMPLE * (SAMPLE // 64)
        for k in range(SAMPLE // 64):
            word = first + k
            whole = word < at // 64
            some = (word == at // 64) & (at % 64 > 0)
            value = words[np.minimum(word, len(words) - 1)] if len(words) else np.zeros(at.shape, np.uint64)
            mask = (np.uint64(1) << (at % 64).astype(np.uint64)) - np.uint64(1)
            out = out + np.where(whole, np.bitwise_count(value), np.where(some, np.bitwise_count(value & mask), 0))
        return out

    def select(self, level: int, on: bool, k: int) -> int:
        """Position of the ``k``-th (from 0) one or zero of a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = int(self.rank1(level, mid + 1))
            if (ones if on else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, at) -> np.ndarray:
        at = np.asarray(at, np.int64)
        out = np.zeros(at.shape, np.int64)
        for level in range(len(self.planes)):
            on = self._bit(level, at)
            ones = self.rank1(level, at)
            out = out << 1 | on
            at = np.where(on == 1, self.zeros[level] + ones, at - ones)
        return out

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` among the first ``end`` ids stand after the last plane."""
        lo, hi = 0, end
        for level in range(len(self.planes)):
            a, b = (int(x) for x in self.rank1(level, np.array([lo, hi])))
            if value >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, value: int, end: int | None = None) -> int:
        lo, hi = self._range(value, self.n if end is None else end)
        return hi - lo

    def locate(self, value: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of ``value``."""
        lo, hi = self._range(value, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            if value >> (len(self.planes) - 1 - level) & 1:
                at = self.select(level, True, at - self.zeros[level])
            else:
                at = self.select(level, False, at)
        return at


def pack(partition: int, number: int, ids: list, lengths: list[int], tokens: np.ndarray, bits: int) -> bytes:
    matrix = WaveletMatrix.build(tokens, bits)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    parts = [np.array([0 if i is None else i for i in ids], "<i8").tobytes(),
             np.array([i is None for i in ids], np.uint8).tobytes(), np.array(lengths, "<u8").tobytes()]
    for plane, samples in zip(matrix.planes, matrix.samples):
        parts += [squeeze(plane.tobytes()), squeeze(samples.astype("<u8").tobytes())]
    header = json.dumps({"partition": partition, "number": number, "n": matrix.n, "docs": len(ids), "bits": bits,
                         "zeros": matrix.zeros, "parts": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *parts])


def unpack(raw: bytes) -> tuple[dict, list, np.ndarray, WaveletMatrix]:
    """Header, document ids, lengths and matrix of a file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    size, = struct.unpack_from("<I", raw, 8)
    header = json.loads(raw[12:12 + size])
    parts, at = [], 12 + size
    for n in header["parts"]:
        parts.append(raw[at:at + n])
        at += n
    open_ = zstandard.ZstdDecompressor().decompress
    ids = [None if none else i for i, none in zip(np.frombuffer(parts[0], "<i8").tolist(), parts[1])]
    planes = [np.frombuffer(open_(p), np.uint8) for p in parts[3::2]]
    samples = [np.frombuffer(open_(p), "<u8") for p in parts[4::2]]
    return header, ids, np.frombuffer(parts[2], "<u8"), WaveletMatrix(header["n"], header["zeros"], planes, samples)


# -- encoding ---------------------------------------------------------------------------
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_AZ = np.zeros(256, bool)
_AZ[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_QUOTE = ord("'")


class Encoder:
    """A byte-level BPE of the tokenizers library, with the ids of text pieces remembered.

    The library's pre-tokenizer cuts text at certain places whatever stands
    around them: where white space begins, between a letter and punctuation, and
    so on (``_cuts``). Text between two such places is encoded on its own, once, and
    its ids are looked up by a hash afterwards. Texts with white space outside
    ASCII, control bytes or a special token's string are encoded whole.
    """

    def __init__(self, path: str, keep: int = 1 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.kind = np.uint16 if self.bits <= 16 else np.uint32
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep = keep
        self._forget()

    def _forget(self):
        # sorted hashes with their entries: a large table, and a small one that takes what is new
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.large, self.small = none, none
        self.start, self.pool = np.zeros(1, np.int64), np.zeros(0, self.kind)

    def _entries(self, kinds: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where it is not remembered."""
        out = np.full(len(kinds), -1)
        for hashes, entries in (self.large, self.small):
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, kinds), len(hashes) - 1)
                out = np.where(hashes[at] == kinds, entries[at], out)
        return out

    @staticmethod
    def _merged(table, more):
        place = np.searchsorted(table[0], more[0])
        return np.insert(table[0], place, more[0]), np.insert(table[1], place, more[1])

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of every text, without an end id."""
        out: list = [None] * len(texts)
        plain, size = [], 0
        for i, t in enumerate(texts):
            if self._odd(t):
                out[i] = np.array(self._ids([t.decode()])[0], self.kind)
            else:
                plain.append(i)
                size += len(t)
                if size >= ENCODED:
                    self._encode_plain(texts, plain, out)
                    plain, size = [], 0
        self._encode_plain(texts, plain, out)
        return out

    def _odd(self, t: bytes) -> bool:
        if any(s in t for s in self.special):
            return True
        b = np.frombuffer(t, np.uint8)
        if ((b >= 0x1C) & (b < 0x20)).any():
            return True
        lead = np.flatnonzero((b == 0xC2) | ((b >= 0xE1) & (b <= 0xE3)))
        if not len(lead):
            return False
        x = b[lead].astype(np.int64) << 16 | b[lead + 1].astype(np.int64) << 8 | b[np.minimum(lead + 2, len(b) - 1)]
        two, three = x >> 8, x
        return bool(np.isin(two, (0xC285, 0xC2A0)).any() or np.isin(
            three, (0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080)).any())

    @staticmethod
    def _cuts(b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of pieces: places that are always a boundary of the pre-tokenizer.

        With texts put end to end, ``offsets`` are boundaries as well.
        """
        n = len(b)
        ws, az, punct = _WS[b], _AZ[b], _PUNCT[b]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        cut = edge[:n].copy()
        prev_ws = np.zeros(n, bool)
        prev_ws[1:] = ws[:-1] & ~edge[1:n]
        next_word = np.zeros(n, bool)
        next_word[:-1] = ~ws[1:] & ~edge[1:n]
        cut |= ws & ~prev_ws                                   # white space begins
        cut |= ws & next_word                                  # the last white space before a word
        cut[1:] |= ~ws[1:] & ws[:-1] & (b[:-1] != 0x20)        # a word after white space but a blank
        cut[1:] |= az[:-1] & punct[1:]                         # punctuation after a letter
        cut[1:] |= punct[:-1] & az[1:] & (b[:-1] != _QUOTE)    # a letter after punctuation
        return np.flatnonzero(cut)

    def _encode_plain(self, texts, rows, out):
        own = [texts[i] for i in rows]
        offsets = np.zeros(len(own) + 1, np.int64)
        np.cumsum([len(t) for t in own], out=offsets[1:])
        raw = b"".join(own)
        b = np.frombuffer(raw, np.uint8)
        if not len(b):
            for i in rows:
                out[i] = np.zeros(0, self.kind)
            return
        starts = self._cuts(b, offsets)
        ends = np.append(starts[1:], len(b))
        h = run_hashes(_BYTE[b], starts, ends)
        kinds, first, back = np.unique(h, return_index=True, return_inverse=True)
        entry = self._learn(raw, kinds, starts[first], ends[first])[back]
        lo, size = self.start[entry], (self.start[entry + 1] - self.start[entry])
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(lo - upto[:-1], size) + np.arange(upto[-1])]
        bounds = upto[np.searchsorted(starts, offsets)]
        for k, i in enumerate(rows):
            out[i] = ids[bounds[k]:bounds[k + 1]]

    def _learn(self, raw, kinds, starts, ends) -> np.ndarray:
        """The entries of all pieces, the new ones encoded and remembered."""
        if len(self.start) > self.keep:         # forgetting costs time only
            self._forget()
        found = self._entries(kinds)
        new = np.flatnonzero(found < 0)
        if len(new):
            got = self._ids([raw[s:e].decode() for s, e in zip(starts[new].tolist(), ends[new].tolist())])
            sizes = np.array([len(g) for g in got], np.int64)
            more = np.fromiter((x for g in got for x in g), self.kind, int(sizes.sum()))
            found[new] = np.arange(len(new)) + len(self.start) - 1
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
            self.pool = np.concatenate([self.pool, more])
            self.small = self._merged(self.small, (kinds[new], found[new]))
            if len(self.small[0]) > max(1 << 14, len(self.large[0]) // 4):
                self.large, self.small = self._merged(self.large, self.small), (kinds[:0], found[:0])
        return found


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and vocabulary, so remembered pieces serve all its tasks.

    A task has one core, so the library is told not to start threads for the others.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_shards(docs: DataFrame, out: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 shard_tokens: int = SHARD_TOKENS, partition_rows: int = PARTITION_ROWS) -> None:
    """Write the token ids of ``docs`` as wavelet-matrix files under ``out``, by ascending id.

    ``vocabulary`` is the path of a tokenizers file that every executor can read.
    Ids are integers; null ids come first, and rows that share an id are in order
    of their text. Null and empty texts are an end id alone. An empty table writes no shard.
    A shard outgrows ``shard_tokens`` only by its last document.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = max(1, -(-own.select("id").count() // partition_rows))

    def run(batches):
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        enc = encoder(vocabulary)
        ids, tokens, total, number = [], [], 0, 0

        def shard():
            lengths = [len(t) for t in tokens]
            raw = pack(partition, number, ids, lengths, np.concatenate(tokens), enc.bits)
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["content"])

        end = np.array([END], enc.kind)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                piece = b.slice(lo, 1024)
                texts = [t or b"" for t in piece.column(1).cast("binary").to_pylist()]
                for i, t in zip(piece.column(0).to_pylist(), enc.encode(texts)):
                    ids.append(i)
                    tokens.append(np.concatenate([t, end]))
                    total += len(t) + 1
                    if total >= shard_tokens:
                        yield shard()
                        ids, tokens, total, number = [], [], 0, number + 1
        if ids:
            yield shard()

    dealt = own.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    write_files(dealt.mapInArrow(run, "content binary"), "content", out)


def read_documents(spark, path: str) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32, partition, shard)`` of every document, from the files alone.

    Starts count all ids before a document: first over the partitions, then over
    the shards of a partition, then inside the shard, so no task sees more than
    totals of the others.
    """
    def run(batches):
        for b in batches:
            for raw in b.column("content"):
                header, ids, lengths, matrix = unpack(raw.as_py())
                ends = np.cumsum(lengths).astype(np.int64)
                flat = matrix.values().astype("<u4")
                starts = ends - lengths.astype(np.int64)
                crc = [zlib.crc32(flat[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts), pa.array(lengths.astype(np.int64)),
                     pa.array(crc, pa.int64()), pa.array(np.full(n, header["partition"], np.int32)),
                     pa.array(np.full(n, header["number"], np.int32))],
                    names=["id", "inner", "n_tokens", "ids_crc32", "partition", "shard"])

    found = materialize(read_files(spark, path).mapInArrow(
        run, "id long, inner long, n_tokens long, ids_crc32 long, partition int, shard int"), "documents-of-shards")
    shards = found.groupBy("partition", "shard").agg(F.sum("n_tokens").alias("n"))
    within = shards.withColumn("in_part", F.sum("n").over(Window.partitionBy("partition").orderBy("shard")) - F.col("n"))
    parts = shards.groupBy("partition").agg(F.sum("n").alias("n"))
    before = parts.select("partition", (F.sum("n").over(Window.orderBy("partition")) - F.col("n")).alias("to_part"))
    return found.join(within.drop("n"), ["partition", "shard"]).join(before, "partition") \
        .select("id", (F.col("to_part") + F.col("in_part") + F.col("inner")).alias("start"),
                "n_tokens", "ids_crc32", "partition", "shard")


def op9_wavelet(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = scratch_path(spark, "wavelet")
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, out).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32",
                                             "partition", "shard")
