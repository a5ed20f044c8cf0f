import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward_rows, frame, prose

from featurespark.llm import files, warc, wavelet
from featurespark.llm.shared import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n,high", [(0, 3), (1, 0), (1000, 1), (1536, 50256), (5000, 300)])
def test_wavelet_matrix(n, high):
    rng = np.random.default_rng(n)
    a = rng.integers(0, high + 1, n).astype(np.uint16)
    _, ids, lengths, m = wavelet.unpack(wavelet.pack(1, 2, [5, None], [n, 0], a, 16) + b"\n")
    assert ids == [5, None] and lengths.tolist() == [n, 0]
    assert m.values().tolist() == a.tolist()
    if n:
        assert m.access(np.arange(n)).tolist() == a.tolist()
    for v in {0, high, *a[:5].tolist()}:
        at = np.flatnonzero(a == v)
        assert m.count(v) == len(at) and m.count(v, n // 2) == (a[:n // 2] == v).sum()
        for k in {0, len(at) // 2, len(at) - 1} & set(range(len(at))):
            assert m.locate(v, k) == at[k]
        with pytest.raises(IndexError):
            m.locate(v, len(at))


ODD = ["", " ", "a", "  a", "a  b", "a \n b", "\n\na", "a\n\n", "it's they'll 'tis x'y", "don't,stop.", "a b", "a   b",
       "x y", "<|endoftext|>", "a<|endoftext|> b", "tab\tx", "\t\tx", "…,", "é, è.\nÈ", "12,5% of $3.50!", "日本語 テキスト。次",
       "👍🏽 ok", "\x1c\x1dx", "a\u0085b", "---\n---", "word%%% junk*** a|b | c", "\r\nline\r\n", "x ' y", "'s's", "éa", "　x"]


def test_encoder_matches_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(1)
    texts = ODD + [r[1] or "" for r in awkward_rows()]
    pieces = ["the", "é", " ", "  ", "\n", "\t", ",", ".", "'s", "'", "12", " ", "—", "X", "it'll", "ß", "|", "\r", "\x0b", "!?"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for keep in (1 << 20, 5):
        enc = wavelet.Encoder(VOCABULARY, keep)
        for lo in range(0, len(texts), 500):
            part = texts[lo:lo + 500]
            for t, ids in zip(part, enc.encode([t.encode() for t in part])):
                assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_wavelet_shards(spark):
    from tokenizers import Tokenizer

    rows = awkward_rows()
    out = scratch_path(spark, "test-wavelet")
    wavelet.write_shards(frame(spark, rows), out, VOCABULARY, shard_tokens=600, partition_rows=15)
    got = wavelet.read_documents(spark, out).orderBy("start").collect()
    plain = Tokenizer.from_file(VOCABULARY)
    start = 0
    for r, g in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), got, strict=True):
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [0]
        assert (g["id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (
            r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len({(g["partition"], g["shard"]) for g in got}) > 5
    empty = scratch_path(spark, "test-wavelet")
    wavelet.write_shards(frame(spark, []), empty, VOCABULARY)
    assert wavelet.read_documents(spark, empty).count() == 0


def page_rows():
    rng = random.Random(2)
    big = prose(rng, 400) + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, f"https://www.h{i % 5}.example.org/p{i % 3}?b=2&a=1", prose(rng, rng.randint(1, 300)) + "é") for i in range(60)]
    rows += [(100, "http://x.example/", big), (101, "http://y.example/", big), (102, "http://x.example/", big), (102, "http://x.example/", big),
             (110, "u v\r\nX: y", None), (111, None, ""), (112, "http://[bad", "short"), (113, "", "short"),
             (None, "http://n.example/", big), (None, "http://n.example/2", "z" * 2000), (120, "http://l.example/", "w" * 300_000)]
    return rows


def test_warc_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = scratch_path(spark, "test-warc")
    warc.write_archives(pages, out, archive_bytes=20_000)
    got = warc.merge_runs(warc.capture_runs(spark, out), range_rows=20).collect()
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            first[h] = max(first.get(h, i), i)
    want = sorted((str(i), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(),
                   "revisit" if h in first and first[h] != i else "response",
                   first[h] if h in first and first[h] != i else None) for i, _, h in rows)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    # the ranges one after another are in one order
    key = lambda r: (r["urlkey"], r["capture_time"], r["page_id"] is not None, r["page_id"] or 0)
    ordered = sorted(got, key=lambda r: (r["range_no"], r["place"]))
    assert [key(r) for r in ordered] == sorted(key(r) for r in got)
    assert len({r["range_no"] for r in got}) > 1 and len({r["archive"] for r in got}) > 3
    # archives are plain gzip, and offsets lead to records
    raw = {r["path"]: bytes(r["content"]) for r in files.read_files(spark, out).collect()}
    assert all(gzip.decompress(x).startswith(b"WARC/1.1\r\n") for x in raw.values())
    for r in got:
        own = gzip.decompress(raw[r["archive"]][r["offset"]:r["offset"] + r["length"]])
        assert f"<urn:page:{'' if r['page_id'] is None else r['page_id']}>".encode() in own
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.page_captures(none, scratch_path(spark, "test-warc")).count() == 0


def test_loser_tree():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randint(0, 30), j, i) for i in range(rng.randint(0, 20))) for j in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("https://www.Example.org:443/A/b?z=1&a=2#f") == "org,example)/a/b?a=2&z=1"
    assert warc.url_key("http://example.org:8080") == "org,example:8080)/"
