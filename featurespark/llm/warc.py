"""WARC archives of pages and a globally ordered capture index, merged from sorted runs.

Pages become gzip members of WARC 1.1 archives of a bounded size, one member a
record, so a record can be read by its offset. Equal payloads of at least
``REVISIT_BYTES`` are stored once; the others are revisit records. Reading the
archives back gives each one's captures, sorted locally by URL key and time: a
run. The runs' entries are dealt by ranges of that order, and a task merges the
pieces of all runs in its range with a loser tree. The concatenated ranges are
the capture histories of all URLs in order; the history of one URL may span
ranges, as the time and the page id are part of the order.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurespark.llm.files import read_files, write_files
from featurespark.llm.shared import materialize, scratch_path

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 8 << 20          # compressed size at which an archive is closed
RANGE_ROWS = 200_000             # index entries that one task merges
EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
CRLF = b"\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"


def _member(raw: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


_LAST = _member(b"")             # an empty member, which a reader skips, ends every archive


def url_key(url: str) -> str:
    """Sort key of a URL: host labels from the right, then path and sorted query, in lower case."""
    try:
        u = urlsplit(url.strip())
        host, port = u.hostname or "", u.port
    except ValueError:
        return url.strip().lower()
    labels = [x for x in host.lower().split(".") if x]
    if labels[:1] == ["www"]:
        labels = labels[1:]
    query = "&".join(sorted(u.query.lower().split("&"))) if u.query else ""
    return ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")" \
        + (u.path.lower() or "/") + ("?" + query if query else "")


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _date(page) -> str:
    """Capture time of a page: a second for each id after the epoch, as the table has no time."""
    at = EPOCH + dt.timedelta(seconds=(page or 0) % (1 << 31))
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page, url: str, payload: bytes, refers_to, revisit: bool) -> bytes:
    """One WARC record: HTTP head and payload, or for a revisit the head alone."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8",
                      b"Content-Length: %d" % len(payload), b"", b""])
    block = http if revisit else http + payload
    name = "" if page is None else str(page)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{name}>",
            f"WARC-Date: {_date(page)}", f"WARC-Target-URI: {_clean(url)}",
            "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(),
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>",
                 f"WARC-Refers-To-Date: {_date(refers_to)}"]
    return "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF


def records(raw: bytes):
    """(offset, length, headers, block) of every record of an archive, by the lengths it states."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        d, body, upto = zlib.decompressobj(31), [], at
        while not d.eof:
            if upto >= len(raw):
                raise ValueError(f"archive ends inside the record at {at}")
            body.append(d.decompress(view[upto:upto + (1 << 14)]))
            upto = min(upto + (1 << 14), len(raw))
        size = upto - len(d.unused_data) - at
        if any(body):
            head, _, rest = b"".join(body).partition(CRLF + CRLF)
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record at {at}")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            block = rest[:int(headers["Content-Length"])]
            if len(block) != int(headers["Content-Length"]) or rest[len(block):] != CRLF + CRLF:
                raise ValueError(f"wrong length of the record at {at}")
            yield at, size, headers, block
        at += size


class LoserTree:
    """Merges sorted lists: a match of every inner node keeps its loser, the winner goes on up."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, max(1, len(runs))
        self.at = [0] * len(runs)
        self.tree = [-1] * self.k
        for r in range(len(runs)):
            self._play(r)

    def _head(self, r):
        return self.runs[r][self.at[r]] if self.at[r] < len(self.runs[r]) else None

    def _beats(self, a, b) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None and (x is not None or a < b) or x is not None and (x, a) < (y, b)

    def _play(self, r):
        node = (r + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = r          # waits for an opponent
                return
            if self._beats(self.tree[node], r):
                self.tree[node], r = r, self.tree[node]
            node //= 2
        self.tree[0] = r

    def __iter__(self):
        while self.runs and (head := self._head(self.tree[0])) is not None:
            yield head
            r = self.tree[0]
            self.at[r] += 1
            self._play(r)


def write_archives(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a WARC record for every row under ``out``; see ``page_captures`` for the cases."""
    own = pages.select(F.col(id_col).cast("long").alias("page"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                       F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    sized = own.select("page", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")) \
        .filter(F.col("n") >= REVISIT_BYTES)
    winner = sized.groupBy("digest", "n").agg(F.max("page").alias("first"), F.min("page").alias("least"),
                                              F.count("*").alias("k"), F.count("page").alias("named")) \
        .filter("first is not null and (least < first or named < k)").select("digest", "n", "first")
    # digests that repeat are joined to narrow rows; only the list of revisits meets the payloads
    revisits = sized.join(winner, ["digest", "n"]).filter("page < first").select("page", "digest", "first").distinct()
    unnamed = winner.select("digest", "first")
    named = own.filter("page is not null").withColumn("digest", F.sha1("payload")) \
        .join(revisits, ["page", "digest"], "left")
    nameless = own.filter("page is null").withColumn("digest", F.sha1("payload")).join(unnamed, "digest", "left") \
        .withColumn("first", F.when(F.octet_length("payload") >= REVISIT_BYTES, F.col("first")))
    rows = named.unionByName(nameless).select("page", "url", "payload", "first")

    def run(batches):
        held, size = [], 0
        for b in batches:
            for page, url, payload, first in zip(*(c.to_pylist() for c in b.columns)):
                held.append(_member(record(page, url, payload, first, first is not None)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["content"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["content"])

    write_files(rows.mapInArrow(run, "content binary"), "content", out, end=_LAST)


RUN = ("urlkey string, capture_time string, page_id long, url string, archive string, offset long, length long, "
       "record_type string, refers_to long, payload_digest string, payload_bytes long")


def _page(header: str):
    text = header.strip("<>").removeprefix(_ID)
    return int(text) if text else None


def capture_runs(spark, path: str) -> DataFrame:
    """Index entries of every archive, each archive's sorted by URL key, time and page: ``RUN`` and ``seq``.

    Payloads of responses are checked against the digest their header states.
    """
    names = [x.split()[0] for x in RUN.split(", ")]

    def run(batches):
        for b in batches:
            for where, raw in zip(b.column("path").to_pylist(), b.column("content")):
                got = []
                for at, size, h, block in records(raw.as_py()):
                    head, _, payload = block.partition(CRLF + CRLF)
                    stated = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if h["WARC-Type"] == "response" and (len(payload) != stated or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"payload of {where} at {at} does not match its record")
                    refers = _page(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
                    got.append((url_key(h["WARC-Target-URI"]), h["WARC-Date"], _page(h["WARC-Record-ID"]),
                                h["WARC-Target-URI"], where, at, size, h["WARC-Type"], refers, digest, stated))
                got.sort(key=_order)
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c, t) for c, t in zip(zip(*got), _TYPES)), pa.array(range(len(got)), pa.int64())],
                        names=[*names, "seq"])

    return read_files(spark, path).mapInArrow(run, RUN + ", seq long")


_TYPES = [pa.int64() if x.split()[1] == "long" else pa.string() for x in RUN.split(", ")]


def _order(entry):
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[4], entry[5]


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All runs' entries in one global order, as ordered ranges, with ``range_no`` and ``place`` in it.

    A task holds the entries of its range only. Ranges are bounded by sampled
    values of (URL key, time, page), so a URL with very many captures is spread.
    """
    runs = materialize(runs, "runs")
    ranges = max(1, -(-runs.count() // range_rows))
    names = [x.split()[0] for x in RUN.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        no, pieces, last = TaskContext.get().partitionId(), [], None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns[:len(names)])):
                if row[4] != last:
                    pieces.append([])
                    last = row[4]
                pieces[-1].append((_order(row), row))
        out = [row for _, row in LoserTree(pieces)]
        for lo in range(0, len(out), 1 << 14):
            part = out[lo:lo + (1 << 14)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(zip(*part), _TYPES)), pa.array([no] * len(part), pa.int32()),
                 pa.array(range(lo, lo + len(part)), pa.int64())], names=[*names, "range_no", "place"])

    return runs.repartitionByRange(ranges, "urlkey", "capture_time", "page_id") \
        .sortWithinPartitions("archive", "seq").mapInArrow(run, RUN + ", range_no int, place long")


def page_captures(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """Archive ``pages`` under ``out``, read the archives back and merge their index.

    One entry for each row. Of rows with equal payloads of at least
    ``REVISIT_BYTES`` those with the largest id are responses and the others
    revisits of it; rows without an id are never the largest. A null html is an
    empty payload and a null url an empty one; control characters and blanks of a url
    are percent-encoded. Rows that repeat the largest id are all responses.
    """
    write_archives(pages, out, id_col, url_col, html_col)
    return merge_runs(capture_runs(pages.sparkSession, out))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    found = page_captures(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_path(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
w AS (SELECT payload_digest, payload_bytes, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN d.page_id < w.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id < w.first THEN w.first END AS refers_to
FROM d LEFT JOIN w USING (payload_digest, payload_bytes)
"""
