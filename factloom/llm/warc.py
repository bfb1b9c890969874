"""WARC archives, index first.

Writing: each task appends one gzip member per record to its own archive files in the shared
folder and returns an index row per record: file, offset, length, URL, digest.  A file name
holds a fresh id, so a task that runs again writes other files and only the index rows of the
attempt that succeeded count.  Which record is the response and which revisit it comes from a
grouping of digests with map-side minima; the digests that several pages share are joined back,
by broadcast if they are BROADCAST_ROWS at most, so that bodies are shuffled only beyond that.

Reading: the index rows of the wanted records are dealt by file and sorted by offset; ranges
with small gaps are read in one go, up to ``SPAN`` bytes, and every record is parsed and its
digest checked.

Defined results: null html is an empty payload; a null url is written as an empty one; line
breaks in a URL become spaces.  A repeated row of the smallest page_id is a response like the
first.  Rows without a page_id revisit the smallest page_id of an equal payload, and are
responses where none of the equal payloads has one.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ROLL_BYTES = 64 << 20
GAP, SPAN = 64 << 10, 8 << 20
LEVEL = 3
MOST_READERS = 20_000

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed; a revisit (refers_to given) keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(url.splitlines())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record: type, page_id, url, digest, refers_to, payload_bytes, payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    page = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
    revisit = named["WARC-Type"] == "revisit"
    return {
        "record_type": named["WARC-Type"],
        "page_id": page(named["WARC-Record-ID"]),
        "url": named["WARC-Target-URI"],
        "payload_digest": named["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": page(named.get("WARC-Refers-To")),
        "payload_bytes": size,
        "payload": None if revisit else payload,
    }


def base32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def _write(folder: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for b in batches:
            rows = []
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                for page_id, url, payload, sha, first in zip(*(C.text_bytes(part.column(i)) if i == 2 else part.column(i).to_pylist() for i in range(5)), strict=True):
                    if out is None:
                        name, at = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    digest = base32(sha)
                    refers = first if first is not None and first != page_id else None
                    raw = gzip.compress(record(page_id, url or "", payload, digest, refers), LEVEL, mtime=0)
                    out.write(raw)
                    rows.append((page_id, url, name, at, len(raw), digest, len(payload), "response" if refers is None else "revisit", refers))
                    at += len(raw)
                    if at >= ROLL_BYTES:
                        out.close()
                        out = None
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return run


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, revisit_bytes: int = 0) -> DataFrame:
    """Write *pages* (page_id, url, html) as archives in *folder* and return the index, itself a written table.

    Payloads of at least *revisit_bytes* bytes are written once; their copies become revisits.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    firsts = rows.where(F.octet_length("html") >= revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("held"))
    firsts = C.staged(spark, firsts.where("held > 1").select("sha", "first"), "repeated")
    joined = rows.join(F.broadcast(firsts) if firsts.count() <= C.BROADCAST_ROWS else firsts, "sha", "left").select("page_id", "url", "html", "sha", "first")
    return C.staged(spark, joined.mapInArrow(_write(folder), INDEX), "warc-index")


def ranges(rows: list[tuple[int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Coalesce (offset, length) pairs, sorted by offset, to (start, size, pairs) reads."""
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    for at, n in rows:
        if out and at - (out[-1][0] + out[-1][1]) <= gap and at + n - out[-1][0] <= span:
            start, size, held = out[-1]
            held.append((at, n))
            out[-1] = (start, max(size, at + n - start), held)
        else:
            out.append((at, n, [(at, n)]))
    return out


def _read(folder: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        name, handle = None, None
        for b in batches:
            files, offsets, lengths = (b.column(i).to_pylist() for i in range(3))
            rows, lo = [], 0
            while lo < len(files):
                hi = lo
                while hi < len(files) and files[hi] == files[lo]:
                    hi += 1
                if files[lo] != name:
                    if handle is not None:
                        handle.close()
                    name, handle = files[lo], store.open_input_file(f"{root}/{files[lo]}")
                for start, size, held in ranges(list(zip(offsets[lo:hi], lengths[lo:hi], strict=True))):
                    data = memoryview(handle.read_at(size, start))
                    for at, n in held:
                        r = parse(zlib.decompress(data[at - start : at - start + n], 31))
                        if r["payload"] is not None and base32(hashlib.sha1(r["payload"]).hexdigest()) != r["payload_digest"]:
                            raise ValueError(f"{name}: digest of the record at {at} does not hold")
                        rows.append((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
                lo = hi
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])
        if handle is not None:
            handle.close()

    return run


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that *index* rows (file, offset, length; filtered as wanted) point at.

    Index rows are small beside what they point at, so their number of partitions is set by the
    files and not left to be coalesced.
    """
    files = index.agg(F.count_distinct("file")).first()[0]
    dealt = index.select("file", "offset", "length").repartition(min(max(files, 1), MOST_READERS), "file").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read(folder), RESULT)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{C.shared_dir(spark)}/warc-{uuid.uuid4().hex[:8]}"
    return read_archives(write_archives(spark, C.table(spark, sf_dir, "pages"), folder), folder)


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, upper(sha1(h)) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first FROM d GROUP BY hex)
SELECT d.page_id, d.payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(d.hex, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) + 1 AS BIGINT), 1) FOR k IN range(0, 32)], '') AS payload_digest,
  CASE WHEN d.page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.page_id <> f.first THEN f.first END AS refers_to
FROM d JOIN f USING (hex)
"""
