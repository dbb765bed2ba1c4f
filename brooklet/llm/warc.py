"""WARC archives: written as text, read back through a verified chain of record boundaries.

Writing: one record per page. Spark's text writer puts the records, each a string of headers
and block, one after the other with the record end CR LF CR LF as its line separator, so the
archives go to any store Spark can write, under its commit protocol. Records with equal
payloads of REVISIT_BYTES or more are one response, of the largest page_id, and revisits
without a payload that refer to it. Files are bounded by bytes: records are written by size
class, and a file of a class holds as many as fit in ARCHIVE_BYTES at the class's largest size (a
record beyond the largest class is a file of its own).

Reading: a payload may hold anything, record headers too. Each file's task finds every
place that looks like a record and emits the offset where its successor would begin, from its
header (of any length) and length. Pointer jumping from offset 0 of each file (every offset learns
its 2^k-th successor, round by round) keeps what the chain reaches, and so rejects what merely
stands inside a payload; only what is reached is parsed and hashed. A chain that doesn't
end where its file ends is an error that names the file and offset (or, with ``strict=False``, the end of
that file's records). A file is one task's work, and one row of at most 2 GB, which Spark checks.

Defined cases: null html is an empty payload; a null or odd url gives a record without one, or
with line ends percent-encoded; equal page_ids give one record each, and the equal payloads of one
page_id are responses all, for none is larger; a null page_id gives a response without an id; an empty
table gives no file and no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES, ARCHIVE_BYTES = 1000, 64 << 20
#: Size classes of records by their upper bounds in bytes, and what a record's header takes at most, its url aside.
CLASSES, HEADER_BYTES = (1 << 12, 1 << 16, 1 << 20, 1 << 24), 1024
BROADCAST_ROWS = 1_000_000
END, MAGIC = "\r\n\r\n", b"WARC/1.1\r\n"
AFTER = END.encode() + MAGIC  # a record begins its file or follows a record end
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the WARC standard
_SCHEMA = "path string, at long, next long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, valid boolean"
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]


def _payload() -> Column:
    return F.coalesce("html", F.lit(""))


def _class() -> Column:
    """The number of size classes that a page's record can be beyond."""
    most = F.octet_length(_payload()).cast("long") + F.coalesce(F.octet_length("url"), F.lit(0)).cast("long") * 3 + HEADER_BYTES
    return sum((F.when(most >= bound, 1).otherwise(0) for bound in CLASSES), F.lit(0)).alias("class")


def decide(pages: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Pages with payload_bytes, payload_digest and refers_to. Equal payloads are found on digests
    alone; the html itself is never shuffled unless repeated payloads outgrow a broadcast."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    p = p.withColumns({"payload_bytes": F.octet_length(_payload()).cast("long"), "payload_digest": F.sha1(_payload().cast("binary"))})
    again = p.filter(f"payload_bytes >= {REVISIT_BYTES} and page_id is not null").groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), "first")
    again = scratch.cut(again, "repeated")
    few = common.if_small(again, again.count(), BROADCAST_ROWS)
    out = p.join(few, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    return out.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.expr("case when first != page_id then first end").alias("refers_to"))


def write(pages: DataFrame, path: str, scratch: common.Scratch | None = None) -> None:
    """Archives of pages(page_id, url, html) in a folder."""
    p = decide(pages, scratch or common.Scratch(pages.sparkSession, "warc"))
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(_HTTP), F.when(revisit, "").otherwise(_payload()))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value)).otherwise("")
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z"),
        line("WARC-Target-URI", uri),
        line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))),
        line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit(END), block,
    )
    # the size classes that there are, at most one row each; each is a pass that reads only its own pages further
    classes = sorted(r[0] for r in pages.select(_class()).distinct().collect()) or [0]
    for c in classes:
        here = p if len(classes) == 1 else p.filter(_class() == c)
        out = here.select(record.alias("value")).write.mode("append").option("lineSep", END)
        out.option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // CLASSES[c]) if c < len(CLASSES) else 1).text(path)


_HEADER = re.compile(rb"^([A-Za-z-]+): ?(.*)$", re.M)
_PAGE = re.compile(rb"<urn:page:(-?\d+)>")
_LENGTH = re.compile(rb"\r\ncontent-length: *([0-9]{1,18}) *\r\n", re.I)


def candidates(raw: bytes) -> Iterator[tuple[int, int, int]]:
    """(offset, start of the block, offset of the successor) of every place that looks like a record."""
    at = 0 if raw.startswith(MAGIC) else raw.find(AFTER)
    while at >= 0:  # a header of any length, which ends before the next candidate
        at += 4 * raw.startswith(AFTER, at)
        head = raw.find(b"\r\n\r\n", at)
        if head < 0:
            return
        length = _LENGTH.search(raw, at + len(MAGIC) - 2, head + 2)
        if length:
            stop = head + 4 + int(length[1])
            if raw[stop : stop + 4] == b"\r\n\r\n":
                yield at, head + 4, stop + 4
        at = raw.find(AFTER, at)


def _record(path: str, raw: bytes, at: int, start: int, after: int) -> tuple:
    found = {k.lower(): v.strip() for k, v in _HEADER.findall(raw[at + len(MAGIC) : start - 4].replace(b"\r\n", b"\n"))}
    http = raw.find(b"\r\n\r\n", start, after - 4)
    body = memoryview(raw)[http + 4 if http >= 0 else start : after - 4]
    page, refers = _PAGE.match(found.get(b"warc-record-id", b"")), _PAGE.match(found.get(b"warc-refers-to", b""))
    digest, size, kind = hashlib.sha1(body).hexdigest(), len(body), found.get(b"warc-type", b"").decode("utf-8", "replace")
    told = found.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("utf-8", "replace")
    if kind == "revisit":
        length = found.get(b"warc-payload-length", b"")
        digest, size = told, int(length) if length.isdigit() else 0
    return path, at, after, page and int(page[1]), kind, refers and int(refers[1]), size, digest, digest == told


def _records(batches: Iterator[pa.RecordBatch], strict: bool) -> Iterator[pa.RecordBatch]:
    """The records of whole archives (path, content) that their chains reach."""
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    for b in batches:
        for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = data.as_buffer().to_pybytes()
            found = np.array(list(candidates(raw)), dtype=np.int64).reshape(-1, 3)
            found = found[reached(found[:, 0], found[:, 2])]
            end = int(found[:, 2].max()) if len(found) else 0
            if strict and end != len(raw):
                raise ValueError(f"{path}: the record chain ends at {end} of {len(raw)} bytes")
            for part in range(0, len(found), common.BATCH_ROWS):
                cols = zip(*(_record(path, raw, *map(int, x)) for x in found[part : part + common.BATCH_ROWS]), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names)
            del raw


def reached(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Which candidate offsets a chain from offset 0 reaches: pointer jumping, log2(n) rounds."""
    order = np.argsort(at, kind="stable")
    pos = at[order]
    n = len(pos)
    to = np.searchsorted(pos, nxt[order])
    to[(to >= n) | (pos[np.minimum(to, n - 1)] != nxt[order])] = n  # no candidate there: the end
    jump = np.append(to, n)
    on = np.zeros(n + 1, dtype=bool)
    if n and pos[0] == 0:
        on[0] = True
    while True:
        more = on.copy()
        more[jump[on]] = True
        if (more == on).all():
            break
        on, jump = more, jump[jump]
    out = np.zeros(n, dtype=bool)
    out[order] = on[:n]
    return out


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The reachable records of all archives in a folder (see _SCHEMA)."""
    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    return archives.mapInArrow(lambda b: _records(b, strict), _SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "warc")
    write(common.read(spark, sf_dir, "pages"), out := scratch.path("archives"), scratch)
    got = read(spark, out)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to, TRUE AS valid
FROM g
"""
