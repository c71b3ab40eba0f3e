"""Web archives: written with segmented records, read back by reassembly.

1. A narrow pass over the payloads' SHA-256 digests finds, of equal payloads
   of at least ``LEAST_BYTES``, the page with the smallest id: it is the
   response, the others revisit it.  The groups that have revisits are
   broadcast up to a checked number and shuffled beyond; adaptive execution
   splits a hot digest there.
2. Every page becomes a WARC/1.1 record whose block is an HTTP response in
   chunked transfer framing.  A block of more than ``SEGMENT_BYTES`` is cut
   into a first record and continuation records that name it as their origin.
   Spark's own writer stores them as gzipped files; since no record is larger
   than a segment and a file holds ``RECORDS_PER_FILE`` at most, the size of a
   file has a bound whatever the pages are.
3. Files are read whole, one task each, and parsed as a stream.  Records in
   one piece are decoded where they are read.  Only segmented ones are
   shuffled: grouped by the identifier of their origin, ordered by segment
   number, checked for gaps and against the total length, then joined, and the
   chunked framing is decoded.  A group is one record, never more.
4. A revisit gets its payload's size from the response with its digest.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.llm.common import bound_batches, materialize
from clientele.session import ensure_checkpoint_dir

#: Payloads below this size are never revisits.
LEAST_BYTES = 100
#: Block bytes of a record at most; longer blocks go on in continuation records.
SEGMENT_BYTES = 16 << 10
#: Records of a file at most: with SEGMENT_BYTES a file has 64 MB and its headers at most before compression.
RECORDS_PER_FILE = 4096
#: Bytes of a chunk of the transfer framing.
CHUNK_BYTES = 4 << 10
#: The groups of equal payloads are broadcast up to so many narrow rows.
BROADCAST_ROWS = 200_000
#: Bytes of blocks that a task hands on at once.
BATCH_BYTES = 4 << 20

#: Fixed values of the archive format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages carry no time of capture; records need one.
DATE = "1970-01-01T00:00:00Z"

_RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("origin", pa.string()),
                     ("segment", pa.int64()), ("total", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())),
                     ("block", pa.binary())])
_RECORD_DDL = ("record_id string, record_type string, origin string, segment long, total long, "
               "headers map<string,string>, block binary")


def _head(fields: list[tuple[str, object]]) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in fields if v is not None)]
    return ("\r\n".join(lines) + END).encode()


def _chunked(payload: bytes) -> bytes:
    parts = []
    for at in range(0, len(payload), CHUNK_BYTES):
        piece = payload[at:at + CHUNK_BYTES]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def _named(*parts: object) -> str:
    """A record identifier that follows from ``parts``, the same in every run of a task."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16])}>"


def _page_records(name: tuple, page_id: str | None, url: str | None, payload: bytes, digest: str,
                  refers_to: str | None, refers_url: str | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of a page, each without the line ends that close it."""
    own = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"),
           ("X-Page-ID", page_id)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        block = http + b"\r\n"
        yield _head([("WARC-Type", "revisit"), ("WARC-Record-ID", _named(*name, 1)), *own, ("WARC-Profile", PROFILE),
                     ("WARC-Refers-To-Target-URI", refers_url), ("WARC-Refers-To-Date", DATE),
                     ("X-Refers-To-Page", refers_to), kind, ("Content-Length", len(block))]) + block
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + _chunked(payload)
    origin, total = _named(*name, 1), len(block)
    pieces = [block[at:at + segment_bytes] for at in range(0, total, segment_bytes)]
    several = len(pieces) > 1
    yield _head([("WARC-Type", "response"), ("WARC-Record-ID", origin), *own, kind,
                 ("WARC-Segment-Number", 1 if several else None), ("Content-Length", len(pieces[0]))]) + pieces[0]
    for k, piece in enumerate(pieces[1:], 2):
        yield _head([("WARC-Type", "continuation"), ("WARC-Record-ID", _named(*name, k)), ("WARC-Date", DATE),
                     ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", k),
                     ("WARC-Segment-Total-Length", total if k == len(pieces) else None),
                     ("Content-Length", len(piece))]) + piece


def _first_pages(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(digest, first, first_url) of the payloads that have revisits; narrow, written."""
    return materialize(
        pages.filter(F.octet_length("payload") >= least_bytes).groupBy("digest")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count_if(F.col("id").isNull()).alias("unnamed"),
             F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("first_page"))
        .filter("first IS NOT NULL AND (last > first OR unnamed > 0)")
        .select("digest", "first", F.col("first_page.url").alias("first_url")))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least_bytes: int = LEAST_BYTES, segment_bytes: int = SEGMENT_BYTES,
                   records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``pages`` as gzipped WARC files into the folder ``path``.

    The payload is the page's text in UTF-8, a null text is an empty payload.
    Of equal payloads of at least ``least_bytes`` the page with the smallest id
    is a response and the others are revisits; a null id is larger than any
    other, so that pages without id alone are all responses.  Rows that repeat
    an id with its payload are alike: responses, or revisits of the smaller
    id.  Urls and ids are stored percent-encoded; other columns are not read.
    An empty table gives a folder without records."""
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = _first_pages(rows, least_bytes)
    few = firsts.count() <= BROADCAST_ROWS
    # the payload goes with the row: a group is small unless it has copies, and those need no payload
    joined = rows.join(F.broadcast(firsts) if few else firsts, "digest", "left")
    again = F.col("first").isNotNull() & (F.octet_length("payload") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("first"))
    planned = joined.select(F.col("id").cast("string").alias("id"), "url", "digest",
                            F.when(~again, F.col("payload")).alias("payload"),
                            F.when(again, F.col("first").cast("string")).alias("refers_to"),
                            F.when(again, F.col("first_url")).alias("refers_url"))

    def safe(text: str | None) -> str | None:
        return None if text is None else quote(text, safe="/:?&=#%")

    def records(batches):
        task, row = TaskContext.get().partitionId(), 0
        out, size = [], 0
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, digest, payload, refers_to, refers_url = values
                for record in _page_records((page_id, digest, task, row), None if page_id is None else quote(page_id, safe=""),
                                            safe(url), payload or b"", digest,
                                            None if refers_to is None else quote(refers_to, safe=""), safe(refers_url),
                                            segment_bytes):
                    out.append(record)
                    size += len(record)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                        out, size = [], 0
                row += 1
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    # a record holds whatever bytes it holds: the cast keeps them, and the writer ends each with the line ends
    (planned.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def _parse(content: bytes, where: str) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(headers in lower case, block, whether it is whole) of each record of a
    file, plain or gzipped in one or many members."""
    raw = io.BytesIO(content)
    lines = io.BufferedReader(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw, 1 << 16)
    while line := lines.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{where}: no record where one should begin: {line[:60]!r}")
        headers: dict[str, str] = {}
        while (line := lines.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers.get("content-length", "0"))
        block = lines.read(length)
        yield headers, block, len(block) == length


def read_records(spark: SparkSession, path: str, segmented: bool | None = None) -> DataFrame:
    """A row per record of the archives in ``path``: record_id, record_type,
    origin (the first record of its segments, itself included), segment
    (null for a record in one piece), total (length of all segments, on the
    last), headers and block.  ``segmented`` keeps only records in several
    pieces (True) or in one (False).  Bytes that are no record are an error; a
    block cut short by the end of its file is null."""
    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for headers, block, whole in _parse(content.as_py(), where):
                    number = headers.get("warc-segment-number")
                    if segmented is not None and segmented != (number is not None):
                        continue
                    own = headers.get("warc-record-id")
                    total = headers.get("warc-segment-total-length")
                    rows.append((own, headers.get("warc-type"), headers.get("warc-segment-origin-id", own),
                                 None if number is None else int(number), None if total is None else int(total),
                                 list(headers.items()), block if whole else None))
                    size += len(block)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)

    bound_batches(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _RECORD_DDL)


def reassembled(records: DataFrame) -> DataFrame:
    """(record_id, record_type, headers, pieces, total): records in several
    segments, grouped by their origin, pieces in the order of their numbers."""
    first = F.col("record_type") != "continuation"
    return (records.groupBy("origin")
            .agg(F.first(F.when(first, F.col("record_type")), ignorenulls=True).alias("record_type"),
                 F.first(F.when(first, F.col("headers")), ignorenulls=True).alias("headers"),
                 F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("pieces"),
                 F.max("total").alias("total"))
            .select(F.col("origin").alias("record_id"), "record_type", "headers", "pieces", "total"))


def _joined(pieces: list[dict], total: int | None) -> bytes | None:
    """The block of all pieces; None if one is missing, cut short or differs
    from another of its number, or if the total length does not hold."""
    blocks: list[bytes] = []
    for piece in pieces:
        if piece["block"] is None:
            return None
        if piece["segment"] == len(blocks) and blocks and piece["block"] == blocks[-1]:
            continue  # the same record twice
        if piece["segment"] != len(blocks) + 1:
            return None
        blocks.append(piece["block"])
    block = b"".join(blocks)
    return block if len(block) == total else None


def unchunked(body: bytes) -> bytes | None:
    """The payload of a body in chunked framing, None if the framing is broken."""
    out, at = [], 0
    while (line_end := body.find(b"\r\n", at)) >= 0:
        digits = body[at:line_end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", digits):
            return None
        size, at = int(digits, 16), line_end + 2
        if not size:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            return None
        out.append(body[at:at + size])
        at += size + 2
    return None


def http_payload(block: bytes) -> bytes | None:
    """The payload of an HTTP response; None if it is cut short or no response."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return None
    fields = dict((k.strip().lower(), v.strip().lower()) for k, _, v in
                  (line.partition(b":") for line in head.split(b"\r\n")[1:]))
    if fields.get(b"transfer-encoding") == b"chunked":
        return unchunked(body)
    if b"content-length" in fields:
        size = int(fields[b"content-length"])
        return body[:size] if len(body) >= size else None
    return body


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """A row per response or revisit record of the archives in ``path``:
    record_id, record_type, headers, payload.  The payload of a revisit is
    null, and so is one that cannot be restored in full: a segment is missing,
    the total length does not hold or the transfer framing is broken."""
    names = ["record_id", "record_type", "headers", "payload"]

    def decode(batches):
        for batch in batches:
            payloads = []
            for kind, pieces, total in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4)), strict=True):
                block = _joined(pieces, total) if kind == "response" else None
                payloads.append(None if block is None else http_payload(block))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(payloads, pa.binary())], names=names)

    one = read_records(spark, path, segmented=False).select(
        "record_id", "record_type", "headers", F.array(F.struct(F.lit(1).cast("long").alias("segment"), "block")).alias("pieces"),
        F.octet_length("block").cast("long").alias("total"))
    several = reassembled(read_records(spark, path, segmented=True))
    return one.unionByName(several).filter(F.col("record_type").isin("response", "revisit")).mapInArrow(
        decode, "record_id string, record_type string, headers map<string,string>, payload binary")


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as archives, read them back and return a row per page:
    ``id_col``, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is that of the payload read back.  A revisit has
    the digest it names and the size of its response, null if the archives lack
    that.  Rules and edge cases are those of :func:`write_archives`."""
    spark = pages.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, url_col, html_col, **options)
    kind = pages.schema[id_col].dataType
    value = lambda name: F.url_decode(F.col("headers")[name]).cast(kind)
    found = materialize(read_responses(spark, path).select(
        value("x-page-id").alias("id"), "record_type", value("x-refers-to-page").alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.regexp_replace(F.col("headers")["warc-payload-digest"], "^sha256:", ""))
        .otherwise(F.sha2("payload", 256)).alias("payload_digest")))
    responses = found.filter("record_type = 'response'")
    revisits = found.filter("record_type = 'revisit'")
    sizes = (responses.join(revisits.select("payload_digest").distinct(), "payload_digest", "left_semi")
             .groupBy("payload_digest", F.col("id").alias("refers_to")).agg(F.first("payload_bytes").alias("payload_bytes")))
    resolved = revisits.drop("payload_bytes").join(sizes, ["payload_digest", "refers_to"], "left")
    return responses.unionByName(resolved).select(
        F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_page THEN first_page END AS refers_to
FROM f
"""
