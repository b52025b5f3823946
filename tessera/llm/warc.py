"""WARC archives: writing with segmentation and chunked transfer framing, reading with reassembly.

A response longer than SEGMENT_BYTES is split into a first record and continuation records.  Reading
groups the segments by the identifier of their origin, orders them by segment number, verifies the
total length and decodes the chunked framing.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Emitter, arrow_schema, materialize, rows, scratch_path

SEGMENT_BYTES = 16384
CHUNK_BYTES = 4096
#: An archive holds so many records at most, hence at most this times (SEGMENT_BYTES + headers) bytes.
RECORDS_PER_ARCHIVE = 2000
MIN_REVISIT_BYTES = 100
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """Undoes chunked transfer framing; chunk extensions and trailers are skipped.  ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk size is missing")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            break
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2
    if body.find(b"\r\n", at) < 0:
        raise ValueError("the end of the chunks is missing")
    return b"".join(out)


def http_response(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block, with its framing undone."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("the HTTP headers don't end")
    return dechunk(body) if re.search(rb"(?mi)^transfer-encoding:.*\bchunked\b", head) else body


def record(kind: str, record_id: str, block: bytes, **headers) -> bytes:
    """A WARC record; header values that are None are left out, control characters in them percent-encoded."""
    clean = lambda v: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", str(v))
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {clean(v)}" for k, v in headers.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_records(
    record_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, segment: int = SEGMENT_BYTES, refers_url: str | None = None
) -> Iterator[bytes]:
    """The records of a page: a revisit if ``refers`` is given, else a response, in segments if it is long.

    A revisit names the page, and its URL, whose response has its payload.
    """
    common = dict(WARC_Target_URI=url, WARC_Page_ID=page_id, WARC_Payload_Digest=f"sha256:{digest}", Content_Type="application/http;msgtype=response")
    if refers is not None:
        yield record("revisit", record_id, b"HTTP/1.1 200 OK\r\n\r\n", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                     WARC_Refers_To_Target_URI=refers_url, WARC_Refers_To_Page_ID=refers, **common)
        return
    block = http_response(payload)
    if len(block) <= segment:
        yield record("response", record_id, block, **common)
        return
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield record("response", record_id, pieces[0], WARC_Segment_Number=1, **common)
    for n, piece in enumerate(pieces[1:], 2):
        own = str(uuid.uuid5(uuid.UUID(record_id), str(n)))
        total = len(block) if n == len(pieces) else None
        yield record("continuation", own, piece, WARC_Segment_Origin_ID=f"<urn:uuid:{record_id}>", WARC_Segment_Number=n, WARC_Segment_Total_Length=total)


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes pages (page_id, url, html) as gzipped archives under ``path``, through Spark's own writer.

    Of the pages with equal payloads of at least MIN_REVISIT_BYTES, that with the smallest page_id is a
    response and the others are revisits of it.  Rows that repeat that page_id are responses too; a null
    page_id is smallest only where it is the only one.
    """
    data = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    data = data.withColumn("digest", F.sha2("html", 256))
    long = data.where(F.octet_length("html") >= MIN_REVISIT_BYTES).select("digest", "page_id", "url")
    shared = long.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"), F.min_by("url", F.struct("page_id", "url")).alias("first_url"))
    shared = shared.where("n > 1").select(F.col("digest").alias("_d"), "first", "first_url")
    shared = materialize(shared, "shared")  # written, its size is known: Spark moves the payloads for the join only if it is large

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, n, part = Emitter(arrow_schema(record=pa.binary()), 512), 0, TaskContext.get().partitionId()
        for batch in batches:
            for page_id, url, html, digest, first, first_url in zip(*rows(batch, "page_id", "url", "html", "digest", "first", "first_url"), strict=True):
                n += 1
                record_id = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{digest}:{part}:{n}"))
                refers = first if first is not None and first != page_id else None
                for r in page_records(record_id, page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers, SEGMENT_BYTES, first_url):
                    e.add(r[:-2])  # the writer ends each row with the last line break
                    if e.full():
                        yield e.take()
        yield e.take()

    marked = data.join(shared, F.col("digest") == F.col("_d"), "left").select("page_id", "url", "html", "digest", "first", "first_url")
    written = marked.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    written.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(path)


def parse(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a WARC stream given in pieces.  ValueError if it is broken."""
    held = bytearray()
    more = iter(stream)

    def need(n: int) -> bool:
        while len(held) < n:
            piece = next(more, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while held[:2] == b"\r\n" or (not held and need(1)):
            if held[:2] != b"\r\n":
                break
            del held[:2]
        if not held:
            return
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not need(seen + 1):
                raise ValueError("record headers don't end")
        lines = bytes(held[:end]).split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower().decode(): v.strip().decode("utf-8", "surrogatepass") for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = int(headers["content-length"])
        if not need(end + 4 + size):
            raise ValueError("a block is cut short")
        yield headers, bytes(held[end + 4 : end + 4 + size])
        need(end + 4 + size + 4)
        del held[: end + 4 + size + 4]


def unzipped(data: bytes, piece: int = 1 << 16) -> Iterator[bytes]:
    """The content of a gzip file (of any number of members), or the data itself, in pieces."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + piece] for i in range(0, len(data), piece))
        return
    left = data
    while left:
        z = zlib.decompressobj(31)
        out = z.decompress(left, piece)
        while True:
            if out:
                yield out
            if z.eof or not (z.unconsumed_tail or out):
                break
            out = z.decompress(z.unconsumed_tail, piece)
        left = z.unused_data


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, page_id, payload_digest, payload_bytes, refers_to, status) per record, segments put together.

    ``status`` is ok, or says what is wrong: ``segments`` (a number is missing or double), ``length`` (not the
    total length), ``framing`` (chunks can't be decoded), ``digest`` (not the payload that the header names),
    ``orphan`` (continuations without their origin).  Digest and length are null unless the payload could be
    decoded; revisits carry the digest of their header.  Only the segments of split records are shuffled with
    their content.
    """
    out = arrow_schema(
        record_id=pa.string(), kind=pa.string(), page_id=pa.int64(), named=pa.string(), total=pa.int64(), number=pa.int32(), block=pa.binary(),
        digest=pa.string(), bytes=pa.int64(), refers=pa.int64(), status=pa.string(),
    )

    def decode(block: bytes, named: str | None) -> tuple[str | None, int | None, str]:
        try:
            payload = http_payload(block)
        except ValueError:
            return None, None, "framing"
        digest = hashlib.sha256(payload).hexdigest()
        return digest, len(payload), "ok" if named in (None, digest) else "digest"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Emitter(out, 256)
        for batch in batches:
            for i in range(batch.num_rows):
                for h, block in parse(unzipped(batch.column(0)[i].as_py())):
                    kind, number = h.get("warc-type", ""), h.get("warc-segment-number")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    own = h.get("warc-segment-origin-id") if kind == "continuation" else h.get("warc-record-id")
                    page = int(h["warc-page-id"]) if "warc-page-id" in h else None
                    named = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    total = int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None
                    if number is not None:
                        e.add(own, kind, page, named, total, int(number), block, None, None, None, None)
                    elif kind == "revisit":
                        refers = int(h["warc-refers-to-page-id"]) if "warc-refers-to-page-id" in h else None
                        e.add(own, kind, page, named, None, None, None, named, None, refers, "ok")
                    else:
                        digest, size, status = decode(block, named)
                        e.add(own, kind, page, named, None, None, None, digest, size, None, status)
                    if e.full():
                        yield e.take()
        yield e.take()

    records = spark.read.format("binaryFile").load(path).select("content").mapInArrow(
        run, "record_id string, kind string, page_id long, named string, total long, number int, block binary, digest string, bytes long, refers long, status string"
    )
    grouped = records.groupBy("record_id").agg(
        F.max(F.when(F.col("kind") != "continuation", F.col("kind"))).alias("kind"),
        *[F.max(c).alias(c) for c in ("page_id", "named", "total", "digest", "bytes", "refers", "status")],
        F.sort_array(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", "block")))).alias("segments"),
    )
    done = arrow_schema(record_id=pa.string(), record_type=pa.string(), page_id=pa.int64(), payload_digest=pa.string(), payload_bytes=pa.int64(), refers_to=pa.int64(), status=pa.string())

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Emitter(done)
        names = ("record_id", "kind", "page_id", "named", "total", "digest", "bytes", "refers", "status", "segments")
        for batch in batches:
            for i in range(batch.num_rows):
                own, kind, page, named, total, digest, size, refers, status, segments = (batch.column(batch.schema.get_field_index(n))[i].as_py() for n in names)
                if segments:
                    block = b"".join(s["block"] for s in segments)
                    if kind is None:
                        status = "orphan"
                    elif [s["number"] for s in segments] != list(range(1, len(segments) + 1)):
                        status = "segments"
                    elif total != len(block):
                        status = "length"
                    else:
                        digest, size, status = decode(block, named)
                e.add(own, kind, page, digest, size, refers, status)
                if e.full():
                    yield e.take()
        yield e.take()

    slim = grouped.select("record_id", "kind", "page_id", "named", "total", "digest", "bytes", "refers", "status", "segments")
    return slim.mapInArrow(put_together, "record_id string, record_type string, page_id long, payload_digest string, payload_bytes long, refers_to long, status string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives to the shared folder and reads them back: one row per page.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, status).  A null html is an empty
    payload; null page_ids and urls are left out of the headers and come back null; repeated rows are
    repeated records.  Other columns are ignored.  An empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    found = materialize(read_archives(spark, path), "records")
    whole = found.where("record_type = 'response' and status = 'ok'").groupBy(F.col("payload_digest").alias("_d"), F.col("page_id").alias("_page")).agg(
        F.max("payload_bytes").alias("_bytes")
    )
    revisit = F.col("record_type") == "revisit"
    return found.join(whole, revisit & (F.col("payload_digest") == F.col("_d")) & (F.col("refers_to") == F.col("_page")), "left").select(
        "page_id",
        F.when(revisit, F.col("_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
        F.when(revisit & F.col("_d").isNull(), "unresolved").otherwise(F.col("status")).alias("status"),
    )
