"""Operator 13: WARC archives of pages, written with deduplication, segments and chunked framing, and read back.

Writing: each row becomes a record of WARC/1.1. Of rows of equal payload that of the largest id holds the payload (``response``, an HTTP message in
chunked framing), the others refer to it (``revisit``). A block over ``segment_bytes`` is cut into segments: the record itself and ``continuation``
records, which name the first by its id. Files are written by Spark's text writer, whose line end is the end of a WARC record; they hold
about ``FILE_BYTES`` of payload each, however many there are.

Reading: archives are parsed record by record. Segments are brought together by the id of their origin, in order of their numbers, their total length is verified, and
the chunked framing is decoded as they pass, so that a payload needn't be in memory at once. Revisits are resolved through the record they refer to.

A null html is empty; payloads are compared by SHA-256. Null ids are less than all others; a payload of null ids alone has one of them as response and its revisits refer
to null. Rows that are repeated are records of their own: one is the response (or a revisit of another id), its repetitions revisits. An empty table
gives no archives and no rows; columns besides id, url and html are ignored.
"""

from __future__ import annotations

import io
import re
import uuid
from base64 import b32encode
from collections.abc import Iterator
from gzip import GzipFile
from hashlib import sha1
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import partitions_for, read_table, released, saved, shared_folder

SEGMENT_BYTES = 8192
CHUNK_BYTES = 2048
FILE_BYTES = 32 << 20
ARROW_ROWS = 64

# Fixed values of the formats.
VERSION = b"WARC/1.1"
LINE_END = b"\r\n"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"  # the tables hold no time of capture


def base32_sha1(digest: bytes) -> str:
    return b32encode(digest).decode()


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    """The same for a page wherever it is written, so that revisits can name it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest} {copy}')}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x\r\n" % len(part), part, LINE_END]
    return b"".join([*out, b"0\r\n\r\n"])


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that follow it."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return LINE_END.join([*lines, b"", block])


def segments(headers: list[tuple[str, str]], block: bytes, own_id: str, segment_bytes: int) -> Iterator[bytes]:
    """A record, as one or as a first segment and its continuations."""
    if len(block) <= segment_bytes:
        yield record(headers, block)
        return
    last = -(-len(block) // segment_bytes)
    for k in range(last):
        part = block[k * segment_bytes : (k + 1) * segment_bytes]
        if k == 0:
            yield record([*headers, ("WARC-Segment-Number", "1")], part)
            continue
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{own_id} {k}')}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own_id), ("WARC-Segment-Number", str(k + 1))]
        yield record(more + [("WARC-Segment-Total-Length", str(len(block)))] * (k + 1 == last), part)


def written_records(page_id: int | None, url: str | None, payload: bytes, copy: int, refers_to: tuple[int | None] | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page; refers_to holds the id of the page that it revisits, if it does."""
    digest = base32_sha1(sha1(payload).digest())
    own_id = record_id(page_id, digest, copy)
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", own_id), ("WARC-Date", DATE)]
    if page_id is not None:
        headers.append(("Page-ID", str(page_id)))
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Refers-To", record_id(refers_to[0], digest, 0)), ("WARC-Profile", REVISIT_PROFILE)]
        yield record(headers, REVISIT_HEAD)
    else:
        yield from segments(headers, RESPONSE_HEAD + chunked(payload), own_id, segment_bytes)


class HttpBody:
    """The payload of an HTTP message that is fed in pieces: the head is skipped, chunked framing decoded."""

    def __init__(self):
        self.rest, self.head, self.framed, self.left, self.ended = b"", True, False, 0, False

    def feed(self, data: bytes) -> bytes:
        data, out = self.rest + data, []
        if self.head:
            end = data.find(b"\r\n\r\n")
            if end < 0:
                self.rest = data
                return b""
            self.framed = re.search(rb"\r\ntransfer-encoding:[ \t]*chunked[ \t]*(?:\r|$)", data[:end], re.I) is not None
            self.head, data = False, data[end + 4 :]
        if not self.framed:
            self.rest = b""
            return data
        at = 0
        while not self.ended:
            if self.left > 2:  # of a chunk and the line end that follows it
                part = data[at : at + self.left - 2]
                out.append(part)
                at, self.left = at + len(part), self.left - len(part)
                if self.left > 2:
                    break
            if self.left:
                if len(data) < at + 2:
                    break
                if data[at : at + 2] != LINE_END:
                    raise ValueError("a chunk isn't followed by a line end")
                at, self.left = at + 2, 0
            end = data.find(LINE_END, at)
            if end < 0:
                break
            size = int(data[at:end].split(b";")[0], 16)
            at, self.left, self.ended = end + 2, size + 2 if size else 0, not size
        self.rest = b"" if self.ended else data[at:]  # trailer fields are of no use here
        return b"".join(out)

    @property
    def whole(self) -> bool:
        return not self.head and (self.ended or not self.framed)


def parsed(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line.rstrip(b"\r\n") == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != RECORD_END.encode():
            raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
        yield fields, block


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a WARC record for every row under ``path``; payloads under ``min_bytes`` are never revisits."""
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    rows = rows.withColumn("_sum", F.unhex(F.sha2("html", 256))).withColumn("_id", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    # Of each payload the largest id; of each id and payload the number of rows. Texts aren't carried.
    each = saved(rows.groupBy("_id", "_sum").agg(F.first("page_id").alias("page_id"), F.count("*").alias("_copies"), F.max(F.octet_length("html")).cast("bigint").alias("_bytes")))
    holders = each.groupBy("_sum").agg(F.max("page_id").alias("_holder"))
    decided = each.join(holders, "_sum").select("_id", "_sum", "_copies", "_holder", ((F.col("_bytes") < min_bytes) | _same(F.col("page_id"), F.col("_holder"))).alias("_holds"), (F.col("_bytes") < min_bytes).alias("_short"))
    total = each.agg(F.sum(F.col("_bytes") * F.col("_copies"))).first()[0] or 0
    files = partitions_for(spark, total, FILE_BYTES)
    joined = rows.repartition(files, "_id", "_sum").join(decided.repartition(files, "_id", "_sum").hint("shuffle_hash"), ["_id", "_sum"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}  # rows that are repeated
        for batch in batches:
            for at in range(0, len(batch), ARROW_ROWS):
                out = []
                for row in batch.slice(at, ARROW_ROWS).to_pylist():
                    copy, mark = 0, (row["page_id"], row["_sum"])
                    if row["_copies"] > 1:
                        copy = seen[mark] = seen.get(mark, -1) + 1
                    holds = row["_short"] or (row["_holds"] and copy == 0)
                    out += written_records(row["page_id"], row["url"], row["html"].encode(), copy, None if holds else (row["_holder"],), segment_bytes)
                yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    found = joined.select("page_id", "url", "html", "_sum", "_copies", "_holder", "_holds", "_short").mapInArrow(released(run), "value binary")
    found.select(F.col("value").cast("string").alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


READ = "record_id string, page_id bigint, record_type string, refers_to_id string, declared string, segment bigint, total bigint, payload_bytes bigint, payload_digest string, complete boolean, content binary"


def _own(fields: dict[str, str]) -> dict:
    return {
        "record_id": fields["warc-record-id"],
        "page_id": int(fields["page-id"]) if "page-id" in fields else None,
        "record_type": fields["warc-type"],
        "refers_to_id": fields.get("warc-refers-to"),
        "declared": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
    }


class Reassembly:
    """One record from its segments, in order."""

    def __init__(self, row: dict, payloads: bool):
        self.row, self.body, self.hash, self.bytes, self.blocks, self.next = row, HttpBody(), sha1(), 0, 0, 1
        self.total, self.parts, self.sound = None, [] if payloads else None, True

    def add(self, row: dict) -> None:
        self.sound &= row["segment"] == self.next and self.total is None
        self.next, self.total = self.next + 1, row["total"]
        if self.sound:
            self.take(row["content"])

    def take(self, block: bytes) -> None:
        self.blocks += len(block)
        try:
            part = self.body.feed(block)
        except ValueError:
            self.sound = False
            return
        self.bytes += len(part)
        self.hash.update(part)
        if self.parts is not None:
            self.parts.append(part)

    def done(self, segmented: bool = True) -> dict:
        digest = base32_sha1(self.hash.digest())
        complete = self.sound and self.body.whole and (not segmented or self.total == self.blocks) and digest == self.row["declared"]
        content = b"".join(self.parts) if self.parts is not None else None
        return {**self.row, "segment": None, "total": None, "payload_bytes": self.bytes, "payload_digest": digest, "complete": complete, "content": content}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """``record_id, page_id, record_type, refers_to_id, declared, payload_bytes, payload_digest, complete, content`` of the records under ``path``.

    content is the payload of a response (null for revisits, or if payloads aren't asked for). A record with missing or surplus segments, of another total length, with broken
    framing or of another digest than declared isn't complete.
    """
    kind = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in READ.split(", "))])
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(archive):
            for fields, block in parsed(GzipFile(fileobj=io.BytesIO(archive))):
                if fields["warc-type"] == "continuation":
                    yield {"record_id": fields["warc-segment-origin-id"], "record_type": "continuation", "segment": int(fields["warc-segment-number"]), "total": int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None, "content": block}
                elif "warc-segment-number" in fields:
                    yield {**_own(fields), "segment": int(fields["warc-segment-number"]), "content": block}
                elif fields["warc-type"] == "revisit":
                    yield {**_own(fields), "segment": 1}
                elif fields["warc-type"] == "response":
                    one = Reassembly(_own(fields), payloads)
                    one.take(block)
                    yield {**one.done(segmented=False), "segment": 1}

        for batch in batches:
            for archive in batch.column(0):
                out = []
                for row in rows(archive.as_buffer()):
                    out.append(row)
                    if len(out) == ARROW_ROWS:
                        yield pa.RecordBatch.from_pylist(out, kind)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, kind)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Reassembly | None = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["segment"] == 1 or now is None or now.row["record_id"] != row["record_id"]:
                    if now is not None:
                        out.append(now.done())
                    now = None
                    if row["record_type"] == "revisit" or row["complete"] is not None:  # whole as it was parsed
                        out.append(row)
                        continue
                    now = Reassembly(row, payloads)  # of a continuation without its first segment: never complete
                now.add(row)
            yield pa.RecordBatch.from_pylist(out, kind)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.done()], kind)

    found = files.mapInArrow(released(parse), READ).repartition("record_id").sortWithinPartitions("record_id", "segment")
    return found.mapInArrow(released(assemble), READ).drop("segment", "total")


def resolved(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of a written table of records: revisits take what they refer to."""
    held = records.where(F.col("record_type") == "response").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest", "complete")
    again = records.where(F.col("record_type") == "revisit").select("page_id", "record_type", "refers_to_id", "declared").join(held, "refers_to_id")
    sound = again.where(F.col("complete") & (F.col("declared") == F.col("payload_digest")))
    own = records.where((F.col("record_type") == "response") & F.col("complete")).withColumn("refers_to", F.lit(None).cast("bigint"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.select(*columns).unionByName(sound.select(*columns))


def op13_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as WARC archives in the shared folder and read back."""
    path = f"{shared_folder(spark)}/warc/{uuid.uuid4().hex}"
    write_archives(read_table(spark, sf_dir, "pages"), path)
    return resolved(saved(read_archives(spark, path, payloads=False)))


OP13_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), h AS (SELECT *, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS m FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + (5 * i // 4)::INT, 2))::INT >> (3 - (5 * i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM h"""
