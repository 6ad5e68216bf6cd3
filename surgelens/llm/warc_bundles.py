"""WARC archives as seekable Zstandard bundles.

A bundle is one file: records grouped into independent Zstandard frames, an index of the records
(JSON in a skippable frame), and the seek table of the seekable format in a last skippable frame. Any
Zstandard reader unpacks a bundle to a plain WARC file; with the seek table and the record index
one record is read by unpacking one frame. Bundles are written by Spark's own writer.

Payloads that occur before, of at least ``least`` bytes, become revisit records: the record with the largest
page_id is the response, and the others name it. Copies are found over digests alone (SHA-1 and size
of the payload); a digest with many copies may be split over tasks, as its rows meet in a plain join.

Records follow the standard: responses hold an HTTP head and the payload, a revisit names the response's record, URI and date, and every bundle
starts with a warcinfo record. A record's id is a hash of page_id, url and digest; rows that are alike in all three add the place where they
were written, so each can be reached by its own id.

Rows: null html is an empty payload; repeated rows get records and ids of their own; rows that repeat the largest page_id with the same payload are
all responses; null page_ids and urls are archived without that header, a null id is a revisit of the
payload's largest id, and where a payload has null ids only, all are responses; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surgelens.llm.common import schema, shared_folder, stored

#: fixed values of the seekable format: skippable frame of the seek table, its end mark; and a frame for the index
SEEK_MAGIC, SEEK_END, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
LEAST = 1000
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 16 << 20
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None, url: str | None, digest: str, place: str = "") -> str:
    return "<urn:uuid:%s>" % uuid.uuid5(NAMESPACE, f"{page_id} {url} {digest}{place}")


def _uri(url: str) -> str:
    return "".join(c if " " < c else "%%%02X" % ord(c) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None,
           refers_url: str | None = None, refers_name: str | None = None, place: str = "") -> tuple[str, bytes]:
    """(record id, bytes of the WARC record). A revisit has no payload of its own."""
    name = record_id(page_id, url, digest, place)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}",
             "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), f"X-Payload-Length: {size}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + _uri(url))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Refers-To-Date: {DATE}"]
        if refers_name is not None:
            lines.append(f"WARC-Refers-To: {refers_name}")
        if refers_url is not None:
            lines.append("WARC-Refers-To-Target-URI: " + _uri(refers_url))
    head = HTTP_HEAD % size
    body = head + payload if refers_to is None else head
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return name, b"\r\n".join([*(x.encode() for x in lines), b"", body, b"", b""])


def information(place: str) -> tuple[str, bytes]:
    """The warcinfo record of a bundle."""
    name, body = record_id(None, None, "", place), b"format: WARC File Format 1.1\r\nsoftware: surgelens\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return name, b"\r\n".join([*(x.encode() for x in lines), b"", body, b"", b""])


class Bundle:
    """Collects records into frames; ``close`` gives the file."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.press, self.frame_bytes = zstandard.ZstdCompressor(level=level, write_content_size=True), frame_bytes
        self.frames, self.sizes, self.index, self.open, self.held, self.packed = [], [], [], [], 0, 0

    def add(self, name: str, raw: bytes) -> None:
        if self.held and self.held + len(raw) > self.frame_bytes:
            self._end_frame()
        self.index.append((name, len(self.sizes), self.held, len(raw)))
        self.open.append(raw)
        self.held += len(raw)

    def _end_frame(self) -> None:
        frame = self.press.compress(b"".join(self.open))
        self.frames.append(frame)
        self.sizes.append((len(frame), self.held))
        self.packed, self.open, self.held = self.packed + len(frame), [], 0

    def close(self) -> bytes:
        if self.held:
            self._end_frame()
        index = self.press.compress(json.dumps([(n[10:-1], f, o, s) for n, f, o, s in self.index]).encode())
        index = struct.pack("<II", INDEX_MAGIC, len(index)) + index
        entries = b"".join(struct.pack("<II", *s) for s in [*self.sizes, (len(index), 0)])
        foot = struct.pack("<IBI", len(self.sizes) + 1, 0, SEEK_END)
        return b"".join([*self.frames, index, struct.pack("<II", SEEK_MAGIC, len(entries) + len(foot)), entries, foot])


class BundleReader:
    """Reads a bundle: all records in order, or one by its id through seek table and index."""

    def __init__(self, raw: bytes):
        import zstandard

        self.raw, self.unpack = raw, zstandard.ZstdDecompressor()
        n, _, end = struct.unpack("<IBI", raw[-9:])
        if end != SEEK_END:
            raise ValueError("no seek table")
        table, at, self.frames = raw[-9 - 8 * n:-9], 0, []
        for packed, size in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, size))
            at += packed
        at, packed, _ = self.frames.pop()
        index = json.loads(self.unpack.decompress(raw[at + 8:at + packed]))
        self.where = {f"<urn:uuid:{name}>": (frame, offset, size) for name, frame, offset, size in index}
        self.order = [(frame, offset, size) for _, frame, offset, size in index]

    def frame(self, k: int) -> bytes:
        at, packed, size = self.frames[k]
        return self.unpack.decompress(self.raw[at:at + packed], max_output_size=size)

    def one(self, name: str) -> bytes:
        frame, offset, size = self.where[name]
        return self.frame(frame)[offset:offset + size]

    def __iter__(self) -> Iterator[bytes]:
        last, body = -1, b""
        for frame, offset, size in self.order:
            if frame != last:
                last, body = frame, self.frame(frame)
            yield body[offset:offset + size]


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields of one record, and its payload: what follows the HTTP head, or the whole block of other types."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    block = rest[:n]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["Content-Type"].startswith("application/http") else block


def _bundles(frame_bytes: int, bundle_bytes: int):
    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, seq, bundle, size, place = TaskContext.get().partitionId(), 0, None, 0, 0
        for b in batches:
            for i in range(b.num_rows):  # one row at a time: pages may be long
                page_id, url, html, digest, n, response, to_url, alike, to_alike = (b.column(c)[i].as_py() for c in ROW)
                if bundle is None:
                    bundle, size, place = Bundle(frame_bytes), 0, 0
                    bundle.add(*information(f" {task} {seq}"))
                place += 1
                target = None if response is None or to_alike else record_id(response, to_url, digest)
                name, raw = record(page_id, url, html or b"", digest, n, response, to_url, target, f" {task} {seq} {place}" if alike else "")
                bundle.add(name, raw)
                size += len(raw)
                if size >= bundle_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([bundle.close()[:-1]], pa.binary())], ["file"])
                    bundle, seq = None, seq + 1
        if bundle:
            yield pa.RecordBatch.from_arrays([pa.array([bundle.close()[:-1]], pa.binary())], ["file"])

    return write


ROW = ("page_id", "url", "html", "digest", "n", "response", "to_url", "alike", "to_alike")


def write_warc(pages: DataFrame, path: str, least: int = LEAST, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"n": F.length("html").cast("long"), "digest": F.sha1("html")})
    # per payload: how often, the response (largest page_id, then url), and whether any of its rows are alike
    each = rows.groupBy("digest", "n", "page_id", "url").agg(F.count("*").alias("c"))
    last = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.col("url").isNotNull().alias("u"), "url", (F.col("c") > 1).alias("twice")))).alias("last")
    copies = each.groupBy("digest", "n").agg(F.sum("c").alias("copies"), F.max("c").alias("most"), last).where(F.col("copies") > 1)
    named = (F.col("n") >= least) & F.col("last").isNotNull()
    pick = lambda c: F.when(named, F.col(f"last.{c}"))
    copies = copies.where(named | (F.col("most") > 1)).select(F.col("digest").alias("d"), pick("page_id").alias("response"), pick("url").alias("to_url"), pick("twice").alias("to_alike"), (F.col("most") > 1).alias("alike"))
    told = rows.join(stored(copies, "warc-copies"), F.col("digest") == F.col("d"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    # the response's own id stays plain, so that revisits can name it, unless it is repeated itself
    plain = F.col("page_id").eqNullSafe(F.col("response")) & F.col("url").eqNullSafe(F.col("to_url")) & ~F.coalesce("to_alike", F.lit(False))
    # a revisit carries no payload, so it need not travel to the task that writes it
    told = told.select("page_id", "url", F.when(F.col("response").isNull() | refers.isNull(), F.col("html")).alias("html"), "digest", "n", refers.alias("response"), "to_url",
                       (F.coalesce("alike", F.lit(False)) & ~plain).alias("alike"), F.coalesce("to_alike", F.lit(False)).alias("to_alike"))
    (told.mapInArrow(_bundles(frame_bytes, bundle_bytes), "file binary").select(F.col("file").cast("string"))
     .write.option("maxRecordsPerFile", 1).option("lineSep", "\x8f").option("encoding", "ISO-8859-1").text(path))


def _records(batches: Iterator) -> Iterator:
    import hashlib

    import pyarrow as pa

    number = lambda x: None if x is None else int(x)
    for b in batches:
        for content in b.column("content"):
            out = []
            for raw in BundleReader(content.as_py()):
                h, payload = parsed(raw)
                if h["WARC-Type"] == "warcinfo":
                    continue
                digest = base64.b32decode(h["WARC-Payload-Digest"][5:]).hex()
                if h["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(h["X-Payload-Length"])):
                    raise ValueError("a payload does not match its digest")
                out.append((number(h.get("X-Page-Id")), int(h["X-Payload-Length"]), digest, h["WARC-Type"], number(h.get("X-Refers-To-Page-Id"))))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    return files.mapInArrow(_records, schema("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"))


def op5(spark: SparkSession, pages: DataFrame) -> DataFrame:
    path = shared_folder(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS last FROM d GROUP BY ALL HAVING count(*) > 1 AND payload_bytes >= 1000)
SELECT d.page_id, d.payload_bytes, d.payload_digest, CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND d.payload_bytes = g.payload_bytes
"""
