"""Token ids in byte or bit planes: fixed-size blocks of ids are transposed into planes, each
plane is compressed with zstandard, and a chunk index tells where each block's planes lie.

File, little-endian but for the tail::

    b"IDPLANE1"
    planes of block 0, block 1, ...        zstandard frames; a plane of zeros takes no bytes
    chunk index                            per block: offset, first id, ids, bytes of each plane
    document table                         per document: id, has an id, ids
    header (JSON)                          block size, plane kind, width, sizes of the two tables
    tail (24 + 8 bytes, big-endian)        task, file of the task, ids, length of the header; b"IDPLANE\\x8f"

``write_ids`` sorts documents by id over range partitions and writes files of a bounded number
of ids through Spark's own writer, so a failed or repeated task leaves no half file.
``read_ids`` reads them back. Rows: null text counts as empty (its only id is the end id), a null
doc_id comes first and stays null, repeated rows are written each, an empty table gives no file
rows; further columns are ignored. A document of any length lies in one file.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surgelens.llm.common import schema, shared_folder, stored, text_rows, text_slices
from surgelens.llm.word_encoder import default_vocabulary, encoder

MAGIC, TAIL = b"IDPLANE1", b"IDPLANE\x8f"
BLOCK = 65_536
#: a file is closed when it holds so many ids
FILE_IDS = 4_000_000
INDEX = np.dtype([("offset", "<u8"), ("first", "<u8"), ("ids", "<u4"), ("sizes", "<u4", (32,))])


def to_planes(ids: np.ndarray, kind: str) -> np.ndarray:
    """(planes, bytes) of one block: byte planes or bit planes, lowest first."""
    octets = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return np.ascontiguousarray(octets.T)
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little")


def from_planes(planes: np.ndarray, n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.ascontiguousarray(planes.T).view("<u4").ravel()
    bits = np.unpackbits(planes, axis=1, bitorder="little")[:, :n]
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u4").ravel()


def encode_file(ids: np.ndarray, docs: list[tuple[int | None, int]], task: int, seq: int, block: int = BLOCK, kind: str = "byte", level: int = 3) -> bytes:
    import zstandard

    press, width = zstandard.ZstdCompressor(level=level), 4 if kind == "byte" else 32
    out, at = [MAGIC], len(MAGIC)
    index = np.zeros(-(-len(ids) // block), INDEX)
    for k in range(len(index)):
        part = ids[k * block:(k + 1) * block]
        index[k]["offset"], index[k]["first"], index[k]["ids"] = at, k * block, len(part)
        for p, plane in enumerate(to_planes(part, kind)):
            frame = press.compress(plane.tobytes()) if plane.any() else b""
            index[k]["sizes"][p] = len(frame)
            out.append(frame)
            at += len(frame)
    table = np.array([0 if d is None else d for d, _ in docs], "<i8").tobytes() + np.array([d is not None for d, _ in docs], np.uint8).tobytes() + np.array([n for _, n in docs], "<u8").tobytes()
    parts = [press.compress(index.tobytes()), press.compress(table)]
    head = json.dumps({"block": block, "kind": kind, "width": width, "documents": len(docs), "blocks": len(index), "index": len(parts[0]), "table": len(parts[1])}).encode()
    return b"".join([*out, *parts, head, struct.pack(">IIQQ", task, seq, len(ids), len(head)), TAIL])


class PlaneFile:
    """Reads one file; ``ids(a, b)`` opens only the blocks that the range touches."""

    def __init__(self, raw: bytes):
        import zstandard

        if raw[:8] != MAGIC or raw[-8:] != TAIL:
            raise ValueError("not a plane file")
        self.raw, self._open = raw, zstandard.ZstdDecompressor()
        self.task, self.seq, self.n, size = struct.unpack(">IIQQ", raw[-32:-8])
        head = self.head = json.loads(raw[-32 - size:-32])
        at = len(raw) - 32 - size - head["table"]
        table = self._open.decompress(raw[at:at + head["table"]], max_output_size=17 * head["documents"] + 1)
        n = head["documents"]
        known = np.frombuffer(table, np.uint8, n, 8 * n).astype(bool)
        self.doc_ids = np.frombuffer(table, "<i8", n)
        self.known, self.lengths = known, np.frombuffer(table, "<u8", n, 9 * n).astype(np.int64)
        index = self._open.decompress(raw[at - head["index"]:at], max_output_size=INDEX.itemsize * head["blocks"] + 1)
        self.index = np.frombuffer(index, INDEX)

    def block(self, k: int) -> np.ndarray:
        row, kind = self.index[k], self.head["kind"]
        n, at = int(row["ids"]), int(row["offset"])
        planes = np.zeros((self.head["width"], n if kind == "byte" else -(-n // 8)), np.uint8)
        for p in range(self.head["width"]):
            size = int(row["sizes"][p])
            if size:
                planes[p] = np.frombuffer(self._open.decompress(self.raw[at:at + size]), np.uint8)
            at += size
        return from_planes(planes, n, kind)

    def ids(self, start: int, end: int) -> np.ndarray:
        b = self.head["block"]
        if end <= start:
            return np.zeros(0, "<u4")
        first = start // b
        whole = np.concatenate([self.block(k) for k in range(first, (end - 1) // b + 1)])
        return whole[start - first * b:end - first * b]


def _file_writer(vocabulary: str, end_id: int, file_ids: int, block: int, kind: str):
    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc, task = encoder(vocabulary), TaskContext.get().partitionId()
        end, parts, docs, held, seq = np.array([end_id], enc.dtype).tobytes(), [], [], 0, 0

        def close() -> pa.RecordBatch:
            raw = encode_file(np.frombuffer(b"".join(parts), enc.dtype), docs, task, seq, block, kind)
            return pa.RecordBatch.from_arrays([pa.array([raw[:-1]], pa.large_binary() if len(raw) > 2**31 - 9 else pa.binary())], ["file"])

        for some in text_slices(batches):
            rows = zip(some.column("doc_id").to_pylist(), enc.encode_many(some.column("text").to_pylist()))
            for doc_id, ids in rows:
                parts.append(ids)
                parts.append(end)
                n = len(ids) // enc.dtype.itemsize + 1
                docs.append((doc_id, n))
                held += n
                if held >= file_ids:
                    yield close()
                    parts, docs, held, seq = [], [], 0, seq + 1
        if docs:
            yield close()

    return write


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1, file_ids: int = FILE_IDS, block: int = BLOCK, kind: str = "byte") -> None:
    """Tokenise whole texts, append ``end_id`` to each document, write plane files in ascending doc_id order."""
    writer = _file_writer(vocabulary or default_vocabulary(), end_id, file_ids, block, kind)
    rows = text_rows(docs).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    # the text writer puts bytes as they are; the tail's last byte is its line end, and each row its own file
    (rows.mapInArrow(writer, "file binary").select(F.col("file").cast("string"))
     .write.option("maxRecordsPerFile", 1).option("lineSep", TAIL[-1:].decode("latin-1")).option("encoding", "ISO-8859-1").text(path))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(task, seq, n_ids, content): the files with what their tails say."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    number = lambda at, size: F.conv(F.hex(F.substring("content", at, size)), 16, 10).cast("long")
    return files.select(number(-32, 4).alias("task"), number(-28, 4).alias("seq"), number(-24, 8).alias("n_ids"), "content")


def _read_documents(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for task, seq, content in zip(*(batch.column(c).to_pylist() for c in ("task", "seq", "content"))):
            f = PlaneFile(content)
            ends = np.cumsum(f.lengths)
            crcs, b, have, at = np.zeros(len(ends), np.int64), f.head["block"], np.zeros(0, "<u4"), 0
            for i, (start, end) in enumerate(zip((ends - f.lengths).tolist(), ends.tolist())):
                if end > at + len(have):  # decode on, keep what this document still needs
                    k = (at + len(have)) // b
                    have, at = np.concatenate([have[start - at:], *(f.block(j) for j in range(k, (end - 1) // b + 1))]), start
                crcs[i] = zlib.crc32(have[start - at:end - at].tobytes())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(ends), task)), pa.array(np.full(len(ends), seq)), pa.array(f.doc_ids.astype(np.int64), mask=~f.known),
                pa.array(ends - f.lengths), pa.array(f.lengths), pa.array(crcs)], ["task", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone. The files are read once: what
    their documents say is written, and the files' offsets are sums of it."""
    files = read_files(spark, path)
    rows = stored(files.select("task", "seq", "content").mapInArrow(_read_documents, schema("task long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")), "ids-documents")
    # one row per file of millions of ids
    before = Window.orderBy("task", "seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("task", "seq").agg(F.sum("n_tokens").alias("n"))
    offsets = sizes.select("task", "seq", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(offsets, ["task", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op2(spark: SparkSession, docs: DataFrame, end_id: int = 1) -> DataFrame:
    path = shared_folder(spark, "token-planes")
    write_ids(docs, path, end_id=end_id)
    return read_ids(spark, path)
