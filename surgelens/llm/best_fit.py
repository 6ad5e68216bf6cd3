"""Best-fit decreasing over the whole corpus with a segment tree of remaining capacities.

Pieces of one length are alike, so the packing is decided on the histogram of lengths, which has
at most ``capacity`` entries whatever the corpus: lengths fall, and each piece goes to the open
bin that it leaves tightest, found in the segment tree in logarithmic time. A run of equal pieces
that meets a run of equal bins is placed in one step; the outcome is that of best-fit decreasing
piece by piece. The plan's steps give, for the k-th piece of a length, its bin and place. Ranks
within a length are taken over salted groups of bounded size, so no length is a hot key.

Rows: null text is empty (its only id is the end id); a null doc_id stays null; repeated rows are
packed each; an empty table packs to no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surgelens.llm.common import schema, stored, text_rows, text_slices
from surgelens.llm.word_encoder import default_vocabulary, encoder

CAPACITY = 2048
#: pieces of a length that one salted group holds on average
GROUP = 500
#: groups of a block of one length
BLOCK = 4_096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Slack:
    """Segment tree over remaining capacities 0..capacity: is a bin open there?"""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.base)

    def put(self, r: int, is_open: bool) -> None:
        i = self.base + r
        self.some[i] = is_open
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] | self.some[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` with an open bin."""
        i = self.base + least
        if i >= 2 * self.base:
            return None
        if self.some[i]:
            return least
        while i > 1:  # up until a right neighbour has one, then down to its first
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.base
            i //= 2
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Steps (length, rank, bins, per_bin, bin, place): ranks rank .. rank + bins * per_bin - 1 of
    a length fill consecutive bins with per_bin pieces each, from a place on."""
    tree, held, steps, made = Slack(capacity), {}, [], 0

    def add(r: int, first: int, n: int) -> None:
        if n and r:
            q = held.setdefault(r, deque())
            q.append((first, n))
            tree.put(r, True)

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} ids cannot be packed into {capacity}")
        left, rank = histogram[length], 0
        while left:
            r = tree.tightest(length)
            if r is None:
                n = -(-left // (capacity // length))
                add(capacity, made, n)
                made, r = made + n, capacity
            first, n = held[r].popleft()
            fits = r // length
            full = min(n, left // fits)
            if full:
                steps.append((length, rank, full, fits, first, capacity - r))
                add(r - fits * length, first, full)
                rank, left, first, n = rank + full * fits, left - full * fits, first + full, n - full
            if n and 0 < left < fits:
                steps.append((length, rank, 1, left, first, capacity - r))
                add(r - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            if n:
                held[r].appendleft((first, n))
            tree.put(r, bool(held[r]))
    return np.array(steps, np.int64).reshape(-1, 6)


def _piece_maker(vocabulary: str, end_id: int, capacity: int):
    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        for some in text_slices(batches):
            out = []
            for doc_id, raw in zip(some.column("doc_id").to_pylist(), enc.encode_many(some.column("text").to_pylist())):
                ids = np.frombuffer(raw + end, enc.dtype).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at:at + capacity]
                    out.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Tokenised documents with the end id, those over the capacity cut; one row per piece."""
    return text_rows(docs).mapInArrow(_piece_maker(vocabulary or default_vocabulary(), end_id, capacity), schema(PIECES))


def _placer(steps: np.ndarray):
    starts = steps[:, 0] << 44 | steps[:, 1]
    order = np.argsort(starts)
    starts, steps = starts[order], steps[order]

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
                s = steps[np.searchsorted(starts, length << 44 | rank, side="right") - 1]
                k = rank - s[:, 1]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(s[:, 4] + k // s[:, 3]), pa.array(s[:, 5] + k % s[:, 3] * length)], names + ["sequence_id", "offset"])

    return place


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces with their sequence_id and offset. ``cut`` must be a written table."""
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    steps = plan(counts, capacity)
    salts = F.split(F.lit(",".join(str(-(-counts.get(n, 1) // group)) for n in range(capacity + 1))), ",")  # constant, by length
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts[F.col("length").cast("int")].cast("long")))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # most pieces of long texts share one length, so its groups are summed over blocks of groups first, then within each block
    sizes = stored(sizes.withColumn("block", F.floor(F.col("salt") / BLOCK)), "pack-groups")
    over = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy("length", "block").agg(F.sum("n").alias("n")).select("length", "block", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "block").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "block", "salt", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inside")).join(blocks, ["length", "block"])
    bases = stored(bases.select("length", "salt", (F.col("before") + F.col("inside")).alias("base")), "pack-bases")
    inner = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("k", F.row_number().over(inner)).join(bases, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("k") - 1).alias("rank"))
    return ranked.mapInArrow(_placer(steps), schema(PIECES + ", sequence_id long, offset long"))


def op4(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(stored(pieces(docs, capacity=capacity), "pack-pieces"), capacity)
