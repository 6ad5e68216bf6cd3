"""SimHash near-duplicates with BK-trees over shards of fingerprints.

A fingerprint has 64 bits; two within 3 bits agree in one of four blocks of 16 bits at least. So
each distinct fingerprint goes to four shards (block, value), and a shard's task builds a BK-tree:
children hang at their Hamming distance from the parent, and a search follows only the edges
within the radius of the distance at hand. Trees are not broadcast, as a tree of all documents has
no size bound: tree and searches of one shard meet in its task. A shard over ``SHARD`` entries is dealt anew
by the blocks of its other bits (48, then 36, then 27), where the same argument holds, so no shard
grows with the corpus and no link is lost. A shard emits one edge per member to a member of
its group, never all pairs; components follow from the edges.

Rows: null and wordless texts have fingerprint zero and link like any other; null doc_ids take
part, and a component of null ids only has a null component_id; repeated rows are copies of each other;
an empty table gives no rows; further columns are ignored by ``linked`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surgelens.llm.common import fresh, row_key, schema, stored, text_rows, text_slices
from surgelens.llm.components import components

SEED, SHINGLE, RADIUS, BLOCKS = 42, 3, 3, 4
#: entries of a shard that is not dealt anew
SHARD = 200
#: bits of a block, by level: a quarter of the bits that are left
WIDTHS = (16, 12, 9, 7)


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The unsigned fingerprint: majority of the bits of all word shingles, repeats included."""
    import xxhash

    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return 0
    whole = b" ".join(words)
    if n <= size:
        hashes = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate([[0], ends[:n - size]]).tolist()
        call = xxhash.xxh64_intdigest
        hashes = [call(whole[s:e], SEED) for s, e in zip(starts, (ends[size - 1:] - 1).tolist())]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        some = np.array(hashes[at:at + 65_536], ">u8")
        bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def _fingerprints(size: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for some in text_slices(batches):
            prints = np.array([fingerprint(t, size) for t in some.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([some.column(c) for c in some.schema.names if c != "text"] + [pa.array(prints)], [c for c in some.schema.names if c != "text"] + ["fp"])

    return run


class BKTree:
    """Children keyed by their distance from the parent."""

    def __init__(self, first: int):
        self.prints, self.children = [first], [{}]

    def within(self, x: int, radius: int) -> list[int]:
        """Positions of the entries within the radius, following only edges that can lead there."""
        found, stack, prints, children = [], [0], self.prints, self.children
        while stack:
            i = stack.pop()
            d = (prints[i] ^ x).bit_count()
            if d <= radius:
                found.append(i)
            kids = children[i]
            if kids:
                stack.extend([kids[e] for e in range(d - radius, d + radius + 1) if e in kids])
        return found

    def add(self, x: int) -> int:
        i = 0
        while True:
            d = (self.prints[i] ^ x).bit_count()
            nxt = self.children[i].get(d)
            if nxt is None:
                self.children[i][d] = len(self.prints)
                self.prints.append(x)
                self.children.append({})
                return len(self.prints) - 1
            i = nxt


def shard_links(prints: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (fingerprint, first of its group) that connect what is within the radius in one shard."""
    if len(prints) == 2:
        return [(prints[1], prints[0])] if (prints[0] ^ prints[1]).bit_count() <= radius else []
    tree, group = BKTree(prints[0]), [0]

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for x in prints[1:]:
        near = tree.within(x, radius)
        me = tree.add(x)
        group.append(me)
        for i in near:
            a, b = top(i), top(me)
            group[max(a, b)] = min(a, b)
    return [(p, prints[top(i)]) for i, p in enumerate(prints) if top(i) != i]


def _shard_edges(batches: Iterator) -> Iterator:
    """Rows (shard, fp) sorted by shard: a shard's rows follow each other, also over batches."""
    import pyarrow as pa

    shard, prints, out = None, [], []
    for b in batches:
        shards, fps = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "fp"))
        if not len(shards):
            continue
        edges = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
        fps = fps.view(np.uint64).tolist()
        for a, z in zip(edges, edges[1:]):
            if shards[a] != shard:
                if len(prints) > 1:
                    out += shard_links(prints)
                shard, prints = shards[a], []
            prints += fps[a:z]
        if len(out) > 10_000:
            yield _edge_batch(pa, out)
            out = []
    if len(prints) > 1:
        out += shard_links(prints)
    if out:
        yield _edge_batch(pa, out)


def _edge_batch(pa, edges: list[tuple[int, int]]):
    pairs = np.array(edges, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def _deal(df: DataFrame, level: int) -> DataFrame:
    """Each fingerprint to the shards of the blocks of its remaining bits."""
    w = WIDTHS[level]
    low = lambda bits: F.lit((1 << bits) - 1 if bits < 63 else 0x7FFFFFFFFFFFFFFF)
    parts = []
    for b in range(BLOCKS):
        value = F.shiftrightunsigned("rest", b * w).bitwiseAND(low(w))
        above = F.shiftleft(F.shiftrightunsigned("rest", (b + 1) * w), b * w) if (b + 1) * w < 64 else F.lit(0).cast("long")
        below = F.col("rest").bitwiseAND(low(b * w)) if b else F.lit(0).cast("long")
        parts.append(F.struct(F.xxhash64("shard", F.lit(level), F.lit(b), value).alias("shard"), above.bitwiseOR(below).alias("rest"), value.alias("value"), F.lit(b).alias("block")))
    return df.select("fp", F.explode(F.array(*parts)).alias("p")).select(F.col("p.shard").alias("shard"), F.col("p.rest").alias("rest"), "fp")


def links(prints: DataFrame, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within the radius. ``prints`` (fp long) is a written table.

    A shard's key is a hash of its path of blocks; should two paths share a key, their rows meet
    in one tree, which adds no wrong link as distances decide."""
    rows, found = prints.select(F.lit(0).cast("long").alias("shard"), F.col("fp").alias("rest"), "fp"), None
    for level in range(len(WIDTHS)):
        rows = _deal(rows, level)
        sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
        sizes = stored(sizes, "simhash-shards")
        last = level == len(WIDTHS) - 1
        ready = rows.join(sizes if last else sizes.where(F.col("n") <= shard), "shard", "left_semi").select("shard", "fp")
        part = ready.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(_shard_edges, schema("a long, b long"))
        found = part if found is None else found.union(part)
        hot = sizes.where(F.col("n") > shard)
        if last or hot.isEmpty():
            return found
        rows = stored(rows.join(hot, "shard", "left_semi"), "simhash-hot")
    return found


def component_labels(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id): for each distinct fingerprint its component's smallest fingerprint and smallest doc_id.
    ``prints`` (doc_id, fp) is a written table."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "simhash-rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    return stored(rooted.join(least, "root").select("fp", "root", "component_id"), "simhash-labels")


def linked(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document."""
    prints = stored(text_rows(docs).mapInArrow(_fingerprints(size), schema("doc_id long, fp long")), "simhash-prints")
    labels = component_labels(prints)
    return prints.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Of each component the row with the smallest doc_id (a null one last, then by text), all columns kept."""
    key, place = fresh(docs, "row_key", "row_place")
    slim = text_rows(docs).withColumn("key", row_key(F.col("doc_id"), F.col("text"))).select("doc_id", "key", "text")
    prints = stored(slim.mapInArrow(_fingerprints(size), schema("doc_id long, key binary, fp long")), "simhash-prints")
    labels = component_labels(prints)
    # per fingerprint first, so that a large group of copies meets as one row
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    best = prints.groupBy("fp").agg(F.min(order).alias("best"))
    best = best.join(labels, "fp").groupBy("root").agg(F.min("best").alias("best"))  # roots, as ids may repeat
    keepers = stored(best.select(F.col("best.key").alias(key)).distinct(), "simhash-keepers")
    rows = docs.withColumn(key, row_key(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = rows.join(keepers.hint("merge"), key, "left_semi")
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(key))).where(F.col(place) == 1).select(*docs.columns)


def op3(docs: DataFrame) -> DataFrame:
    return linked(docs)
