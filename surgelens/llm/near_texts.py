"""Near copies by Jaccard similarity of five-word shingles: candidates share a min-hash band, the sets decide.

With ``fingerprints`` the links of ``simhash_bk`` (fingerprints within 3 bits, found by its BK-trees) count as well, all of them.
They select nothing among the others: two texts with a similarity of 0.8 differ in 7 of 64 bits in the median, and in any
number of them where one repeats a phrase or a separator, as repeats count in a fingerprint and not in the similarity. So shards are
dealt by min-hash bands of the shingle sets (``BANDS`` bands of ``ROWS`` values: a pair at 0.8 shares no band once in
about 1,500 pairs, and more alike ones more rarely still), and a shard's task compares the sets of all its members exactly.

Texts of equal word sequences are one class from the start, so copies never meet as pairs. Shards of equal
members are searched once. A shard over ``CHUNK`` classes is cut into chunks by a hash, and each pair of chunks
becomes a task's shard, so none is lost and no task grows with the corpus; what is linked already is not compared again.

Rows: null and wordless texts are one class; texts of one to four words have their word sequence as only shingle;
a null doc_id comes last in its group; repeated rows become one; an empty table gives no rows; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surgelens.llm import simhash_bk
from surgelens.llm.common import fresh, row_key, schema, stored, text_rows, text_slices
from surgelens.llm.components import components
from surgelens.llm.simhash_bk import SEED

SIZE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6
#: classes of a shard that is not cut
CHUNK = 256
#: below so many members, or above so many hashes, a shard's sets are compared pair by pair: the same edges in less time or memory
FEW, MANY = 8, 4_000_000
_DRAW = np.random.default_rng(SEED)
FACTORS = _DRAW.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _DRAW.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, A-Z lower-cased."""
    import xxhash

    words = text.encode().lower().split()
    n = len(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if n else [], np.uint64)
    whole, call = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[:n - size]]).tolist()
    return np.unique(np.fromiter((call(whole[s:e], SEED) for s, e in zip(starts, (ends[size - 1:] - 1).tolist())), np.uint64, n - size + 1))


def bands(hashes: np.ndarray) -> list[int]:
    """One signed key per band of min-hash values."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1_024):
        drawn = np.multiply.outer(FACTORS, hashes[at:at + 1_024])
        drawn += OFFSETS[:, None]
        np.minimum(least, drawn.min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sorted distinct sets reaches the bound."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if len(few) < similarity * len(many):
        return False
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    both = int((many[at] == few).sum())
    return both >= similarity * (len(a) + len(b) - both)


def _sketches(fingerprints: bool):
    """(doc_id, key, text) to (doc_id, key, cls, bands, fp); fp is null without ``fingerprints``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for some in text_slices(batches):
            texts = some.column("text").to_pylist()
            cls = [xxhash.xxh3_128_digest(b" ".join(t.encode().lower().split())) for t in texts]
            keys = [bands(shingle_set(t)) for t in texts]
            prints = pa.array(np.array([simhash_bk.fingerprint(t) for t in texts], np.uint64).view(np.int64)) if fingerprints else pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("key"), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64())), prints], ["doc_id", "key", "cls", "bands", "fp"])

    return run


def _sets(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for some in text_slices(batches):
        yield pa.RecordBatch.from_arrays([some.column("cls"), pa.array([shingle_set(t).tobytes() for t in some.column("text").to_pylist()], pa.binary())], ["cls", "hashes"])


def shard_links(rows: list[tuple], apart: bool, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Edges that connect the alike classes of one shard. ``rows`` (side, node, hashes) with side 0 first and no set
    empty; with ``apart`` only rows of different sides are compared."""
    sets, n = [r[2] for r in rows], len(rows)
    sizes, group, edges = np.array([len(h) for h in sets]), np.arange(n), []
    ends = np.cumsum(sizes)
    starts, first = ends - sizes, sum(not r[0] for r in rows)
    at_once = n >= FEW and ends[-1] <= MANY
    if at_once:
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        mark = np.zeros(len(ids), bool)
    for me in range(first if apart else 1, n):
        upto = first if apart else me
        few, many = np.minimum(sizes[:upto], sizes[me]), np.maximum(sizes[:upto], sizes[me])
        found = np.flatnonzero((group[:upto] != group[me]) & (few >= similarity * many))
        if at_once and len(found):
            mine = ids[starts[me]:ends[me]]
            mark[mine] = True
            both = np.add.reduceat(mark[ids[:ends[upto - 1]]], starts[:upto], dtype=np.int64)[found]
            mark[mine] = False
            found = found[both >= similarity * (sizes[found] + sizes[me] - both)]
        for i in found.tolist():
            if group[i] != group[me] and (at_once or alike(sets[i], sets[me], similarity)):
                group[group == group[me]] = group[i]
                edges.append((rows[me][1], rows[i][1]))
    return edges


def _shard_edges(batches: Iterator) -> Iterator:
    """Rows (shard, apart, side, node, hashes) sorted by shard and side."""
    import pyarrow as pa

    shard, apart, rows, out = None, False, [], []

    def batch(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    for b in batches:
        for s, p, side, node, hashes in zip(*(b.column(c).to_pylist() for c in ("shard", "apart", "side", "node", "hashes"))):
            if s != shard:
                out += shard_links(rows, apart) if len(rows) > 1 else []
                shard, apart, rows = s, p, []
            rows.append((side, node, np.frombuffer(hashes, np.uint64)))
        if len(out) > 10_000:
            yield batch(out)
            out = []
    out += shard_links(rows, apart) if len(rows) > 1 else []
    if out:
        yield batch(out)


def shards(classes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(shard, apart, side, node): the members of each shard that has to be searched. ``classes`` (node, bands) is a written table."""
    rows = classes.select("node", F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")).where("n > 1")
    # bands with the same members are searched once
    sizes = stored(sizes.groupBy("n", "members").agg(F.min("band").alias("band")).select("band", "n"), "near-shards")
    rows = rows.join(sizes.hint("merge"), "band").withColumn("k", F.ceil(F.col("n") / chunk).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node", "band"), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return rows.select(F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other")).alias("shard"), (F.col("mine") != F.col("other")).alias("apart"),
                       (F.col("mine") > F.col("other")).cast("int").alias("side"), "node")


def links(classes: DataFrame, texts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) of class nodes. ``classes`` (cls, node, key, bands) is written; ``texts`` (doc_id, key, text)."""
    members = stored(shards(classes, chunk), "near-members")
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("key", "node", "cls")
    wanted = stored(wanted, "near-wanted")
    shown = texts.join(wanted.select("key", "cls").hint("merge"), "key").select("cls", "text")
    sets = stored(shown.mapInArrow(_sets, schema("cls binary, hashes binary")).dropDuplicates(["cls"]).join(wanted.select("cls", "node"), "cls").select("node", "hashes"), "near-sets")
    full = members.join(sets.hint("merge"), "node")
    return full.repartition("shard").sortWithinPartitions("shard", "side").select("shard", "apart", "side", "node", "hashes").mapInArrow(_shard_edges, schema("a long, b long"))


def print_links(classes: DataFrame) -> DataFrame:
    """Edges (a, b) of class nodes whose fingerprints are equal or within the radius. ``classes`` (node, fp) is written."""
    prints = stored(classes.groupBy("fp").agg(F.min("node").alias("first")), "near-prints")
    near = simhash_bk.links(prints.select("fp"))
    end = lambda c, name: prints.select(F.col("fp").alias(c), F.col("first").alias(name))
    apart = near.join(end("a", "from"), "a").join(end("b", "to"), "b").select(F.col("from").alias("a"), F.col("to").alias("b"))
    return classes.join(prints, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).union(apart)


def one_of_each(docs: DataFrame, chunk: int = CHUNK, fingerprints: bool = False) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id (a null one last, then by text), all columns kept.
    With ``fingerprints`` texts whose SimHash fingerprints link are near copies too."""
    key, place = fresh(docs, "row_key", "row_place")
    slim = text_rows(docs).withColumn("key", row_key(F.col("doc_id"), F.col("text"))).select("doc_id", "key", "text")
    rows = slim.mapInArrow(_sketches(fingerprints), schema("doc_id long, key binary, cls binary, bands array<long>, fp long"))
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "key")
    classes = rows.groupBy("cls").agg(F.min(order).alias("best"), F.min("bands").alias("bands"), F.min("fp").alias("fp"))
    # written with a number for each class, so that links are pairs of longs
    classes = stored(classes.select("cls", F.monotonically_increasing_id().alias("node"), F.col("best.key").alias("key"), "best", "bands", "fp"), "near-classes")
    edges = links(classes, slim, chunk)
    roots = components(edges.union(print_links(classes.select("node", "fp"))) if fingerprints else edges)
    best = classes.join(roots, classes["node"] == roots["node"], "left").select(F.coalesce("root", classes["node"]).alias("root"), "best").groupBy("root").agg(F.min("best").alias("best"))
    keepers = stored(best.select(F.col("best.key").alias(key)).distinct(), "near-keepers")
    own = docs.withColumn(key, row_key(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    own = own.join(keepers.hint("merge"), key, "left_semi")
    return own.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(key))).where(F.col(place) == 1).select(*docs.columns)
