"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

Turns get their place by range partitions sorted within (a running count over the few partitions of a conversation, then within
each), so a conversation of any length is spread over tasks. A prefix is named by running sums of two
64-bit hashes of (place, turn), taken over blocks of turns; the nodes are the groups of one name.

Contraction: each round rakes all leaves into their parents, then splices out, of every unary chain, the nodes whose
priority of the round is smaller than both neighbours' (an independent set, a third of a long chain). A spliced node leaves its own value
on the edge of its child and a record "total = value + total of the child". The rounds end when the
root is alone, after about the logarithm of the nodes; then the records are followed by doubling. Every round is a written table.

Rows: a null role or text counts as empty; rows of a null conv_id take no part; a null turn comes first; turns of one
number follow by role, then by the SHA-256 of role and text; exact repeats are turns of their own. Rows
without conversations give no nodes, not even a root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from surgelens.llm.common import schema, stored

STEP, HEADS = 5, 9
#: turns of a block of a running sum; conversation ids of a chunk of an end list (as a power of two)
BLOCK, CHUNK_BITS = 4_096, 12


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, bytes): the digest stands for role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"),
                               F.octet_length(text).cast("long").alias("bytes"))
    return out.where(F.col("conv_id").isNotNull())


def placed(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Add ``place`` (from 1) of each row of a key, exact for keys of any size.

    Rows are range partitioned by key and order, so a large key spans partitions; numbers that rise through the sorted partitions
    give the place within one, and a running count over a key's partitions what comes before. Equal rows are dealt by a running number."""
    ranged = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(key), *order, F.col("_tie")]
    ranged = ranged.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged.drop("_tie"), "placed")
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition that the key touches
    parts = ranged.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    parts = parts.select(key, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return ranged.join(parts, [key, "_part"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv_id, place, digest, bytes) of their turns, and (conv_id, length) of all of them."""
    own = stored(placed(turns(conversations), "conv_id", [F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]).select("conv_id", "place", "digest", "bytes"), "turns")
    every = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    every = every.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).withColumn("base", F.col("conv_id") - F.col("conv_id") % STEP)
    heads = every.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    every = every.join(heads, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    every = stored(every.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "conversations")
    first = own.where(F.col("place") < HEADS).withColumnRenamed("conv_id", "base")  # at most 8 rows a conversation, for at most 5
    first = first.join(every.where("head > 0").select("conv_id", "base", "head"), "base").where("place <= head").select("conv_id", "place", "digest", "bytes")
    rest = own.join(every.select("conv_id", "h", "head"), "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("head")).alias("place"), "digest", "bytes")
    return first.union(rest), every.select("conv_id", "length")


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, parent_a, parent_b, bytes): each prefix of each conversation, named by its depth and two sums."""
    wide = "decimal(38,0)"
    rows = rows.select("conv_id", F.col("place").alias("depth"), "bytes", F.xxhash64("place", "digest").cast(wide).alias("x"), F.xxhash64("digest", F.lit(1), "place").cast(wide).alias("y"),
                       F.floor(F.col("place") / BLOCK).alias("block"))
    sums = rows.groupBy("conv_id", "block").agg(F.sum("x").cast(wide).alias("x"), F.sum("y").cast(wide).alias("y"))
    over = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("conv_id", "block", *[F.coalesce(F.sum(c).over(over), F.lit(0)).cast(wide).alias("b" + c) for c in "xy"])
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(base, ["conv_id", "block"])
    run = {c: (F.col("b" + c) + F.sum(c).over(inside)).cast(wide) for c in "xy"}
    rows = rows.select("conv_id", "depth", "bytes", "x", "y", run["x"].alias("sx"), run["y"].alias("sy"))
    # sums of 64-bit hashes, folded to 64 bits again
    name = lambda x, y, salt: F.xxhash64(x, y, F.lit(salt))
    up = [(F.col("s" + c) - F.col(c)).cast(wide) for c in "xy"]
    return rows.select("conv_id", "depth", name(F.col("sx"), F.col("sy"), 0).alias("a"), name(F.col("sx"), F.col("sy"), 1).alias("b"),
                       name(*up, 0).alias("parent_a"), name(*up, 1).alias("parent_b"), "bytes")


def _digest_of_ends(batches: Iterator) -> Iterator:
    """Chunks sorted by node and place: one hash per node, fed chunk by chunk."""
    import pyarrow as pa

    now, h = None, None
    for batch in batches:
        done = []
        for d, a, b, text in zip(*(batch.column(c).to_pylist() for c in ("depth", "a", "b", "text"))):
            if (d, a, b) == now:
                h.update(b",")
            else:
                if now:
                    done.append((*now, h.hexdigest()))
                now, h = (d, a, b), hashlib.sha256()
            h.update(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["depth", "a", "b", "ends_sha256"])
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, h.hexdigest())], ["depth", "a", "b", "ends_sha256"])


def ends(path: DataFrame, every: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes where a conversation ends: ids meet in chunks of bounded size, whose texts are hashed in turn."""
    last = path.select("conv_id", "depth", "a", "b").join(every.where("length > 0").select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"])
    root = every.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), *_root_name())
    chunk = F.shiftright("conv_id", CHUNK_BITS).alias("chunk")
    chunks = last.select("conv_id", "depth", "a", "b").union(root).groupBy("depth", "a", "b", chunk).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))  # 4,096 ids at most
    chunks = chunks.select("depth", "a", "b", "chunk", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("text"))
    chunks = chunks.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "chunk")
    return chunks.mapInArrow(_digest_of_ends, schema("depth long, a long, b long, ends_sha256 string"))


def _root_name() -> list[Column]:
    zero = F.lit(0).cast("decimal(38,0)")
    return [F.xxhash64(zero, zero, F.lit(0)).alias("a"), F.xxhash64(zero, zero, F.lit(1)).alias("b")]


def nodes(conversations: DataFrame) -> DataFrame:
    """The trie: (id, parent, conv_id, depth, parent_conv_id, n_convs, n_children, bytes, ends_sha256); ids are numbers of no meaning."""
    rows, every = rebuilt(conversations)
    path = stored(paths(rows), "paths")
    named = path.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"),
                                               F.min("parent_a").alias("parent_a"), F.min("parent_b").alias("parent_b"))
    none = F.lit(None).cast("long")
    root = every.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), *_root_name(), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"), none.alias("parent_a"), none.alias("parent_b"))
    named = stored(named.union(root).withColumn("id", F.monotonically_increasing_id()), "trie-named")
    up = named.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = stored(named.join(up, ["depth", "parent_a", "parent_b"], "left"), "trie-linked")
    children = linked.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    linked = linked.join(children, "id", "left").join(ends(path, every), ["depth", "a", "b"], "left")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return linked.select("id", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "bytes",
                         F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def _round(state: DataFrame, number: int, values: list[str]) -> DataFrame:
    """The state (v, p, k, per value: own and edge; k counts children) with what is raked added up, k = -1 on the leaves
    and ``gone`` on the spliced nodes."""
    below = state.where("p is not null").groupBy(F.col("p").alias("v")).agg(
        F.count_if(F.col("k") == 0).alias("raked"), F.min(F.when(F.col("k") > 0, F.col("v"))).alias("child"),
        *[F.sum(F.when(F.col("k") == 0, F.col("own_" + c) + F.col("edge_" + c))).alias("in_" + c) for c in values],
        *[F.sum(F.when(F.col("k") > 0, F.col("edge_" + c))).alias("via_" + c) for c in values])  # of the child, where one is left
    now = state.join(below, "v", "left")
    now = now.withColumn("k", F.when(F.col("k") == 0, F.lit(-1)).otherwise(F.col("k") - F.coalesce("raked", F.lit(0))))  # -1: leaves in this round
    for c in values:
        now = now.withColumn("own_" + c, F.col("own_" + c) + F.coalesce("in_" + c, F.lit(0)))
    rank = lambda c: F.xxhash64(F.lit(number), F.col(c))
    # the only child that is left is no leaf of this round, so it is the smallest one that had children
    spliced = (F.col("k") == 1) & F.col("p").isNotNull() & (rank("v") < rank("p")) & (rank("v") < rank("child"))
    now = now.withColumn("gone", F.coalesce(spliced, F.lit(False)))
    return now.select("v", "p", "k", "gone", "child", *[x + c for c in values for x in ("own_", "edge_", "via_")])


def totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(id, and per value the sum over the node's subtree) of a forest's rows (id, parent, n_children, values); long values."""
    state = tree.select(F.col("id").alias("v"), F.col("parent").alias("p"), F.col("n_children").alias("k"),
                        *[x for c in values for x in (F.col(c).alias("own_" + c), F.lit(0).cast("long").alias("edge_" + c))])
    records, number, left = None, 0, 1
    while left:
        number += 1
        seen = Observation()
        stays = (F.col("k") >= 0) & ~F.col("gone")
        now = stored(_round(state, number, values).observe(seen, F.count_if(stays).alias("left")), "trie-round")
        left = seen.get["left"]
        # leaves and the root at last have their totals; a spliced node's follows from its child's
        kept = now.where(~stays).select("v", F.when(F.col("gone"), F.col("child")).alias("next"),
                                        *[(F.col("own_" + c) + F.when(F.col("gone"), F.col("via_" + c)).otherwise(0)).alias(c) for c in values])
        records = kept if records is None else records.union(kept)
        moved = now.where("gone").select(F.col("v").alias("p"), F.col("p").alias("grand"), *[(F.col("own_" + c) + F.col("edge_" + c)).alias("add_" + c) for c in values])
        rest = now.where(stays).join(moved, "p", "left")
        state = rest.select("v", F.coalesce("grand", "p").alias("p"), "k", *[x for c in values for x in ("own_" + c, (F.col("edge_" + c) + F.coalesce("add_" + c, F.lit(0))).alias("edge_" + c))])
    return _expanded(records, values).withColumnRenamed("v", "id")


def _expanded(records: DataFrame, values: list[str]) -> DataFrame:
    """Follow "total = value + total of next" by doubling; the chains of records are no longer than the rounds."""
    missing = F.count_if(F.col("next").isNotNull()).alias("missing")
    seen = Observation()
    now = stored(records.observe(seen, missing), "trie-records")
    while seen.get["missing"]:
        open_, seen = now.where("next is not null"), Observation()
        ahead = now.select(F.col("v").alias("next"), F.col("next").alias("after"), *[F.col(c).alias("n_" + c) for c in values])
        moved = open_.join(ahead, "next").select("v", F.col("after").alias("next"), *[(F.col(c) + F.col("n_" + c)).alias(c) for c in values])
        now = stored(now.where("next is null").union(moved).observe(seen, missing), "trie-records")
    return now.drop("next")


def op12(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie."""
    tree = nodes(conversations)
    tree = tree.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes"))
    tree = stored(tree, "trie")
    summed = totals(tree, ["n_leaves", "saved_tokens"])
    out = tree.drop("n_leaves", "saved_tokens").join(summed, "id")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: the same in DuckDB: the CRC table and its use over the decimal digits, prefixes as lists of digests, subtrees as all longer prefixes
SQL = """
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, ''))::BIGINT AS bytes
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT conv_id, conv_id::VARCHAR AS s FROM turns GROUP BY 1
), crc(conv_id, s, k, v) AS (
  SELECT conv_id, s, 0, 4294967295::BIGINT FROM ids
  UNION ALL SELECT conv_id, s, k + 1, xor(v // 256, tab[xor(v % 256, ascii(s[k + 1])::BIGINT) + 1]) FROM crc, crc_table WHERE k < length(s)
), heads AS (SELECT conv_id, xor(v, 4294967295) % 9 AS h FROM crc WHERE k = length(s)
), sizes AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1
), joined AS (
  SELECT c.conv_id, h, least(h, coalesce(n, 0)) AS head FROM heads c LEFT JOIN sizes b ON b.conv_id = c.conv_id - c.conv_id % 5
), rebuilt AS (
  SELECT c.conv_id, t.place, t.digest, t.bytes FROM joined c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.place <= c.head
  UNION ALL SELECT c.conv_id, t.place - c.h + c.head, t.digest, t.bytes FROM joined c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h
), prefixes AS (
  SELECT conv_id, place AS depth, bytes, sha256(string_agg(digest, '') OVER w) AS node FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY place)
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM joined
), lengths AS (SELECT conv_id, max(depth) AS length FROM prefixes GROUP BY 1
), grouped AS (
  SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = length), '')) AS ends_sha256
  FROM prefixes JOIN lengths USING (conv_id) GROUP BY 1
), links AS (
  SELECT DISTINCT c.node, p.node AS parent FROM prefixes c JOIN prefixes p ON p.conv_id = c.conv_id AND p.depth = c.depth - 1
), children AS (SELECT parent AS node, count(*) AS n_children FROM links GROUP BY 1
), valued AS (SELECT g.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * bytes AS own FROM grouped g LEFT JOIN children USING (node)
), pairs AS (SELECT DISTINCT a.node AS top, b.node FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), summed AS (SELECT top AS node, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM pairs JOIN valued USING (node) GROUP BY 1
)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM valued v JOIN summed USING (node) LEFT JOIN links l ON l.node = v.node LEFT JOIN valued p ON p.node = l.parent
"""
