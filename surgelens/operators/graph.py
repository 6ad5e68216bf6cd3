"""Entity graph per merchant-window: components, concentration, cross-merchant reach.

Windows of a merchant are dealt to hour tiles. A tile of at most ``TILE_EDGES`` (minute, edge) rows, its own
hour and the one before, is one bounded group of numbers: for each window end, the edges of the 1, 5, 15 and 60 minute
windows join the labels in turn, newest first, each edge where it is seen last. Attempts are dealt as they are, packed (``tiles``),
and shuffled once; only where a tile's attempts could be too many, edges of repeated events collapse
first. The tiles beyond that size are spread: there a 5-minute window is the union of five 1-minute
windows, a 15-minute one of three 5-minute ones, an hour of four quarters; each level only merges the finished labels of the level below (an entity
that carries two labels links them), by rounds of joins on checkpointed tables. Both ways give the same rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from surgelens.operators import sweep, tiles
from surgelens.operators.grid import ALL_SIZES, HORIZONS, W, instant
from surgelens.operators.window_features import entity_columns, flatten, neighbour_steps
from surgelens.session import cut_lineage, hold

# Each horizon as a number of windows of a shorter one.
MERGES = {"5m": ("1m", 5), "15m": ("5m", 3), "1h": ("15m", 4)}
_PREFIX = {"cus": "CUS:", "dev": "DEV:", "ins": "INS:", "ip": "IP:"}
_PAIRS = (("cus", "dev"), ("dev", "ins"), ("cus", "ip"))  # the edges of an attempt
#: (minute, edge) rows of a tile and the hour before it that one task takes
TILE_EDGES = 3_000_000


def connected_components(edges: DataFrame, keys: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """(keys, node, component): the least node name of each component, within each key.

    Alternates the large-star and small-star steps until the edges are disjoint stars; every
    round is two grouped minima and joins on (keys, node), checkpointed.
    """
    both = edges.select(*keys, F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b")
    nodes = (edges.select(*keys, F.col(src).alias("node"))
             .unionByName(edges.select(*keys, F.col(dst).alias("node"))).distinct())
    cur = cut_lineage(both.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_stars(cur, keys):
        wide = cur.unionByName(cur.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = wide.groupBy(*keys, "a").agg(F.least(F.col("a"), F.min("b")).alias("lo"))
        large = (wide.join(least, [*keys, "a"]).filter("b > a").select(*keys, F.col("b").alias("a"), F.col("lo").alias("b")))
        large = large.filter("a <> b").distinct()
        low = large.groupBy(*keys, "a").agg(F.min("b").alias("lo"))
        small = (large.join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("lo").alias("b"))
                 .unionByName(low.select(*keys, "a", F.col("lo").alias("b"))))
        cur = cut_lineage(small.filter("a <> b").distinct())
    labels = cur.select(*keys, F.col("a").alias("node"), F.col("b").alias("component"))
    return (nodes.join(labels, [*keys, "node"], "left")
            .withColumn("component", F.coalesce("component", "node")))


def _is_stars(edges: DataFrame, keys: list[str]) -> bool:
    """Does every node either have one smaller neighbour and no larger one, or only larger ones?"""
    ends = F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                   F.struct(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    bad = (edges.select(*keys, F.explode(ends).alias("_x")).groupBy(*keys, "_x.n")
           .agg(F.sum("_x.up").alias("up"), F.max("_x.down").alias("down")).filter("up > 1 or (up = 1 and down = 1)"))
    return bad.isEmpty()


def graph_edges(events: DataFrame) -> DataFrame:
    """Undirected simple edges per (merchant, minute): CUS-DEV, DEV-INS, CUS-IP."""
    cols = {k: F.concat(F.lit(_PREFIX[k]), v) for k, v in entity_columns().items()}
    pair = lambda a, b, t: F.struct(cols[a].alias("src"), cols[b].alias("dst"), F.lit(t).alias("edge_type"))
    from surgelens.operators.grid import minute
    return (events.withColumn("m", minute("timestamp"))
            .withColumn("_e", F.explode(F.array(pair("cus", "dev", "used_device"), pair("dev", "ins", "used_card"),
                                                pair("cus", "ip", "used_ip"))))
            .select("merchant_id", "m", "_e.*").distinct())


def degrees(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges per vertex and edge type."""
    ends = (edges.select(*keys, F.col("src").alias("vertex"), "edge_type")
            .unionByName(edges.select(*keys, F.col("dst").alias("vertex"), "edge_type")))
    return ends.groupBy(*keys, "vertex", "edge_type").agg(F.count(F.lit(1)).alias("degree"))


def window_labels(flat: DataFrame, sizes: tuple[str, ...] = ALL_SIZES) -> DataFrame:
    """(W, vertex, component, first_us) for every entity of every non-empty window."""
    name = {k: F.concat(F.lit(_PREFIX[k]), F.col(k)) for k in _PREFIX}
    seen = (flat.select("merchant_id", (F.col("m") + 1).alias("end_minute"), "us",
                        F.explode(F.array(*name.values())).alias("vertex"))
            .groupBy("merchant_id", "end_minute", "vertex").agg(F.min("us").alias("first_us")))
    pairs = F.array(*[F.struct(name[a].alias("src"), name[b].alias("dst")) for a, b in _PAIRS])
    edges = (flat.select("merchant_id", (F.col("m") + 1).alias("end_minute"), F.explode(pairs).alias("_e"))
             .select("merchant_id", "end_minute", "_e.*").distinct())
    keys = ["merchant_id", "end_minute"]
    parts = connected_components(edges, keys).withColumnRenamed("node", "vertex")
    level = {"1m": hold(seen.join(parts, [*keys, "vertex"]))}
    for size, (below, k) in MERGES.items():
        if not any(HORIZONS[s] >= HORIZONS[size] for s in sizes):
            break
        late = F.explode(F.array(*[F.lit(i * HORIZONS[below]) for i in range(k)]))
        spread = level[below].withColumn("_o", late).withColumn("end_minute", F.col("end_minute") + F.col("_o"))
        per_vertex = Window.partitionBy(*keys, "vertex")
        spread = spread.withColumn("least", F.min("component").over(per_vertex))
        links = spread.filter("component <> least").select(*keys, F.col("component").alias("src"), F.col("least").alias("dst")).distinct()
        merged = connected_components(links, keys).withColumnRenamed("node", "least")
        level[size] = hold(spread.groupBy(*keys, "vertex").agg(F.min("least").alias("least"), F.min("first_us").alias("first_us"))
                           .join(merged, [*keys, "least"], "left")
                           .select(*keys, "vertex", "first_us", F.coalesce("component", "least").alias("component")))
    return reduce(DataFrame.unionByName, [level[s].select("merchant_id", F.lit(s).alias("window_size"), "end_minute",
                                                          "vertex", "component", "first_us") for s in sizes])


def cluster_features(flat: DataFrame, labels: DataFrame, sizes: tuple[str, ...]) -> DataFrame:
    """Component count, and size, share and density of the component with most entities.

    Every edge has exactly one device end or is a customer-IP edge, so a component's distinct
    edges are its devices' neighbours plus its customers' IPs.
    """
    owned = sweep.expand_steps(neighbour_steps(flat, sizes, ("dev_deg", "cus_ip")), ["merchant_id", "dim", "item"], "value")
    owned = owned.select(*W, F.concat(F.when(F.col("dim") == "dev_deg", "DEV:").otherwise("CUS:"), F.col("item")).alias("vertex"),
                         F.col("value").alias("edges"))
    comps = (labels.select(*W, "vertex", "component", "first_us", F.lit(0).cast("long").alias("edges"))
             .join(owned.withColumnRenamed("edges", "_own"), [*W, "vertex"], "left")
             .groupBy(*W, "component")
             .agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("_own"), F.lit(0)).alias("edges"), F.min("first_us").alias("first_us")))
    best = (comps.groupBy(*W)
            .agg(F.count(F.lit(1)).alias("clusters"),
                 F.max(F.struct("nodes", (-F.col("first_us")).alias("_early"), "edges")).alias("_b")))
    return best.select(*W, "clusters", "_b.nodes", "_b.edges")


def timed_edges(flat: DataFrame) -> DataFrame:
    """(merchant_id, m, src, dst, us): each edge once per minute, with its first instant; combined before the shuffle."""
    name = {k: F.concat(F.lit(_PREFIX[k]), F.col(k)) for k in _PREFIX}
    pairs = F.array(*[F.struct(name[a].alias("src"), name[b].alias("dst")) for a, b in _PAIRS])
    return (flat.select("merchant_id", "m", "us", F.explode(pairs).alias("_e"))
            .groupBy("merchant_id", "m", "_e.src", "_e.dst").agg(F.min("us").alias("us")))


def _meet(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels under which the ends of every edge agree too. A label is a vertex that carries its own name.

    Labels are hooked to smaller and larger ones in turn, so neither direction can hold up a hub's edges."""
    a, b, down = label[a], label[b], True
    while True:
        apart = a != b
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        label = label.copy()
        if down:
            label[high] = low
        else:
            label[low] = high
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        a, b, down = label[a], label[b], not down


def _ends(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
    """Both ends of every edge as numbers below the third value, of rows of edges or of attempts. A missing entity is one vertex, whatever its kind."""
    if "src" in rows.column_names:
        names = pa.chunked_array([rows.column(end).combine_chunks().cast(pa.string()) for end in ("src", "dst")]).combine_chunks()
        both, n = tiles.codes(names.dictionary_encode(null_encoding="encode"))
        return both[:rows.num_rows], both[rows.num_rows:], n
    of, vertices = {}, 1  # vertex 0: missing
    for kind in _PREFIX:
        of[kind], n = tiles.codes(rows.column(kind), null=-vertices)
        of[kind] = of[kind] + np.int32(vertices)
        vertices += n
    return tuple(np.concatenate([of[pair[end]] for pair in _PAIRS]) for end in (0, 1)) + (vertices,)


def _clusters_of_tile(sizes: tuple[str, ...]):
    """(window, clusters, nodes, edges) of every non-empty window that ends in the tile's hour."""
    ordered = tuple(s for _, s in sorted((HORIZONS[s], s) for s in sizes))

    def run(rows: pa.Table, first_end: int) -> dict[str, list]:
        m, us = (rows.column(c).to_numpy() for c in ("m", "us"))
        a, b, vertices = _ends(rows)
        if len(a) > len(m):  # attempts: three edges each
            m, us = np.tile(m, 3), np.tile(us, 3)
        by_minute = np.argsort(m, kind="stable")
        m, us, a, b = m[by_minute], us[by_minute], a[by_minute], b[by_minute]
        again, out, of = tiles.seen_again(m, a, b, vertices), [], None
        for size, end, at, upto in tiles.windows_of(m, first_end, ordered):
            if end != of:
                label, met, since, of = np.arange(vertices, dtype=a.dtype), np.zeros(vertices, bool), upto, end
            if at < since:
                last = again[at:since] >= end
                x, y = a[at:since][last], b[at:since][last]
                met[x] = met[y] = True
                label, since = _meet(label, x, y), at
            here = label[met]
            nodes = np.bincount(here, minlength=vertices)
            best = np.flatnonzero(nodes == nodes.max())  # most entities, then the earliest, then most edges
            if len(best) > 1:
                first = np.full(vertices, np.iinfo(np.int64).max)
                np.minimum.at(first, label[a[at:upto]], us[at:upto])
                best = best[first[best] == first[best].min()]
            own = np.bincount(label[a[at:upto][again[at:upto] >= end]], minlength=vertices)[best].max()
            out.append((size, end, np.count_nonzero(nodes), nodes[best[0]], own))
        return dict(zip(("window_size", "end_minute", "clusters", "nodes", "edges"), map(list, zip(*out)) if out else ([] for _ in range(5))))

    return run


def clusters(flat: DataFrame, sizes: tuple[str, ...], tile_edges: int = TILE_EDGES, packs: DataFrame | None = None) -> DataFrame:
    """(W, clusters, nodes, edges) of every non-empty window: bounded tiles in one task each, larger ones by labels.
    ``packs``: the attempts as ``tiles.packed`` makes them, if they are there already."""
    tile, total = ["merchant_id", "tile"], F.sum("n").alias("_n")
    solved = lambda packs, way=tiles.solved: way(packs, _clusters_of_tile(sizes), "clusters long, nodes long, edges long")
    packs = hold(tiles.packed(flat, tiles.ENTITIES)) if packs is None else packs
    dealt = tiles.dealt(packs)
    # an attempt has three edges: only tiles that could be too large have their edges collapsed, counted and kept
    busy = dealt.groupBy(*tile).agg(total).filter(3 * F.col("_n") > tile_edges).select(*tile)
    if busy.isEmpty():
        return solved(packs, tiles.solved_all)

    def attempts_of(some: DataFrame) -> DataFrame:
        hours = some.select("merchant_id", F.explode(F.array("tile", F.col("tile") - 1)).alias("_h")).distinct()
        return flat.withColumn("_h", F.floor(F.col("m") / tiles.TILE)).join(hours, ["merchant_id", "_h"], "left_semi").drop("_h")

    tiled = hold(tiles.dealt(tiles.packed(timed_edges(attempts_of(busy)), ("src", "dst"))).join(busy, tile, "left_semi"))
    large = tiled.groupBy(*tile).agg(total).filter(F.col("_n") > tile_edges).select(*tile)
    some = not large.isEmpty()
    small = tiled.join(large, tile, "left_anti") if some else tiled
    out = solved(dealt.join(busy, tile, "left_anti")).unionByName(solved(small))
    if some:
        part = hold(attempts_of(large))
        spread = cluster_features(part, window_labels(part, sizes), sizes).withColumn("tile", F.floor((F.col("end_minute") - 1) / tiles.TILE))
        out = out.unionByName(spread.join(large, tile, "left_semi").select(*out.columns))
    return out


def cross_merchant(flat: DataFrame, sizes: tuple[str, ...]) -> DataFrame:
    """Per window: entities also active at another merchant in the same window, and the
    largest number of merchants one of them touches. Entities of a single merchant drop out
    before any window is looked at."""
    name = F.array(*[F.concat(F.lit(_PREFIX[k]), F.col(k)) for k in _PREFIX])
    occ = flat.select("merchant_id", "m", F.explode(name).alias("vertex"))
    # a missing merchant is one of its own
    shared = hold(occ.groupBy("vertex").agg(F.min("merchant_id").alias("_lo"), F.max("merchant_id").alias("_hi"), F.count("merchant_id").alias("_known"), F.count(F.lit(1)).alias("_all"))
                  .filter("_lo <> _hi or (_known > 0 and _known < _all)").select("vertex"))
    shared.count()  # its size is known now, so that few such entities are broadcast and the attempts not shuffled for them
    occ = occ.join(shared, "vertex", "left_semi").distinct()
    keys = ["vertex", "merchant_id"]
    here = sweep.steps_from_deltas(sweep.presence_deltas(occ, keys, sizes), keys, "delta", "on", combine=False)
    active = sweep.expand_steps(here, keys, "on")
    at = ["window_size", "end_minute", "vertex"]
    reach = active.groupBy(*at).agg(F.count(F.lit(1)).alias("merchants")).filter("merchants > 1")
    return (active.join(reach, at).groupBy(*W)
            .agg(F.count(F.lit(1)).alias("cross_entities"), F.max("merchants").alias("fanout")))


def graph_features(events: DataFrame, sizes: tuple[str, ...] = ALL_SIZES, with_cross_merchant: bool = False, tile_edges: int = TILE_EDGES,
                   flat: DataFrame | None = None, packs: DataFrame | None = None) -> DataFrame:
    """The component and cross-merchant part of family J for every non-empty window. The
    rest of the family comes with ``window_features``. ``flat`` and ``packs``: the events as ``flatten`` and ``tiles.packed`` make
    them, if they are there already."""
    flat = hold(flatten(events).select("merchant_id", "m", "us", *_PREFIX)) if flat is None else flat
    per_w = clusters(flat, sizes, tile_edges, packs)
    counts = sweep.sliding_sums(flat.groupBy("merchant_id", "m").agg(F.count(F.lit(1)).alias("n")), ["merchant_id"], ["n"], sizes)
    out = per_w.join(counts, W)
    if with_cross_merchant:
        out = out.join(cross_merchant(flat, sizes), W, "left")
    else:
        out = out.withColumn("cross_entities", F.lit(0)).withColumn("fanout", F.lit(1))
    n, e, nodes = F.col("n"), F.col("edges").cast("double"), F.col("nodes")
    density = e / F.greatest(F.lit(1), nodes)
    return out.select(
        "merchant_id", "window_size", instant("end_minute").alias("window_end"),
        F.col("clusters").cast("double").alias("J_cluster_count"), e.alias("J_largest_cluster_size"),
        F.least(F.lit(1.0), e / F.greatest(F.lit(1), n)).alias("J_largest_cluster_vol_share"),
        density.alias("J_cluster_density"),
        F.when(nodes > 2, density / F.greatest(F.lit(1.0), (nodes - 1) / 2.0)).otherwise(0.0).alias("J_cluster_density_z"),
        F.coalesce("cross_entities", F.lit(0)).cast("double").alias("J_cross_merchant_entities"),
        F.coalesce("fanout", F.lit(1)).cast("double").alias("J_cross_merchant_fanout_max"),
        F.lit(0.0).alias("J_shared_address_clusters"))


def entity_payload(events: DataFrame, keys: list[str], max_nodes: int = 50) -> tuple[DataFrame, DataFrame]:
    """Graph payload per key: the first ``max_nodes`` vertices in arrival order (customer,
    device, instrument, IP of each attempt) and the edges among them."""
    txn = F.col("transaction_id")
    anon = F.concat(F.lit("anon_"), txn)
    ids = [("customer", F.concat(F.lit("CUS:"), F.coalesce("customer_id", anon))),
           ("device", F.concat(F.lit("DEV:"), F.coalesce("device_fp", anon))),
           ("instrument", F.concat(F.lit("INS:"), F.col("instrument_fp"))),
           ("ip", F.concat(F.lit("IP:"), F.coalesce("ip_fp", anon)))]
    rows = F.array(*[F.struct(F.struct(F.unix_micros("timestamp").alias("us"), txn.alias("txn"), F.lit(i).alias("slot")).alias("arrival"),
                              F.lit(kind).alias("type"), c.alias("id")) for i, (kind, c) in enumerate(ids)])
    first = (events.withColumn("_v", F.explode(rows)).groupBy(*keys, "_v.id", "_v.type").agg(F.min("_v.arrival").alias("arrival")))
    # keep the 50 earliest per minute of arrival before ranking a whole key
    minute_of = F.floor(F.col("arrival.us") / 60000000)
    early = (first.withColumn("_m", minute_of)
             .withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_m").orderBy("arrival"))).filter(F.col("_r") <= max_nodes))
    nodes = (early.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("arrival")))
             .filter(F.col("position") <= max_nodes)
             .select(*keys, "id", "type", F.expr("substring(id, if(type = 'ip', 4, 5), 10)").alias("label"), "position"))
    cus, dev, ins = ids[0][1], ids[1][1], ids[2][1]
    pairs = F.array(F.struct(cus.alias("source"), dev.alias("target"), F.lit("used_device").alias("type")),
                    F.struct(dev.alias("source"), ins.alias("target"), F.lit("used_card").alias("type")))
    edges = events.withColumn("_e", F.explode(pairs)).select(*keys, "_e.*").distinct()
    kept = nodes.select(*keys, "id")
    edges = (edges.join(kept.withColumnRenamed("id", "source"), [*keys, "source"], "left_semi")
             .join(kept.withColumnRenamed("id", "target"), [*keys, "target"], "left_semi"))
    return nodes, edges
