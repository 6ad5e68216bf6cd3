from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from surgelens.operators import graph as G
from surgelens.operators.grid import HORIZONS
from surgelens.operators.window_features import flatten
from surgelens.sources import fixtures as fx


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def test_components_match_union_find(spark):
    chain = [("w1", f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("w1", "x", "y"), ("w2", "n000", "z"), ("w2", "z", "z")]
    got = G.connected_components(spark.createDataFrame(chain, "w string, src string, dst string"), ["w"]).collect()
    label = {(r.w, r.node): r.component for r in got}
    assert label[("w1", "n040")] == "n000" and label[("w1", "y")] == "x" and label[("w2", "z")] == "n000"
    assert len(got) == 45


@pytest.mark.parametrize("tile_edges", [G.TILE_EDGES, 60])  # the second: many tiles go the spread way
def test_window_graph_matches_brute_force(spark, tiny, tile_edges):
    events = fx.annotated(spark, tiny)
    got = {(r.merchant_id, r.window_size, r.window_end): r for r in G.graph_features(events, with_cross_merchant=True, tile_edges=tile_edges).collect()}
    rows = flatten(events).select("merchant_id", "m", "us", "cus", "dev", "ins", "ip").orderBy("us").collect()
    members, reach = defaultdict(list), defaultdict(set)
    for r in rows:
        for s, n in HORIZONS.items():
            for e in range(r.m + 1, r.m + n + 1):
                members[(r.merchant_id, s, e)].append(r)
                for v in ("CUS:" + r.cus, "DEV:" + r.dev, "INS:" + r.ins, "IP:" + r.ip):
                    reach[(s, e, v)].add(r.merchant_id)
    assert len(got) == len(members)
    import datetime as dt
    for (mer, s, e), txns in members.items():
        sets, edges, first = Sets(), set(), {}
        for r in txns:
            c, d, i, p = "CUS:" + r.cus, "DEV:" + r.dev, "INS:" + r.ins, "IP:" + r.ip
            for a, b in ((c, d), (d, i), (c, p)):
                sets.join(a, b)
                edges.add((a, b))
            for v in (c, d, i, p):
                first.setdefault(v, r.us)
        nodes = defaultdict(list)
        for v in first:
            nodes[sets.find(v)].append(v)
        best = max(nodes, key=lambda k: (len(nodes[k]), -min(first[v] for v in nodes[k])))
        n_edges = sum(1 for a, _ in edges if sets.find(a) == best)
        row = got[(mer, s, dt.datetime.fromtimestamp(e * 60, dt.timezone.utc).replace(tzinfo=None))]
        assert row.J_cluster_count == len(nodes)
        assert row.J_largest_cluster_size == n_edges
        assert abs(row.J_largest_cluster_vol_share - min(1.0, n_edges / len(txns))) < 1e-12
        assert abs(row.J_cluster_density - n_edges / len(nodes[best])) < 1e-12
        touched = [len(reach[(s, e, v)]) for v in first if len(reach[(s, e, v)]) > 1]
        assert row.J_cross_merchant_entities == len(touched)
        assert row.J_cross_merchant_fanout_max == max(touched, default=1)


def test_empty_windows_have_an_empty_graph(spark, tiny):
    from surgelens.operators import grid
    from surgelens.plans import scoring
    events = fx.annotated(spark, tiny).filter("merchant_id = 'm_1'")
    empty = scoring.all_features(events, ("1m", "5m"), spine=grid.window_spine(events, ("1m", "5m"))).filter("B_txn_count = 0")
    j = sorted(c for c in empty.columns if c.startswith("J_"))
    ones = {"J_devices_per_account_max", "J_accounts_per_ip_max", "J_cross_merchant_fanout_max"}
    rows = empty.select(*j).distinct().collect()
    assert len(j) == 12 and [r.asDict() for r in rows] == [{c: float(c in ones) for c in j}]


def test_labels_meet_like_a_union_find():
    import numpy as np
    rng = np.random.default_rng(5)
    for n, edges in ((2, 1), (50, 20), (300, 280), (300, 2000)):
        a, b = rng.integers(0, n, (2, edges))
        star, path = np.arange(n - 1), np.arange(1, n)
        for x, y in ((a, b), (star, np.full(n - 1, n - 1)), (star, path), (path, star)):
            half, sets = len(x) // 2, Sets()
            label = G._meet(G._meet(np.arange(n), x[:half], y[:half]), x[half:], y[half:])
            for u, v in zip(x.tolist(), y.tolist()):
                sets.join(u, v)
            groups, named = defaultdict(set), defaultdict(set)
            for v in range(n):
                groups[sets.find(v)].add(v)
                named[int(label[v])].add(v)
            assert sorted(map(sorted, groups.values())) == sorted(map(sorted, named.values()))
            assert all(r in members for r, members in named.items())


def test_a_busy_hour_stays_one_task(spark, monkeypatch):
    """70,000 attempts in two hours: over 200,000 distinct (minute, edge) rows, which no window label table may be made of."""
    monkeypatch.setattr(G, "window_labels", lambda *a: pytest.fail("spread over window labels"))
    i, text = F.col("id"), lambda p, x: F.concat(F.lit(p), x.cast("string"))
    flat = spark.range(70_000).select(F.lit("m").alias("merchant_id"), F.floor(i / 700).alias("m"), (i * 100).alias("us"), text("c", i % 20_000).alias("cus"),
                                      text("d", F.floor(i / 7)).alias("dev"), text("n", i).alias("ins"), text("p", F.floor(i / 70)).alias("ip"))
    got = {(r.window_size, r.end_minute): r for r in G.clusters(flat, ("1m", "1h")).collect()}
    assert len(got) == 100 + 159  # ends 1 to 100, and 1 to 159 of an hour
    for size, end, lo, hi in (("1m", 5, 4 * 700, 5 * 700), ("1h", 100, 40 * 700, 70_000)):
        sets, edges, nodes = Sets(), set(), defaultdict(set)
        for k in range(lo, hi):
            c, d, n, p = f"c{k % 20_000}", f"d{k // 7}", f"n{k}", f"p{k // 70}"
            for a, b in ((c, d), (d, n), (c, p)):
                sets.join(a, b)
                edges.add((a, b))
        for v in list(sets.up):
            nodes[sets.find(v)].add(v)
        row = got[(size, end)]
        most = max(map(len, nodes.values()))
        assert (row.clusters, row.nodes) == (len(nodes), most)
        assert row.edges in {sum(sets.find(a) == r for a, _ in edges) for r in [k for k, v in nodes.items() if len(v) == most][:1]}


def test_attempts_are_dealt_as_they_are(spark, monkeypatch):
    """Where no tile is too large, no table of edges is made; repeated attempts and missing instruments give the same clusters either way."""
    i, text = F.col("id"), lambda p, x: F.concat(F.lit(p), x.cast("string"))
    flat = spark.range(600).withColumn("id", i % 200).select(
        F.when(i % 2 == 0, "m").otherwise("n").alias("merchant_id"), F.floor(i / 2).alias("m"), (i * 30_000_000).alias("us"), text("c", i % 23).alias("cus"),
        text("d", i % 31).alias("dev"), F.when(i % 7 != 0, text("n", i % 41)).alias("ins"), text("p", i % 5).alias("ip"))
    collapsed = sorted(map(tuple, G.clusters(flat, ("1m", "15m", "1h"), tile_edges=600).collect()))  # 3 x 300 attempts, a third of the edges are distinct
    monkeypatch.setattr(G, "timed_edges", lambda *a: pytest.fail("edges were shuffled before they were dealt"))
    dealt = sorted(map(tuple, G.clusters(flat, ("1m", "15m", "1h")).collect()))
    assert len(dealt) > 300 and dealt == collapsed


def test_entities_of_several_merchants(spark):
    rows = [("a", 1, "x"), ("b", 1, "x"), ("a", 1, "y"), (None, 1, "y"), ("a", 9, "z"), ("a", 9, "z"), ("b", 20, "x")]
    flat = spark.createDataFrame(rows, "merchant_id string, m long, cus string").select(
        "*", *[F.concat(F.lit(k), F.col("merchant_id"), "cus").alias(k) for k in ("dev", "ins")], F.lit(None).cast("string").alias("ip"))
    got = {(r.merchant_id, r.end_minute): (r.cross_entities, r.fanout) for r in G.cross_merchant(flat, ("1m",)).collect()}
    assert got == {("a", 2): (2, 2), ("b", 2): (1, 2), (None, 2): (1, 2)}
