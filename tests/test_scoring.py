import datetime as dt
from statistics import median

from pyspark.sql import functions as F

from surgelens.plans import scoring
from surgelens.plans.catalog import BOUNDS, CATALOG, _scored_rows
from surgelens.sources import fixtures as fx

T0 = dt.datetime(2024, 1, 1)
STEPS = {"1m": 1, "5m": 5, "15m": 15, "1h": 60}


def base(dev):
    return 1 / (1 + 2.718 ** (-0.5 * (dev - 3))) if dev > 0 else 0.05


def test_steady_traffic_is_no_deviation(spark):
    rows = [("busy", "1m", T0 + dt.timedelta(minutes=7 * k), 40.0 + k % 3) for k in range(8 * 24 * 60 // 7)]
    rows += [("busy", "1m", T0 + dt.timedelta(days=7, minutes=1), 90.0), ("new", "1m", T0 + dt.timedelta(days=7, minutes=1), 41.0)]
    wide = spark.createDataFrame(rows, "merchant_id string, window_size string, window_end timestamp, A_txn_rate double")
    wide = wide.withColumn("J_largest_cluster_vol_share", F.lit(0.0)).withColumn("D_gmv", F.lit(1.0)).withColumn("B_txn_count", F.lit(1))
    for c in ("J_bipartite_gini", "C_failure_rate", "C_instrument_novelty", "C_coupon_rate"):
        wide = wide.withColumn(c, F.lit(0.0))
    bound = int((T0 + dt.timedelta(days=7) - dt.datetime(1970, 1, 1)).total_seconds())
    got = scoring.score_windows(scoring.with_stored_baselines(wide, bound)).filter(F.unix_micros("window_end") >= bound * 1000000).collect()
    steady = [r for r in got if r.merchant_id == "busy" and r.A_txn_rate < 50]
    assert len(steady) > 200 and not any(r.action_tier == "RESTRICT" for r in steady)
    assert [r.action_tier for r in got if r.A_txn_rate == 90.0] == ["RESTRICT"]
    assert [(r.baseline_confidence, r.action_tier) for r in got if r.merchant_id == "new"] == [("LOW", "OBSERVE")]  # of its category


def test_scored_windows_against_a_plain_version(spark, tiny):
    """Every window of the grid; after the history the rate is held against the history's median of that hour."""
    minutes, epoch = {}, lambda x: int(x // 60)
    for r in fx.attempts(spark, tiny).select("merchant_id", (F.unix_micros("timestamp") / 1e6).alias("t")).collect():
        minutes.setdefault(r.merchant_id, []).append(epoch(r.t))
    category = {r.merchant_id: r.category for r in fx.categories(spark, tiny).collect()}
    rate, own, peers = {}, {}, {}
    for m, at in minutes.items():
        for size, n in STEPS.items():
            for e in range(min(at) + n, max(at) + 2):
                rate[m, size, e] = sum(e - n <= x < e for x in at) / n
                if 60 * e < BOUNDS[0]:
                    own.setdefault((m, size, e // 60), []).append(rate[m, size, e])
                    peers.setdefault((category.get(m, "retail"), size, e // 60), []).append(rate[m, size, e])
    got = {(r.merchant_id, r.window_size, epoch(r.window_end if isinstance(r.window_end, float) else r.window_end.timestamp())): r for r in CATALOG["score_windows"][0](spark, tiny).collect()}
    assert set(got) == set(rate)
    held = 0
    for (m, size, e), r in got.items():
        dev, known = rate[m, size, e], None
        if 60 * e >= BOUNDS[0]:
            known = own.get((m, size, e // 60))
            values = known or peers.get((category.get(m, "retail"), size, e // 60), [])
            if values:
                mid = median(values)
                dev = (dev - mid) / max(1e-4, 1.4826 * median(abs(v - mid) for v in values))
        want = "HIGH" if known and len(known) >= 20 else "MEDIUM" if known and len(known) >= 5 else "LOW"
        assert r.baseline_confidence == want
        assert min(1, base(dev)) - 2e-6 <= r.risk_score <= min(1, base(dev) + 0.4) + 2e-6
        held += want != "LOW"
    assert held


def test_incidents_of_scored_windows(spark, tiny):
    """The incident queries judge the windows as score_windows does: plain versions over its written rows."""
    rows = _scored_rows(spark, tiny).withColumn("e", F.unix_micros("window_end") / 1e6).collect()
    best = {}
    for r in rows:
        if r.risk_score >= 0.6:
            k = (r.merchant_id, r.e)
            best[k] = max(best.get(k, (0,)), (STEPS[r.window_size], r.window_size, r.risk_score))
    got = CATALOG["scored_incident_rows"][0](spark, tiny).collect()
    assert {(r.merchant_id, r.last_flag_time): r.horizon for r in got} == {k: v[1] for k, v in best.items()} and len(got) == len(best)
    assert all(abs(r.risk_score - best[r.merchant_id, r.last_flag_time][2]) < 2e-6 for r in got)
    bounds = {(r.merchant_id, r.window_size, r.e): r.risk_score for r in rows}
    stored = CATALOG["scored_eval_store_rows"][0](spark, tiny).collect()
    assert stored and all(abs(r.predicted_score - bounds[r.merchant_id, r.window_size, r.window_end]) < 2e-6 for r in stored)
    assert CATALOG["incident_matching"][0](spark, tiny).count() == 1
