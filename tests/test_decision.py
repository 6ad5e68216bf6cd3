import datetime as dt

from pyspark.sql import functions as F

from surgelens.operators import decision as X, incidents as E, metrics as M

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_exposure_hand_case(spark):
    df = spark.createDataFrame([(100000.0, 50, 0.80, 5000.0)], "gmv double, n_txns long, p double, promo double")
    r = X.exposure(df, p_loss="p", promo="promo").first()
    assert (float(r.direct_fraud_loss), float(r.operational_loss), float(r.total_exposure)) == (80000.0, 83500.0, 168500.0)


def test_tiers(spark):
    df = spark.createDataFrame([(s,) for s in (0.15, 0.45, 0.70, 0.92)], "risk_score double")
    rows = X.assign_tier(df, thresholds=(0.30, 0.60, 0.85)).orderBy("risk_score").collect()
    assert [r.action_tier for r in rows] == ["OBSERVE", "ALERT", "REVIEW", "RESTRICT"]
    assert rows[3].recommended_control == "RECOMMEND_STEP_UP_AUTHENTICATION" and rows[0].recommended_control is None


def test_threshold_on_grid_points(spark):
    grid = X.threshold_grid()
    df = spark.createDataFrame([(1, t) for t in grid[::7]] + [(0, t - 1e-12) for t in grid[3::9]] + [(0, 0.0), (0, 1.0)], "y_true int, y_prob double")
    rows = {r.i: r for r in X.sweep_thresholds(df).collect()}
    data = df.collect()
    for i, t in enumerate(grid):
        cost = sum(5000.0 for r in data if r.y_true == 1 and r.y_prob < t) + sum(250.0 for r in data if r.y_true == 0 and r.y_prob >= t)
        assert rows[i].total_cost == cost


def test_nothing_feasible(spark):
    r = X.choose_thresholds(spark.createDataFrame([(1, 0.99)], "y_true int, y_prob double")).first()
    assert r.theta_review == 0.50 and r.expected_loss == float("inf")


def test_incident_assembly(spark):
    flags = [("m", "1m", at(k), s, 1000.0) for k, s in ((1, 0.7), (2, 0.9), (3, 0.8), (8, 0.75))]
    df = spark.createDataFrame(flags, "merchant_id string, window_size string, window_end timestamp, risk_score double, gmv double")
    a, b = E.assemble_incidents(df, 120).orderBy("first_flag_time").collect()
    assert (a.window_count, a.max_risk_score, a.total_gmv, b.window_count) == (3, 0.90, 3000.0, 1)
    assert a.first_flag_time == at(0) and a.last_flag_time == at(3)


def pred(rows, spark):
    return spark.createDataFrame([(f"p{i}", m, at(a), at(b), 1, 0.9, 1.0) for i, (m, a, b) in enumerate(rows)],
                                 "incident_id string, merchant_id string, first_flag_time timestamp, last_flag_time timestamp, window_count long, max_risk_score double, total_gmv double")


def true(rows, spark):
    return E.number_truth(spark.createDataFrame([("s", m, at(a), at(b), True, g) for m, a, b, g in rows],
                                                "scenario_id string, merchant_id string, start_time timestamp, end_time timestamp, is_attack boolean, total_gmv double"))


def test_matching_against_plain_loop(spark):
    import random
    rng = random.Random(7)
    ps = [(rng.choice("ab"), s, s + rng.randint(1, 30)) for s in (rng.randint(0, 600) for _ in range(40))]
    ts = [(rng.choice("ab"), s, s + rng.randint(1, 40), 10.0) for s in (rng.randint(0, 600) for _ in range(25))]
    got = E.match_incidents(pred(ps, spark), true(ts, spark)).first()
    order, free, tp = sorted(ps, key=lambda p: p[1]), sorted(set(ts), key=lambda t: t[1]), 0
    for m, a, b in order:
        hit = next((t for t in free if t[0] == m and not (b < t[1] or a > t[2])), None)
        if hit:
            free.remove(hit)
            tp += 1
    # predictions of equal start may be taken in either order, which can move one match
    assert abs(got.true_positives - tp) <= 1 and got.true_positives + got.false_positives == len(ps)


def test_one_broad_prediction_is_not_three(spark):
    r = E.incident_taxonomy(pred([("m", 0, 300)], spark), true([("m", 10, 40, 1.0), ("m", 100, 140, 1.0), ("m", 200, 260, 1.0)], spark)).first()
    assert (r.detection_recall, r.strict_matched_count, r.merge_index, r.fragmentation_index) == (1.0, 1, 3.0, 1.0)
    none = E.incident_taxonomy(pred([("x", 0, 300)], spark), true([("m", 10, 40, 1.0)], spark)).first()
    assert none.detection_recall == 0.0 and none.false_alarm_incidents == 1
    brush = E.incident_taxonomy(pred([("m", 0, 10.5)], spark), true([("m", 10, 100, 1.0)], spark)).first()
    assert brush.detected_count == 0


def test_single_class_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.9)], "y_true int, y_prob double")
    r = M.window_metrics(df).first()
    assert r.pr_auc == 0.0 and r.roc_auc == 0.5


def test_incident_detail_hides_other_merchants(spark):
    from surgelens.operators.explain import incident_detail
    rows = spark.sql("""SELECT * FROM VALUES ('i1', 'a', array('5m', '1h'), timestamp'2024-01-01 00:00:00', 'REVIEW', 0.5D, 'OPEN', CAST(NULL AS STRING)),
      ('i2', 'b', CAST(array() AS ARRAY<STRING>), timestamp'2024-01-01 00:00:00', 'RESTRICT', 0.9D, 'CLOSED', 'checked') AS
      t(incident_id, merchant_id, window_sizes, last_flag_time, action_tier, risk_score, status, analyst_notes)""")
    got = {r.incident_id: r for r in incident_detail(rows).collect()}
    assert got["i1"].window_size == "5m" and got["i1"].analyst_notes == "" and got["i2"].window_size is None and got["i2"].analyst_notes == "checked"
    assert [r.incident_id for r in incident_detail(rows, ["a"]).collect()] == ["i1"] and incident_detail(rows, []).count() == 0
