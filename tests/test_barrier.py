import datetime as dt

import pytest
from pyspark.sql import functions as F

from surgelens import registry as R
from surgelens.operators import baselines as B, detectors as D
from surgelens.sources import intake


def test_labels_are_no_model_columns():
    assert R._learnable("y.true") is False and R._learnable("label") is False and R._learnable("A.my_ratio")
    for leaked in ("y.true", "label", "dominant_scenario_id", "I.dispute_rate"):
        with pytest.raises(R.DownstreamLeak):
            R.assert_no_downstream(["A.txn_rate", leaked])


def test_scores_do_not_depend_on_labels_after_the_fit(spark):
    rows = [(i, float(i % 10), float(i % 7), float(i % 3), int(i % 10 > 6), "FRAUD_SPIKE" if i % 10 > 6 else "NORMAL") for i in range(200)]
    df = spark.createDataFrame(rows, "i long, A_txn_rate double, C_failure_rate double, J_cluster_count double, y_true int, label string")
    for make in (lambda: D.contextual(2), lambda: D.fusion(2)):
        det = make().fit(df)
        assert det.columns and all(R.FEATURE_COLUMN.match(c) for c in det.columns)
        turned = df.withColumn("y_true", 1 - F.col("y_true"))
        a, b = ({r.i: r.risk_score for r in det.score(x).collect()} for x in (df, turned))
        assert a == b
        assert det.score(df.drop("y_true", "label")).count() == 200


def test_unfitted_volume_detector_is_logistic(spark):
    df = spark.createDataFrame([(3.0,), (5.0,)], "A_txn_rate_dev double")
    got = sorted(r.risk_score for r in D.volume_only().score(df).collect())
    assert got[0] == 0.5 and abs(got[1] - 1 / (1 + 2.718281828459045 ** -1.0)) < 1e-9


def _at(second):
    return dt.datetime(2024, 1, 1, 0, 0, second)


def test_refused_events_claim_nothing(spark):
    def status(rows, stored=None):
        df = spark.createDataFrame(rows, "event_id string, idempotency_key string, timestamp timestamp")
        old = spark.createDataFrame(stored, "event_id string, idempotency_key string") if stored else None
        return sorted((r.event_id, r.idempotency_key, r.status[:3]) for r in intake.dedupe(df, old).collect())

    # b repeats the id of a, so its key k2 is free for c; d repeats the key of a, so its id is free for e
    rows = [("a", "k1", _at(1)), ("a", "k2", _at(2)), ("c", "k2", _at(3)), ("d", "k1", _at(4)), ("d", "k3", _at(5)), ("d", "k3", _at(5))]
    assert status(rows) == [("a", "k1", "acc"), ("a", "k2", "dup"), ("c", "k2", "acc"), ("d", "k1", "dup"), ("d", "k3", "acc"), ("d", "k3", "dup")]
    assert status(rows, [("x", "k2"), ("d", "y")]) == [("a", "k1", "acc"), ("a", "k2", "dup"), ("c", "k2", "dup"), ("d", "k1", "dup"), ("d", "k3", "dup"), ("d", "k3", "dup")]


def test_guard_is_not_pruned(spark):
    at = dt.datetime(2024, 1, 1, 10)
    long = spark.createDataFrame([("m", "5m", at, "A.txn_rate", 2.0)], "merchant_id string, window_size string, window_end timestamp, feature_id string, value double")
    later = long.withColumn("window_end", F.col("window_end") + F.expr("INTERVAL 7 DAYS"))
    merchant_b, _ = B.fit_baselines(later)
    with pytest.raises(Exception, match="BaselineLeak"):
        B.overall_confidence(B.deviation(long, merchant_b)).collect()
    assert B.overall_confidence(B.deviation(long, merchant_b, allow_in_sample=True)).count() == 1


def test_rounds_see_only_events_that_share_an_id_or_key(spark, monkeypatch):
    from surgelens.sources import intake
    rows = [(f"e{i}", f"k{i}", i) for i in range(500)] + [("e1", "k1", 900), ("e2", "new", 901), ("other", "k3", 902), ("e4", "k4", 4)]
    df = spark.createDataFrame(rows, "event_id string, idempotency_key string, timestamp long")
    old = spark.createDataFrame([("e5", "gone"), (None, None)], "event_id string, idempotency_key string")
    cut, seen = intake.cut_lineage, []

    def counted(t):
        seen.append(cut(t))
        return seen[-1]

    monkeypatch.setattr(intake, "cut_lineage", counted)
    refused = [(r.event_id, r.idempotency_key, r.timestamp) for r in intake.dedupe(df, old).filter("status = 'duplicate'").collect()]
    assert sorted(refused) == [("e1", "k1", 900), ("e2", "new", 901), ("e4", "k4", 4), ("e5", "k5", 5), ("other", "k3", 902)]
    assert max(t.count() for t in seen) == 8
