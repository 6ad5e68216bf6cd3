import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from surgelens.operators import detectors as D, gates as G, incidents as E, report as R
from surgelens.operators.labels import NOT_EVALUATED
from surgelens.plans import scoring

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


# shuffled labels

def test_shuffle_is_a_seeded_permutation(spark):
    rows = [(f"w{i}", int(i % 7 == 0)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "w string, y_true int")
    got = {r.w: (r.y_true, r.y_shuffled) for r in G.shuffle_labels(df, F.col("w"), seed=5).collect()}
    md5 = lambda w, part: hashlib.md5(f"{w}|5|{part}".encode()).hexdigest()
    asking = sorted(w for w, _ in rows)
    asking.sort(key=lambda w: md5(w, "rows"))
    giving = sorted(rows, key=lambda r: md5(r[0], "labels"))
    assert {w: y for w, (y, _) in got.items()} == dict(rows)
    assert {w: y for w, (_, y) in got.items()} == {w: y for w, (_, y) in zip(asking, giving)}
    assert sum(y == s for y, s in got.values()) < 0.85 * len(rows)
    other = {r.w: r.y_shuffled for r in G.shuffle_labels(df, F.col("w"), seed=6).collect()}
    assert other != {w: s for w, (_, s) in got.items()}


def _windows(spark, scenarios):
    """Windows whose rate tells attacks from the rest; (split, scenario, rate, y)."""
    rows, i = [], 0
    for split, n in (("train", 240), ("validation", 60), ("test", 120)):
        for k in range(n):
            attack = k % 4 == 0
            rows.append((f"m_{k % 3}", "5m", at(i), split, scenarios[k // 4 % len(scenarios)] if attack else "normal_day", int(attack), (8.0 if attack else 1.0) + k % 5 / 10, float(k % 11)))
            i += 1
    return spark.createDataFrame(rows, "merchant_id string, window_size string, window_end timestamp, split string, dominant_scenario_id string, y_true int, A_txn_rate double, A_interarrival_mean double")


def _detector(rounds):
    return D.Detector("boosted", lambda ids: ids, D._boosting(rounds, 0.1))


def test_gates_on_two_attack_scenarios(spark):
    data = _windows(spark, ["a", "b"])
    long = data.select("y_true", F.explode(F.array(*[F.struct(F.lit(c).alias("feature_id"), F.col(c).alias("value")) for c in ("A_txn_rate", "A_interarrival_mean")])).alias("f")).select("y_true", "f.*")
    ident = F.concat_ws("|", "merchant_id", "window_end")
    got = {(r.gate, r["item"]): r for r in G.leakage_gates(long, data, ident, _detector, (5, 5)).collect()}
    assert got["temporal_split", "train-validation"].passed and got["temporal_split", "validation-test"].value == 60
    assert got["median_feature_auc", "2"].passed is None  # two features cannot be judged
    shuffled = got["shuffled_labels", "boosted"]
    assert shuffled.passed == (shuffled.value <= 0.1)
    assert got["held_out_scenario", "a"].passed and got["held_out_scenario", "b"].value == 1.0
    folds = {r.scenario_id: tuple(r)[1:] for r in G.scenario_folds(data).collect()}
    assert folds == {"a": (210, 30, 15, 15), "b": (210, 30, 15, 15)}


def test_a_fold_without_positives_is_not_judged(spark):
    data = _windows(spark, ["only"])
    rows = G.held_out_gate(data.filter("split = 'train'"), data.filter("split = 'test'"), lambda: _detector(2)).collect()
    assert [(r["item"], r.value, r.passed) for r in rows] == [("only", None, None)]


def test_overlapping_splits_fail(spark):
    data = _windows(spark, ["a"])
    mixed = data.withColumn("split", F.when(F.col("window_end") == F.lit(at(10)), "test").otherwise(F.col("split")))
    got = {r["item"]: r.passed for r in G.split_gate(mixed).collect()}
    assert got == {"train-validation": True, "validation-test": False}


def test_median_auc_gate(spark):
    cheat = spark.createDataFrame([(f"f{j:02d}", float(i % 2 if j < 8 else (i * (j + 3)) % 17), i % 2) for i in range(200) for j in range(12)], "feature_id string, value double, y_true int")
    assert [r.passed for r in G.median_auc_gate(cheat).collect()] == [False]
    assert [r.passed for r in G.median_auc_gate(cheat.filter("feature_id >= 'f08'").unionByName(cheat.filter("feature_id < 'f08'").withColumn("value", F.col("value") * 0 + F.hash("feature_id", F.rand(3)) % 100))).collect()] == [True]


# comparison tables

def test_absent_scenarios_are_never_zero(spark):
    fps = spark.createDataFrame([("x", "sale", 3, 17), ("y", "sale", 0, 17), ("x", "normal_day", 9, 0)], "detector string, scenario_id string, false_positives long, hard_negative_windows long")
    got = {r.scenario_id: r for r in R.hard_negative_table(fps, ["festival", "normal_day", "sale"], ["x", "y"]).collect()}
    assert (got["sale"].population, got["sale"].x, got["sale"].y) == (17, "3", "0")
    for absent in ("festival", "normal_day"):
        assert (got[absent].population, got[absent].x, got[absent].y) == (0, NOT_EVALUATED, NOT_EVALUATED)
    recalls = spark.createDataFrame([("x", "burst", 2, 3), ("x", "ring", 0, 1)], "detector string, scenario_id string, hit long, total long")
    got = {r.scenario_id: r for r in R.recall_table(recalls, ["burst", "farm", "ring"], ["x", "y"]).collect()}
    assert (got["burst"].x, got["burst"].y, got["ring"].x) == ("66.7% (2/3)", "0.0% (0/3)", "0.0% (0/1)")
    assert (got["farm"].x, got["farm"].population) == (NOT_EVALUATED, 0)


# evaluation keyed by detector

def test_detectors_do_not_touch_each_other(spark):
    """All detectors in one pass give what each gives alone, one that flags nothing included."""
    rows, span = [], 400
    for i in range(span):
        for m in ("m_0", "m_1"):
            attack = i % 60 < 8
            label = "FRAUD_SPIKE" if attack else "LEGIT_SPIKE" if i % 50 == 0 else "NORMAL"
            scores = {"sharp": 0.85 if attack and m == "m_0" else 0.2, "blunt": 0.7 if i % 60 < 12 or i % 40 == 3 else 0.1, "silent": 0.05}
            for name, p in scores.items():
                rows.append((name, m, "5m", at(i), "validation" if i < 200 else "test", label, "burst" if attack else "normal_day", int(attack), p, float(i)))
    cols = "detector string, merchant_id string, window_size string, window_end timestamp, split string, label string, dominant_scenario_id string, y_true int, risk_score double, gmv double"
    scores = spark.createDataFrame(rows, cols)
    bounds = (0, int((at(200) - dt.datetime(1970, 1, 1)).total_seconds()))
    together = {r.detector: r.asDict() for r in scoring.evaluate_scores(scores, bounds, cap=0.5)[0].collect()}
    assert set(together) == {"sharp", "blunt", "silent"} and together["silent"]["true_positives"] == 0 and together["sharp"]["true_positives"] == 1
    for name in ("sharp", "silent"):
        alone = scoring.evaluate_scores(scores.filter(F.col("detector") == name), bounds, cap=0.5)[0].first().asDict()
        assert alone == pytest.approx(together[name])
    rows = R.detector_table(spark.createDataFrame([tuple(together["sharp"].values())], scoring.evaluate_scores(scores, bounds, cap=0.5)[0].schema)).first()
    assert rows.few_incidents and rows.incident_recall.endswith(f"/{rows.ground_truth_incidents})")


def test_recall_by_detector(spark):
    truth = E.number_truth(spark.createDataFrame([("m_0", "burst", at(0), at(9), True, 1.0), ("m_0", "burst", at(50), at(60), True, 1.0), ("m_1", "ring", at(0), at(9), True, 1.0)],
                                                 "merchant_id string, scenario_id string, start_time timestamp, end_time timestamp, is_attack boolean, total_gmv double"))
    flagged = spark.createDataFrame([("x", "m_0", at(5)), ("x", "m_0", at(55)), ("y", "m_1", at(9)), ("y", "m_0", at(30))], "detector string, merchant_id string, window_end timestamp")
    got = {(r.detector, r.scenario_id): (r.hit, r.total) for r in E.scenario_recall(truth, flagged, ["detector"]).collect()}
    assert got == {("x", "burst"): (2, 2), ("x", "ring"): (0, 1), ("y", "burst"): (0, 2), ("y", "ring"): (1, 1)}


# detectors as ML stages, figures at stage borders

def test_a_loaded_detector_scores_alike(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from surgelens.operators.estimators import DetectorEstimator, DetectorModel
    data = _windows(spark, ["a"]).withColumn("A_txn_rate_dev", F.col("A_txn_rate"))
    train, test = data.filter("split = 'train'"), data.filter("split = 'test'")
    key = lambda df: sorted((r.window_end, round(r.risk_score, 12)) for r in df.collect())
    for est in (DetectorEstimator(kind="volume_only"), DetectorEstimator(kind="contextual_ml", rounds=3, seed=7, share=0.8)):
        model = est.fit(train)
        scores = key(model.transform(test))
        assert len(scores) == 120 and all(0 <= s <= 1 for _, s in scores)
        path = str(tmp_path / est.getOrDefault("kind"))
        model.write().overwrite().save(path)
        again = DetectorModel.read().load(path)
        assert again.columns == model.columns and again.uid == model.uid and again.getOrDefault("rounds") == est.getOrDefault("rounds")
        assert key(again.transform(test)) == scores
        est.write().overwrite().save(path + "-estimator")
        assert key(DetectorEstimator.load(path + "-estimator").fit(train).transform(test)) == scores
    inside = Pipeline(stages=[DetectorEstimator(kind="volume_only")]).fit(train)
    assert isinstance(inside, PipelineModel) and inside.transform(test).filter("risk_score is null").count() == 0


def test_a_detector_scores_after_the_session_observed_a_query(spark):
    from pyspark.sql import Observation
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    data = _windows(spark, ["a"])
    scored = D.volume_only().fit(data.filter("split = 'train'")).score(data.filter("split = 'test'"))
    assert seen.get == {"n": 5} and scored.filter("risk_score between 0 and 1").count() == 120 and len({r.risk_score for r in scored.collect()}) > 2


def test_stage_figures_equal_counts_taken_apart(spark, tiny):
    from surgelens.plans import stages
    from surgelens.sources import fixtures as fx, intake
    events = fx.envelopes(spark, tiny)
    raw, table = stages.watched_intake(events)
    got = {(r.stage, r.figure): r.value for r in table.collect()}
    good, bad = intake.validate_events(events)
    claimed = intake.dedupe(good)
    assert got == {("checked", "rows"): events.count(), ("checked", "null_merchant_id"): intake.check_events(events).filter("merchant_id is null").count(), ("checked", "rejected"): bad.count(),
                   ("claimed", "rows"): good.count(), ("claimed", "duplicates"): claimed.filter("status = 'duplicate'").count(),
                   ("logged", "rows"): raw.count(), ("logged", "null_transaction_id"): raw.filter("transaction_id is null").count()}


def test_arms_take_no_label_only_column(spark):
    from surgelens.registry import FEATURES, col_of
    ids = [f.id for f in FEATURES.values()]
    row = spark.createDataFrame([(i % 2, *[float(i * (j + 1) % 5) for j in range(len(ids))]) for i in range(40)], ["y_true", *[col_of(i) for i in ids]])
    barred = {col_of(f.id) for f in FEATURES.values() if f.downstream_only or f.evidence_only}
    for arm in D.arms(1, 3):
        arm.fit(row)
        assert arm.columns and not barred & set(arm.columns) and (arm.name != "ablation_graph_only" or all(c.startswith("J_") for c in arm.columns))


def test_held_out_fits_run_side_by_side(spark, monkeypatch):
    """Two scenarios, two fits: each waits for the other to begin, which never happens one after the other."""
    import threading
    both = threading.Barrier(2)
    fit = D.Detector.fit

    def waiting(self, df):
        both.wait(timeout=60)
        return fit(self, df)

    monkeypatch.setattr(D.Detector, "fit", waiting)
    data = _windows(spark, ["a", "b"])
    rows = G.held_out_gate(data.filter("split = 'train'"), data.filter("split = 'test'"), lambda: _detector(1)).collect()
    assert sorted(r.item for r in rows) == ["a", "b"]


# runs of the ablation

def test_runs_fit_each_detector_as_the_protocol_does(spark, monkeypatch):
    """Every seed fits all five arms with the rounds that the detectors have by themselves, on every row of TRAIN."""
    from surgelens.plans import catalog as C
    data, fitted, rows = _windows(spark, ["a", "b"]), [], []
    monkeypatch.setattr(C, "_written", lambda spark, d, name, make: make())
    for name in ("_all_rows", "_label_rows"):
        monkeypatch.setattr(C, name, lambda spark, d: None)
    monkeypatch.setattr(scoring, "protocol_data", lambda *a: data)
    monkeypatch.setattr(scoring, "fit_all", lambda detectors, train: (fitted.extend(detectors), rows.append(train)))
    runs = C._runs(spark, "").collect()
    of = lambda det: (det.name, (lambda x: (x.getMaxIter(), x.getStepSize(), x.getMaxDepth(), x.getMinInstancesPerNode()) if x.hasParam("stepSize") else x.getMaxIter())(det._learner(240)))
    own = [D.volume_only(), D.contextual(), D.fusion(), D.graph_only(), D.contextual_without_twins()]
    assert [of(x) for x in fitted] == [of(x) for x in own] * 3 and {(r.run_id, r.detector) for r in runs} == {(s, x.name) for s in (42, 43, 44) for x in own}
    assert [x._learner(240).getSeed() for x in fitted if x.name != "volume_only"] == [s for s in (42, 43, 44) for _ in range(4)]
    assert sorted(rows[0].collect()) == sorted(data.filter("split = 'train'").collect())


@pytest.mark.parametrize("rows", [50, 10_000])
def test_rows_dealt_for_fits_do_not_depend_on_how_they_lay(spark, monkeypatch, rows):
    monkeypatch.setattr(scoring, "FIT_ROWS", rows)
    noise = lambda n: F.pmod(F.hash("window_end"), F.lit(n))
    data = _windows(spark, ["a"]).withColumns({"A_interarrival_mean": (F.col("A_interarrival_mean") + noise(50)).cast("double"), "y_true": (noise(3) == 0).cast("int")})
    twice = data.filter("split = 'train'").unionByName(data.filter("split = 'train' and merchant_id = 'm_1'"))
    dealt = [scoring.dealt_for_fits(x) for x in (twice.repartition(7, "A_txn_rate"), twice.coalesce(1).orderBy(F.desc("window_end")))]
    assert [x.rdd.getNumPartitions() for x in dealt] == [-(-320 // rows)] * 2
    assert sorted(dealt[0].collect()) == sorted(twice.collect())
    learner = lambda: D.Detector("boosted", lambda ids: ids, D._boosting(3, 0.1, seed=5, share=0.5))
    a, b = ([r.risk_score for r in learner().fit(x).score(data).orderBy("window_end").collect()] for x in dealt)
    assert a == b and len(set(a)) > 10


def test_dealing_for_fits_takes_an_empty_table(spark):
    assert scoring.dealt_for_fits(_windows(spark, ["a"]).limit(0)).count() == 0
