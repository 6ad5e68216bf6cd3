"""Scoring all merchant-windows end to end, and the evaluation protocol."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from surgelens.operators import baselines as B, decision as X, incidents as E, labels as L, metrics as M
from surgelens.operators.detectors import Detector, side_by_side
from surgelens.operators.explain import narrative
from surgelens.operators.graph import graph_features
from surgelens.operators.grid import ALL_SIZES
from surgelens.operators.window_features import attempt_packs, flatten, window_features
from surgelens.registry import FEATURE_COLUMN, TWIN_IDS, assert_no_downstream, col_of, id_of, split_columns
from surgelens.session import cut_lineage, hold

KEY = ["merchant_id", "window_size", "window_end"]
#: rows of TRAIN in a task of a fit
FIT_ROWS = 16_384


def all_features(events: DataFrame, sizes: tuple[str, ...] = ALL_SIZES, cross_merchant: bool = False, **options) -> DataFrame:
    """Families A-J, raw values, one row per non-empty window, or per window of the ``spine`` among
    the options; an empty window has an empty graph: no clusters, and a fan-out of 1."""
    flat = hold(flatten(events))
    packs = attempt_packs(flat)
    graph = graph_features(events, sizes, cross_merchant, flat=flat, packs=packs)
    filled = {c: 0.0 for c in graph.columns if c not in KEY} | {"J_cross_merchant_fanout_max": 1.0}
    return window_features(events, sizes, flat=flat, packs=packs, **options).join(graph, KEY, "left").fillna(filled)


def with_twins(wide: DataFrame, merchant_b: DataFrame | None = None, category_b: DataFrame | None = None,
               categories: DataFrame | None = None, allow_in_sample: bool = False) -> DataFrame:
    """Add ``<feature>_dev`` columns and the window's baseline confidence. Without baselines
    every twin equals its raw value at LOW confidence."""
    if merchant_b is None:
        twins = [F.col(col_of(f)).alias(col_of(f) + "_dev") for f in TWIN_IDS if col_of(f) in wide.columns]
        return wide.select("*", *twins, F.lit("LOW").alias("baseline_confidence"))
    ids = [f for f in TWIN_IDS if col_of(f) in wide.columns]
    dev = B.deviation(B.to_long(wide, ids), merchant_b, category_b, categories, allow_in_sample)
    rank = F.when(F.col("confidence") == "HIGH", 2).when(F.col("confidence") == "MEDIUM", 1).otherwise(0)
    twins = B.to_wide(dev.withColumn("_r", rank), ids, "deviation", "_dev", ["_r"])
    name = F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), F.col("_r") + 1)
    return wide.join(twins.withColumn("baseline_confidence", name).drop("_r"), KEY)


def with_stored_baselines(wide: DataFrame, bound: int, categories: DataFrame | None = None) -> DataFrame:
    """Twins as a service has them: windows that end before ``bound`` (epoch seconds) are the history that baselines are
    fitted on once, and start cold themselves; later windows are held against these baselines. ``wide`` is read several times."""
    past = F.unix_micros("window_end") < bound * 1000000
    history = wide.filter(past)
    merchant_b, category_b = (cut_lineage(x) for x in B.fit_baselines(B.to_long(history, TWIN_IDS), categories))
    return with_twins(history).unionByName(with_twins(wide.filter(~past), merchant_b, category_b, categories))


def model_columns(wide: DataFrame) -> list[str]:
    """Columns allowed into a model, checked against the label barrier."""
    ids = [id_of(c) for c in wide.columns if FEATURE_COLUMN.match(c)]
    return [col_of(i) for i in assert_no_downstream(split_columns(ids)[0])]


def score_windows(twinned: DataFrame, detector: Detector | None = None,
                  thresholds: tuple[float, float, float] = X.DEFAULT_THRESHOLDS) -> DataFrame:
    """Risk score, tier, exposure and explanation per window."""
    if detector is None:
        scored = twinned.withColumn("risk_score", X.heuristic_score(F.col("A_txn_rate_dev"), F.col("J_largest_cluster_vol_share")))
    else:
        scored = detector.score(twinned)
    tiered = X.assign_tier(scored, "risk_score", thresholds)
    return narrative(X.exposure(tiered, "D_gmv", "B_txn_count"))


def fit_all(detectors: list[Detector], train: DataFrame) -> list[Detector]:
    """Fit the detectors side by side."""
    return side_by_side(train.sparkSession, [lambda d=d: d.fit(train) for d in detectors])


def dealt_for_fits(train: DataFrame) -> DataFrame:
    """All rows of TRAIN, dealt by window into tasks of about ``FIT_ROWS`` rows and written: boosting is thousands of small jobs, whose
    cost on few rows is their tasks. The rows of a task are in order, so a seeded share of them is the same each time."""
    tasks = max(1, -(-train.count() // FIT_ROWS))
    return cut_lineage(train.repartition(tasks, *KEY).sortWithinPartitions(*KEY))


def protocol_data(wide: DataFrame, labels: DataFrame, bounds: tuple[int, int]) -> DataFrame:
    """Labelled windows with twins and their split, written: baselines come from the model features of TRAIN, whose own
    twins are in sample; later windows are held against them."""
    every = labels.select(*KEY, "label", "dominant_scenario_id").join(wide, KEY)  # wide holds the empty windows too
    data = L.temporal_split(every, *bounds).withColumn("y_true", (F.col("label") == "FRAUD_SPIKE").cast("int"))
    data = cut_lineage(data)
    train = data.filter("split = 'train'")
    model_ids = [id_of(c) for c in model_columns(wide)]
    merchant_b, category_b = side_by_side(train.sparkSession, [lambda x=x: cut_lineage(x) for x in B.fit_baselines(B.to_long(train, model_ids))])
    twins = with_twins(train, merchant_b, category_b, allow_in_sample=True).unionByName(with_twins(data.filter("split <> 'train'"), merchant_b, category_b))
    return cut_lineage(twins)


def scored_slim(data: DataFrame, detectors: list[Detector]) -> DataFrame:
    """VALIDATION and TEST windows scored by every fitted detector: (detector, window, split, label, y_true, risk_score, gmv), written."""
    later = data.filter("split <> 'train'")
    parts = [d.score(later).select(F.lit(d.name).alias("detector"), *KEY, "split", "label", "dominant_scenario_id", "y_true", "risk_score", F.col("D_gmv").alias("gmv")) for d in detectors]
    return cut_lineage(reduce(DataFrame.unionByName, parts))


def evaluate_scores(scores: DataFrame, bounds: tuple[int, int], cap: float = 0.15, by: tuple[str, ...] = ("detector",)) -> tuple[DataFrame, DataFrame]:
    """(one row per value of ``by``, false positives by scenario) of a slim table of scores.

    Thresholds come from VALIDATION, everything else from TEST. Every step runs once for all detectors, keyed by them. Needs what
    ``scored_slim`` returns; the truth and the population are those of the test windows of any one detector."""
    by = [*by]
    theta = X.choose_thresholds(scores.filter("split = 'validation'"), cap, p="risk_score", keys=by).drop("expected_loss", "review_rate")
    theta = cut_lineage(theta)  # a row per detector
    test = scores.filter("split = 'test'").join(F.broadcast(theta), by)
    windows = test.groupBy(*KEY).agg(F.first("label").alias("label"), F.first("dominant_scenario_id").alias("dominant_scenario_id"), F.first("gmv").alias("gmv"))
    truth = cut_lineage(E.number_truth(L.true_incident_spans(windows)))
    days = F.greatest(F.lit(1.0), (F.max(F.unix_micros("window_end")) / 1e6 - bounds[1]) / 86400.0)
    spread = windows.agg((F.greatest(F.lit(1), F.countDistinct("merchant_id")) * days).alias("_merchant_days"))  # one row
    pred = cut_lineage(E.assemble_incidents(test.filter(F.col("risk_score") >= F.col("theta_review")), by=by))
    each = theta.select(*by)
    money, count = M.expected_loss(F.col("missed_fraud_gmv"), F.col("false_positives"), F.col("false_negatives"), F.col("fp"))
    taxonomy = E.incident_taxonomy(pred, truth, by=by, spread=each).select(*by, "detection_recall", "strict_match_recall", "mean_temporal_iou", "fragmentation_index", "merge_index")
    out = (M.window_metrics(test, F.col("theta_review"), by, p="risk_score").join(E.match_incidents(pred, truth, by, each), by).join(taxonomy, by).join(theta, by)
           .withColumns({"loss_by_money": money, "loss_by_count": count}).crossJoin(F.broadcast(spread))
           .withColumn("false_alerts_per_merchant_day", F.col("false_positives") / F.col("_merchant_days")).drop("_merchant_days"))
    return out, M.false_positives_by_scenario(test, F.col("theta_review"), by)


def run_protocol(wide: DataFrame, labels: DataFrame, bounds: tuple[int, int], detectors: list[Detector], cap: float = 0.15) -> DataFrame:
    """Fit on TRAIN, thresholds on VALIDATION, TEST scored once: one row per detector. ``wide`` holds raw features, computed once."""
    data = protocol_data(wide, labels, bounds)
    fitted = fit_all(detectors, data.filter("split = 'train'"))
    return evaluate_scores(scored_slim(data, fitted), bounds, cap)[0]
