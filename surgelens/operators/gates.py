"""Leakage gates: checks that a benchmark's labels, splits and features do not give the answer away.

Every gate is one row (gate, item, value, bound, passed); ``passed`` is null where the data cannot
judge it (no positive rows, one class only), never a made-up pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from surgelens.operators import metrics as M
from surgelens.operators.detectors import Detector, side_by_side

#: bounds of the gates, as fixed values
MEDIAN_AUC, LEAST_FEATURES, SHUFFLE_DISTANCE, HELD_OUT_RECALL, HELD_OUT_THRESHOLD = 0.85, 10, 0.10, 0.50, 0.40
GATE = "gate string, item string, value double, bound double, passed boolean"


def _numbered(df: DataFrame, order: str, tie: str) -> DataFrame:
    """Add ``_place``, the row's number in the order of a hash text: counts of 65,536 hash slices are summed up,
    then each slice is numbered on its own, so no task sorts the table."""
    sliced = df.withColumn("_s", F.substring(order, 1, 4))
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # over at most 65,536 rows
    counts = sliced.groupBy("_s").agg(F.count(F.lit(1)).alias("_n")).select("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_s").orderBy(order, tie)
    return sliced.withColumn("_i", F.row_number().over(inside)).join(counts, "_s").withColumn("_place", F.col("_base") + F.col("_i")).drop("_s", "_i", "_base")


def shuffle_labels(df: DataFrame, ident: Column, y: str = "y_true", seed: int = 42, out: str = "y_shuffled") -> DataFrame:
    """Add ``out``: the labels of all rows, dealt anew by a seeded permutation.

    Two seeded hashes of the row's identity (a text, unique) give two orders; the row at a place of the first order takes the label
    at that place of the second. Both orders come from sliced counts, and they meet in an equi-join on the place."""
    rows = df.withColumn("_id", ident)
    place = lambda part: F.md5(F.concat_ws("|", "_id", F.lit(str(seed)), F.lit(part)))
    asking = _numbered(rows.withColumn("_h", place("rows")), "_h", "_id").drop("_h")
    giving = _numbered(rows.select("_id", F.col(y).alias(out), place("labels").alias("_h")), "_h", "_id").select("_place", out)
    return asking.join(giving, "_place").drop("_place", "_id")


def scenario_folds(labelled: DataFrame) -> DataFrame:
    """Leave-one-scenario-out folds of attack scenarios: rows and positives that train and that are judged.

    Needs split, dominant_scenario_id, y_true. One row per scenario with a positive window; training leaves the scenario's
    windows out, the test keeps only them. Everything after the first count is over a few rows."""
    c = labelled.groupBy("split", F.col("dominant_scenario_id").alias("scenario_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y_true").cast("long")).alias("pos"))
    at = lambda split, col: F.coalesce(F.sum(F.when(F.col("split") == split, F.col(col))), F.lit(0))
    each = c.groupBy("scenario_id").agg(at("train", "n").alias("_tn"), at("train", "pos").alias("_tp"), at("test", "n").alias("test_windows"), at("test", "pos").alias("test_positives"),
                                        F.sum("pos").alias("_any"))
    total = c.agg(at("train", "n").alias("_an"), at("train", "pos").alias("_ap"))  # one row
    return each.filter("_any > 0").crossJoin(total).select("scenario_id", (F.col("_an") - F.col("_tn")).alias("train_windows"), (F.col("_ap") - F.col("_tp")).alias("train_positives"),
                                                           "test_windows", "test_positives")


def _row(df: DataFrame, gate: str, item: Column, value: Column, bound: float, passed: Column) -> DataFrame:
    return df.select(F.lit(gate).alias("gate"), item.cast("string").alias("item"), value.cast("double").alias("value"), F.lit(float(bound)).alias("bound"), passed.alias("passed"))


def median_auc_gate(long: DataFrame) -> DataFrame:
    """The median two-sided AUC of single features stays below the bound; over ten features must vary."""
    auc = M.feature_auc(long).agg(F.percentile("auc", F.lit(0.5)).alias("m"), F.count(F.lit(1)).alias("n"))  # over registry features
    enough = F.col("n") > LEAST_FEATURES
    return _row(auc, "median_feature_auc", F.col("n"), F.col("m"), MEDIAN_AUC, F.when(enough, F.col("m") < MEDIAN_AUC))


def split_gate(labelled: DataFrame, ts: str = "window_end") -> DataFrame:
    """The splits follow each other in time: seconds from the last window of one to the first of the next are not negative."""
    us = F.unix_micros(ts)
    edge = lambda f, split: f(F.when(F.col("split") == split, us))
    e = labelled.agg(*[edge(f, s).alias(f"{n}_{s}") for s in ("train", "validation", "test") for n, f in (("lo", F.min), ("hi", F.max))])
    gap = lambda a, b: (F.col(f"lo_{b}") - F.col(f"hi_{a}")) / 1e6
    return _row(e, "temporal_split", F.lit("train-validation"), gap("train", "validation"), 0.0, gap("train", "validation") >= 0).unionByName(
        _row(e, "temporal_split", F.lit("validation-test"), gap("validation", "test"), 0.0, gap("validation", "test") >= 0))


def shuffle_gate(train: DataFrame, test: DataFrame, ident: Column, detector: Detector, seed: int = 42) -> DataFrame:
    """A detector fitted on shuffled labels ranks no better than the base rate of the test rows."""
    dealt = shuffle_labels(train, ident, seed=seed).drop("y_true").withColumnRenamed("y_shuffled", "y_true")
    scored = detector.fit(dealt).score(test)
    m = M.ranking_metrics(scored, y="y_true", p="risk_score").crossJoin(test.agg(F.avg("y_true").alias("rate")))  # single rows
    far = F.abs(F.col("pr_auc") - F.col("rate"))
    return _row(m, "shuffled_labels", F.lit(detector.name), far, SHUFFLE_DISTANCE, F.when(F.col("rate") > 0, far <= SHUFFLE_DISTANCE))


def held_out_gate(train: DataFrame, test: DataFrame, make: Callable[[], Detector]) -> DataFrame:
    """Recall on an attack scenario that the detector never saw; one row per scenario (a few).

    Without positives on either side the fold cannot be judged: value and ``passed`` are null."""
    spark = train.sparkSession
    folds = scenario_folds(train.withColumn("split", F.lit("train")).select("split", "dominant_scenario_id", "y_true").unionByName(
        test.withColumn("split", F.lit("test")).select("split", "dominant_scenario_id", "y_true"))).collect()  # attack scenarios only
    out = spark.createDataFrame([("held_out_scenario", f.scenario_id, None, HELD_OUT_RECALL, None) for f in folds if not (f.train_positives and f.test_positives)], GATE)
    judged = [f for f in folds if f.train_positives and f.test_positives]
    kept = lambda f: F.coalesce(F.col("dominant_scenario_id") != f.scenario_id, F.lit(True))
    fitted = side_by_side(spark, [lambda f=f: make().fit(train.filter(kept(f))) for f in judged])
    for f, detector in zip(judged, fitted):
        scored = detector.score(test.filter(F.col("dominant_scenario_id") == f.scenario_id).filter("y_true = 1"))
        r = scored.agg(F.avg((F.col("risk_score") >= HELD_OUT_THRESHOLD).cast("double")).alias("r"))
        out = out.unionByName(_row(r, "held_out_scenario", F.lit(f.scenario_id), F.col("r"), HELD_OUT_RECALL, F.col("r") >= HELD_OUT_RECALL))
    return out


def leakage_gates(long: DataFrame, data: DataFrame, ident: Column, make: Callable[[int], Detector], rounds: tuple[int, int] = (50, 100), seed: int = 42) -> DataFrame:
    """All gates as one table. ``long`` (feature_id, value, y_true) of non-empty windows; ``data`` has features, split, y_true,
    dominant_scenario_id; ``make(rounds)`` gives an unfitted detector."""
    train, test = data.filter("split = 'train'"), data.filter("split = 'test'")
    shuffled, held_out = side_by_side(data.sparkSession, [lambda: shuffle_gate(train, test, ident, make(rounds[0]), seed),
                                                          lambda: held_out_gate(train, test, lambda: make(rounds[1]))])
    return median_auc_gate(long).unionByName(split_gate(data)).unionByName(shuffled).unionByName(held_out)
