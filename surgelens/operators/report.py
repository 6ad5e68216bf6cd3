"""Comparison tables over detectors and scenarios: dense grids whose cells say what was measured, on how many,
or that nothing was there to measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from surgelens.operators import metrics as M
from surgelens.operators.labels import NOT_EVALUATED


def _grid(spark, scenarios: list[str], detectors: list[str]) -> DataFrame:
    """Every asked scenario with every detector: a few rows, made on the driver."""
    return spark.createDataFrame([(s, d) for s in scenarios for d in detectors], "scenario_id string, detector string")


def _wide(cells: DataFrame, detectors: list[str], table: str) -> DataFrame:
    """(table, scenario_id, population, one text per detector)."""
    return cells.groupBy(F.lit(table).alias("table"), "scenario_id").agg(
        F.max("population").alias("population"), *[F.max(F.when(F.col("detector") == d, F.col("cell"))).alias(d) for d in detectors])


def rate_text(part: Column, whole: Column) -> Column:
    """A share in percent with its counts, e.g. ``66.7% (2/3)``; the digit is rounded half up."""
    tenths = F.floor((part * 2000 + whole) / (whole * 2)).cast("long")
    return F.concat((tenths / 10).cast("decimal(10,1)").cast("string"), F.lit("% ("), part.cast("string"), F.lit("/"), whole.cast("string"), F.lit(")"))


def hard_negative_table(by_scenario: DataFrame, scenarios: list[str], detectors: list[str]) -> DataFrame:
    """False positives of each detector on legitimate spikes, beside the spikes' windows.

    ``by_scenario``: (detector, scenario_id, false_positives, hard_negative_windows). A scenario without windows is
    not evaluated, whatever a detector flagged; one with windows and no flag is a measured 0."""
    known = by_scenario.select("detector", "scenario_id", "false_positives", "hard_negative_windows")
    there = known.groupBy("scenario_id").agg(F.max("hard_negative_windows").alias("population"))
    cells = (_grid(by_scenario.sparkSession, scenarios, detectors).join(there, "scenario_id", "left").join(known, ["scenario_id", "detector"], "left")
             .withColumn("population", F.coalesce("population", F.lit(0)).cast("long")))
    cell = F.when(F.col("population") > 0, F.coalesce("false_positives", F.lit(0)).cast("string")).otherwise(NOT_EVALUATED)
    return _wide(cells.withColumn("cell", cell), detectors, "hard_negative_false_positives")


def recall_table(recalls: DataFrame, scenarios: list[str], detectors: list[str]) -> DataFrame:
    """Incident recall of each detector by attack scenario with its denominator.

    ``recalls``: (detector, scenario_id, hit, total). A scenario without an incident is not evaluated."""
    there = recalls.groupBy("scenario_id").agg(F.max("total").alias("population"))
    cells = (_grid(recalls.sparkSession, scenarios, detectors).join(there, "scenario_id", "left").join(recalls, ["scenario_id", "detector"], "left")
             .withColumn("population", F.coalesce("population", F.lit(0)).cast("long")))
    hit = F.coalesce("hit", F.lit(0)).cast("long")
    cell = F.when(F.col("population") > 0, rate_text(hit, F.col("population"))).otherwise(NOT_EVALUATED)
    return _wide(cells.withColumn("cell", cell), detectors, "incident_recall")


def detector_table(metrics: DataFrame) -> DataFrame:
    """One row per detector as a report prints it: ranking quality, recall and precision with their counts, latency, alert load, losses.

    ``metrics`` is what ``scoring.evaluate_scores`` returns. Without incidents in the truth recall and latency are not evaluated."""
    truth = (F.col("true_positives") + F.col("false_negatives")).cast("long")
    pred = (F.col("true_positives") + F.col("false_positives")).cast("long")
    hit = F.col("true_positives").cast("long")
    two = lambda c: F.col(c).cast("decimal(38,10)").cast("decimal(20,2)").cast("string")
    return metrics.select(
        "detector", "pr_auc", truth.alias("ground_truth_incidents"), F.when(truth > 0, rate_text(hit, truth)).otherwise(NOT_EVALUATED).alias("incident_recall"),
        F.when(pred > 0, rate_text(hit, pred)).otherwise(NOT_EVALUATED).alias("incident_precision"),
        F.when(hit > 0, two("latency_p50_minutes")).otherwise(NOT_EVALUATED).alias("latency_p50_minutes"),
        two("false_alerts_per_merchant_day").alias("false_alerts_per_merchant_day"), two("loss_by_money").alias("expected_loss"), (truth < 10).alias("few_incidents"))


def separability_audit(long: DataFrame, k: int = 10, y: str = "y_true") -> DataFrame:
    """The ``k`` features that separate the classes best on their own: two-sided AUC, class means, the positives' p05..p95
    band and the share of negatives inside it. ``long``: (feature_id, value, y_true); constant features are skipped."""
    from pyspark.sql import Window
    top = M.feature_auc(long, y)
    top = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc(F.round("auc", 9)), "feature_id"))).filter(F.col("position") <= k)  # over registry features
    mine = long.join(F.broadcast(top.select("feature_id")), "feature_id")
    means = mine.groupBy("feature_id").agg(F.avg(F.when(F.col(y) == 1, F.col("value"))).alias("attack_mean"), F.avg(F.when(F.col(y) == 0, F.col("value"))).alias("other_mean"))
    return top.join(means, "feature_id").join(M.class_overlap(mine, y), "feature_id", "left")


def separability_summary(long: DataFrame, y: str = "y_true") -> DataFrame:
    """One row: largest and median single-feature AUC, and the number of features that vary."""
    return M.feature_auc(long, y).agg(F.max("auc").alias("max_auc"), F.percentile("auc", F.lit(0.5)).alias("median_auc"), F.count(F.lit(1)).alias("features"))
