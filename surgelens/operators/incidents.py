"""Predicted incidents, matching against truth and the incident metric taxonomy."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from surgelens.operators.labels import runs

DETECTION = "true_positives long, false_positives long, false_negatives long"


def assemble_incidents(flagged: DataFrame, gap: int = 180, by: list[str] = ()) -> DataFrame:
    """Flagged windows (merchant_id, window_size, window_end, risk_score, gmv) -> incidents;
    ends at most ``gap`` seconds apart belong together. ``by``: columns (a detector, a run) whose values stay apart."""
    out = runs(flagged, [*by, "merchant_id"], gap, "risk_score")
    ident = F.concat(F.lit("pred_inc_"), F.substring(F.sha2(F.concat_ws("|", "merchant_id", F.unix_micros("start_time"), F.unix_micros("end_time")), 256), 1, 26))
    return out.select(*by, ident.alias("incident_id"), "merchant_id", F.col("start_time").alias("first_flag_time"),
                      F.col("end_time").alias("last_flag_time"), "window_count", "max_risk_score", "total_gmv")


def overlap_pairs(pred: DataFrame, truth: DataFrame, by: list[str] = ()) -> DataFrame:
    """Pairs of one merchant whose closed spans touch or overlap, with the overlap seconds. With ``by``, of predictions
    only: the truth is the same for each of their values.

    Spans meet on (merchant, day): a span is listed under every day it touches and a pair is
    kept on the first day both share.
    """
    day = 86400000000
    p = pred.select(*by, "merchant_id", F.col("incident_id").alias("pred_id"), F.unix_micros("first_flag_time").alias("ps"), F.unix_micros("last_flag_time").alias("pe"))
    t = truth.filter("is_attack").select("merchant_id", F.col("truth_id"), F.unix_micros("start_time").alias("ts"), F.unix_micros("end_time").alias("te"), F.col("total_gmv").alias("truth_gmv"))
    days = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / day), F.floor(F.col(b) / day)))
    both = p.withColumn("_d", days("ps", "pe")).join(t.withColumn("_d", days("ts", "te")), ["merchant_id", "_d"])
    start, end = F.greatest("ps", "ts"), F.least("pe", "te")
    return (both.filter((F.col("pe") >= F.col("ts")) & (F.col("ps") <= F.col("te")) & (F.col("_d") == F.floor(start / day)))
            .withColumn("overlap", (end - start) / 1e6).drop("_d"))


def number_truth(truth: DataFrame) -> DataFrame:
    """Give true incidents a stable id and their place in the greedy order."""
    ident = F.substring(F.sha2(F.concat_ws("|", "merchant_id", "scenario_id", F.unix_micros("start_time"), F.unix_micros("end_time")), 256), 1, 20)
    return truth.withColumn("truth_id", ident)


def greedy_pairs(pairs: DataFrame, truth_order: tuple[str, ...] = ("ts", "truth_id"), by: list[str] = ()) -> DataFrame:
    """Greedy one-to-one matching: predictions by start time take the first free incident.

    A chain of overlapping spans is independent of every other one, so each chain (not each
    merchant) is one group; it only holds candidate pairs.
    """
    w = Window.partitionBy(*by, "merchant_id").orderBy("lo", "hi")
    spans = pairs.select(*by, "merchant_id", "pred_id", "truth_id", F.least("ps", "ts").alias("lo"), F.greatest("pe", "te").alias("hi"))
    seen = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    chained = (spans.withColumn("_new", F.when(seen.isNull() | (F.col("lo") > seen), 1).otherwise(0))
               .withColumn("chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
               .select(*by, "merchant_id", "pred_id", "truth_id", "chain"))
    rows = pairs.join(chained, [*by, "merchant_id", "pred_id", "truth_id"])
    others = "".join(f"{c} {pairs.schema[c].dataType.simpleString()}, " for c in by)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ps", "pred_id", *truth_order])
        free, keep, last = set(pdf["truth_id"]), [], None
        for i, (pred, true) in enumerate(zip(pdf["pred_id"], pdf["truth_id"])):
            if pred != last and true in free:
                free.discard(true)
                keep.append(i)
                last = pred
        return pdf.iloc[keep][[*by, "merchant_id", "pred_id", "truth_id", "ps", "ts", "truth_gmv"]]

    return rows.select(*by, "merchant_id", "chain", "pred_id", "truth_id", "ps", "ts", F.col("truth_gmv").cast("double").alias("truth_gmv")).groupBy(
        *by, "merchant_id", "chain").applyInPandas(assign, others + "merchant_id string, pred_id string, truth_id string, ps long, ts long, truth_gmv double")


def _beside(first: DataFrame, others: list[DataFrame], by: list[str], spread: DataFrame | None) -> DataFrame:
    """Join single rows, or rows per value of ``by`` onto all its values; counts that are missing are 0."""
    out = first if spread is None else spread.join(first, [*by], "left")
    for o in others:
        out = out.join(F.broadcast(o), [*by], "left") if set(by) & set(o.columns) else out.crossJoin(F.broadcast(o))  # a row per value, or one
    return out.fillna(0)


def match_incidents(pred: DataFrame, truth: DataFrame, by: list[str] = (), spread: DataFrame | None = None) -> DataFrame:
    """One row, or one per row of ``spread`` (the values of ``by``): counts, precision, recall, F1, latency and money recall of greedy matching
    on any overlap (touching ends included)."""
    matched = greedy_pairs(overlap_pairs(pred, truth, by), by=by)
    wait = F.greatest(F.lit(0.0), (F.col("ps") - F.col("ts")) / 6e7)
    m = matched.groupBy(*by).agg(F.count(F.lit(1)).alias("tp"), F.coalesce(F.percentile(wait, F.lit(0.5)), F.lit(0.0)).alias("p50"),
                    F.coalesce(F.percentile(wait, F.lit(0.9)), F.lit(0.0)).alias("p90"), F.coalesce(F.sum("truth_gmv"), F.lit(0.0)).alias("caught"))
    t = truth.filter("is_attack").agg(F.count(F.lit(1)).alias("n_true"), F.coalesce(F.sum("total_gmv"), F.lit(0)).cast("double").alias("gmv"))
    p = pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pred"))
    r = _beside(m, [t, p], by, spread)
    empty = (F.col("n_true") == 0) & (F.col("n_pred") == 0)
    prec = F.when(empty, 1.0).otherwise(F.col("tp") / F.greatest(F.lit(1), F.col("n_pred")))
    rec = F.when(empty, 1.0).otherwise(F.col("tp") / F.greatest(F.lit(1), F.col("n_true")))
    return r.select(
        *by, F.col("tp").alias("true_positives"), (F.col("n_pred") - F.col("tp")).alias("false_positives"), (F.col("n_true") - F.col("tp")).alias("false_negatives"),
        rec.alias("incident_recall"), prec.alias("incident_precision"),
        F.when(empty, 1.0).otherwise(2.0 * prec * rec / F.greatest(F.lit(1e-4), prec + rec)).alias("incident_f1"),
        F.col("p50").alias("latency_p50_minutes"), F.col("p90").alias("latency_p90_minutes"),
        F.col("caught").alias("caught_fraud_gmv"), F.greatest(F.lit(0.0), F.col("gmv") - F.col("caught")).alias("missed_fraud_gmv"),
        F.when(F.col("gmv") > 0, F.col("caught") / F.greatest(F.lit(1.0), F.col("gmv"))).otherwise(1.0).alias("gmv_recall"))


def material_pairs(pred: DataFrame, truth: DataFrame, fraction: float = 0.10, by: list[str] = ()) -> DataFrame:
    """Pairs whose overlap reaches min(duration, max(60 s, fraction of duration)), with IoU."""
    dur = (F.col("te") - F.col("ts")) / 1e6
    need = F.least(dur, F.greatest(F.lit(60.0), dur * fraction))
    union = F.greatest(F.lit(1e-9), (F.greatest("pe", "te") - F.least("ps", "ts")) / 1e6)
    return (overlap_pairs(pred, truth, by).filter((F.col("overlap") >= need) & (F.col("overlap") > 0))
            .withColumn("iou", F.col("overlap") / union))


def incident_taxonomy(pred: DataFrame, truth: DataFrame, fraction: float = 0.10, by: list[str] = (), spread: DataFrame | None = None) -> DataFrame:
    """One row, or one per row of ``spread`` (the values of ``by``): detection recall, strict recall, precision, false alarms, mean IoU,
    fragmentation and merge index."""
    pairs = material_pairs(pred, truth, fraction, by)
    strict = greedy_pairs(pairs, by=by).groupBy(*by).agg(F.count(F.lit(1)).alias("strict"))
    a = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("merchant_id", "truth_id").alias("detected"),
                  F.countDistinct("merchant_id", "pred_id").alias("hitting"), F.avg("iou").alias("iou"))
    t = truth.filter("is_attack").agg(F.count(F.lit(1)).alias("n_true"))
    p = pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pred"))
    r = _beside(a, [strict, t, p], by, spread)
    share = lambda x, y: F.coalesce(F.try_divide(F.col(x), F.col(y)), F.lit(0.0))
    some = F.col("n_true") > 0
    return r.select(*by, F.col("n_true").alias("n_ground_truth"), F.col("n_pred").alias("n_predicted"), F.col("detected").alias("detected_count"),
                    share("detected", "n_true").alias("detection_recall"), F.col("strict").alias("strict_matched_count"),
                    share("strict", "n_true").alias("strict_match_recall"),
                    F.when(some, share("hitting", "n_pred")).otherwise(0.0).alias("incident_precision"),
                    (F.col("n_pred") - F.col("hitting")).alias("false_alarm_incidents"),
                    F.coalesce("iou", F.lit(0.0)).alias("mean_temporal_iou"), share("pairs", "detected").alias("fragmentation_index"),
                    share("pairs", "hitting").alias("merge_index"))


def scenario_recall(truth: DataFrame, flagged: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per scenario (and value of ``by``, a column of the flagged windows): incidents with any flagged window end inside, and
    all incidents. With ``by``, only values that flagged something are listed."""
    day = 86400000000
    f = flagged.select(*by, "merchant_id", F.unix_micros("window_end").alias("_e")).distinct().withColumn("_d", F.floor(F.col("_e") / day))
    t = (truth.select("merchant_id", "scenario_id", "truth_id", F.unix_micros("start_time").alias("_a"), F.unix_micros("end_time").alias("_b"))
         .withColumn("_d", F.explode(F.sequence(F.floor(F.col("_a") / day), F.floor(F.col("_b") / day)))))
    hit = (t.join(f, ["merchant_id", "_d"]).filter(F.col("_e").between(F.col("_a"), F.col("_b")))
           .select(*by, "merchant_id", "scenario_id", "truth_id").distinct().groupBy(*by, "scenario_id").agg(F.count(F.lit(1)).alias("hit")))
    total = truth.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("total"))
    if not by:
        return total.join(hit, "scenario_id", "left").select("scenario_id", F.coalesce("hit", F.lit(0)).alias("hit"), "total")
    values = flagged.select(*by).distinct()  # a few detectors
    return total.crossJoin(F.broadcast(values)).join(hit, [*by, "scenario_id"], "left").select(*by, "scenario_id", F.coalesce("hit", F.lit(0)).alias("hit"), "total")
