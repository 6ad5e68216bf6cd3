"""Window-level classification metrics, exact, in DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from surgelens.functions.ranking import exact_quantile


def _tied(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """One row per (keys, distinct score)."""
    return df.groupBy(*keys, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("long")).alias("_pos"))


def ranking_metrics(df: DataFrame, keys: list[str] = (), y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Average precision (step, ties grouped) and ROC-AUC (mid-ranks) per key.

    Scores are cut into 4096 slices; running counts are taken over slices and then within
    each slice, so neither a key nor the whole table is ever sorted in one task.
    """
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(p).alias("_lo"), F.max(p).alias("_hi"), F.count(F.lit(1)).alias("_NT"), F.sum(F.col(y).cast("long")).alias("_PT"))
    tied = _tied(df, keys, y, p)
    tied = tied.join(span, keys) if keys else tied.crossJoin(F.broadcast(span))
    width = (F.col("_hi") - F.col("_lo")) / 4096
    tied = tied.withColumn("_s", F.when(width > 0, F.least(F.lit(4095), F.floor((F.col("_p") - F.col("_lo")) / width))).otherwise(0).cast("int"))
    slices = tied.groupBy(*keys, "_s").agg(F.sum("_n").alias("_sn"), F.sum("_pos").alias("_sp"))
    above = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*keys, "_s", F.coalesce(F.sum("_sn").over(above), F.lit(0)).alias("_an"), F.coalesce(F.sum("_sp").over(above), F.lit(0)).alias("_ap"))
    inside = Window.partitionBy(*keys, "_s").orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cum = (tied.join(slices, [*keys, "_s"])
           .withColumn("_cn", F.col("_an") + F.sum("_n").over(inside)).withColumn("_cp", F.col("_ap") + F.sum("_pos").over(inside)))
    neg_here = F.col("_n") - F.col("_pos")
    neg_above = F.col("_cn") - F.col("_cp") - neg_here
    neg_below = F.col("_NT") - F.col("_PT") - neg_above - neg_here
    out = cum.groupBy(*keys).agg(F.first("_NT").alias("n"), F.first("_PT").alias("pos"),
                                 F.sum(F.col("_pos") * (F.col("_cp") / F.col("_cn"))).alias("_ap"),
                                 F.sum(F.col("_pos") * (neg_below + neg_here / 2.0)).alias("_u"))
    single = (F.col("pos") == 0) | (F.col("pos") == F.col("n"))
    return out.select(*keys, F.when(single, F.col("pos") / F.col("n")).otherwise(F.try_divide("_ap", "pos")).alias("pr_auc"),
                      F.when(single, 0.5).otherwise(F.try_divide(F.col("_u"), F.col("pos") * (F.col("n") - F.col("pos")))).alias("roc_auc"))


def confusion(df: DataFrame, keys: list[str] = (), y: str = "y_true", p: str = "y_prob", threshold: float | Column = 0.5) -> DataFrame:
    hit, pos = F.col(p) >= threshold, F.col(y) == 1
    c = df.groupBy(*keys).agg(F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"),
                              F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp"),
                              F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier_score"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(*keys, "tn", "fp", "fn", "tp", "brier_score", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"),
                    share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(fp, F.greatest(F.lit(1), fp + tn)).alias("false_positive_rate"),
                    share(fn, F.greatest(F.lit(1), fn + tp)).alias("false_negative_rate"),
                    ((tp + fn) / (tp + fn + fp + tn)).alias("base_rate"), (tp + fn + fp + tn).alias("sample_count"), (tp + fn).alias("positive_count"))


def window_metrics(df: DataFrame, threshold: float | Column = 0.5, keys: list[str] = (), y: str = "y_true", p: str = "y_prob") -> DataFrame:
    a, b = ranking_metrics(df, keys, y, p), confusion(df, keys, y, p, threshold)
    return a.join(b, list(keys)) if keys else a.crossJoin(b)  # single rows


def feature_auc(long: DataFrame, y: str = "y_true") -> DataFrame:
    """Two-sided AUC of every non-constant feature in one pass over the long form."""
    varied = long.groupBy("feature_id").agg(F.min("value").alias("_a"), F.max("value").alias("_b")).filter("_a < _b").select("feature_id")
    auc = ranking_metrics(long.join(F.broadcast(varied), "feature_id"), ["feature_id"], y, "value")  # at most 151 ids
    return auc.select("feature_id", F.greatest(F.col("roc_auc"), 1 - F.col("roc_auc")).alias("auc"))


def class_overlap(long: DataFrame, y: str = "y_true") -> DataFrame:
    """Share of negatives inside the positives' p05..p95 band, per feature."""
    pos = long.filter(F.col(y) == 1)
    lo, hi = exact_quantile(pos, ["feature_id"], "value", 0.05, "p05").drop("n_total"), exact_quantile(pos, ["feature_id"], "value", 0.95, "p95").drop("n_total")
    band = lo.join(hi, "feature_id")
    return (long.filter(F.col(y) == 0).join(F.broadcast(band), "feature_id").groupBy("feature_id")
            .agg(F.first("p05").alias("p05"), F.first("p95").alias("p95"),
                 F.avg(F.col("value").between(F.col("p05"), F.col("p95")).cast("double")).alias("overlap_share")))


def across_runs(runs: DataFrame, metric_cols: list[str]) -> DataFrame:
    """Mean, population std, min and max of each metric per detector over runs."""
    long = runs.select("detector", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metric_cols])).alias("_m"))
    return long.groupBy("detector", "_m.metric").agg(F.avg("_m.v").alias("mean"), F.stddev_pop("_m.v").alias("std"), F.min("_m.v").alias("min"), F.max("_m.v").alias("max"))


def ablation_deltas(runs: DataFrame, metric: str = "pr_auc") -> DataFrame:
    """Mean differences between detector arms, and fusion against contextual per run."""
    names = ["volume_only", "contextual_ml", "fusion", "ablation_graph_only", "ablation_contextual_no_dev"]
    v = {n: F.when(F.col("detector") == n, F.col(metric)) for n in names}
    per_run = runs.groupBy("run_id").agg(F.max(v["fusion"]).alias("f"), F.max(v["contextual_ml"]).alias("c"))
    wins = per_run.agg(F.count_if(F.col("f") > F.col("c")).alias("fusion_wins"), F.count_if(F.col("f").isNotNull() & F.col("c").isNotNull()).alias("runs_compared"))
    m = runs.agg(*[F.avg(v[n]).alias(n) for n in names], F.greatest(F.stddev_pop(v["fusion"]), F.stddev_pop(v["contextual_ml"])).alias("spread"))
    return m.crossJoin(wins).select(  # single rows
        (F.col("contextual_ml") - F.col("volume_only")).alias("contextual_minus_volume"), (F.col("fusion") - F.col("contextual_ml")).alias("fusion_minus_contextual"),
        (F.col("ablation_graph_only") - F.col("contextual_ml")).alias("graph_minus_contextual"),
        (F.col("contextual_ml") - F.col("ablation_contextual_no_dev")).alias("contextual_minus_no_dev"), "spread", "fusion_wins", "runs_compared",
        F.when(F.abs(F.col("fusion") - F.col("contextual_ml")) < F.col("spread"), "no established difference")
         .when(F.col("fusion") - F.col("contextual_ml") >= 0.002, "fusion ahead").when(F.col("fusion") - F.col("contextual_ml") <= -0.002, "fusion behind")
         .otherwise("indistinguishable").alias("reading"))


def false_positives_by_scenario(scored: DataFrame, threshold: float | Column, keys: list[str] = ()) -> DataFrame:
    """Flagged windows that are not FRAUD_SPIKE, and the LEGIT_SPIKE population, by scenario."""
    neg = F.col("label") != "FRAUD_SPIKE"
    return (scored.withColumn("scenario_id", F.coalesce("dominant_scenario_id", F.lit("normal"))).groupBy(*keys, "scenario_id")
            .agg(F.count_if((F.col("risk_score") >= threshold) & neg).alias("false_positives"),
                 F.count_if(F.col("label") == "LEGIT_SPIKE").alias("hard_negative_windows")))


def expected_loss(missed_gmv, false_incidents, fn_incidents, fp_windows):
    """Operational cost, as money missed plus reviews, and as flat cost per miss plus reviews."""
    return (missed_gmv + false_incidents * 250.0).alias("loss_by_money"), (fn_incidents * 5000.0 + fp_windows * 250.0).alias("loss_by_count")
