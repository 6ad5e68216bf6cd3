"""Hour-of-week baselines (median and MAD), deviation twins and the temporal guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from surgelens.functions.stats import MAD_FLOOR, median_mad_large
from surgelens.operators.grid import hour_of_week
from surgelens.registry import FEATURES, TWIN_IDS, col_of

WINDOW = ["merchant_id", "window_size", "window_end"]
PROFILE = ["feature_id", "window_size", "hour_of_week"]
RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}


class BaselineLeak(AssertionError):
    """A baseline fitted on a window's future was applied to it."""


def to_long(wide: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Wide feature rows -> (window key, feature_id, value)."""
    ids = [f for f in (ids or FEATURES) if col_of(f) in wide.columns]
    pairs = F.array(*[F.struct(F.lit(f).alias("feature_id"), F.col(col_of(f)).cast("double").alias("value")) for f in ids])
    return wide.select(*WINDOW, F.explode(pairs).alias("_f")).select(*WINDOW, "_f.feature_id", "_f.value")


def to_wide(long: DataFrame, ids: list[str], value: str = "value", suffix: str = "", others: list[str] = ()) -> DataFrame:
    """Long form -> one row per window, over the fixed id list (no extra distinct job)."""
    return long.groupBy(*WINDOW).agg(
        *[F.max(F.when(F.col("feature_id") == f, F.col(value))).alias(col_of(f) + suffix) for f in ids],
        *[F.min(o).alias(o) for o in others])


def fit_baselines(long: DataFrame, categories: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Merchant and category baselines from a window history.

    Medians are taken over value buckets, so a group may hold any number of windows. The fit
    period is that of the whole history.
    """
    history = long.withColumn("hour_of_week", hour_of_week("window_end"))
    period = history.agg(F.min("window_end").alias("fit_period_start"), F.max("window_end").alias("fit_period_end"))
    n = F.col("sample_count")
    merchant = (median_mad_large(history, ["merchant_id", *PROFILE], "value")
                .withColumn("confidence", F.when(n >= 20, "HIGH").when(n >= 5, "MEDIUM").otherwise("LOW"))
                .crossJoin(F.broadcast(period)))  # one row
    if categories is None:
        named = history.withColumn("category", F.lit("retail"))
    else:
        named = (history.join(categories.select("merchant_id", "category"), "merchant_id", "left")
                 .withColumn("category", F.coalesce("category", F.lit("retail"))))
    category = (median_mad_large(named, ["category", *PROFILE], "value")
                .withColumn("confidence", F.lit("MEDIUM")).crossJoin(F.broadcast(period)))
    return merchant, category


def lookup_baselines(long: DataFrame, merchant_b: DataFrame, category_b: DataFrame | None = None,
                     categories: DataFrame | None = None) -> DataFrame:
    """Attach a baseline to each (window, feature): merchant's own, else its category's at
    LOW confidence, else (0, 1, LOW)."""
    keyed = long.withColumn("hour_of_week", hour_of_week("window_end"))
    own = merchant_b.select("merchant_id", *PROFILE, F.col("expected_median").alias("_m1"), F.col("variability_mad").alias("_s1"),
                            F.col("confidence").alias("_c1"), F.col("fit_period_end").alias("_f1"))
    out = keyed.join(own, ["merchant_id", *PROFILE], "left")
    if category_b is not None:
        if categories is not None:
            out = out.join(categories.select("merchant_id", "category"), "merchant_id", "left")
        else:
            out = out.withColumn("category", F.lit(None).cast("string"))
        peer = category_b.select("category", *PROFILE, F.col("expected_median").alias("_m2"), F.col("variability_mad").alias("_s2"))
        out = out.withColumn("category", F.coalesce("category", F.lit("retail"))).join(peer, ["category", *PROFILE], "left").drop("category")
    else:
        out = out.withColumn("_m2", F.lit(None).cast("double")).withColumn("_s2", F.lit(None).cast("double"))
    return out.select(*long.columns, "hour_of_week",
                      F.coalesce("_m1", "_m2", F.lit(0.0)).alias("expected_median"),
                      F.coalesce("_s1", "_s2", F.lit(1.0)).alias("variability_mad"),
                      F.coalesce("_c1", F.lit("LOW")).alias("confidence"), F.col("_f1").alias("fit_period_end"))


def leaks(looked_up: DataFrame) -> DataFrame:
    """Rows whose baseline was fitted on history that reaches past their window."""
    return looked_up.filter(F.col("fit_period_end") > F.col("window_end"))


def deviation(long: DataFrame, merchant_b: DataFrame, category_b: DataFrame | None = None,
              categories: DataFrame | None = None, allow_in_sample: bool = False) -> DataFrame:
    """(window, feature, value, deviation, confidence) for features with a twin.

    Out of sample, a leaking row fails the job when it is evaluated.
    """
    looked = lookup_baselines(long.filter(F.col("feature_id").isin(TWIN_IDS)), merchant_b, category_b, categories)
    dev = (F.col("value") - F.col("expected_median")) / F.greatest(F.lit(MAD_FLOOR), F.col("variability_mad"))
    if not allow_in_sample:
        bad = F.col("fit_period_end") > F.col("window_end")
        stop = F.raise_error(F.lit("BaselineLeak: baseline fitted past the window it is applied to"))
        dev = F.when(bad, stop.cast("double")).otherwise(dev)
        # the guard also rides on the confidence, so that it is not pruned where no deviation is read
        looked = looked.withColumn("confidence", F.when(bad, stop.cast("string")).otherwise(F.col("confidence")))
    return looked.withColumn("deviation", dev)


def overall_confidence(deviations: DataFrame) -> DataFrame:
    """Lowest confidence among a window's twins."""
    rank = F.when(F.col("confidence") == "HIGH", 2).when(F.col("confidence") == "MEDIUM", 1).otherwise(0)
    return (deviations.groupBy(*WINDOW).agg(F.min(rank).alias("_r"))
            .select(*WINDOW, F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), F.col("_r") + 1).alias("baseline_confidence")))


def twins_equal_raw(deviations: DataFrame) -> DataFrame:
    """True when every twin equals its raw value, i.e. no baseline was in effect."""
    return deviations.agg(F.bool_and(F.abs(F.col("deviation") - F.col("value")) < 1e-9).alias("twins_are_raw"))


def fit_as_of(wide: DataFrame, as_of: str, days: int, categories: DataFrame | None = None) -> DataFrame:
    """Merchant baselines from the windows that lie wholly in ``[as_of - days, as_of)``."""
    from surgelens.operators.grid import window_start
    end = F.to_timestamp(F.lit(as_of))
    start = F.timestamp_micros(F.unix_micros(end) - F.lit(days * 86400000000))
    inside = wide.filter((window_start(F.col("window_end"), F.col("window_size")) >= start) & (F.col("window_end") < end))
    return fit_baselines(to_long(inside), categories)[0]


def to_store(merchant_b: DataFrame, version: int = 1) -> DataFrame:
    return merchant_b.withColumn("version", F.lit(version))


def from_store(rows: DataFrame) -> DataFrame:
    """Stored profiles -> baselines; an unknown confidence reads as LOW."""
    return rows.select("merchant_id", *PROFILE, F.col("expected_median").cast("double"), F.col("variability_mad").cast("double"),
                       F.coalesce(F.col("sample_count"), F.lit(0)).cast("long").alias("sample_count"),
                       F.when(F.col("confidence").isin("LOW", "MEDIUM", "HIGH"), F.col("confidence")).otherwise("LOW").alias("confidence"),
                       "fit_period_start", "fit_period_end")
