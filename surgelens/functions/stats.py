"""Concentration, entropy, divergence and robust scale, as grouped DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from surgelens.functions.ranking import histogram, median_of, value_bucket

MAD_SCALE = 1.4826  # makes MAD comparable to a standard deviation
MAD_FLOOR = 1e-4


def entropy_bits(total: Column, plogp: Column) -> Column:
    """Shannon entropy from N and sum(c*log2 c); 0 when N is 0."""
    return F.when(total > 0, F.greatest(F.lit(0.0), F.log2(total.cast("double")) - plogp / total)).otherwise(0.0)


def gini_from_ranks(items: Column, total: Column, rank_sum: Column) -> Column:
    """Gini from the number of items, their sum and sum(rank * value)."""
    return F.when(total > 0, 2.0 * rank_sum / (items * total) - (items + 1.0) / items).otherwise(0.0)


def block_rank_sum(value: Column, multiplicity: Column, before: Column) -> Column:
    """sum(rank * value) of a block of equal values that follows ``before`` smaller ones."""
    return value * (multiplicity * before + multiplicity * (multiplicity + 1) / 2)


def gini(df: DataFrame, keys: list[str], value: str, out: str = "gini") -> DataFrame:
    """Gini per group. Equal values are collapsed first, so a group of any size is ranked
    over its distinct values only; negative values are dropped."""
    hist = df.filter(F.col(value) >= 0).groupBy(*keys, F.col(value).alias("_y")).agg(F.count(F.lit(1)).alias("_h"))
    w = Window.partitionBy(*keys).orderBy("_y").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.withColumn("_before", F.sum("_h").over(w) - F.col("_h"))
    return (ranked.groupBy(*keys)
            .agg(F.sum("_h").alias("_n"), F.sum(F.col("_y") * F.col("_h")).alias("_t"),
                 F.sum(block_rank_sum(F.col("_y"), F.col("_h"), F.col("_before"))).alias("_r"))
            .select(*keys, gini_from_ranks(F.col("_n"), F.col("_t").cast("double"), F.col("_r")).alias(out)))


def entropy(df: DataFrame, keys: list[str], count: str, out: str = "entropy") -> DataFrame:
    """Shannon entropy (bits) per group over a column of category counts."""
    c = F.col(count)
    return (df.filter(c > 0).groupBy(*keys)
            .agg(F.sum(c).alias("_n"), F.sum(c * F.log2(c.cast("double"))).alias("_p"))
            .select(*keys, entropy_bits(F.col("_n"), F.col("_p")).alias(out)))


def js_distance(p: DataFrame, q: DataFrame, keys: list[str], category: str, weight: str = "weight",
                out: str = "js_distance") -> DataFrame:
    """Jensen-Shannon distance per group of two category distributions (any scale).

    A group missing on one side, or with zero total, has distance 0.
    """
    one = p.groupBy(*keys, category).agg(F.sum(weight).cast("double").alias("_p"))
    two = q.groupBy(*keys, category).agg(F.sum(weight).cast("double").alias("_q"))
    both = one.join(two, [*keys, category], "full").fillna(0.0, ["_p", "_q"])
    totals = both.groupBy(*keys).agg(F.sum("_p").alias("_pt"), F.sum("_q").alias("_qt"))
    shares = (both.join(totals, keys).withColumn("_p", F.try_divide("_p", "_pt"))
              .withColumn("_q", F.try_divide("_q", "_qt")))
    mid = (F.col("_p") + F.col("_q")) / 2
    side = lambda c: F.when(c > 0, c * F.log2(c / mid)).otherwise(0.0)
    return (shares.groupBy(*keys)
            .agg(F.min(F.least("_pt", "_qt")).alias("_least"),
                 (F.sum(side(F.col("_p"))) / 2 + F.sum(side(F.col("_q"))) / 2).alias("_j"))
            .select(*keys, F.when(F.col("_least") > 0, F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), F.col("_j")))))
                    .otherwise(0.0).alias(out)))


def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and scaled MAD per group of bounded size (``percentile`` keeps a group's
    distinct values in memory); see ``median_mad_large`` for the rest."""
    per_key = Window.partitionBy(*keys)
    mid = df.filter(F.col(value).isNotNull()).withColumn("_med", F.median(value).over(per_key))
    return (mid.groupBy(*keys)
            .agg(F.first("_med").alias("expected_median"),
                 F.greatest(F.lit(MAD_FLOOR), F.median(F.abs(F.col(value) - F.col("_med"))) * MAD_SCALE)
                 .alias("variability_mad"),
                 F.count(F.lit(1)).alias("sample_count")))


def median_mad_large(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``median_mad`` for groups of any size."""
    hist = histogram(df, keys, value).withColumn("_b", value_bucket(F.col(value)))
    med = median_of(hist.drop("_b"), keys, value, "expected_median").withColumnRenamed("n_total", "sample_count")
    # medians go to the values by value bucket: joined by the keys alone, a key's rows would all be sorted in one task
    buckets = hist.select(*keys, "_b").distinct().join(med.drop("sample_count"), keys)
    spread = (hist.join(buckets, [*keys, "_b"]).withColumn("_dev", F.abs(F.col(value) - F.col("expected_median")))
              .groupBy(*keys, "_dev").agg(F.sum("weight").alias("weight")))
    mad = median_of(spread.filter("_dev is not null"), keys, "_dev", "_mad").drop("n_total")
    return (med.join(mad, keys)
            .select(*keys, "expected_median",
                    F.greatest(F.lit(MAD_FLOOR), F.col("_mad") * MAD_SCALE).alias("variability_mad"),
                    F.col("sample_count")))


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population standard deviation, min and max per group."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                                 F.min(value).alias("min"), F.max(value).alias("max"))
