"""Exact order statistics per group when groups have no size bound.

``percentile`` holds all distinct values of a group in one buffer. Here a group is first cut
into value buckets (a fixed number of them); only the buckets that hold a wanted rank are
looked into, and each of those is ranked on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS_PER_OCTAVE = 64


def value_bucket(v: Column) -> Column:
    """Monotone bucket of a number: 64 per power of two, on both sides of zero."""
    v = v.cast("double")
    size = F.floor(F.log2(F.abs(v)) * BUCKETS_PER_OCTAVE) + 80000
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("long")


def rank_select(hist: DataFrame, keys: list[str], value: str, weight: str,
                lo: Column, hi: Column) -> DataFrame:
    """Values at the 1-based ranks ``lo`` and ``hi`` (columns over ``n_total`` and keys).

    ``hist`` has one row per (keys, value) with its weight. Returns keys, n_total,
    lo_value, hi_value.
    """
    cells_in = hist.withColumn("_b", value_bucket(F.col(value)))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    targets = (cells_in.groupBy(*keys, "_b").agg(F.sum(weight).alias("_w"))
               .withColumn("_cum", F.sum("_w").over(before))
               .withColumn("n_total", F.sum("_w").over(by_key))
               .withColumn("_lo", lo).withColumn("_hi", hi)
               .withColumn("_before", F.col("_cum") - F.col("_w"))
               .filter((F.col("_before") < F.col("_hi")) & (F.col("_cum") >= F.col("_lo")))
               .select(*keys, "_b", "_before", "n_total", "_lo", "_hi"))
    inside = (Window.partitionBy(*keys, "_b").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, 0))
    upto = F.col("_before") + F.col("_in")
    return (cells_in.join(targets, [*keys, "_b"])
            .withColumn("_in", F.sum(weight).over(inside))
            .groupBy(*keys)
            .agg(F.first("n_total").alias("n_total"),
                 F.min(F.when(upto >= F.col("_lo"), F.col(value))).alias("lo_value"),
                 F.min(F.when(upto >= F.col("_hi"), F.col(value))).alias("hi_value")))


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("weight"))


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """Interpolated median per group; the group may be of any size."""
    return median_of(histogram(df, keys, value), keys, value, out)


def median_of(hist: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``exact_median`` of a histogram (keys, value, weight)."""
    n = F.col("n_total")
    picked = rank_select(hist, keys, value, "weight", F.floor((n + 1) / 2), F.floor(n / 2) + 1)
    return picked.select(*keys, ((F.col("lo_value") + F.col("hi_value")) / 2).alias(out), "n_total")


def exact_quantile(df: DataFrame, keys: list[str], value: str, p: float, out: str) -> DataFrame:
    """Linearly interpolated quantile per group; the group may be of any size."""
    at = F.lit(p) * (F.col("n_total") - 1)
    picked = rank_select(histogram(df, keys, value), keys, value, "weight", F.floor(at) + 1, F.ceil(at) + 1)
    frac = at - F.floor(at)
    return picked.select(*keys, (F.col("lo_value") + (F.col("hi_value") - F.col("lo_value")) * frac).alias(out), "n_total")
