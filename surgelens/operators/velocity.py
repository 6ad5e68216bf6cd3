"""Trailing counters per key, claims with a time to live, and samples per bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def _running_at(marks: DataFrame, df: DataFrame, key: str, ts: str, out: str) -> DataFrame:
    """Running sum of ``marks`` (key, _t, _d) at the instants of ``df``.

    Sums run over hours first and then within the hour, so a hot key is spread over its
    hours; equal instants collapse before.
    """
    ask = df.select(key, F.unix_micros(ts).alias("_t")).distinct().select(key, "_t", F.lit(0).cast("long").alias("_d"), F.lit(1).alias("_q"))
    steps = (marks.select(key, "_t", F.col("_d").cast("long").alias("_d"), F.lit(0).alias("_q")).unionByName(ask)
             .groupBy(key, "_t").agg(F.sum("_d").alias("_d"), F.max("_q").alias("_q"))
             .withColumn("_h", F.floor(F.col("_t") / 3600000000)))
    before = Window.partitionBy(key).orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    carried = (steps.groupBy(key, "_h").agg(F.sum("_d").alias("_s"))
               .select(key, "_h", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base")))
    inside = Window.partitionBy(key, "_h").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    at = (steps.join(carried, [key, "_h"]).withColumn(out, F.col("_base") + F.sum("_d").over(inside))
          .filter("_q = 1").select(key, "_t", out))
    return df.withColumn("_t", F.unix_micros(ts)).join(at, [key, "_t"]).drop("_t")


def trailing_count(df: DataFrame, key: str, seconds: int = 60, ts: str = "timestamp", out: str = "trailing") -> DataFrame:
    """Events of the key in ``[t - seconds, t]``, the event itself and its equals included:
    +1 at each event, -1 once it is older than the window, and a running sum."""
    us = F.unix_micros(ts)
    marks = F.array(F.struct(us.alias("_t"), F.lit(1).alias("_d")),
                    F.struct((us + seconds * 1000000 + 1).alias("_t"), F.lit(-1).alias("_d")))
    return _running_at(df.select(key, F.explode(marks).alias("_m")).select(key, "_m.*"), df, key, ts, out)


def trailing_distinct(df: DataFrame, key: str, member: str, seconds: int, ts: str = "timestamp", out: str = "members") -> DataFrame:
    """Distinct members of the key in ``[t - seconds, t]`` at each event.

    A member counts from each sighting until ``seconds`` after it, or its next sighting;
    marks at both ends replace the sets.
    """
    length = seconds * 1000000
    ev = df.filter(F.col(member).isNotNull()).select(key, member, F.unix_micros(ts).alias("_us")).distinct()
    per = Window.partitionBy(key, member).orderBy("_us")
    gap_next, gap_prev = F.lead("_us").over(per) - F.col("_us"), F.col("_us") - F.lag("_us").over(per)
    marked = (ev.withColumn("_on", gap_prev.isNull() | (gap_prev > length))
              .withColumn("_off", gap_next.isNull() | (gap_next > length)))
    ups = marked.filter("_on").select(key, F.col("_us").alias("_t"), F.lit(1).alias("_d"))
    downs = marked.filter("_off").select(key, (F.col("_us") + length + 1).alias("_t"), F.lit(-1).alias("_d"))
    return _running_at(ups.unionByName(downs), df, key, ts, out)


def velocity_flags(df: DataFrame, key: str, limit: int, seconds: int = 60, ts: str = "timestamp") -> DataFrame:
    """Flag events whose trailing count, themselves included, exceeds the limit."""
    return trailing_count(df, key, seconds, ts).withColumn("over_limit", F.col("trailing") > limit)


def sample_per_bucket(df: DataFrame, bucket: str, ident: str, cap: int, seed: int) -> DataFrame:
    """Uniform sample of at most ``cap`` rows per bucket, by a seeded hash order.

    Hash slices are ranked on their own first, so only ``cap`` rows per slice reach the
    final ranking of a bucket.
    """
    h = F.md5(F.concat_ws("|", F.col(ident), F.lit(seed)))
    sliced = df.withColumn("_h", h).withColumn("_s", F.substring("_h", 32, 1))
    first = sliced.withColumn("_r", F.row_number().over(Window.partitionBy(bucket, "_s").orderBy("_h"))).filter(F.col("_r") <= cap)
    return (first.withColumn("_r", F.row_number().over(Window.partitionBy(bucket).orderBy("_h")))
            .filter(F.col("_r") <= cap).drop("_h", "_s", "_r"))


def composition(df: DataFrame) -> DataFrame:
    """Legitimate and fraudulent counts and the measured fraud ratio."""
    return (df.agg(F.count(F.lit(1)).alias("events"), F.count_if(~F.col("is_abusive")).alias("legitimate_events"), F.count_if("is_abusive").alias("fraud_events"))
            .withColumn("actual_fraud_ratio", F.try_divide("fraud_events", "events")))
