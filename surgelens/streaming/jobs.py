"""Structured Streaming: intake with claims, sliding additive features, closed-window scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from surgelens.operators.grid import HORIZONS
from surgelens.sources import intake


def stream_intake(events: DataFrame, ttl_seconds: int = intake.DEDUPE_TTL_SECONDS) -> DataFrame:
    """Checked events, first delivery per idempotency key, then per event id, within the time to live."""
    checked = intake.check_events(events).filter(F.size("reasons") == 0).drop("reasons")
    claimed = checked.withWatermark("timestamp", f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark(["idempotency_key"])
    return claimed.dropDuplicatesWithinWatermark(["event_id"])


def stream_rejects(events: DataFrame) -> DataFrame:
    """The other output of the intake: events that fail a check, with their reasons."""
    return intake.check_events(events).filter(F.size("reasons") > 0)


def sliding_counts(attempts: DataFrame, size: str, lateness: str = "5 minutes") -> DataFrame:
    """Additive features of one horizon; windows close when the watermark passes their end."""
    minutes = HORIZONS[size]
    return (attempts.withWatermark("timestamp", lateness)
            .groupBy("merchant_id", F.window("timestamp", f"{minutes} minutes", "1 minute"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("gmv"), F.count_if(F.col("coupon_id").isNotNull()).alias("coupons"),
                 F.count_if(F.col("attempt_number") > 1).alias("retries"))
            .select("merchant_id", F.lit(size).alias("window_size"), F.col("window.end").alias("window_end"), "n", "gmv",
                    (F.col("n") / minutes).alias("txn_rate"), (F.col("coupons") / F.col("n")).alias("coupon_rate"), (F.col("retries") / F.col("n")).alias("retry_rate")))


def start_table(df: DataFrame, path: str, checkpoint: str, partition: list[str] = ()):
    """Append a stream to a Parquet table, in one pass over what is available."""
    w = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (w.partitionBy(*partition) if partition else w).trigger(availableNow=True).start()


def start_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand every micro-batch to ``handle`` (merges, and features that do not add up: medians,
    concentration, components). Batches may repeat after a failure, so handlers overwrite by
    batch id or merge by key."""
    return df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Idempotent sink: a repeated batch replaces its own folder."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return handle
