"""Joining an attempt to what happened to it afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from surgelens.session import hold


def as_joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of ``left`` as often as a left join with ``right`` gives them, for plans that read none of its columns.

    Only the keys of ``right`` move, and then its repeated keys, whose number is known before they are joined; ``left`` stays where it is."""
    more = hold(right.groupBy(key).agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1"))
    if more.count() == 0:
        return left
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_times", F.lit(1).cast("long"))))
    return left.join(more, key, "left").withColumn("_time", times).drop("_times", "_time")


def join_lifecycle(attempts: DataFrame, outcomes: DataFrame | None = None,
                   refunds: DataFrame | None = None, orders: DataFrame | None = None) -> DataFrame:
    """Left-join outcome, refund and order status onto attempts.

    Outcomes, refunds and attempts share the key ``transaction_id``, so they are joined one
    after the other on one partitioning; refunds collapse to one row per transaction first.
    """
    out = attempts
    if outcomes is not None:
        out = out.join(outcomes.select("transaction_id", F.col("status").alias("outcome_status"),
                                       "decline_source", "failure_code"), "transaction_id", "left")
    if refunds is not None:
        per_txn = refunds.groupBy("transaction_id").agg(
            F.min("timestamp").alias("refunded_at"), F.sum("amount").alias("refund_amount"))
        out = out.join(per_txn, "transaction_id", "left")
    if orders is not None:
        # progress of one order is several rows; the latest one wins
        last = orders.groupBy("order_id").agg(F.max_by("status", "timestamp").alias("order_status"))
        out = out.join(last, "order_id", "left")
    return out


def join_disputes(annotated: DataFrame, disputes: DataFrame) -> DataFrame:
    """Label path only: attach disputes. The result must never feed features."""
    per_txn = disputes.groupBy("transaction_id").agg(
        F.min("days_after_transaction").alias("dispute_days"),
        F.min_by("dispute_type", "timestamp").alias("dispute_type"))
    return annotated.join(per_txn, "transaction_id", "left").withColumn(
        "is_disputed", F.col("dispute_type").isNotNull())
