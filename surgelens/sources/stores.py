"""Keyed stores as tables: merges by key, co-occurrence counters, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from surgelens.functions.protect import stable_hash


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str], update_cols: list[str] | None = None) -> DataFrame:
    """Merge by key: new keys are added; of existing rows only ``update_cols`` change
    (default: all but the keys). One full join on the key, which is unique on both sides."""
    cols = existing.columns
    change = update_cols if update_cols is not None else [c for c in cols if c not in keys]
    a, b = existing.withColumn("_old", F.lit(True)).alias("a"), updates.withColumn("_new", F.lit(True)).alias("b")
    both = a.join(b, keys, "full")

    def pick(c: str):
        if c in keys:
            return F.col(c)
        newer = F.when(F.col("_new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
        return (newer if c in change else F.when(F.col("_old"), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))).alias(c)

    return both.select(*[pick(c) for c in cols])


def latest_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest row per key, by a grouped maximum (combines before the shuffle)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def feature_rows(wide: DataFrame, feature_cols: list[str], evidence_cols: list[str]) -> DataFrame:
    """Feature store rows: id, window key, features and evidence maps."""
    as_map = lambda cols: F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(c).cast("double") for c in cols]))
    iso = F.date_format("window_end", "yyyy-MM-dd'T'HH:mm:ssxxx")
    return wide.select(stable_hash(F.concat_ws(":", "merchant_id", "window_size", iso)).alias("id"), "merchant_id", "window_size", "window_end",
                       as_map(feature_cols).alias("features"), as_map(evidence_cols).alias("evidence"))


def co_occurrence(attempts: DataFrame, ttl_days: int = 90) -> DataFrame:
    """Entity pairs of a merchant: count, first and last sight, expiry."""
    pair = lambda ta, a, tb, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(
        F.lit(ta).alias("entity_type_a"), F.col(a).alias("entity_id_a"), F.lit(tb).alias("entity_type_b"), F.col(b).alias("entity_id_b")))
    pairs = F.array(pair("customer", "customer_id", "device", "device_fp"), pair("device", "device_fp", "instrument", "instrument_fp"),
                    pair("customer", "customer_id", "network", "ip_fp"))
    key = ["merchant_id", "entity_type_a", "entity_id_a", "entity_type_b", "entity_id_b"]
    return (attempts.select("merchant_id", "timestamp", F.explode(pairs).alias("_p")).filter("_p is not null")
            .select("merchant_id", "timestamp", "_p.*").groupBy(*key)
            .agg(F.count(F.lit(1)).alias("co_occurrence_count"), F.min("timestamp").alias("first_seen_at"), F.max("timestamp").alias("last_seen_at"))
            .withColumn("expires_at", F.timestamp_micros(F.unix_micros("last_seen_at") + F.lit(ttl_days * 86400000000))))


def merge_co_occurrence(old: DataFrame, new: DataFrame, as_of) -> DataFrame:
    """Add counters of two periods and drop what has expired by ``as_of``."""
    key = ["merchant_id", "entity_type_a", "entity_id_a", "entity_type_b", "entity_id_b"]
    return (old.unionByName(new).groupBy(*key)
            .agg(F.sum("co_occurrence_count").alias("co_occurrence_count"), F.min("first_seen_at").alias("first_seen_at"),
                 F.max("last_seen_at").alias("last_seen_at"), F.max("expires_at").alias("expires_at"))
            .filter(F.col("expires_at") > as_of))


def evidence_csv(members: DataFrame, path: str, limit: int = 100) -> None:
    """First ``limit`` attempts of a window as CSV (the report's fixed cut)."""
    rows = evidence_rows(members, limit)
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def evidence_rows(members: DataFrame, limit: int = 100) -> DataFrame:
    """The first attempts of a window as an analyst exports them; ``is_abusive`` is the truth of labelled data, false without one."""
    truth = F.coalesce("is_abusive", F.lit(False)) if "is_abusive" in members.columns else F.lit(False)
    return members.orderBy("timestamp", "transaction_id").limit(limit).select(
        "timestamp", "transaction_id", F.coalesce("customer_id", F.lit("")).alias("customer_id"), F.coalesce("device_fp", F.lit("")).alias("device_fp"),
        "amount", F.when(F.col("outcome_status") == "CAPTURED", "CAPTURED").otherwise("FAILED").alias("status"), truth.alias("is_abusive"))
