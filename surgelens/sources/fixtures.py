"""Views of the given star-schema tables in the shape of payment traffic.

Everything is derived from ``events`` and ``customer`` by integer arithmetic, JSON access
and CASE. Two time axes: ``calendar`` keeps ``ts``; ``dense`` packs 30 days into 12 hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from surgelens.operators.lifecycle import as_joined, join_lifecycle

BASE_US = 1704067200000000  # 2024-01-01T00:00Z


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def base_events(spark: SparkSession, sf_dir: str, axis: str = "dense") -> DataFrame:
    """Events with the derived integers ``k``, ``mi``, ``dm`` and the chosen time axis."""
    ev = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    dense_us = F.lit(BASE_US) + F.expr(f"(unix_micros(cast(ts as timestamp)) - {BASE_US}) div 60")
    chosen = dense_us if axis == "dense" else us
    return ev.select(
        "event_id", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.pmod(F.col("user_id"), F.lit(8)).alias("mi"),
        F.timestamp_micros(chosen).alias("timestamp"),
        F.expr(f"({BASE_US} + (unix_micros(cast(ts as timestamp)) - {BASE_US}) div 60) div 60000000").alias("dm"),
    )


def attempts(spark: SparkSession, sf_dir: str, axis: str = "dense", geo: bool = True) -> DataFrame:
    """Payment attempts with nested instrument and geo structs. Without ``geo`` the same rows, that column null: its join is not made."""
    ev = base_events(spark, sf_dir, axis)
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    # nation (25 rows) and region (5 rows) are of fixed size; customer grows, so the
    # optimizer decides its join from statistics.
    places = (table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
              .join(F.broadcast(nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))),
                    F.col("c_nationkey") == F.col("n_nationkey"))
              .select(F.col("c_custkey").alias("user_id"),
                      F.when(F.col("n_nationkey") < 20, "IN")
                       .otherwise(F.concat(F.lit("X"), F.col("n_nationkey"))).alias("country"),
                      F.col("n_name").alias("state"), F.col("r_name").alias("city")))
    e, k, t = F.col("event_id"), F.col("k"), F.col("event_type")
    if geo:
        joined = ev.join(places, "user_id", "left")
    else:
        joined = as_joined(ev, places.select("user_id"), "user_id")
    return joined.select(
        F.concat(F.lit("txn_"), e).alias("transaction_id"),
        F.concat(F.lit("m_"), F.col("mi")).alias("merchant_id"),
        F.when(e % 17 != 0, F.concat(F.lit("cus_"), F.col("user_id"))).alias("customer_id"),
        F.concat(F.lit("ord_"), e).alias("order_id"),
        F.concat(F.lit("if_"), F.col("user_id") * 7 + k % 3).alias("instrument_fp"),
        F.struct(
            F.lit(None).cast("string").alias("brand"),
            F.lit("UNKNOWN").alias("instrument_type"),
            F.when(k % 4 == 0, None).when(k % 4 == 1, "US").otherwise("IN").alias("issuer_country"),
            F.when(k % 11 != 0, F.concat(F.lit("bin_"), k % 6)).alias("bin_hash"),
            F.lit(False).alias("is_on_file")).alias("instrument_meta"),
        F.when(e % 13 != 0, F.concat(F.lit("dv_"), k)).alias("device_fp"),
        F.when(e % 19 != 0, F.concat(F.lit("ip_"), k % 25)).alias("ip_fp"),
        F.struct(F.coalesce(F.col("country"), F.lit("IN")).alias("country"), "state", "city").alias("geo") if geo
        else F.lit(None).cast("struct<country:string,state:string,city:string>").alias("geo"),
        F.col("value").cast("decimal(14,2)").alias("amount"),
        F.lit("INR").alias("currency"),
        _pick(["CARD", "UPI", "NETBANKING", "WALLET", "EMI", "COD", "PAY_LATER"], k % 7).alias("payment_method"),
        ((t == "view") & (k % 10 == 0)).alias("is_cod"),
        F.when(t == "signup", "C1").alias("coupon_id"),
        F.when(e % 10 == 0, 2).otherwise(1).alias("attempt_number"),
        F.col("timestamp"),
    )


def outcomes(spark: SparkSession, sf_dir: str, axis: str = "dense") -> DataFrame:
    ev = base_events(spark, sf_dir, axis)
    failed, k = F.col("event_type") == "error", F.col("k")
    return ev.select(
        F.concat(F.lit("txn_"), F.col("event_id")).alias("transaction_id"),
        F.when(failed, "FAILED").when(k % 5 == 0, "AUTHORIZED").otherwise("CAPTURED").alias("status"),
        F.when(failed & (k % 4 == 3), "GATEWAY").when(failed, "ISSUER").otherwise("UNKNOWN").alias("decline_source"),
        F.when(failed, _pick(["DO_NOT_HONOR", "INSUFFICIENT_FUNDS", "INCORRECT_OTP", "GATEWAY_TIMEOUT"], k % 4)).alias("failure_code"),
        "timestamp")


def refunds(spark: SparkSession, sf_dir: str, axis: str = "dense") -> DataFrame:
    ev = base_events(spark, sf_dir, axis).filter((F.col("event_type") == "purchase") & (F.col("k") % 9 == 0))
    return ev.select(
        F.concat(F.lit("ref_"), F.col("event_id")).alias("refund_id"),
        F.concat(F.lit("txn_"), F.col("event_id")).alias("transaction_id"),
        F.col("value").cast("decimal(14,2)").alias("amount"),
        F.lit("CUSTOMER_REQUEST").alias("reason_code"), F.lit(True).alias("is_full"),
        F.timestamp_micros(F.unix_micros("timestamp") + F.col("k") * 3600000000).alias("timestamp"))


def disputes(spark: SparkSession, sf_dir: str, axis: str = "dense") -> DataFrame:
    ev = base_events(spark, sf_dir, axis).filter((F.col("event_type") == "error") & (F.col("k") % 20 == 0))
    days = F.lit(14) + F.col("k") % 30
    return ev.select(
        F.concat(F.lit("dsp_"), F.col("event_id")).alias("dispute_id"),
        F.concat(F.lit("txn_"), F.col("event_id")).alias("transaction_id"),
        F.lit("FRAUD").alias("dispute_type"), F.col("value").cast("decimal(14,2)").alias("amount"),
        days.cast("int").alias("days_after_transaction"),
        F.timestamp_micros(F.unix_micros("timestamp") + days * 86400000000).alias("timestamp"))


def order_statuses(spark: SparkSession, sf_dir: str, axis: str = "dense") -> DataFrame:
    ev = base_events(spark, sf_dir, axis)
    return ev.select(
        F.concat(F.lit("ord_"), F.col("event_id")).alias("order_id"),
        F.concat(F.lit("m_"), F.col("mi")).alias("merchant_id"),
        F.when((F.col("event_type") == "view") & (F.col("k") % 10 == 0), "RTO").otherwise("DELIVERED").alias("status"),
        "timestamp")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction-level ground truth, defined on the dense axis."""
    ev = base_events(spark, sf_dir, "dense")
    phase, k, mi = F.col("dm") % 90, F.col("k"), F.col("mi")
    abusive = (phase < 10) & (mi % 2 == 0) & (k < 70)
    spike = abusive | (phase.between(40, 49) & (mi % 2 == 1) & (k < 80))
    return ev.select(
        F.concat(F.lit("txn_"), F.col("event_id")).alias("transaction_id"),
        abusive.alias("is_abusive"), spike.alias("is_spike"),
        F.when(abusive, "card_testing_burst").when(spike, "flash_sale_spike")
         .otherwise("normal_day").alias("scenario_id"))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchant -> category; ``m_7`` is left out to exercise the default."""
    c = table(spark, sf_dir, "customer").filter(F.col("c_custkey").between(0, 6))
    return c.select(F.concat(F.lit("m_"), F.col("c_custkey")).alias("merchant_id"),
                    F.col("c_mktsegment").alias("category"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer dimension; creation time is the customer's first calendar event minus
    ``user_id % 72`` hours."""
    ev = base_events(spark, sf_dir, "dense")
    return (ev.groupBy("user_id").agg(F.min(F.unix_micros("timestamp")).alias("first_us"))
            .select(F.concat(F.lit("cus_"), F.col("user_id")).alias("customer_id"),
                    F.timestamp_micros(F.col("first_us") - (F.col("user_id") % 72) * 3600000000).alias("created_at")))


def annotated(spark: SparkSession, sf_dir: str, axis: str = "dense", geo: bool = True) -> DataFrame:
    """Attempts joined to their outcome, refund and order status."""
    return join_lifecycle(attempts(spark, sf_dir, axis, geo), outcomes(spark, sf_dir, axis),
                          refunds(spark, sf_dir, axis), order_statuses(spark, sf_dir, axis))


def entity_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``annotated`` with entities and times only: neither places nor outcomes are joined, but their repeats count."""
    return as_joined(attempts(spark, sf_dir, geo=False), outcomes(spark, sf_dir).select("transaction_id"), "transaction_id")


def labelled(spark: SparkSession, sf_dir: str, geo: bool = True) -> DataFrame:
    """Attempts with transaction-level truth (label path only)."""
    return attempts(spark, sf_dir, geo=geo).join(truth(spark, sf_dir), "transaction_id", "left")


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five event kinds as one union, with repeated keys and faulty rows.

    Faults, all functions of ``event_id``: unknown schema version (%97), bare card number
    as instrument (%101), a third decimal place (%103), attempt number 0 (%107).
    """
    from surgelens import schemas as S
    src = attempts(spark, sf_dir, "calendar")
    n = F.substring("transaction_id", 5, 20).cast("long")

    def null_of(name: str) -> Column:
        return F.lit(None).cast(S.EVENT_ENVELOPE[name].dataType).alias(name)

    def shell(df: DataFrame, kind: str, prefix: str, key: Column, merchant: Column) -> list[Column]:
        return [F.concat(F.lit(prefix), key).alias("event_id"), F.lit(kind).alias("event_type"),
                F.lit("synthetic").alias("source"), F.col("timestamp"),
                F.when(key.cast("long") % 97 == 0, "2.0.0").otherwise("1.0").alias("schema_version"),
                F.when(key.cast("long") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit(prefix + "k"), key)).alias("idempotency_key"),
                merchant.alias("merchant_id")]

    pa = F.struct(
        "transaction_id", "merchant_id", "customer_id", "order_id",
        F.when(n % 101 == 0, F.concat(F.lit("4111111111"), F.lpad(n.cast("string"), 6, "0")))
         .otherwise(F.col("instrument_fp")).alias("instrument_fp"),
        "instrument_meta", "device_fp", "ip_fp", "geo",
        (F.col("amount").cast("decimal(18,6)") + F.when(n % 103 == 0, F.lit(0.005).cast("decimal(18,6)"))
         .otherwise(F.lit(0).cast("decimal(18,6)"))).cast("decimal(18,6)").alias("amount"),
        F.lower("currency").alias("currency"), "payment_method", "is_cod", "coupon_id",
        F.when(n % 107 == 0, 0).otherwise(F.col("attempt_number")).alias("attempt_number"),
        "timestamp")
    nothing = F.lit(None).cast("string")
    a = src.select(*shell(src, "PAYMENT_ATTEMPT", "ea_", n.cast("string"), nothing),
                   pa.cast(S.PAYMENT_ATTEMPT).alias("payment_attempt"),
                   null_of("outcome"), null_of("refund"), null_of("dispute"), null_of("order"))
    key = F.expr("substring(transaction_id, 5, 20)")

    def kind(df: DataFrame, event_type: str, prefix: str, slot: str) -> DataFrame:
        k = F.expr("substring(order_id, 5, 20)") if slot == "order" else key
        body = F.struct(*[F.col(f.name) for f in S.EVENT_ENVELOPE[slot].dataType.fields]).cast(S.EVENT_ENVELOPE[slot].dataType)
        cols = [body.alias(slot) if s == slot else null_of(s)
                for s in ("payment_attempt", "outcome", "refund", "dispute", "order")]
        return df.select(*shell(df, event_type, prefix, k, nothing), *cols)

    o = kind(outcomes(spark, sf_dir, "calendar"), "PAYMENT_RESULT", "eo_", "outcome")
    r = kind(refunds(spark, sf_dir, "calendar"), "REFUND", "er_", "refund")
    d = kind(disputes(spark, sf_dir, "calendar"), "DISPUTE", "ed_", "dispute")
    s = kind(order_statuses(spark, sf_dir, "calendar"), "ORDER_STATUS", "es_", "order")
    allk = a.unionByName(o).unionByName(r).unionByName(d).unionByName(s)
    # a redelivery of every fiftieth event, one second later, with the same key; made from its row, so the tables are read once
    late = F.timestamp_micros(F.unix_micros("timestamp") + 1000000)
    times = F.when(F.expr("cast(substring(event_id, 4, 20) as bigint) % 50 = 0"), F.array("timestamp", late)).otherwise(F.array("timestamp"))
    return allk.withColumn("timestamp", F.explode(times))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and score per event for threshold and ranking metrics."""
    ev = table(spark, sf_dir, "events")
    y = (F.col("event_type") == "error").cast("int")
    raw = (F.col("event_id") * 37) % 1000 / F.lit(1000.0) + F.when(y == 1, 0.2).otherwise(0.0)
    return ev.select("event_id", y.alias("y_true"), F.least(F.lit(1.0), raw).alias("y_prob"),
                     F.col("value").alias("loss"))
