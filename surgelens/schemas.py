"""Explicit schemas and closed vocabularies. No reader infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)

# Closed vocabularies.
EVENT_TYPES = ["PAYMENT_ATTEMPT", "PAYMENT_RESULT", "REFUND", "DISPUTE", "ORDER_STATUS"]
PAYMENT_STATUSES = ["ATTEMPTED", "AUTHORIZED", "CAPTURED", "FAILED", "CANCELLED"]
DECLINE_SOURCES = ["ISSUER", "GATEWAY", "NETWORK", "MERCHANT", "UNKNOWN"]
PAYMENT_METHODS = ["CARD", "UPI", "NETBANKING", "WALLET", "EMI", "COD", "PAY_LATER"]
INSTRUMENT_TYPES = ["CREDIT", "DEBIT", "PREPAID", "UNKNOWN"]
ORDER_STATUSES = ["CREATED", "CONFIRMED", "SHIPPED", "DELIVERED", "CANCELLED", "RTO"]
DISPUTE_TYPES = ["FRAUD", "SERVICE", "PROCESSING", "AUTHORIZATION"]
REFUND_REASONS = ["CUSTOMER_REQUEST", "ITEM_NOT_RECEIVED", "ITEM_DEFECTIVE",
                  "DUPLICATE_CHARGE", "MERCHANT_INITIATED", "FRAUD_SUSPECTED"]
CONFIDENCES = ["LOW", "MEDIUM", "HIGH"]
LABEL_ONLY_EVENTS = ["DISPUTE"]
SUPPORTED_SCHEMA_VERSIONS = ["1.0"]

_INTAKE_AMOUNT = T.DecimalType(18, 6)  # wide enough to see a third decimal place and reject it

INSTRUMENT_META = T.StructType([
    T.StructField("brand", T.StringType()),
    T.StructField("instrument_type", T.StringType()),
    T.StructField("issuer_country", T.StringType()),
    T.StructField("bin_hash", T.StringType()),
    T.StructField("is_on_file", T.BooleanType()),
])
GEO = T.StructType([
    T.StructField("country", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("city", T.StringType()),
])
PAYMENT_ATTEMPT = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("instrument_fp", T.StringType()),
    T.StructField("instrument_meta", INSTRUMENT_META),
    T.StructField("device_fp", T.StringType()),
    T.StructField("ip_fp", T.StringType()),
    T.StructField("geo", GEO),
    T.StructField("amount", _INTAKE_AMOUNT),
    T.StructField("currency", T.StringType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("is_cod", T.BooleanType()),
    T.StructField("coupon_id", T.StringType()),
    T.StructField("attempt_number", T.IntegerType()),
    T.StructField("timestamp", T.TimestampType()),
])
PAYMENT_OUTCOME = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("decline_source", T.StringType()),
    T.StructField("failure_code", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])
REFUND = T.StructType([
    T.StructField("refund_id", T.StringType()),
    T.StructField("transaction_id", T.StringType()),
    T.StructField("amount", _INTAKE_AMOUNT),
    T.StructField("reason_code", T.StringType()),
    T.StructField("is_full", T.BooleanType()),
    T.StructField("timestamp", T.TimestampType()),
])
DISPUTE = T.StructType([
    T.StructField("dispute_id", T.StringType()),
    T.StructField("transaction_id", T.StringType()),
    T.StructField("dispute_type", T.StringType()),
    T.StructField("amount", _INTAKE_AMOUNT),
    T.StructField("days_after_transaction", T.IntegerType()),
    T.StructField("timestamp", T.TimestampType()),
])
ORDER = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])
EVENT_ENVELOPE = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("idempotency_key", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("payment_attempt", PAYMENT_ATTEMPT),
    T.StructField("outcome", PAYMENT_OUTCOME),
    T.StructField("refund", REFUND),
    T.StructField("dispute", DISPUTE),
    T.StructField("order", ORDER),
])
# Payload struct that belongs to each event type.
PAYLOAD_OF = {"PAYMENT_ATTEMPT": "payment_attempt", "PAYMENT_RESULT": "outcome",
              "REFUND": "refund", "DISPUTE": "dispute", "ORDER_STATUS": "order"}
