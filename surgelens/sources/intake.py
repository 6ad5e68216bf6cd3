"""Intake of the five event kinds: defaults, checks, de-duplication, hashing, append."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from surgelens import schemas as S
from surgelens.session import cut_lineage, hold, shared_path

PAN_LIKE = r"^[0-9]{12,19}$"
DEDUPE_TTL_SECONDS = 86400


def read_events(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Envelope rows with the explicit schema; no inference. Malformed rows come as nulls
    and fail the checks."""
    return spark.read.schema(S.EVENT_ENVELOPE).format(fmt).load(path)


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON text rows (a queue, a file of lines) -> envelope rows."""
    return lines.select(F.from_json(column, S.EVENT_ENVELOPE).alias("_e")).select("_e.*")


def with_defaults(events: DataFrame) -> DataFrame:
    """Trim, default the idempotency key to the event id and the merchant to the payload's."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return (events.withColumn("event_id", F.trim("event_id"))
            .withColumn("idempotency_key", F.coalesce(blank(F.col("idempotency_key")), F.col("event_id")))
            .withColumn("merchant_id", F.coalesce(blank(F.col("merchant_id")), F.col("payment_attempt.merchant_id"), F.col("order.merchant_id")))
            .withColumn("payment_attempt", F.when(F.col("payment_attempt").isNotNull(),
                        F.col("payment_attempt").withField("currency", F.upper(F.trim(F.coalesce(F.col("payment_attempt.currency"), F.lit("INR"))))))))


def _checks() -> list[tuple[str, Column]]:
    """(reason, is bad) pairs. A null condition is not bad; required fields say so."""
    def required(c: str, top: int = 128):
        n = F.length(F.trim(F.col(c)))
        return F.col(c).isNull() | ~n.between(1, top)

    def too_long(c: str, top: int):
        return F.length(F.trim(F.col(c))) > top

    def not_money(c: str):
        return (F.col(c) < 0) | (F.col(c) != F.round(F.col(c), 2))

    def unknown(c: str, values: list[str]):
        return F.col(c).isNotNull() & ~F.col(c).isin(values)

    kind = lambda k: F.col("event_type") == k
    p, o, r, d, s = "payment_attempt", "outcome", "refund", "dispute", "`order`"
    checks = [("event_id", required("event_id")), ("event_type", F.col("event_type").isNull() | unknown("event_type", S.EVENT_TYPES)),
              ("source", too_long("source", 64)), ("timestamp", F.col("timestamp").isNull()),
              ("idempotency_key", too_long("idempotency_key", 128)), ("merchant_id", too_long("merchant_id", 128))]
    for event_type, slot in S.PAYLOAD_OF.items():
        name = f"`{slot}`" if slot == "order" else slot
        checks.append((f"{slot}_missing", kind(event_type) & F.col(name).isNull()))
        others = [F.col(f"`{x}`").isNotNull() for x in S.PAYLOAD_OF.values() if x != slot]
        checks.append(("foreign_payload", kind(event_type) & reduce(lambda a, b: a | b, others)))
    body = [
        (p, "transaction_id", required(f"{p}.transaction_id")), (p, "attempt_merchant_id", required(f"{p}.merchant_id")),
        (p, "instrument_fp", required(f"{p}.instrument_fp")), (p, "customer_id", too_long(f"{p}.customer_id", 128)),
        (p, "order_id", too_long(f"{p}.order_id", 128)), (p, "device_fp", too_long(f"{p}.device_fp", 128)), (p, "ip_fp", too_long(f"{p}.ip_fp", 128)),
        (p, "amount", F.col(f"{p}.amount").isNull() | not_money(f"{p}.amount")), (p, "currency", F.length(f"{p}.currency") != 3),
        (p, "payment_method", unknown(f"{p}.payment_method", S.PAYMENT_METHODS)), (p, "coupon_id", too_long(f"{p}.coupon_id", 64)),
        (p, "attempt_number", ~F.col(f"{p}.attempt_number").between(1, 100)), (p, "attempt_timestamp", F.col(f"{p}.timestamp").isNull()),
        (p, "card_number", F.col(f"{p}.instrument_fp").rlike(PAN_LIKE) | F.coalesce(F.col(f"{p}.device_fp"), F.lit("")).rlike(PAN_LIKE) | F.coalesce(F.col(f"{p}.ip_fp"), F.lit("")).rlike(PAN_LIKE)),
        (p, "country", F.length(f"{p}.geo.country") != 2), (p, "state", too_long(f"{p}.geo.state", 64)), (p, "city", too_long(f"{p}.geo.city", 64)),
        (p, "brand", too_long(f"{p}.instrument_meta.brand", 32)), (p, "instrument_type", unknown(f"{p}.instrument_meta.instrument_type", S.INSTRUMENT_TYPES)),
        (p, "issuer_country", F.length(f"{p}.instrument_meta.issuer_country") != 2), (p, "bin_hash", too_long(f"{p}.instrument_meta.bin_hash", 64)),
        (o, "transaction_id", required(f"{o}.transaction_id")), (o, "status", F.col(f"{o}.status").isNull() | unknown(f"{o}.status", S.PAYMENT_STATUSES)),
        (o, "decline_source", unknown(f"{o}.decline_source", S.DECLINE_SOURCES)), (o, "failure_code", too_long(f"{o}.failure_code", 64)),
        (r, "refund_id", required(f"{r}.refund_id")), (r, "transaction_id", required(f"{r}.transaction_id")),
        (r, "amount", F.col(f"{r}.amount").isNull() | not_money(f"{r}.amount")), (r, "reason_code", unknown(f"{r}.reason_code", S.REFUND_REASONS)),
        (d, "dispute_id", required(f"{d}.dispute_id")), (d, "transaction_id", required(f"{d}.transaction_id")), (d, "amount", not_money(f"{d}.amount")),
        (d, "dispute_type", unknown(f"{d}.dispute_type", S.DISPUTE_TYPES)), (d, "days_after", ~F.col(f"{d}.days_after_transaction").between(0, 180)),
        (s, "order_id", required(f"{s}.order_id")), (s, "order_merchant_id", required(f"{s}.merchant_id")),
        (s, "order_status", F.col(f"{s}.status").isNull() | unknown(f"{s}.status", S.ORDER_STATUSES)),
    ]
    checks += [(reason, F.col(slot).isNotNull() & bad) for slot, reason, bad in body]
    checks.append(("schema_version", ~F.coalesce(F.col("schema_version"), F.lit(S.SUPPORTED_SCHEMA_VERSIONS[0])).isin(S.SUPPORTED_SCHEMA_VERSIONS)))
    return checks


def check_events(events: DataFrame) -> DataFrame:
    """Add ``reasons``: the sorted list of failed checks, empty for a good row."""
    found = F.array(*[F.when(bad, F.lit(reason)) for reason, bad in _checks()])
    return with_defaults(events).withColumn("reasons", F.array_sort(F.array_distinct(F.array_compact(found))))


def validate_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); rejected rows keep their reasons. Both sides read one checked
    table, held so that the checks run once and are not copied into every branch."""
    checked = hold(check_events(events))
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def _rivals(tuples: DataFrame, c: str, existing: DataFrame | None) -> DataFrame:
    """Raise ``_rivals`` to the rows that share ``c``, and set ``_stored`` where it is among the existing ones."""
    if existing is not None:
        tuples = tuples.unionByName(existing.select(c).filter(F.col(c).isNotNull()).distinct().withColumn("_known", F.lit(True)), allowMissingColumns=True)
    same = Window.partitionBy(c)
    out = tuples.withColumn("_rivals", F.greatest("_rivals", F.count("_n").over(same)))
    if existing is not None:
        out = out.withColumn("_stored", F.col("_stored") | F.coalesce(F.max("_known").over(same), F.lit(False))).filter("_n is not null").drop("_known")
    return out


def dedupe(accepted: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Add status accepted/duplicate: in order of time an event is accepted unless its id or its
    idempotency key is stored, or was accepted before. A refused event claims nothing, so a later
    one may still take its id or key.

    Only (id, key, timestamp) is looked at. What shares neither id nor key with another or a stored event is accepted as it
    is; the others go through rounds: accepted is what comes first both for its id and for its key; what shares either with
    an accepted event is refused, and the rest, if any, goes on. Of rows equal in all three one is accepted.
    """
    at = ["event_id", "idempotency_key", "timestamp"]
    tuples = accepted.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).withColumns({"_rivals": F.lit(1).cast("long"), "_stored": F.lit(False)})
    for c in ("event_id", "idempotency_key"):
        tuples = _rivals(tuples, c, existing)
    # what is left out here stands alone: it is neither refused nor refuses anything
    odd = cut_lineage(tuples.filter("_n > 1 or _rivals > 1 or _stored"))
    rest, winners = odd.filter("_rivals > 1 and not _stored").select(*at), odd.select(*at).limit(0)
    while not rest.isEmpty():
        order = F.min(F.struct("timestamp", "event_id", "idempotency_key")).alias("_f")
        firsts = [rest.groupBy(c).agg(order).select("_f.*") for c in ("event_id", "idempotency_key")]
        won = cut_lineage(firsts[0].join(firsts[1], at, "left_semi").select(*at))
        winners = winners.union(won)
        for c in ("event_id", "idempotency_key"):
            rest = rest.join(won.select(c), c, "left_anti")
        rest = cut_lineage(rest.select(*at))
    # only what lost or stands more than once is written and joined; its known size lets the planner leave the payloads where they are
    lost = F.col("_stored") | ((F.col("_rivals") > 1) & F.col("_w").isNull())
    odd = odd.join(winners.withColumn("_w", F.lit(True)), at, "left").withColumn("_lost", lost).filter("_lost or _n > 1").select(*at, "_lost")
    path = shared_path(accepted.sparkSession, "intake-odd")
    odd.write.parquet(path)
    told = accepted.join(accepted.sparkSession.read.schema(odd.schema).parquet(path), at, "left")
    status = lambda rows, first: (rows.withColumn("status", F.when(first, "accepted").otherwise("duplicate"))
                                  .withColumn("reason", F.when(~first, "event already ingested")).select(*accepted.columns, "status", "reason"))
    plain = status(told.filter("_lost is null or _lost"), F.col("_lost").isNull())
    once = F.row_number().over(Window.partitionBy(*at).orderBy("event_id"))
    return plain.unionByName(status(told.filter("not _lost").withColumn("_r", once), F.col("_r") == 1))


def transaction_id_of() -> Column:
    return F.coalesce("payment_attempt.transaction_id", "outcome.transaction_id", "refund.transaction_id", "dispute.transaction_id")


def payload_json() -> Column:
    return F.to_json(F.struct("payment_attempt", "outcome", "refund", "dispute", F.col("order")))


def to_raw_rows(accepted: DataFrame) -> DataFrame:
    """Rows of the raw event log, with a content hash (self-consistent) and its date."""
    content = F.to_json(F.struct("event_id", "event_type", "idempotency_key", "merchant_id", "schema_version", "source", "timestamp",
                                 "payment_attempt", "outcome", "refund", "dispute", F.col("order")))
    return accepted.select("event_id", "event_type", "source", "timestamp", "schema_version", "idempotency_key", "merchant_id",
                           transaction_id_of().alias("transaction_id"), F.sha2(content, 256).alias("payload_hash"),
                           payload_json().alias("payload"), F.to_date("timestamp").alias("event_date"))


def append_raw(rows: DataFrame, path: str) -> None:
    """Append to the event log, one folder per date; a date's rows meet before the write, so files stay few, and a
    large date is split by the adaptive plan."""
    rows.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").parquet(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """The event log; filters on event_date prune its folders."""
    return spark.read.parquet(path)


def intake_summary(deduped: DataFrame, rejected: DataFrame) -> DataFrame:
    a = deduped.agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "duplicate").alias("duplicates"))
    return a.crossJoin(rejected.agg(F.count(F.lit(1)).alias("rejected")))  # single rows


def scan_events(raw: DataFrame, merchant: str, start: str, end: str) -> DataFrame:
    """A merchant's stored events in ``[start, end)``, ascending; prunes by date."""
    lo, hi = F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))
    out = raw.filter((F.col("merchant_id") == merchant) & (F.col("timestamp") >= lo) & (F.col("timestamp") < hi))
    if "event_date" in raw.columns:
        out = out.filter(F.col("event_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return out.orderBy("timestamp", "event_id")


def find_event(raw: DataFrame, event_id: str | None = None, key: str | None = None) -> DataFrame:
    return raw.filter(F.col("event_id") == event_id if event_id is not None else F.col("idempotency_key") == key)


def attempts_from_payload(raw: DataFrame) -> DataFrame:
    """Rebuild attempts from stored payload text, nested form first, then flat keys, with
    defaults. Other event kinds are left out, so label-only disputes cannot pass."""
    get = lambda k: F.coalesce(F.get_json_object("payload", f"$.payment_attempt.{k}"), F.get_json_object("payload", f"$.{k}"))
    return raw.filter(F.col("event_type") == "PAYMENT_ATTEMPT").select(
        F.coalesce(get("transaction_id"), F.col("event_id")).alias("transaction_id"), "merchant_id",
        get("customer_id").alias("customer_id"), get("order_id").alias("order_id"),
        F.coalesce(get("instrument_fp"), F.lit("if_unknown")).alias("instrument_fp"),
        F.struct(get("instrument_meta.brand").alias("brand"), F.coalesce(get("instrument_meta.instrument_type"), F.lit("UNKNOWN")).alias("instrument_type"),
                 get("instrument_meta.issuer_country").alias("issuer_country"), get("instrument_meta.bin_hash").alias("bin_hash"),
                 F.coalesce(get("instrument_meta.is_on_file").cast("boolean"), F.lit(False)).alias("is_on_file")).alias("instrument_meta"),
        get("device_fp").alias("device_fp"), get("ip_fp").alias("ip_fp"),
        F.struct(F.coalesce(get("geo.country"), F.lit("IN")).alias("country"), get("geo.state").alias("state"), get("geo.city").alias("city")).alias("geo"),
        F.coalesce(get("amount").cast("decimal(14,2)"), F.lit(0).cast("decimal(14,2)")).alias("amount"),
        F.coalesce(get("currency"), F.lit("INR")).alias("currency"), F.coalesce(get("payment_method"), F.lit("CARD")).alias("payment_method"),
        F.coalesce(get("is_cod").cast("boolean"), F.lit(False)).alias("is_cod"), get("coupon_id").alias("coupon_id"),
        F.coalesce(get("attempt_number").cast("int"), F.lit(1)).alias("attempt_number"), "timestamp")


def feature_events(events: DataFrame) -> DataFrame:
    """Barrier: drop event kinds that may only ever label."""
    return events.filter(~F.col("event_type").isin(S.LABEL_ONLY_EVENTS))


def tenant_filter(df: DataFrame, scope: str | None, platform: bool = False, own: str | None = None) -> DataFrame:
    """A platform principal sees everything or the merchant it names; anyone else sees only
    their own merchant, and nothing when they name another."""
    if platform:
        return df if scope is None else df.filter(F.col("merchant_id") == scope)
    return df.filter((F.col("merchant_id") == F.lit(own)) & (F.lit(scope is None or scope == own)))
