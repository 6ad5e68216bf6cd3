"""The registered queries: name -> (Spark callable, DuckDB statement or None)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from surgelens import registry as R
from surgelens.functions import protect, ranking, stats
from surgelens.operators import (baselines as B, decision as X, explain as N, gates as GT, graph as G, grid, incidents as E,
                                 labels as L, lifecycle, metrics as M, report as RP, tiles, velocity as V, window_features as WF)
from surgelens.plans import oracle as O, scoring, stages
from surgelens.plans.comparable import comparable, r6_col
from surgelens.plans.oracle import BASE, WK, r6, secs, with_ctes
from surgelens.session import cut_lineage, hold, release, shared_path
from surgelens.sources import fixtures as fx, intake, stores, tables

CATALOG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
KEY = ["merchant_id", "window_size", "window_end"]
BOUNDS = L.split_bounds(BASE, BASE + 43200 * 1000000)
TWINS = list(R.TWIN_IDS)
PEPPER = "fixture-pepper"


def register(name: str, sql: str | None = None):
    def keep(fn):
        def run(spark, sf_dir):
            release()  # what the previous query held
            return comparable(fn(spark, sf_dir))
        CATALOG[name] = (run, sql)
        return fn
    return keep


# ---- intake ---------------------------------------------------------------------------

ENV = {
    "env0": """SELECT 'ea_' || n AS event_id, 'PAYMENT_ATTEMPT' AS event_type, n, us, CASE WHEN n % 3 = 0 THEN 'ea_' || n ELSE 'ea_k' || n END AS idempotency_key,
      merchant_id, transaction_id, list_sort(list_filter([CASE WHEN n % 97 = 0 THEN 'schema_version' END, CASE WHEN n % 101 = 0 THEN 'card_number' END,
      CASE WHEN n % 103 = 0 THEN 'amount' END, CASE WHEN n % 107 = 0 THEN 'attempt_number' END, CASE WHEN length(country) <> 2 THEN 'country' END], lambda x: x IS NOT NULL)) AS rs FROM attc
      UNION ALL SELECT 'eo_' || n, 'PAYMENT_RESULT', n, us, CASE WHEN n % 3 = 0 THEN 'eo_' || n ELSE 'eo_k' || n END, NULL, transaction_id, CASE WHEN n % 97 = 0 THEN ['schema_version'] ELSE [] END FROM attc
      UNION ALL SELECT 'er_' || n, 'REFUND', n, refund_us, CASE WHEN n % 3 = 0 THEN 'er_' || n ELSE 'er_k' || n END, NULL, transaction_id, CASE WHEN n % 97 = 0 THEN ['schema_version'] ELSE [] END FROM attc WHERE refunded
      UNION ALL SELECT 'ed_' || n, 'DISPUTE', n, us + dispute_days * 86400000000, CASE WHEN n % 3 = 0 THEN 'ed_' || n ELSE 'ed_k' || n END, NULL, transaction_id, CASE WHEN n % 97 = 0 THEN ['schema_version'] ELSE [] END FROM attc WHERE disputed
      UNION ALL SELECT 'es_' || n, 'ORDER_STATUS', n, us, CASE WHEN n % 3 = 0 THEN 'es_' || n ELSE 'es_k' || n END, merchant_id, NULL, CASE WHEN n % 97 = 0 THEN ['schema_version'] ELSE [] END FROM attc""",
    "env": "SELECT *, false AS again FROM env0 UNION ALL SELECT event_id, event_type, n, us + 1000000, idempotency_key, merchant_id, transaction_id, rs, true FROM env0 WHERE n % 50 = 0",
}


@register("intake_checks", with_ctes(["attc"], f"SELECT event_id, event_type, idempotency_key, merchant_id, {r6('us / 1e6')} AS timestamp, array_to_string(rs, ',') AS reasons FROM env", ENV))
def _checks(spark, d):
    return intake.check_events(fx.envelopes(spark, d)).select(
        "event_id", "event_type", "idempotency_key", "merchant_id", "timestamp", F.array_join("reasons", ",").alias("reasons"))


def _accepted(spark, d):
    return intake.validate_events(fx.envelopes(spark, d))


@register("intake_dedupe", with_ctes(["attc"], f"SELECT event_id, {r6('us / 1e6')} AS timestamp, CASE WHEN again THEN 'duplicate' ELSE 'accepted' END AS status FROM env WHERE len(rs) = 0", ENV))
def _dedupe(spark, d):
    return intake.dedupe(_accepted(spark, d)[0]).select("event_id", "timestamp", "status")


@register("intake_dedupe_against_store", with_ctes(["attc"], "SELECT event_type, CASE WHEN again OR n % 4 = 0 THEN 'duplicate' ELSE 'accepted' END AS status, count(*) AS events FROM env WHERE len(rs) = 0 GROUP BY 1, 2", ENV))
def _dedupe_store(spark, d):
    good = _accepted(spark, d)[0]
    stored = good.filter(F.expr("cast(substring(event_id, 4, 20) as bigint) % 4 = 0")).select("event_id", "idempotency_key")
    return intake.dedupe(good, stored).groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("events"))


@register("intake_summary", with_ctes(["attc"], "SELECT count(*) FILTER (len(rs) = 0 AND NOT again) AS accepted, count(*) FILTER (len(rs) = 0 AND again) AS duplicates, count(*) FILTER (len(rs) > 0) AS rejected FROM env", ENV))
def _summary(spark, d):
    good, bad = _accepted(spark, d)
    return intake.intake_summary(intake.dedupe(good), bad)


def _raw(spark, d):
    return intake.to_raw_rows(intake.dedupe(_accepted(spark, d)[0]).filter("status = 'accepted'"))


@register("raw_event_rows", with_ctes(["attc"], f"SELECT event_id, event_type, transaction_id, {r6('us / 1e6')} AS timestamp, CAST(make_timestamp(us) AS DATE)::VARCHAR AS event_date, 64 AS hash_length FROM env WHERE len(rs) = 0 AND NOT again", ENV).replace("64 AS", "CAST(64 AS BIGINT) AS"))
def _raw_rows(spark, d):
    return _raw(spark, d).select("event_id", "event_type", "transaction_id", "timestamp", F.col("event_date").cast("string").alias("event_date"), F.length("payload_hash").alias("hash_length"))


@register("stage_figures", with_ctes(["attc"], """SELECT unnest(['checked', 'checked', 'checked', 'claimed', 'claimed', 'logged', 'logged']) AS stage, unnest(['rows', 'null_merchant_id', 'rejected', 'rows', 'duplicates', 'rows', 'null_transaction_id']) AS figure,
  unnest([count(*), count(*) FILTER (merchant_id IS NULL), count(*) FILTER (len(rs) > 0), count(*) FILTER (len(rs) = 0), count(*) FILTER (len(rs) = 0 AND again), count(*) FILTER (len(rs) = 0 AND NOT again), count(*) FILTER (len(rs) = 0 AND NOT again AND transaction_id IS NULL)]) AS value FROM env""", ENV))
def _stage_figures(spark, d):
    return stages.watched_intake(fx.envelopes(spark, d))[1]


@register("raw_payload_hashes", with_ctes(["attc"], "SELECT event_type, count(*) AS events, count(DISTINCT event_id) AS distinct_hashes FROM env WHERE len(rs) = 0 AND NOT again GROUP BY 1", ENV))
def _hashes(spark, d):
    return _raw(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("payload_hash").alias("distinct_hashes"))


@register("raw_lookup", with_ctes(["attc"], "SELECT event_id, event_type, idempotency_key FROM env WHERE len(rs) = 0 AND NOT again AND event_id = 'ea_7' UNION ALL SELECT event_id, event_type, idempotency_key FROM env WHERE len(rs) = 0 AND NOT again AND idempotency_key = 'eo_k8'", ENV))
def _lookup(spark, d):
    raw = _raw(spark, d)
    return intake.find_event(raw, event_id="ea_7").unionByName(intake.find_event(raw, key="eo_k8")).select("event_id", "event_type", "idempotency_key")


@register("raw_range_scan", with_ctes(["attc"], f"SELECT event_id, {r6('us / 1e6')} AS timestamp FROM env WHERE len(rs) = 0 AND NOT again AND merchant_id = 'm_3' AND us >= epoch_us(TIMESTAMP '2024-01-05') AND us < epoch_us(TIMESTAMP '2024-01-12')", ENV))
def _scan(spark, d):
    return intake.scan_events(_raw(spark, d), "m_3", "2024-01-05 00:00:00", "2024-01-12 00:00:00").select("event_id", "timestamp")


@register("rebuild_attempts", with_ctes(["attc"], f"""SELECT transaction_id, merchant_id, customer_id, order_id, ins AS instrument_fp, device_fp, ip_fp, {r6('amount')} AS amount,
  'INR' AS currency, method AS payment_method, is_cod, coupon_id, CAST(attempt_number AS BIGINT) AS attempt_number, {r6('us / 1e6')} AS timestamp, country, state, issuer_country, bin_hash
  FROM attc JOIN (SELECT transaction_id AS t FROM env WHERE event_type = 'PAYMENT_ATTEMPT' AND len(rs) = 0 AND NOT again) ON t = transaction_id""", ENV))
def _rebuild(spark, d):
    a = intake.attempts_from_payload(_raw(spark, d))
    return a.select("transaction_id", "merchant_id", "customer_id", "order_id", "instrument_fp", "device_fp", "ip_fp", "amount", "currency", "payment_method", "is_cod", "coupon_id",
                    "attempt_number", "timestamp", F.col("geo.country").alias("country"), F.col("geo.state").alias("state"),
                    F.col("instrument_meta.issuer_country").alias("issuer_country"), F.col("instrument_meta.bin_hash").alias("bin_hash"))


@register("label_event_barrier", with_ctes(["attc"], "SELECT event_type, count(*) AS events FROM env WHERE event_type <> 'DISPUTE' GROUP BY 1", ENV))
def _barrier(spark, d):
    return intake.feature_events(fx.envelopes(spark, d)).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@register("tenant_scope", with_ctes(["att"], """SELECT 'platform_all' AS principal, merchant_id, count(*) AS visible FROM att GROUP BY 2 UNION ALL
  SELECT 'platform_one', merchant_id, count(*) FROM att WHERE merchant_id = 'm_2' GROUP BY 2 UNION ALL SELECT 'merchant_own', merchant_id, count(*) FROM att WHERE merchant_id = 'm_5' GROUP BY 2"""))
def _tenant(spark, d):
    a = fx.attempts(spark, d)
    seen = lambda name, df: df.groupBy(F.lit(name).alias("principal"), "merchant_id").agg(F.count(F.lit(1)).alias("visible"))
    return (seen("platform_all", intake.tenant_filter(a, None, True)).unionByName(seen("platform_one", intake.tenant_filter(a, "m_2", True)))
            .unionByName(seen("merchant_own", intake.tenant_filter(a, None, False, "m_5"))).unionByName(seen("merchant_other", intake.tenant_filter(a, "m_2", False, "m_5"))))


# ---- grid -----------------------------------------------------------------------------

@register("grid_alignment", with_ctes(["attc"], f"""SELECT transaction_id, {r6('(us - us % 60000000) / 1e6')} AS aligned, us % 60000000 = 0 AS is_aligned,
  CAST((isodow(make_timestamp(us)) - 1) * 24 + hour(make_timestamp(us)) AS BIGINT) AS hour_of_week, {r6('((us - us % 60000000) - 900000000) / 1e6')} AS start_15m FROM attc"""))
def _align(spark, d):
    a = fx.attempts(spark, d, "calendar")
    return a.select("transaction_id", grid.align("timestamp").alias("aligned"), grid.is_aligned("timestamp").alias("is_aligned"), grid.hour_of_week("timestamp").alias("hour_of_week"),
                    grid.window_start(grid.align("timestamp"), F.lit("15m")).alias("start_15m"))


@register("windows_covering", with_ctes(["win"], f"SELECT merchant_id, window_size, {secs('e')} AS window_end, count(*) AS events FROM win GROUP BY {WK}"))
def _covering(spark, d):
    return grid.assign_windows(fx.attempts(spark, d)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("events"))


@register("grid_points", with_ctes(["att"], f"SELECT merchant_id, {secs('unnest(range(-((-lo) // 60000000), -((-hi) // 60000000)))')} AS grid_at FROM (SELECT merchant_id, min(us) AS lo, max(us) AS hi FROM att GROUP BY 1)").replace("-((-lo) // 60000000)", "CAST(ceil(lo / 6e7) AS BIGINT)").replace("-((-hi) // 60000000)", "CAST(ceil(hi / 6e7) AS BIGINT)"))
def _points(spark, d):
    spans = fx.attempts(spark, d).groupBy("merchant_id").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    return grid.grid(spans, "lo", "hi").select("merchant_id", "grid_at")


@register("window_tiles", with_ctes(["win"], f"SELECT merchant_id, window_size, {secs('e')} AS window_end, {secs('e - o')} AS tile_end FROM (SELECT DISTINCT {WK}, steps FROM win ) JOIN offs ON o < steps"))
def _tiles(spark, d):
    panes = fx.attempts(spark, d).groupBy("merchant_id", grid.minute("timestamp").alias("m")).count()
    from surgelens.operators.sweep import live_ends
    w = live_ends(panes, ["merchant_id"], grid.ALL_SIZES).select("merchant_id", "window_size", grid.instant("end_minute").alias("window_end"))
    return grid.tiles(w)


@register("horizon_memberships", with_ctes(["att", "h"], "SELECT merchant_id, window_size, CAST(steps * 60 AS BIGINT) AS seconds, CAST(count(*) * any_value(steps) AS BIGINT) AS memberships FROM att, h GROUP BY 1, 2, 3"))
def _horizons(spark, d):
    n = fx.attempts(spark, d).groupBy("merchant_id").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(grid.horizon_table(spark))).select("merchant_id", "window_size", "seconds", (F.col("n") * F.col("grid_steps")).alias("memberships"))


@register("window_spine_totals", with_ctes(["spine", "win"], f"SELECT s.merchant_id, s.window_size, {secs('s.e')} AS window_end, coalesce(n, 0) AS events FROM spine s LEFT JOIN (SELECT {WK}, count(*) AS n FROM win GROUP BY {WK}) USING ({WK})"))
def _spine(spark, d):
    a = fx.attempts(spark, d)
    panes = a.groupBy("merchant_id", grid.minute("timestamp").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    from surgelens.operators.sweep import sliding_sums
    s = sliding_sums(panes, ["merchant_id"], ["n"], grid.ALL_SIZES, grid.window_spine(a))
    return s.select("merchant_id", "window_size", grid.instant("end_minute").alias("window_end"), F.col("n").alias("events"))


@register("window_member_join", with_ctes(["spine", "win"], f"SELECT merchant_id, window_size, {secs('e')} AS window_end, count(*) AS members, {r6('sum(amount)')} AS amount, true AS all_inside FROM win SEMI JOIN spine USING ({WK}) GROUP BY {WK}"))
def _members(spark, d):
    a = fx.attempts(spark, d)
    m = grid.window_members(grid.window_spine(a), a).withColumn("window_end", grid.instant("end_minute"))
    return m.groupBy(*KEY).agg(F.count(F.lit(1)).alias("members"), F.sum("amount").alias("amount"),
                               F.bool_and(grid.contains(F.col("window_end"), F.col("window_size"), F.col("timestamp"))).alias("all_inside"))


ADDITIVE_SQL = f"""SELECT b.merchant_id, b.window_size, {secs('b.e')} AS window_end, {r6('b.n / b.steps')} AS A_txn_rate, {r6('(b.n - coalesce(p.n, 0)) / b.steps')} AS A_rate_accel, b.n::DOUBLE AS B_txn_count,
  b.success::DOUBLE AS B_success_count, b.failure::DOUBLE AS B_failure_count, {r6('b.failure / b.n')} AS C_failure_rate, {r6('b.coupons / b.n')} AS C_coupon_rate, {r6('b.cod / b.n')} AS C_cod_rate,
  {r6('b.intl / b.n')} AS C_international_rate, {r6('b.retries / b.n')} AS C_retry_rate, {r6('b.gmv')} AS D_gmv, {r6('b.low / b.n')} AS D_low_value_ratio, {r6('b.high / b.n')} AS D_high_value_ratio,
  {r6('b.coupons * 100.0 / greatest(1.0, b.gmv)')} AS D_discount_to_gmv, {r6('b.card / b.n')} AS H_card_share, {r6('b.iss_dec / greatest(1, b.failure)')} AS I_decline_issuer_share, {r6('b.refunds / b.n')} AS I_refund_rate
  FROM f_base b LEFT JOIN f_base p ON p.merchant_id = b.merchant_id AND p.window_size = b.window_size AND p.e = b.e - b.steps"""


@register("additive_features_with_preceding_rate", with_ctes(["f_base"], ADDITIVE_SQL))
def _additive(spark, d):
    return WF.additive_features(fx.annotated(spark, d), preceding=True)


# ---- lifecycle joins and history --------------------------------------------------------

@register("lifecycle_join", with_ctes(["att"], f"SELECT transaction_id, status AS outcome_status, failure_code, CASE WHEN refunded THEN {r6('amount')} END AS refund_amount, CASE WHEN refunded THEN {r6('refund_us / 1e6')} END AS refunded_at, order_status, disputed AS is_disputed, CASE WHEN disputed THEN CAST(dispute_days AS DOUBLE) END AS dispute_days FROM att"))
def _lifecycle(spark, d):
    return lifecycle.join_disputes(fx.annotated(spark, d), fx.disputes(spark, d)).select(
        "transaction_id", "outcome_status", "failure_code", "refund_amount", "refunded_at", "order_status", "is_disputed", F.col("dispute_days").cast("double").alias("dispute_days"))


HIST = {"known": f"SELECT DISTINCT merchant_id, 'cus' AS kind, customer_id AS entity FROM att WHERE us < {BASE} + 14400000000 AND customer_id IS NOT NULL UNION SELECT DISTINCT merchant_id, 'dev', device_fp FROM att WHERE us < {BASE} + 14400000000 AND device_fp IS NOT NULL UNION SELECT DISTINCT merchant_id, 'ins', ins FROM att WHERE us < {BASE} + 14400000000 UNION SELECT DISTINCT merchant_id, 'ip', ip_fp FROM att WHERE us < {BASE} + 14400000000 AND ip_fp IS NOT NULL",
        "ents": f"SELECT {WK}, 'cus' AS kind, cus AS entity, count(*) AS c FROM win GROUP BY {WK}, cus UNION ALL SELECT {WK}, 'dev', dev, count(*) FROM win GROUP BY {WK}, dev UNION ALL SELECT {WK}, 'ins', ins, count(*) FROM win GROUP BY {WK}, ins UNION ALL SELECT {WK}, 'ip', ip, count(*) FROM win GROUP BY {WK}, ip"}


@register("novelty_against_history", with_ctes(["win"], f"""SELECT {WK.replace(', e', '')}, {secs('e')} AS window_end, {r6("count(*) FILTER (kind = 'ins' AND x IS NULL) / count(*) FILTER (kind = 'ins')")} AS C_instrument_novelty,
  {r6("count(*) FILTER (kind = 'cus' AND x IS NULL) / count(*) FILTER (kind = 'cus')")} AS C_account_novelty, {r6("count(*) FILTER (kind = 'dev' AND x IS NULL) / count(*) FILTER (kind = 'dev')")} AS C_device_novelty,
  {r6("count(*) FILTER (kind = 'cus' AND x IS NULL) / sum(c) FILTER (kind = 'cus')")} AS G_account_cohort_concentration, {r6('count(*) FILTER (x IS NULL) / count(*)')} AS J_entity_novelty_share
  FROM ents LEFT JOIN (SELECT *, 1 AS x FROM known) USING (merchant_id, kind, entity) GROUP BY {WK}""", HIST))
def _novelty(spark, d):
    a = fx.annotated(spark, d)
    history = WF.first_seen(a.filter(F.unix_micros("timestamp") < BASE + 14400000000))
    return WF.novelty_features(a, history)


@register("entity_first_seen", with_ctes(["att"], f"SELECT merchant_id, kind, entity, {r6('min(us) / 1e6')} AS first_seen FROM (SELECT merchant_id, us, unnest(['customer', 'device', 'instrument', 'ip']) AS kind, unnest([customer_id, device_fp, ins, ip_fp]) AS entity FROM att) WHERE entity IS NOT NULL GROUP BY 1, 2, 3"))
def _first_seen(spark, d):
    return WF.first_seen(fx.attempts(spark, d))


MIX = {"mx": "SELECT merchant_id, 'city' AS dim, coalesce(city, 'UNKNOWN') AS item, count(*) / sum(count(*)) OVER (PARTITION BY merchant_id) AS q FROM attc GROUP BY merchant_id, coalesce(city, 'UNKNOWN') UNION ALL SELECT merchant_id, 'method', method, count(*) / sum(count(*)) OVER (PARTITION BY merchant_id) FROM attc WHERE us < 1705276800000000 GROUP BY merchant_id, method",
       "px": f"SELECT {WK}, dim, item, count(*) / sum(count(*)) OVER (PARTITION BY {WK}, dim) AS p FROM (SELECT {WK}, 'city' AS dim, coalesce(city, 'UNKNOWN') AS item FROM win UNION ALL SELECT {WK}, 'method', method FROM win) GROUP BY {WK}, dim, item",
       "full_mix": f"SELECT {WK}, dim, item, p, 0.0::DOUBLE AS q FROM px UNION ALL SELECT w.merchant_id, w.window_size, w.e, m.dim, m.item, 0.0::DOUBLE, m.q FROM (SELECT DISTINCT {WK} FROM win) w JOIN mx m USING (merchant_id)",
       "paired": f"SELECT {WK}, dim, item, sum(p) AS p, sum(q) AS q FROM full_mix GROUP BY {WK}, dim, item",
       "jsd": f"SELECT {WK}, dim, sqrt(greatest(0.0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS j FROM paired GROUP BY {WK}, dim"}


@register("mix_distances", with_ctes(["win", "attc"], f"SELECT merchant_id, window_size, {secs('e')} AS window_end, {r6(chr(39).join(['max(j) FILTER (dim = ', 'city', ')']))} AS E_geo_mix_jsd, {r6(chr(39).join(['max(j) FILTER (dim = ', 'method', ')']))} AS H_method_mix_jsd FROM jsd GROUP BY {WK}", MIX))
def _mix(spark, d):
    cal = fx.attempts(spark, d, "calendar")
    geo = WF.baseline_mix(cal, F.coalesce("geo.city", F.lit("UNKNOWN")))
    method = WF.baseline_mix(cal.filter(F.unix_micros("timestamp") < 1705276800000000), F.col("payment_method"))
    return WF.mix_features(fx.annotated(spark, d), geo, method)


# ---- features and graph -----------------------------------------------------------------

@register("window_features", with_ctes(["feat"], O.feature_select()))
def _features(spark, d):
    return WF.window_features(fx.annotated(spark, d))


@register("declared_features", with_ctes(["win"], f"""SELECT merchant_id, window_size, {secs('e')} AS window_end, {r6('count(*) FILTER (refunded) / count(*)')} AS refund_rate,
  {r6('coalesce(count(*) FILTER (customer_id IS NOT NULL AND us - (f - (CAST(substr(customer_id, 5) AS BIGINT) % 72) * 3600000000) < 86400000000) / nullif(count(customer_id), 0), 0)')} AS young_account_share,
  0.0::DOUBLE AS away_from_home_share FROM win LEFT JOIN (SELECT user_id AS u, min(us) AS f FROM ev GROUP BY 1) ON customer_id = 'cus_' || u GROUP BY {WK}"""))
def _declared(spark, d):
    return WF.declared_features(fx.annotated(spark, d), fx.customers(spark, d))


BORN = "(f - (CAST(substr(customer_id, 5) AS BIGINT) % 72) * 3600000000)"
DECL = {"wd": f"SELECT win.*, CASE WHEN customer_id IS NOT NULL THEN {BORN} END AS born FROM win LEFT JOIN (SELECT user_id AS u, min(us) AS f FROM ev GROUP BY 1) ON customer_id = 'cus_' || u",
        "wc": f"SELECT {WK}, max(c) / sum(c) AS cohort FROM (SELECT {WK}, born // 3600000000 AS b, count(DISTINCT customer_id) AS c FROM wd WHERE born IS NOT NULL GROUP BY {WK}, b) GROUP BY {WK}",
        "wr": f"SELECT {WK}, max(top / total) AS rc FROM (SELECT {WK}, d, max(CASE WHEN i IS NOT NULL THEN c ELSE 0 END) AS top, sum(c) AS total FROM (SELECT {WK}, d, i, count(*) AS c FROM (SELECT {WK}, unnest(['c', 'd']) AS d, unnest([customer_id, device_fp]) AS i FROM wd WHERE refunded) GROUP BY {WK}, d, i) GROUP BY {WK}, d) GROUP BY {WK}"}


@register("declared_statistics", with_ctes(["win", "ev"], f"""SELECT merchant_id, window_size, {secs('e')} AS window_end, {r6('coalesce(am, 0) / 3.6e9')} AS account_age_median, {r6('coalesce(ap, 0) / 3.6e9')} AS account_age_p10, {r6('coalesce(rl, 0) / 3.6e9')} AS refund_latency_median,
  {r6('coalesce(cohort, 0)')} AS account_cohort_concentration, {r6('coalesce(rc, 0)')} AS refund_cohort_concentration FROM (SELECT {WK}, quantile_cont(CAST(us - born AS DOUBLE), 0.5) AS am, quantile_cont(CAST(us - born AS DOUBLE), 0.1) AS ap, quantile_cont(CAST(refund_us - us AS DOUBLE), 0.5) FILTER (refunded) AS rl FROM wd GROUP BY {WK})
  LEFT JOIN wc USING ({WK}) LEFT JOIN wr USING ({WK})""", DECL))
def _declared_statistics(spark, d):
    return WF.declared_statistics(fx.annotated(spark, d), fx.customers(spark, d))


PEAK = """CASE WHEN len(c) < 2 THEN 0.0 WHEN list_inner_product(c, c) <= 1e-12 * list_inner_product(g, g) THEN 1.0
  ELSE greatest(0.0, coalesce(list_max(list_transform(range(1, least(5, len(c) - 1) + 1), lambda k: list_inner_product(c[k + 1:], c[1:len(c) - k]) / list_inner_product(c, c))), 0.0)) END"""


@register("declared_periodicity", with_ctes(["win"], f"""SELECT merchant_id, window_size, {secs('e')} AS window_end, {r6(PEAK)} AS periodicity_score FROM
  (SELECT {WK}, coalesce(g, []::DOUBLE[]) AS g, coalesce(list_transform(g, lambda x: x - list_avg(g)), []::DOUBLE[]) AS c FROM (SELECT DISTINCT {WK} FROM win) LEFT JOIN (SELECT {WK}, list(CAST(gap AS DOUBLE) ORDER BY us) AS g FROM (SELECT {WK}, us, us - lag(us) OVER (PARTITION BY {WK} ORDER BY us) AS gap FROM win) WHERE gap IS NOT NULL GROUP BY {WK}) USING ({WK}))"""))
def _periodicity(spark, d):
    return WF.periodicity(fx.annotated(spark, d))


GRAPH_SQL = {
    "ge": f"SELECT DISTINCT {WK}, 'CUS:' || cus AS a, 'DEV:' || dev AS b FROM win UNION SELECT DISTINCT {WK}, 'DEV:' || dev, 'INS:' || ins FROM win UNION SELECT DISTINCT {WK}, 'CUS:' || cus, 'IP:' || ip FROM win",
}


@register("graph_degrees", with_ctes(["att"], "SELECT merchant_id, m, vertex, edge_type, count(*) AS degree FROM (SELECT merchant_id, m, unnest([src, dst]) AS vertex, edge_type FROM (SELECT DISTINCT merchant_id, m, 'CUS:' || cus AS src, 'DEV:' || dev AS dst, 'used_device' AS edge_type FROM att UNION ALL SELECT DISTINCT merchant_id, m, 'DEV:' || dev, 'INS:' || ins, 'used_card' FROM att UNION ALL SELECT DISTINCT merchant_id, m, 'CUS:' || cus, 'IP:' || ip, 'used_ip' FROM att)) GROUP BY 1, 2, 3, 4"))
def _degrees(spark, d):
    return G.degrees(G.graph_edges(fx.attempts(spark, d)), ["merchant_id", "m"])


CROSS_SQL = """SELECT merchant_id, window_size, e, count(*) AS cross_entities, max(ms) AS fanout FROM
  (SELECT DISTINCT merchant_id, window_size, e, unnest(['CUS:' || cus, 'DEV:' || dev, 'INS:' || ins, 'IP:' || ip]) AS v FROM win) JOIN
  (SELECT window_size, e, v, count(DISTINCT merchant_id) AS ms FROM (SELECT merchant_id, window_size, e, unnest(['CUS:' || cus, 'DEV:' || dev, 'INS:' || ins, 'IP:' || ip]) AS v FROM win) GROUP BY 1, 2, 3 HAVING count(DISTINCT merchant_id) > 1) USING (window_size, e, v) GROUP BY 1, 2, 3"""


@register("graph_features", with_ctes(["win", "g_f"], f"""SELECT merchant_id, window_size, {secs('e')} AS window_end, CAST(J_cluster_count AS DOUBLE) AS J_cluster_count, CAST(J_largest_cluster_size AS DOUBLE) AS J_largest_cluster_size,
  {r6('J_largest_cluster_vol_share')} AS J_largest_cluster_vol_share, {r6('J_cluster_density')} AS J_cluster_density, {r6('J_cluster_density_z')} AS J_cluster_density_z, CAST(coalesce(cross_entities, 0) AS DOUBLE) AS J_cross_merchant_entities,
  CAST(coalesce(fanout, 1) AS DOUBLE) AS J_cross_merchant_fanout_max, 0.0::DOUBLE AS J_shared_address_clusters FROM g_f LEFT JOIN ({CROSS_SQL}) USING ({WK})"""))
def _graph(spark, d):
    return G.graph_features(fx.entity_attempts(spark, d), with_cross_merchant=True)


@register("cross_merchant_reach", with_ctes(["win"], f"SELECT merchant_id, window_size, {secs('e')} AS window_end, cross_entities, fanout FROM ({CROSS_SQL})"))
def _cross(spark, d):
    return G.cross_merchant(hold(WF.flatten(fx.attempts(spark, d))), grid.ALL_SIZES).select(
        "merchant_id", "window_size", grid.instant("end_minute").alias("window_end"), "cross_entities", "fanout")


PAYLOAD = {"pv": "SELECT merchant_id, unnest(['CUS:' || coalesce(customer_id, 'anon_' || transaction_id), 'DEV:' || coalesce(device_fp, 'anon_' || transaction_id), 'INS:' || ins, 'IP:' || coalesce(ip_fp, 'anon_' || transaction_id)]) AS id, unnest([0, 1, 2, 3]) AS slot, us, transaction_id FROM att",
           "pr": "SELECT merchant_id, id, row_number() OVER (PARTITION BY merchant_id ORDER BY us, transaction_id, slot) AS position FROM (SELECT merchant_id, id, min_by(us, (us, transaction_id, slot)) AS us, min_by(transaction_id, (us, transaction_id, slot)) AS transaction_id, min_by(slot, (us, transaction_id, slot)) AS slot FROM pv GROUP BY 1, 2)",
           "kept": "SELECT * FROM pr WHERE position <= 50"}


@register("entity_payload_nodes", with_ctes(["att"], "SELECT merchant_id, id, position, CASE WHEN id LIKE 'IP:%' THEN substr(id, 4, 10) ELSE substr(id, 5, 10) END AS label, CASE WHEN id LIKE 'CUS:%' THEN 'customer' WHEN id LIKE 'DEV:%' THEN 'device' WHEN id LIKE 'INS:%' THEN 'instrument' ELSE 'ip' END AS type FROM kept", PAYLOAD))
def _payload(spark, d):
    return G.entity_payload(fx.attempts(spark, d), ["merchant_id"])[0]


@register("entity_payload_edges", with_ctes(["att"], """SELECT DISTINCT e.merchant_id, e.source, e.target, e.type FROM (SELECT merchant_id, 'CUS:' || coalesce(customer_id, 'anon_' || transaction_id) AS source, 'DEV:' || coalesce(device_fp, 'anon_' || transaction_id) AS target, 'used_device' AS type FROM att
  UNION SELECT merchant_id, 'DEV:' || coalesce(device_fp, 'anon_' || transaction_id), 'INS:' || ins, 'used_card' FROM att) e JOIN kept a ON a.merchant_id = e.merchant_id AND a.id = e.source JOIN kept b ON b.merchant_id = e.merchant_id AND b.id = e.target""", PAYLOAD))
def _payload_edges(spark, d):
    return G.entity_payload(fx.attempts(spark, d), ["merchant_id"])[1]


# ---- statistics -----------------------------------------------------------------------

@register("gini_per_supplier", f"SELECT l_suppkey, {r6('2.0 * sum(rn * q) / (count(*) * sum(q)) - (count(*) + 1.0) / count(*)')} AS gini FROM (SELECT l_suppkey, CAST(l_quantity AS DOUBLE) AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS rn FROM lineitem) GROUP BY 1")
def _gini(spark, d):
    return stats.gini(fx.table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("double")), ["l_suppkey"], "q")


@register("entropy_per_merchant", with_ctes(["att"], f"SELECT merchant_id, {r6('log2(sum(c)) - sum(c * log2(c)) / sum(c)')} AS entropy FROM (SELECT merchant_id, method, count(*) AS c FROM att GROUP BY 1, 2) GROUP BY 1"))
def _entropy(spark, d):
    return stats.entropy(fx.attempts(spark, d).groupBy("merchant_id", "payment_method").agg(F.count(F.lit(1)).alias("c")), ["merchant_id"], "c")


@register("js_distance_per_merchant", with_ctes(["attc"], f"""SELECT merchant_id, {r6('sqrt(greatest(0.0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))')} AS js_distance FROM
  (SELECT merchant_id, failure_code, count(*) FILTER (us < 1705276800000000) / sum(count(*) FILTER (us < 1705276800000000)) OVER (PARTITION BY merchant_id) AS p, count(*) FILTER (us >= 1705276800000000) / sum(count(*) FILTER (us >= 1705276800000000)) OVER (PARTITION BY merchant_id) AS q
   FROM attc WHERE failure_code IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""))
def _js(spark, d):
    a = fx.annotated(spark, d, "calendar").filter("failure_code is not null").select("merchant_id", "failure_code", F.lit(1).alias("weight"), F.unix_micros("timestamp").alias("us"))
    return stats.js_distance(a.filter("us < 1705276800000000"), a.filter("us >= 1705276800000000"), ["merchant_id"], "failure_code")


MAD_SQL = f"SELECT {{k}}, {r6('any_value(med)')} AS expected_median, {r6('greatest(0.0001, median(abs(v - med)) * 1.4826)')} AS variability_mad, count(*) AS sample_count FROM (SELECT {{k}}, v, median(v) OVER (PARTITION BY {{k}}) AS med FROM {{src}}) GROUP BY {{k}}"


@register("median_mad_per_flag", MAD_SQL.format(k="l_returnflag", src="(SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem)"))
def _mad(spark, d):
    return stats.median_mad_large(fx.table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v")), ["l_returnflag"], "v")


@register("quantiles_per_flag", f"SELECT l_returnflag, {r6('quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.05)')} AS p05, {r6('quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.9)')} AS p90 FROM lineitem GROUP BY 1")
def _quantiles(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v"))
    return (ranking.exact_quantile(li, ["l_returnflag"], "v", 0.05, "p05").drop("n_total")
            .join(ranking.exact_quantile(li, ["l_returnflag"], "v", 0.9, "p90").drop("n_total"), "l_returnflag"))


@register("moments_per_supplier", f"SELECT l_suppkey, {r6('avg(CAST(l_quantity AS DOUBLE))')} AS mean, {r6('stddev_pop(CAST(l_quantity AS DOUBLE))')} AS std, {r6('min(l_quantity)')} AS min, {r6('max(l_quantity)')} AS max FROM lineitem GROUP BY 1")
def _moments(spark, d):
    return stats.moments(fx.table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("double")), ["l_suppkey"], "q")


# ---- ids, tokens, protection ------------------------------------------------------------

@register("stable_ids", with_ctes(["att"], "SELECT transaction_id, sha256(transaction_id || '|' || merchant_id) AS content_hash, 'inc_' || substr(sha256(merchant_id || '|spike|' || strftime(make_timestamp((m + 1) * 60000000), '%Y-%m-%d %H:%M:%S') || '+00:00'), 1, 26) AS incident_id FROM att"))
def _ids(spark, d):
    a = fx.attempts(spark, d)
    end = grid.instant(grid.minute("timestamp") + 1)
    return a.select("transaction_id", protect.stable_hash(F.concat_ws("|", "transaction_id", "merchant_id")).alias("content_hash"),
                    X.incident_id(F.col("merchant_id"), F.lit("spike"), end).alias("incident_id"))


@register("instrument_tokens")
def _tokens(spark, d):
    return fx.attempts(spark, d).select("transaction_id", protect.instrument_token(F.col("instrument_fp"), PEPPER).alias("token"))


@register("column_protection_round_trip", with_ctes(["att"], "SELECT transaction_id, ins AS decrypted, length(ins) + 28 AS sealed_bytes FROM att"))
def _protection(spark, d):
    a = fx.attempts(spark, d).withColumn("cipher", protect.encrypt(F.col("instrument_fp"), PEPPER))
    return a.select("transaction_id", protect.decrypt(F.col("cipher"), PEPPER).alias("decrypted"), F.length(F.unbase64("cipher")).cast("long").alias("sealed_bytes"))


@register("redacted_documents", r"""SELECT doc_id, regexp_matches(text, '\b(?:\d[ -]*?){13,19}\b') AS has_number, md5(CASE WHEN regexp_matches(text, '\b(?:\d[ -]*?){13,19}\b')
  THEN regexp_replace(text, '\b(?:\d[ -]*?){13,19}\b', '<redacted-number>', 'g') ELSE text END) AS digest FROM documents""")
def _redacted(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.col("text").rlike(protect.CARD_RUN).alias("has_number"), F.md5(protect.redact_text(F.col("text"))).alias("digest"))


# ---- baselines ------------------------------------------------------------------------

def _light(spark, d):
    return WF.additive_features(fx.annotated(spark, d))


_WRITTEN: dict[tuple, str] = {}


def _inputs(spark, d) -> tuple:
    """Names, sizes and times of the files that the fixtures read."""
    out = []
    for t in ("events", "customer", "nation", "region"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{t}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def _written(spark, d, name, make):
    """A table that several queries read, written once per session and state of the input files."""
    at = (spark.sparkContext.applicationId, name, _inputs(spark, d))
    if at not in _WRITTEN:
        path = shared_path(spark, name)
        make().write.parquet(path)
        _WRITTEN[at] = path
    return spark.read.parquet(_WRITTEN[at])


def _twin_rows(spark, d):
    """Every window's twin features, rounded alike on both sides before medians are taken."""
    return _written(spark, d, "twin-features", lambda: scoring.all_features(fx.annotated(spark, d)).select(*KEY, *[r6_col(R.col_of(f)).alias(R.col_of(f)) for f in TWINS]))


LONG = {"lw": f"SELECT merchant_id, window_size, e, CAST(((e // 1440 + 3) % 7) * 24 + (e // 60) % 24 AS BIGINT) AS how, unnest({TWINS!r}) AS feature_id, unnest([{', '.join(r6(R.col_of(f)) for f in TWINS)}]) AS v FROM featj",
        "mb": MAD_SQL.format(k="merchant_id, feature_id, window_size, how", src="lw").replace("CAST(round(CAST(CAST(any_value(med) AS DOUBLE) AS DECIMAL(38,12)), 6) AS DOUBLE) + 0.0", "any_value(med)").replace("CAST(round(CAST(CAST(greatest(0.0001, median(abs(v - med)) * 1.4826) AS DOUBLE) AS DECIMAL(38,12)), 6) AS DOUBLE) + 0.0", "greatest(0.0001, median(abs(v - med)) * 1.4826)")}
FIT = "min(e) * 60.0::DOUBLE AS fit_period_start, max(e) * 60.0::DOUBLE AS fit_period_end FROM lw"


@register("baseline_fit_merchant", with_ctes(["featj"], f"SELECT merchant_id, feature_id, window_size, how AS hour_of_week, {r6('expected_median')} AS expected_median, {r6('variability_mad')} AS variability_mad, sample_count, CASE WHEN sample_count >= 20 THEN 'HIGH' WHEN sample_count >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, fit_period_start, fit_period_end FROM mb, (SELECT {FIT})", LONG))
def _fit(spark, d):
    return B.fit_baselines(B.to_long(_twin_rows(spark, d), TWINS), fx.categories(spark, d))[0]


CAT = {**LONG, "cb": MAD_SQL.format(k="category, feature_id, window_size, how", src="(SELECT lw.*, coalesce(category, 'retail') AS category FROM lw LEFT JOIN cats USING (merchant_id))")}


@register("baseline_fit_category", with_ctes(["featj", "cats"], f"SELECT category, feature_id, window_size, how AS hour_of_week, expected_median, variability_mad, sample_count, 'MEDIUM' AS confidence, fit_period_start, fit_period_end FROM cb, (SELECT {FIT})", CAT))
def _fit_cat(spark, d):
    return B.fit_baselines(B.to_long(_twin_rows(spark, d), TWINS), fx.categories(spark, d))[1]


def _half_baselines(spark, d):
    """All windows, and baselines of the first five hours without merchant m_1."""
    long = B.to_long(_twin_rows(spark, d), TWINS)
    cut = F.timestamp_micros(F.lit(BASE + 5 * 3600000000))
    cats = fx.categories(spark, d)
    known = long.filter((F.col("window_end") < cut) & (F.col("merchant_id") != "m_1"))
    merchant_b, category_b = B.fit_baselines(known, cats)
    return long, merchant_b, category_b, cats


CUT = (BASE // 60000000) + 300
DEV = {"lw": LONG["lw"], "lk": f"SELECT * FROM lw WHERE e < {CUT} AND merchant_id <> 'm_1'",
       "dmb": LONG["mb"].replace("FROM lw)", "FROM lk)"),
       "dcb": LONG["mb"].replace("merchant_id, feature_id", "category, feature_id").replace("FROM lw)", "FROM (SELECT lk.*, coalesce(category, 'retail') AS category FROM lk LEFT JOIN cats USING (merchant_id)))"),
       "dev": f"""SELECT l.merchant_id, l.window_size, l.e, l.feature_id, l.v, l.how, coalesce(a.expected_median, c.expected_median, 0) AS med, coalesce(a.variability_mad, c.variability_mad, 1) AS mad,
         CASE WHEN a.sample_count >= 20 THEN 'HIGH' WHEN a.sample_count >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM lw l LEFT JOIN dmb a ON a.merchant_id = l.merchant_id AND a.feature_id = l.feature_id AND a.window_size = l.window_size AND a.how = l.how
         LEFT JOIN cats k ON k.merchant_id = l.merchant_id LEFT JOIN dcb c ON c.category = coalesce(k.category, 'retail') AND c.feature_id = l.feature_id AND c.window_size = l.window_size AND c.how = l.how"""}


@register("baseline_lookup", with_ctes(["featj", "cats"], f"SELECT merchant_id, window_size, {secs('e')} AS window_end, feature_id, {r6('v')} AS value, how AS hour_of_week, {r6('med')} AS expected_median, {r6('mad')} AS variability_mad, confidence FROM dev", DEV))
def _lookup_b(spark, d):
    long, merchant_b, category_b, cats = _half_baselines(spark, d)
    return B.lookup_baselines(long, merchant_b, category_b, cats).drop("fit_period_end")


@register("deviation_twins", with_ctes(["featj", "cats"], f"SELECT merchant_id, window_size, {secs('e')} AS window_end, feature_id, {r6('(v - med) / greatest(0.0001, mad)')} AS deviation, confidence FROM dev", DEV))
def _dev(spark, d):
    long, merchant_b, category_b, cats = _half_baselines(spark, d)
    return B.deviation(long, merchant_b, category_b, cats, allow_in_sample=True).select(*KEY, "feature_id", "deviation", "confidence")


@register("baseline_leak_check", with_ctes(["featj"], f"SELECT window_size, count(*) AS leaking_rows FROM lw WHERE e < (SELECT max(e) FROM lw) GROUP BY 1", LONG))
def _leaks(spark, d):
    long = B.to_long(_twin_rows(spark, d), TWINS)
    merchant_b, _ = B.fit_baselines(long)
    return B.leaks(B.lookup_baselines(long, merchant_b)).groupBy("window_size").agg(F.count(F.lit(1)).alias("leaking_rows"))


@register("baseline_confidence", with_ctes(["featj", "cats"], f"SELECT merchant_id, window_size, {secs('e')} AS window_end, CASE min(CASE confidence WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS baseline_confidence FROM dev GROUP BY merchant_id, window_size, e", DEV))
def _confidence(spark, d):
    long, merchant_b, category_b, cats = _half_baselines(spark, d)
    return B.overall_confidence(B.deviation(long, merchant_b, category_b, cats, allow_in_sample=True))


@register("twins_equal_raw", with_ctes(["featj", "cats"], "SELECT bool_and(abs(v / greatest(0.0001, 1.0) - v) < 1e-9) AS without_baselines, bool_and(abs((v - expected_median) / greatest(0.0001, variability_mad) - v) < 1e-9) AS with_baselines FROM lw JOIN mb USING (merchant_id, feature_id, window_size, how)", LONG))
def _raw_twins(spark, d):
    long = B.to_long(_twin_rows(spark, d), TWINS)
    merchant_b, _ = B.fit_baselines(long)
    inert = B.twins_equal_raw(B.deviation(long, merchant_b.limit(0)))
    live = B.twins_equal_raw(B.deviation(long, merchant_b, allow_in_sample=True))
    return inert.withColumnRenamed("twins_are_raw", "without_baselines").crossJoin(live.withColumnRenamed("twins_are_raw", "with_baselines"))


@register("baseline_fit_as_of", with_ctes(["featj"], f"SELECT merchant_id, feature_id, window_size, how AS hour_of_week, CAST(1 AS BIGINT) AS version, {r6('expected_median')} AS expected_median, {r6('variability_mad')} AS variability_mad, sample_count FROM mb",
          {"lw0": LONG["lw"], "lw": f"SELECT * FROM lw0 WHERE e < {CUT + 180}", "mb": LONG["mb"]}))
def _as_of(spark, d):
    return B.to_store(B.from_store(B.fit_as_of(_twin_rows(spark, d), "2024-01-01 08:00:00", 28))).drop("confidence", "fit_period_start", "fit_period_end")


@register("features_by_family", with_ctes(["featj", "cats"], f"SELECT merchant_id, window_size, {secs('e')} AS window_end, feature_id, substr(feature_id, 1, 1) AS family, {r6('v')} AS value, {r6('(v - med) / greatest(0.0001, mad)')} AS deviation_mad, feature_id NOT IN {tuple(sorted(R.EVIDENCE_ONLY | R.DOWNSTREAM_ONLY))} AS is_model_input, feature_id IN {tuple(sorted(R.EVIDENCE_ONLY))} AS is_evidence_only FROM dev", DEV))
def _by_family(spark, d):
    long, merchant_b, category_b, cats = _half_baselines(spark, d)
    return N.features_by_family(long, B.deviation(long, merchant_b, category_b, cats, allow_in_sample=True))


@register("top_deviations", with_ctes(["featj", "cats"], f"""SELECT merchant_id, window_size, {secs('e')} AS window_end, rk AS position, feature_id, dv AS deviation_mad, direction FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id, window_size, e ORDER BY abs(dv) DESC, list_position({TWINS!r}, feature_id)) AS rk FROM
  (SELECT *, CAST(round_even(CAST((v - med) / greatest(0.0001, mad) AS DECIMAL(38,10)), 2) AS DOUBLE) AS dv, CASE WHEN v - med > 0 THEN 'HIGH' ELSE 'LOW' END AS direction FROM dev)) WHERE rk <= 3""", DEV))
def _top(spark, d):
    long, merchant_b, category_b, cats = _half_baselines(spark, d)
    return N.top_deviations(B.deviation(long, merchant_b, category_b, cats, allow_in_sample=True), 3).drop("raw_value")


# ---- labels and splits ------------------------------------------------------------------

LAB = {"lab": f"""SELECT s.merchant_id, s.window_size, s.steps, s.e, coalesce(n, 0) AS n, coalesce(ab, 0) AS ab, coalesce(sp, 0) AS sp, coalesce(ab / n, 0) AS abs_, coalesce(sp / n, 0) AS sps,
        coalesce(gmv, 0) AS gmv, coalesce(dom, 'normal_day') AS dom FROM spine s LEFT JOIN (SELECT {WK}, count(*) AS n, count(*) FILTER (is_abusive) AS ab, count(*) FILTER (is_spike) AS sp, CAST(sum(amount) AS DOUBLE) AS gmv FROM win GROUP BY {WK}) USING ({WK})
        LEFT JOIN (SELECT {WK}, max_by(scenario_id, (c, -us, scenario_id)) AS dom FROM (SELECT {WK}, scenario_id, count(*) AS c, min(us) AS us FROM win GROUP BY {WK}, scenario_id) GROUP BY {WK}) USING ({WK})""",
       "lbl": f"""SELECT *, CASE WHEN ab >= 5 AND abs_ >= 0.2 THEN 'FRAUD_SPIKE' WHEN sp >= 5 AND sps >= 0.2 THEN 'LEGIT_SPIKE' ELSE 'NORMAL' END AS label,
        CASE WHEN e * 60 < {BOUNDS[0]} THEN 'train' WHEN e * 60 < {BOUNDS[1]} THEN 'validation' ELSE 'test' END AS split FROM lab"""}
LB = ["spine", "win"]


@register("window_labels", with_ctes(LB, f"SELECT merchant_id, window_size, {secs('e')} AS window_end, n AS total_txns, ab AS n_abusive, {r6('abs_')} AS abusive_share, sp AS n_spike, {r6('sps')} AS spike_share, dom AS dominant_scenario_id, label FROM lbl", LAB))
def _labels(spark, d):
    return L.lift_labels(fx.labelled(spark, d, geo=False))


@register("label_sensitivity", with_ctes(LB, """SELECT k, share, label, count(*) AS windows FROM (SELECT k, share, CASE WHEN ab >= k AND abs_ >= greatest(share, 0.003) THEN 'FRAUD_SPIKE' WHEN sp >= k AND sps >= share THEN 'LEGIT_SPIKE' ELSE 'NORMAL' END AS label
  FROM lab, (SELECT unnest([3, 5, 10])::BIGINT AS k), (SELECT unnest([0.1, 0.2, 0.4])::DOUBLE AS share) WHERE window_size = '5m') GROUP BY 1, 2, 3""", LAB))
def _sensitivity(spark, d):
    return L.label_sensitivity(fx.labelled(spark, d))


def _split_labels(spark, d):
    return L.temporal_split(L.lift_labels(fx.labelled(spark, d, geo=False)), *BOUNDS)


@register("temporal_split", with_ctes(LB, f"SELECT split, window_size, count(*) AS windows, {secs('min(e)')} AS first_end, {secs('max(e)')} AS last_end FROM lbl GROUP BY 1, 2", LAB))
def _split(spark, d):
    return _split_labels(spark, d).groupBy("split", "window_size").agg(F.count(F.lit(1)).alias("windows"), F.min("window_end").alias("first_end"), F.max("window_end").alias("last_end"))


def _episodes(spark, d):
    ev = fx.labelled(spark, d).filter("scenario_id <> 'normal_day'")
    ep = ev.groupBy("merchant_id", "scenario_id", F.floor(grid.minute("timestamp") / 90).alias("_p")).agg(F.min("timestamp").alias("start_time"), F.count(F.lit(1)).cast("double").alias("intensity")).drop("_p")
    return L.temporal_split(ep.withColumn("is_attack", F.col("scenario_id") == "card_testing_burst"), *BOUNDS, ts="start_time")


COV = {**LAB, "ep": f"SELECT merchant_id, scenario_id, CASE WHEN min(us) / 1000000 < {BOUNDS[0]} THEN 'train' WHEN min(us) / 1000000 < {BOUNDS[1]} THEN 'validation' ELSE 'test' END AS split, CASE WHEN scenario_id = 'card_testing_burst' THEN 'fraud_episode' ELSE 'hard_negative_episode' END AS kind FROM att WHERE scenario_id <> 'normal_day' GROUP BY merchant_id, scenario_id, m // 90",
       "cov": "SELECT split, kind, '*' AS item, count(*) AS n FROM ep GROUP BY 1, 2 UNION ALL SELECT split, kind, scenario_id, count(*) FROM ep GROUP BY 1, 2, 3 UNION ALL SELECT split, 'windows_by_label', label, count(*) FROM lbl GROUP BY 1, 3 UNION ALL SELECT split, 'windows_by_scenario', dom, count(*) FROM lbl WHERE dom <> 'normal_day' GROUP BY 1, 3"}


@register("dataset_coverage", with_ctes(LB, "SELECT * FROM cov", COV))
def _coverage(spark, d):
    return L.coverage(_split_labels(spark, d), _episodes(spark, d))


@register("present_or_not_evaluated", with_ctes(LB, """SELECT split, scenario_id, CASE WHEN e.n > 0 AND w.n > 0 THEN CAST(w.n AS VARCHAR) ELSE 'NOT PRESENT — NOT EVALUATED' END AS reported FROM (SELECT DISTINCT split FROM lbl), (SELECT unnest(['card_testing_burst', 'flash_sale_spike', 'device_farm_ring']) AS scenario_id)
  LEFT JOIN (SELECT split AS es, item AS ei, sum(n) AS n FROM cov WHERE kind IN ('fraud_episode', 'hard_negative_episode') GROUP BY 1, 2) e ON es = split AND ei = scenario_id LEFT JOIN (SELECT split AS ws, item AS wi, n FROM cov WHERE kind = 'windows_by_scenario') w ON ws = split AND wi = scenario_id""", COV))
def _present(spark, d):
    cover = hold(L.coverage(_split_labels(spark, d), _episodes(spark, d)))
    asked = F.explode(F.array(*[F.lit(x) for x in ("card_testing_burst", "flash_sale_spike", "device_farm_ring")]))
    windows = cover.filter("kind = 'windows_by_scenario'").select("split", F.col("item").alias("scenario_id"), "n")
    values = cover.select("split").distinct().withColumn("scenario_id", asked).join(windows, ["split", "scenario_id"], "left")
    return L.present_or_not(values, cover, "n").select("split", "scenario_id", "reported")


def _labels_gmv(spark, d):
    labels = L.lift_labels(fx.labelled(spark, d, geo=False))
    return labels.join(WF.additive_features(fx.entity_attempts(spark, d)).select(*KEY, F.col("D_gmv").alias("gmv")), KEY, "left").fillna(0.0, ["gmv"])


def run_sql(source: str, keys: str, gap: int, score: str = "NULL::DOUBLE") -> str:
    """Runs of windows by end: start of the first (shortest) window to the last end."""
    return f"""SELECT {keys}, run, (min(e) - arg_min(steps, e)) AS s, max(e) AS t, sum(n) AS n, sum(gmv) AS gmv, max(p) AS p FROM (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY e) AS run FROM
      (SELECT *, CASE WHEN e - lag(e) OVER (PARTITION BY {keys} ORDER BY e) <= {gap} THEN 0 ELSE 1 END AS new FROM (SELECT {keys}, e, count(*) AS n, sum(gmv) AS gmv, min(steps) AS steps, max({score}) AS p FROM {source} GROUP BY {keys}, e))) GROUP BY {keys}, run"""


TRUE = {**LAB, "pos": "SELECT *, dom AS scenario_id FROM lbl WHERE label = 'FRAUD_SPIKE'", "tr": run_sql("pos", "merchant_id, scenario_id", 5)}


@register("true_incidents", with_ctes(LB, f"SELECT merchant_id, scenario_id, {secs('s')} AS start_time, {secs('t')} AS end_time, true AS is_attack, {r6('gmv')} AS total_gmv, CAST(n AS BIGINT) AS window_count FROM tr", TRUE))
def _true(spark, d):
    return L.true_incidents(_labels_gmv(spark, d))


@register("true_incident_spans", with_ctes(LB, f"SELECT merchant_id, arg_min(dom, (steps, e)) AS scenario_id, {secs('arg_min(e - steps, (steps, e))')} AS start_time, {secs('arg_max(e, (steps, e))')} AS end_time, {r6('sum(gmv)')} AS total_gmv, true AS is_attack FROM lbl WHERE label = 'FRAUD_SPIKE' GROUP BY 1", LAB))
def _spans(spark, d):
    return L.true_incident_spans(_labels_gmv(spark, d))


# ---- decision -------------------------------------------------------------------------

GRID_SQL = f"SELECT unnest({X.threshold_grid()!r})::DOUBLE AS threshold, unnest(range(81)) AS i"
SWEEP = {"g": GRID_SQL, "sw": "SELECT i, threshold, avg(CASE WHEN p >= threshold THEN 1.0 ELSE 0.0 END) AS review_rate, sum(CASE WHEN y = 1 AND p < threshold THEN {loss} ELSE 0 END) + 250.0 * sum(CASE WHEN y = 0 AND p >= threshold THEN 1 ELSE 0 END) AS total_cost FROM sc, g GROUP BY 1, 2"}


@register("threshold_sweep", with_ctes(["sc"], f"SELECT i, {r6('threshold')} AS threshold, {r6('review_rate')} AS review_rate, {r6('total_cost')} AS total_cost FROM sw", {**SWEEP, "sw": SWEEP["sw"].format(loss="5000.0")}))
def _sweep(spark, d):
    return X.sweep_thresholds(fx.scores(spark, d))


CHOICE = f"""SELECT {r6('greatest(0.15, t - 0.2)')} AS theta_alert, {r6('t')} AS theta_review, {r6('least(0.95, t + 0.2)')} AS theta_restrict, {r6('c')} AS expected_loss, {r6('r')} AS review_rate FROM
  (SELECT arg_min(threshold, (total_cost, i)) AS t, min(total_cost) AS c, arg_min(review_rate, (total_cost, i)) AS r FROM sw WHERE review_rate <= {{cap}})"""


@register("threshold_choice", with_ctes(["sc"], CHOICE.format(cap=0.15), {**SWEEP, "sw": SWEEP["sw"].format(loss="5000.0")}))
def _choice(spark, d):
    return X.choose_thresholds(fx.scores(spark, d))


@register("threshold_choice_with_losses", with_ctes(["sc"], CHOICE.format(cap=0.9), {**SWEEP, "sw": SWEEP["sw"].format(loss="loss")}))
def _choice_loss(spark, d):
    return X.choose_thresholds(fx.scores(spark, d), cap=0.9, loss="loss")


@register("threshold_order_repair", with_ctes(["sc"], f"SELECT {r6('o[1]')} AS theta_alert, {r6('o[2]')} AS theta_review, {r6('o[3]')} AS theta_restrict FROM (SELECT list_sort([theta_alert, theta_review, theta_restrict]) AS o FROM ({CHOICE.format(cap=0.95)}))", {**SWEEP, "sw": SWEEP["sw"].format(loss="loss")}))
def _repair(spark, d):
    return X.choose_thresholds(fx.scores(spark, d), cap=0.95, loss="loss", ordered=True).select("theta_alert", "theta_review", "theta_restrict")


def _scored_rows(spark, d):
    """The windows as ``score_windows`` judges them, empty ones included, from the columns that the score needs: the rate's
    deviation from its stored baseline, and the share of the largest cluster."""
    def make():
        # the sums read joined outcomes, and no column that they do not need; the graph reads entities, for which the repeats of an outcome are enough
        events = fx.annotated(spark, d, geo=False)
        flat = WF.flatten(events)
        paid = ("merchant_id", "m", "amount", "status")
        flat = flat.select(*[F.col(f.name) if f.name in paid else F.lit(None).cast(f.dataType).alias(f.name) for f in flat.schema.fields])
        spine = grid.window_spine(fx.attempts(spark, d, geo=False).select("merchant_id", "timestamp"))
        wide = WF.additive_features(events, spine=spine, flat=flat).select(*KEY, "A_txn_rate", "C_failure_rate", "D_gmv", "B_txn_count")
        entities = fx.entity_attempts(spark, d)
        share = G.graph_features(entities, flat=WF.flatten(entities).select("merchant_id", "m", "us", *tiles.ENTITIES)).select(*KEY, "J_largest_cluster_vol_share")
        wide = cut_lineage(wide.join(share, KEY, "left").fillna(0.0, ["J_largest_cluster_vol_share"]))
        held = scoring.with_stored_baselines(wide.select(*KEY, "A_txn_rate"), BOUNDS[0], fx.categories(spark, d)).drop("A_txn_rate")
        scored = wide.join(held, KEY).withColumn("risk_score", X.heuristic_score(F.col("A_txn_rate_dev"), F.col("J_largest_cluster_vol_share")))
        return scored.withColumn("gmv", F.col("D_gmv")).withColumn("n_txns", F.col("B_txn_count"))
    return _written(spark, d, "scored-windows", make)


def _profile_sql(keys: str, src: str) -> str:
    return f"""SELECT {keys}, window_size, how, any_value(med) AS med, greatest(0.0001, median(abs(rate - med)) * 1.4826) AS mad, count(*) AS c
      FROM (SELECT *, median(rate) OVER (PARTITION BY {keys}, window_size, how) AS med FROM {src} WHERE e * 60 < {BOUNDS[0]}) GROUP BY {keys}, window_size, how"""


#: what the score's statement needs: the spine with rates and cluster shares, baselines of the history, deviations
SCN = ["spine", "f_base", "g_f", "cats"]
SC = {"sp0": f"""SELECT s.merchant_id, s.window_size, s.steps, s.e, coalesce(n, 0) AS n, coalesce(gmv, 0.0::DOUBLE) AS gmv, coalesce(n, 0) / s.steps AS rate, coalesce(share, 0.0::DOUBLE) AS share, coalesce(category, 'retail') AS category,
        CAST(((s.e // 1440 + 3) % 7) * 24 + (s.e // 60) % 24 AS BIGINT) AS how FROM spine s LEFT JOIN (SELECT {WK}, n, gmv FROM f_base) USING ({WK})
        LEFT JOIN (SELECT {WK}, J_largest_cluster_vol_share AS share FROM g_f) USING ({WK}) LEFT JOIN cats USING (merchant_id)""",
      "hm": _profile_sql("merchant_id", "sp0"), "hc": _profile_sql("category", "sp0"),
      "dv": f"""SELECT s.*, CASE WHEN e * 60 < {BOUNDS[0]} THEN rate ELSE (rate - coalesce(m.med, k.med, 0.0)) / greatest(0.0001, coalesce(m.mad, k.mad, 1.0)) END AS dev,
        CASE WHEN e * 60 < {BOUNDS[0]} THEN 'LOW' WHEN m.c >= 20 THEN 'HIGH' WHEN m.c >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM sp0 s
        LEFT JOIN hm m ON m.merchant_id = s.merchant_id AND m.window_size = s.window_size AND m.how = s.how LEFT JOIN hc k ON k.category = s.category AND k.window_size = s.window_size AND k.how = s.how""",
      "swd": "SELECT *, least(1.0::DOUBLE, CASE WHEN dev > 0 THEN 1.0 / (1.0 + pow(2.718::DOUBLE, -0.5 * (dev - 3.0))) ELSE 0.05 END + share * 0.4) AS score FROM dv",
      "tier": "SELECT *, CASE WHEN score >= 0.85 THEN 'RESTRICT' WHEN score >= 0.6 THEN 'REVIEW' WHEN score >= 0.35 THEN 'ALERT' ELSE 'OBSERVE' END AS action_tier FROM swd"}


@register("heuristic_scores", with_ctes(SCN, f"SELECT merchant_id, window_size, {secs('e')} AS window_end, {r6('dev')} AS rate_deviation, {r6('share')} AS cluster_share, {r6('score')} AS risk_score, {r6('1.0 / (1.0 + exp(-0.5 * (dev - 3.0)))')} AS logistic_score, confidence AS baseline_confidence FROM swd", SC))
def _heuristic(spark, d):
    return _scored_rows(spark, d).select(*KEY, F.col("A_txn_rate_dev").alias("rate_deviation"), F.col("J_largest_cluster_vol_share").alias("cluster_share"), "risk_score",
                                         X.logistic(F.col("A_txn_rate_dev")).alias("logistic_score"), "baseline_confidence")


CONTROL_SQL = " ".join(f"WHEN dom = '{a}' THEN '{b}'" for a, b, _ in X.CONTROLS)


@register("action_tiers", with_ctes([*SCN, *LB], f"SELECT merchant_id, window_size, {secs('e')} AS window_end, action_tier, CASE WHEN action_tier = 'RESTRICT' THEN CASE {CONTROL_SQL} ELSE '{X.OTHER_CONTROL[0]}' END END AS recommended_control FROM tier JOIN (SELECT merchant_id, window_size, e, dom FROM lbl) USING ({WK})", {**SC, **LAB}))
def _tiers(spark, d, scored=_scored_rows):
    labels = L.lift_labels(fx.labelled(spark, d, geo=False)).select(*KEY, "dominant_scenario_id")
    return X.assign_tier(scored(spark, d).join(labels, KEY), scenario="dominant_scenario_id").select(*KEY, "action_tier", "recommended_control")


EXPO = "CAST(round_even({x}, 2) AS DOUBLE)"
MONEY = {"ex": "SELECT *, CAST(gmv AS DECIMAL(20,4)) AS g, CASE WHEN action_tier IN ('REVIEW', 'RESTRICT') THEN CAST(0.85 AS DECIMAL(6,4)) ELSE CAST(0.2 AS DECIMAL(6,4)) END AS pl FROM tier"}
DIRECT, OPER = "CAST(g * pl AS DECIMAL(30,8))", "CAST(n * 1670 AS DECIMAL(30,8))"


@register("exposure", with_ctes([*SCN], f"SELECT merchant_id, window_size, {secs('e')} AS window_end, CAST(pl AS DOUBLE) AS p_loss, {EXPO.format(x=DIRECT)} AS direct_fraud_loss, {EXPO.format(x=OPER)} AS operational_loss, {EXPO.format(x=f'{DIRECT} + {OPER}')} AS total_exposure FROM ex", {**SC, **MONEY}))
def _exposure(spark, d, scored=_scored_rows):
    return X.exposure(X.assign_tier(scored(spark, d))).select(*KEY, "p_loss", "direct_fraud_loss", "operational_loss", "total_exposure")


def _incidents(spark, d, scored=_scored_rows):
    return X.incidents(X.exposure(X.assign_tier(scored(spark, d))))


IID = "'inc_' || substr(sha256(merchant_id || '|spike|' || strftime(make_timestamp(e * 60000000), '%Y-%m-%d %H:%M:%S') || '+00:00'), 1, 26)"
INC = {**SC, **MONEY, "inc": f"SELECT *, {IID} AS incident_id, {EXPO.format(x=f'{DIRECT} + {OPER}')} AS exposure_amount FROM ex WHERE action_tier IN ('REVIEW', 'RESTRICT') QUALIFY row_number() OVER (PARTITION BY merchant_id, e ORDER BY steps DESC) = 1"}
INC_COLS = f"incident_id, merchant_id, CASE WHEN action_tier = 'RESTRICT' THEN 'high' ELSE 'medium' END AS severity, action_tier, {secs('e - steps')} AS first_flag_time, {secs('e')} AS last_flag_time, window_size AS horizon, {r6('score')} AS risk_score, exposure_amount"


@register("incident_rows", with_ctes([*SCN], f"SELECT {INC_COLS}, 'OPEN' AS status FROM inc", INC))
def _incident_rows(spark, d, scored=_scored_rows):
    return _incidents(spark, d, scored).withColumn("horizon", F.col("window_sizes")[0]).drop("window_sizes")


def _actions(spark, d, scored=_scored_rows):
    """Analyst actions on every incident, two rounds, as functions of the flag minute."""
    inc = _incidents(spark, d, scored)
    m = grid.minute("last_flag_time")
    first = inc.select("incident_id", F.lit("ACKNOWLEDGE").alias("action"), F.lit("").alias("notes"), F.col("last_flag_time").alias("acted_at"))
    pick = F.element_at(F.array(*[F.lit(x) for x in ("APPLY_DEFENSE", "DISMISS", "RESOLVE", "ESCALATE")]), (m % 4 + 1).cast("int"))
    second = inc.filter(m % 3 == 0).select("incident_id", pick.alias("action"), F.when(m % 2 == 0, "checked").otherwise("").alias("notes"),
                                           F.timestamp_micros(F.unix_micros("last_flag_time") + 60000000).alias("acted_at"))
    return inc, first.unionByName(second)


@register("analyst_actions", with_ctes([*SCN], """SELECT incident_id, CASE WHEN e % 3 <> 0 THEN 'ACKNOWLEDGED' WHEN e % 4 = 0 THEN 'CONFIRMED' WHEN e % 4 = 1 THEN 'DISMISSED' WHEN e % 4 = 2 THEN 'CLOSED' ELSE 'OPEN' END AS status,
  CASE WHEN e % 3 = 0 AND e % 2 = 0 THEN 'checked' WHEN e % 3 <> 0 THEN 'Applied action ACKNOWLEDGE' WHEN e % 4 = 1 THEN 'Applied action DISMISS' ELSE 'Applied action ESCALATE' END AS analyst_notes FROM inc""", INC))
def _acted(spark, d, scored=_scored_rows):
    return X.apply_actions(*_actions(spark, d, scored)).select("incident_id", "status", "analyst_notes")


@register("incident_list", with_ctes([*SCN], f"SELECT {INC_COLS} FROM inc WHERE merchant_id = 'm_3' ORDER BY e DESC, incident_id LIMIT 100", INC))
def _list(spark, d, scored=_scored_rows):
    return N.incident_list(_incidents(spark, d, scored), "m_3", "OPEN").withColumn("horizon", F.col("window_sizes")[0]).drop("window_sizes", "status")


@register("incident_details", with_ctes([*SCN], "SELECT merchant_id, severity, count(*) AS incidents FROM (SELECT merchant_id, CASE WHEN action_tier = 'RESTRICT' THEN 'high' ELSE 'medium' END AS severity FROM inc) GROUP BY 1, 2", INC))
def _details(spark, d, scored=_scored_rows):
    return _incidents(spark, d, scored).groupBy("merchant_id", "severity").agg(F.count(F.lit(1)).alias("incidents"))


@register("incident_detail", with_ctes([*SCN], f"""SELECT incident_id, merchant_id, window_size, {secs('e')} AS window_end, action_tier, {r6('score')} AS risk_score,
  CASE WHEN e % 3 <> 0 THEN 'ACKNOWLEDGED' WHEN e % 4 = 0 THEN 'CONFIRMED' WHEN e % 4 = 1 THEN 'DISMISSED' WHEN e % 4 = 2 THEN 'CLOSED' ELSE 'OPEN' END AS status,
  CASE WHEN e % 3 = 0 AND e % 2 = 0 THEN 'checked' WHEN e % 3 <> 0 THEN 'Applied action ACKNOWLEDGE' WHEN e % 4 = 1 THEN 'Applied action DISMISS' ELSE 'Applied action ESCALATE' END AS analyst_notes FROM inc""", INC))
def _detail(spark, d, scored=_scored_rows):
    return N.incident_detail(X.apply_actions(*_actions(spark, d, scored)))


@register("evidence_cards", with_ctes(["feat"], f"""SELECT merchant_id, window_size, {secs('e')} AS window_end, row_number() OVER (PARTITION BY {WK} ORDER BY w DESC, o DESC) AS position, card, {r6('w')} AS weight, tone FROM (SELECT {WK}, unnest(cards, recursive := true) FROM (SELECT {WK}, list_filter([
  CASE WHEN C_failure_rate >= 0.4 THEN {{'w': C_failure_rate * 100.0, 'o': 0, 'card': 'failure_rate', 'tone': 'risk'}} END, CASE WHEN C_instrument_novelty >= 0.7 THEN {{'w': C_instrument_novelty * 80.0::DOUBLE, 'o': -1, 'card': 'novelty', 'tone': 'risk'}} END,
  CASE WHEN F_accounts_per_device_max >= 3 THEN {{'w': least(90.0, F_accounts_per_device_max * 8.0::DOUBLE), 'o': -3, 'card': 'device_sharing', 'tone': 'risk'}} END, CASE WHEN F_instruments_per_device_max >= 5 THEN {{'w': least(95.0, F_instruments_per_device_max * 6.0::DOUBLE), 'o': -4, 'card': 'cards_per_device', 'tone': 'risk'}} END,
  CASE WHEN D_low_value_ratio >= 0.6 THEN {{'w': D_low_value_ratio * 60.0, 'o': -5, 'card': 'micro_amounts', 'tone': 'risk'}} END, CASE WHEN G_new_account_rate >= 0.7 THEN {{'w': G_new_account_rate * 45.0::DOUBLE, 'o': -6, 'card': 'new_accounts', 'tone': 'risk'}} END,
  CASE WHEN C_failure_rate <= 0.15 THEN {{'w': 12.0::DOUBLE, 'o': -20, 'card': 'failure_rate_ok', 'tone': 'benign'}} END, CASE WHEN C_failure_rate > 0.3 AND I_decline_code_entropy < 0.6 THEN {{'w': 55.0::DOUBLE, 'o': -21, 'card': 'decline_concentration', 'tone': 'risk'}} END,
  CASE WHEN A_txn_rate > 0 THEN {{'w': 20.0::DOUBLE, 'o': -22, 'card': 'velocity', 'tone': 'neutral'}} END], lambda x: x IS NOT NULL) AS cards FROM feat))"""))
def _cards(spark, d):
    return N.evidence_cards(WF.window_features(fx.annotated(spark, d)))


# ---- inspection -----------------------------------------------------------------------

@register("transaction_page", with_ctes(["att"], f"SELECT transaction_id, {r6('us / 1e6')} AS timestamp, customer_id, {r6('amount')} AS amount, status AS outcome_status FROM att ORDER BY us, transaction_id LIMIT 50 OFFSET 150"))
def _page(spark, d):
    return N.page(fx.annotated(spark, d), ["timestamp", "transaction_id"], 4, 50).select("transaction_id", "timestamp", "customer_id", "amount", "outcome_status")


SUMMARY = {"sm": "SELECT merchant_id, m // 60 AS hr, count(*) AS n, count(*) FILTER (is_abusive) AS ab, min(us) AS lo, max(us) AS hi, count(DISTINCT customer_id) AS customers, count(DISTINCT device_fp) AS devices, count(DISTINCT ins) AS instruments, count(DISTINCT ip_fp) AS ips FROM att GROUP BY 1, 2"}


def _window_summary(spark, d):
    return N.window_summary(fx.labelled(spark, d).withColumn("hr", F.floor(grid.minute("timestamp") / 60)), ["merchant_id", "hr"])


@register("window_summary", with_ctes(["att"], f"SELECT merchant_id, hr, n AS total_transactions, ab AS abusive_transactions, n - ab AS benign_transactions, {r6('lo / 1e6')} AS time_range_start, {r6('hi / 1e6')} AS time_range_end, customers, devices, instruments, ips FROM sm", SUMMARY))
def _sm(spark, d):
    return _window_summary(spark, d)


@register("entity_ratios", with_ctes(["att"], f"SELECT merchant_id, hr, {r6('round(instruments / nullif(customers, 0), 4)')} AS instruments_per_customer, {r6('round(n / nullif(devices, 0), 4)')} AS transactions_per_device, customers + devices + instruments + ips AS total_entities FROM sm", SUMMARY))
def _ratios(spark, d):
    return N.entity_ratios(_window_summary(spark, d)).select("merchant_id", "hr", "instruments_per_customer", "transactions_per_device", "total_entities")


@register("evidence_export", with_ctes(["att"], f"SELECT {r6('us / 1e6')} AS timestamp, transaction_id, coalesce(customer_id, '') AS customer_id, coalesce(device_fp, '') AS device_fp, {r6('amount')} AS amount, CASE WHEN status = 'CAPTURED' THEN 'CAPTURED' ELSE 'FAILED' END AS status, is_abusive FROM att WHERE merchant_id = 'm_4' ORDER BY us, transaction_id LIMIT 100"))
def _export(spark, d):
    members = fx.annotated(spark, d).filter("merchant_id = 'm_4'").join(fx.truth(spark, d).select("transaction_id", "is_abusive"), "transaction_id", "left")
    return stores.evidence_rows(members)


# ---- stores ---------------------------------------------------------------------------

@register("store_upsert", with_ctes(["att"], f"SELECT merchant_id, m, CASE WHEN m % 2 = 0 OR m % 3 <> 0 THEN {r6('2 * g')} ELSE {r6('g')} END AS gmv, CASE WHEN m % 3 = 0 THEN n ELSE 2 * n END AS first_n FROM (SELECT merchant_id, m, count(*) AS n, sum(amount) AS g FROM att GROUP BY 1, 2) WHERE m % 3 = 0 OR m % 2 = 0"))
def _upsert(spark, d):
    rows = fx.attempts(spark, d).groupBy("merchant_id", grid.minute("timestamp").alias("m")).agg(F.sum("amount").alias("gmv"), F.count(F.lit(1)).alias("first_n"))
    old = rows.filter("m % 3 = 0")
    new = rows.filter("m % 2 = 0").withColumn("gmv", F.col("gmv") * 2).withColumn("first_n", F.col("first_n") * 2)
    return stores.upsert(old, new.withColumn("gmv", F.col("gmv").cast(old.schema["gmv"].dataType)), ["merchant_id", "m"], ["gmv"])


@register("co_occurrence_store", with_ctes(["att"], f"""SELECT merchant_id, ta AS entity_type_a, a AS entity_id_a, tb AS entity_type_b, b AS entity_id_b, count(*) AS co_occurrence_count, {r6('min(us) / 1e6')} AS first_seen_at, {r6('max(us) / 1e6')} AS last_seen_at
  FROM (SELECT merchant_id, us, unnest(['customer', 'device', 'customer']) AS ta, unnest([customer_id, device_fp, customer_id]) AS a, unnest(['device', 'instrument', 'network']) AS tb, unnest([device_fp, ins, ip_fp]) AS b FROM att)
  WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2, 3, 4, 5 HAVING max(us) + 3600000000 > {BASE} + 21600000000"""))
def _co(spark, d):
    a = fx.attempts(spark, d)
    cut = F.unix_micros("timestamp") < BASE + 14400000000
    day = lambda x: stores.co_occurrence(x).withColumn("expires_at", F.timestamp_micros(F.unix_micros("last_seen_at") + 3600000000))
    return stores.merge_co_occurrence(day(a.filter(cut)), day(a.filter(~cut)), F.timestamp_micros(F.lit(BASE + 21600000000))).drop("expires_at")


@register("feature_store_ids", with_ctes(["f_base"], f"SELECT sha256(merchant_id || ':' || window_size || ':' || strftime(make_timestamp(e * 60000000), '%Y-%m-%dT%H:%M:%S') || '+00:00') AS id, {r6('n / steps')} AS txn_rate, {r6('gmv')} AS gmv FROM f_base"))
def _store_ids(spark, d):
    rows = stores.feature_rows(_light(spark, d), ["A_txn_rate", "C_failure_rate"], ["D_gmv"])
    return rows.select("id", F.col("features")["A_txn_rate"].alias("txn_rate"), F.col("evidence")["D_gmv"].alias("gmv"))


@register("eval_store_rows", with_ctes([*SCN, *LB], f"SELECT split, merchant_id, window_size, {secs('e')} AS window_end, {r6('score')} AS predicted_score, label AS ground_truth_label, dom AS scenario_id FROM swd JOIN (SELECT {WK}, split, label, dom FROM lbl) USING ({WK}) WHERE split = 'test'", {**SC, **LAB}))
def _eval_rows(spark, d, scored=_scored_rows):
    scored = scored(spark, d).select(*KEY, F.col("risk_score").alias("predicted_score"))
    rows = _split_labels(spark, d).select("split", *KEY, F.col("label").alias("ground_truth_label"), F.col("dominant_scenario_id").alias("scenario_id")).join(scored, KEY)
    return rows.filter("split = 'test'").orderBy("window_end", "merchant_id", "window_size")


HALF = BASE // 60000000 + 360


@register("feature_store_windows", with_ctes(["f_base"], f"""SELECT sha256(merchant_id || ':' || window_size || ':' || strftime(make_timestamp(e * 60000000), '%Y-%m-%dT%H:%M:%S') || '+00:00') AS id, window_size, {secs('e')} AS window_end,
  {r6(f'n / steps * (CASE WHEN e >= {HALF} - 60 THEN 2 ELSE 1 END)')} AS txn_rate, {r6('gmv')} AS gmv FROM f_base WHERE merchant_id = 'm_3'"""))
def _feature_store(spark, d):
    """Two saves that overlap by an hour, the second repeated; the later values stand."""
    wide = hold(_light(spark, d).select(*KEY, "A_txn_rate", "D_gmv"))
    store = tables.FeatureStore(spark, shared_path(spark, "feature-store"))
    minute = grid.minute("window_end")
    store.save(wide.filter(minute < HALF), ["A_txn_rate"], ["D_gmv"])
    for _ in range(2):
        store.save(wide.filter(minute >= HALF - 60).withColumn("A_txn_rate", F.col("A_txn_rate") * 2), ["A_txn_rate"], ["D_gmv"])
    return store.get("m_3", start="2024-01-01 00:00:00", end="2024-01-02 00:00:00").select("id", "window_size", "window_end", F.col("features")["A_txn_rate"].alias("txn_rate"), F.col("evidence")["D_gmv"].alias("gmv"))


VERSIONS = {"rates": "SELECT merchant_id, window_size, e, CAST(((e // 1440 + 3) % 7) * 24 + (e // 60) % 24 AS BIGINT) AS how, unnest(['A.txn_rate', 'D.gmv']) AS feature_id, unnest([n / steps, gmv]) AS v FROM f_base",
            "vers": "SELECT *, 1 AS version FROM rates WHERE e < {0} UNION ALL SELECT *, 2 FROM rates".format(HALF)}


@register("baseline_store_versions", with_ctes(["f_base"], f"""SELECT version, feature_id, window_size, how AS hour_of_week, {r6('any_value(med)')} AS expected_median, {r6('greatest(0.0001, median(abs(v - med)) * 1.4826)')} AS variability_mad, count(*) AS sample_count
  FROM (SELECT *, median(v) OVER (PARTITION BY version, feature_id, window_size, how) AS med FROM vers WHERE merchant_id = 'm_2') GROUP BY 1, 2, 3, 4""", VERSIONS))
def _baseline_store(spark, d):
    """Two versions, the first saved twice; a merchant's profiles of each."""
    long = hold(B.to_long(_light(spark, d), ["A.txn_rate", "D.gmv"]))
    store = tables.BaselineStore(spark, shared_path(spark, "baseline-store"))
    first = B.fit_baselines(long.filter(grid.minute("window_end") < HALF))[0]
    for version, profiles in ((1, first), (2, B.fit_baselines(long)[0]), (1, first)):
        store.save(profiles, version)
    cols = ["version", "feature_id", "window_size", "hour_of_week", "expected_median", "variability_mad", "sample_count"]
    return store.list("m_2", 1).select(*cols).unionByName(store.list("m_2", 2).select(*cols))


@register("raw_log_range", with_ctes(["attc"], f"SELECT event_id, {r6('us / 1e6')} AS timestamp, CAST(make_timestamp(us) AS DATE)::VARCHAR AS event_date FROM env WHERE len(rs) = 0 AND NOT again AND merchant_id = 'm_3' AND us >= epoch_us(TIMESTAMP '2024-01-05') AND us < epoch_us(TIMESTAMP '2024-01-12')", ENV))
def _raw_log(spark, d):
    """The log, appended in two parts by date, and scanned for a week: only its partitions are read."""
    raw, path = hold(_raw(spark, d)), shared_path(spark, "raw-log")
    for part in (0, 1):
        intake.append_raw(raw.filter(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part), path)
    return intake.scan_events(intake.read_raw(spark, path), "m_3", "2024-01-05 00:00:00", "2024-01-12 00:00:00").select("event_id", "timestamp", F.col("event_date").cast("string").alias("event_date"))


# ---- evaluation -----------------------------------------------------------------------

def _flagged(spark, d, scored=_scored_rows):
    return scored(spark, d).filter("risk_score >= 0.6").select(*KEY, "risk_score", "gmv")


PRED = {**SC, "fl": "SELECT *, score AS s0 FROM swd WHERE score >= 0.6", "pr": run_sql("fl", "merchant_id", 3, "s0")}


@register("predicted_incidents", with_ctes([*SCN], f"SELECT merchant_id, {secs('s')} AS first_flag_time, {secs('t')} AS last_flag_time, CAST(n AS BIGINT) AS window_count, {r6('p')} AS max_risk_score, {r6('gmv')} AS total_gmv FROM pr", PRED))
def _pred(spark, d, scored=_scored_rows):
    return E.assemble_incidents(_flagged(spark, d, scored)).drop("incident_id")


def _pred_truth(spark, d, scored=_scored_rows):
    return hold(E.assemble_incidents(_flagged(spark, d, scored))), hold(E.number_truth(L.true_incidents(_labels_gmv(spark, d))))


OV = {**TRUE, **PRED, "ov": "SELECT p.merchant_id, p.s AS ps, p.t AS pe, r.s AS ts, r.t AS te, r.scenario_id, (least(p.t, r.t) - greatest(p.s, r.s)) * 60.0 AS ov FROM pr p JOIN tr r ON p.merchant_id = r.merchant_id AND p.t >= r.s AND p.s <= r.t"}


@register("incident_overlaps", with_ctes([*SCN, *LB], f"SELECT merchant_id, {secs('ps')} AS ps, {secs('pe')} AS pe, {secs('ts')} AS ts, {secs('te')} AS te, {r6('ov')} AS overlap FROM ov", OV))
def _overlaps(spark, d, scored=_scored_rows):
    s = lambda c: (F.col(c) / 1e6).alias(c)
    return E.overlap_pairs(*_pred_truth(spark, d, scored)).select("merchant_id", s("ps"), s("pe"), s("ts"), s("te"), "overlap")


DET = {**OV, "mat": "SELECT *, ov / greatest(1e-9, (greatest(pe, te) - least(ps, ts)) * 60.0) AS iou FROM ov WHERE ov > 0 AND ov >= least((te - ts) * 60.0, greatest(60.0, 0.1 * (te - ts) * 60.0))"}


@register("incident_detection", with_ctes([*SCN, *LB], f"""SELECT g AS n_ground_truth, q AS n_predicted, dt AS detected_count, {r6('coalesce(dt / nullif(g, 0), 0)')} AS detection_recall, {r6('coalesce(hp / nullif(q, 0), 0)')} AS incident_precision, q - hp AS false_alarm_incidents, {r6('coalesce(iou, 0)')} AS mean_temporal_iou, {r6('coalesce(pairs / nullif(dt, 0), 0)')} AS fragmentation_index, {r6('coalesce(pairs / nullif(hp, 0), 0)')} AS merge_index
  FROM (SELECT count(*) AS g FROM tr), (SELECT count(*) AS q FROM pr), (SELECT count(*) AS pairs, count(DISTINCT (merchant_id, scenario_id, ts)) AS dt, count(DISTINCT (merchant_id, ps)) AS hp, avg(iou) AS iou FROM mat)""", DET))
def _detection(spark, d, scored=_scored_rows):
    return E.incident_taxonomy(*_pred_truth(spark, d, scored)).drop("strict_matched_count", "strict_match_recall")


def greedy_sql(pairs: str, group: str = "merchant_id") -> str:
    """Greedy one-to-one matching: per group, predictions by start (then id) take the first free incident by start (then id)."""
    pid = "'pred_inc_' || substr(sha256(merchant_id || '|' || (ps * 60000000) || '|' || (pe * 60000000)), 1, 26)"
    tid = "substr(sha256(merchant_id || '|' || scenario_id || '|' || (ts * 60000000) || '|' || (te * 60000000)), 1, 20)"
    return f"""cand AS (SELECT grp, ps, pid, list({{'t': tid, 's': ts, 'g': gmv}} ORDER BY ts, tid) AS cands, row_number() OVER (PARTITION BY grp ORDER BY ps, pid) AS k FROM (SELECT *, {group} AS grp, {pid} AS pid, {tid} AS tid FROM {pairs}) GROUP BY grp, ps, pid),
      steps AS (SELECT grp, 0::BIGINT AS k, []::VARCHAR[] AS used, NULL::BIGINT AS ps, NULL::STRUCT(t VARCHAR, s BIGINT, g DOUBLE) AS got FROM (SELECT DISTINCT grp FROM cand)
        UNION ALL SELECT grp, k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.t) END, ps, pick FROM
          (SELECT r.grp, c.k, r.used, c.ps, list_filter(c.cands, lambda x: NOT list_contains(r.used, x.t))[1] AS pick FROM steps r JOIN cand c ON c.grp = r.grp AND c.k = r.k + 1)),
      won AS (SELECT grp, ps, got.s AS ts, got.g AS g FROM steps WHERE got IS NOT NULL)"""


def recursive(sql: str, ctes: str) -> str:
    """Put more table expressions, some recursive, behind those of a statement that ends in the marker."""
    return sql.replace("WITH ", "WITH RECURSIVE ", 1).replace(" /*more*/", f", {ctes}", 1)


OVG = {**TRUE, **PRED, "ovg": "SELECT p.merchant_id, p.s AS ps, p.t AS pe, r.s AS ts, r.t AS te, r.scenario_id, r.gmv, (least(p.t, r.t) - greatest(p.s, r.s)) * 60.0 AS ov FROM pr p JOIN tr r ON p.merchant_id = r.merchant_id AND p.t >= r.s AND p.s <= r.t",
       "matg": "SELECT * FROM ovg WHERE ov > 0 AND ov >= least((te - ts) * 60.0, greatest(60.0, 0.1 * (te - ts) * 60.0))"}


@register("incident_strict_matching", recursive(with_ctes([*SCN, *LB], f" /*more*/ SELECT g AS n_ground_truth, q AS n_predicted, w AS strict_matched_count, {r6('coalesce(w / nullif(g, 0), 0)')} AS strict_match_recall FROM (SELECT count(*) AS g FROM tr), (SELECT count(*) AS q FROM pr), (SELECT count(*) AS w FROM won)", OVG), greedy_sql("matg")))
def _strict(spark, d):
    return E.incident_taxonomy(*_pred_truth(spark, d)).select("n_ground_truth", "n_predicted", "strict_matched_count", "strict_match_recall")


@register("incident_matching", recursive(with_ctes([*SCN, *LB], f""" /*more*/ SELECT w AS true_positives, q - w AS false_positives, g - w AS false_negatives, {r6('rec')} AS incident_recall, {r6('prec')} AS incident_precision,
  {r6('2.0 * prec * rec / greatest(0.0001, prec + rec)')} AS incident_f1, {r6('p50')} AS latency_p50_minutes, {r6('p90')} AS latency_p90_minutes, {r6('caught')} AS caught_fraud_gmv, {r6('greatest(0.0, total - caught)')} AS missed_fraud_gmv,
  {r6('CASE WHEN total > 0 THEN caught / greatest(1.0, total) ELSE 1.0 END')} AS gmv_recall FROM (SELECT *, CASE WHEN g = 0 AND q = 0 THEN 1.0 ELSE w / greatest(1, q) END AS prec, CASE WHEN g = 0 AND q = 0 THEN 1.0 ELSE w / greatest(1, g) END AS rec
  FROM (SELECT count(*) AS g, coalesce(sum(gmv), 0) AS total FROM tr), (SELECT count(*) AS q FROM pr), (SELECT count(*) AS w, coalesce(quantile_cont(greatest(0.0, (ps - ts) * 1.0::DOUBLE), 0.5), 0) AS p50,
  coalesce(quantile_cont(greatest(0.0, (ps - ts) * 1.0::DOUBLE), 0.9), 0) AS p90, coalesce(sum(g), 0) AS caught FROM won))""", OVG), greedy_sql("ovg")))
def _matching(spark, d):
    return E.match_incidents(*_pred_truth(spark, d))


@register("scenario_incident_recall", with_ctes([*SCN, *LB], "SELECT scenario_id, count(*) FILTER (EXISTS (SELECT 1 FROM fl WHERE fl.merchant_id = tr.merchant_id AND fl.e BETWEEN tr.s AND tr.t)) AS hit, count(*) AS total FROM tr GROUP BY 1", OV))
def _recall(spark, d, scored=_scored_rows):
    truth = E.number_truth(L.true_incidents(_labels_gmv(spark, d)))
    return E.scenario_recall(hold(truth), _flagged(spark, d, scored))


def auc_sql(keys: str, src: str) -> str:
    """Average precision and ROC-AUC per key of (keys, y, p)."""
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {lead}CASE WHEN any_value(tp) = 0 OR any_value(tn) = 0 THEN any_value(tp) / (any_value(tp) + any_value(tn)) ELSE sum(pos * cp / cn) / any_value(tp) END AS ap,
      CASE WHEN any_value(tp) = 0 OR any_value(tn) = 0 THEN 0.5 ELSE sum(pos * ((tn - (cn - cp)) + (c - pos) / 2.0)) / (any_value(tp) * any_value(tn)) END AS auc FROM (SELECT *, sum(c) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER ({part}) AS tp, sum(c - pos) OVER ({part}) AS tn
      FROM (SELECT {lead}p, count(*) AS c, sum(y) AS pos FROM {src} GROUP BY {lead}p) WINDOW w AS ({part} ORDER BY p DESC)) {group}"""


@register("window_metrics", with_ctes(["sc"], f"""SELECT {r6('ap')} AS pr_auc, {r6('auc')} AS roc_auc, tn, fp, fn, tp, {r6('brier')} AS brier_score, {r6('tp / (tp + fp)')} AS precision, {r6('tp / (tp + fn)')} AS recall, {r6('2 * tp / (2 * tp + fp + fn)')} AS f1,
  {r6('fp / (fp + tn)')} AS false_positive_rate, {r6('fn / (fn + tp)')} AS false_negative_rate, {r6('(tp + fn) / n')} AS base_rate, n AS sample_count, tp + fn AS positive_count FROM ({auc_sql('', 'sc')}), (SELECT count(*) AS n, count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 0 AND p >= 0.5) AS fp,
  count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, avg((p - y) * (p - y)) AS brier FROM sc)"""))
def _metrics(spark, d):
    return M.window_metrics(fx.scores(spark, d))


FA = {**LAB, "lf": f"SELECT b.feature_id, b.v AS p, b.merchant_id, CASE WHEN label = 'FRAUD_SPIKE' THEN 1 ELSE 0 END AS y FROM lw b JOIN lbl USING ({WK})", "lw": LONG["lw"]}
FA = {"lw": LONG["lw"], **LAB, "lf": FA["lf"], "lfv": "SELECT * FROM lf WHERE feature_id IN (SELECT feature_id FROM lf GROUP BY 1 HAVING min(p) < max(p))"}


def _long_labelled(spark, d):
    labels = L.lift_labels(fx.labelled(spark, d, geo=False)).select(*KEY, (F.col("label") == "FRAUD_SPIKE").cast("int").alias("y_true"))
    return hold(B.to_long(_twin_rows(spark, d), TWINS).join(labels, KEY))


@register("single_feature_auc", with_ctes(["featj", *LB], f"SELECT feature_id, {r6('greatest(auc, 1 - auc)')} AS auc FROM ({auc_sql('feature_id', 'lfv')})", FA))
def _feature_auc(spark, d):
    return M.feature_auc(_long_labelled(spark, d))


@register("class_overlap", with_ctes(["featj", *LB], f"SELECT feature_id, {r6('a')} AS p05, {r6('b')} AS p95, {r6('avg(CASE WHEN p BETWEEN a AND b THEN 1.0 ELSE 0.0 END)')} AS overlap_share FROM lf JOIN (SELECT feature_id, quantile_cont(p, 0.05) AS a, quantile_cont(p, 0.95) AS b FROM lf WHERE y = 1 GROUP BY 1) USING (feature_id) WHERE y = 0 GROUP BY feature_id, a, b", FA))
def _class_overlap(spark, d):
    return M.class_overlap(_long_labelled(spark, d))


# ---- leakage gates --------------------------------------------------------------------

def _window_ident():
    return F.concat_ws("|", "merchant_id", "window_size", F.floor(F.unix_micros("window_end") / 60000000).cast("string"))


SHUF = {**LAB, "tra": "SELECT merchant_id, window_size, e, CASE WHEN label = 'FRAUD_SPIKE' THEN 1 ELSE 0 END AS y, merchant_id || '|' || window_size || '|' || e AS id FROM lbl WHERE split = 'train'",
        "ask": "SELECT *, row_number() OVER (ORDER BY md5(id || '|42|rows'), id) AS place FROM tra", "giv": "SELECT y AS ys, row_number() OVER (ORDER BY md5(id || '|42|labels'), id) AS place FROM tra"}


@register("label_shuffle", with_ctes(LB, f"SELECT merchant_id, window_size, {secs('e')} AS window_end, CAST(y AS BIGINT) AS y_true, CAST(ys AS BIGINT) AS y_shuffled FROM ask JOIN giv USING (place)", SHUF))
def _shuffle(spark, d):
    rows = _split_labels(spark, d).filter("split = 'train'").select(*KEY, (F.col("label") == "FRAUD_SPIKE").cast("int").alias("y_true"))
    return GT.shuffle_labels(rows, _window_ident(), seed=42)


@register("scenario_folds", with_ctes(LB, """SELECT s.scenario_id, count(*) FILTER (split = 'train' AND dom <> s.scenario_id) AS train_windows, count(*) FILTER (split = 'train' AND dom <> s.scenario_id AND label = 'FRAUD_SPIKE') AS train_positives,
  count(*) FILTER (split = 'test' AND dom = s.scenario_id) AS test_windows, count(*) FILTER (split = 'test' AND dom = s.scenario_id AND label = 'FRAUD_SPIKE') AS test_positives
  FROM lbl, (SELECT DISTINCT dom AS scenario_id FROM lbl WHERE label = 'FRAUD_SPIKE') s GROUP BY 1""", LAB))
def _folds(spark, d):
    return GT.scenario_folds(_split_labels(spark, d).withColumn("y_true", (F.col("label") == "FRAUD_SPIKE").cast("int")))


@register("leakage_gates_of_data", with_ctes(["featj", *LB], f"""SELECT 'median_feature_auc' AS gate, CAST(count(*) AS VARCHAR) AS item, {r6('quantile_cont(greatest(auc, 1 - auc), 0.5)')} AS value, 0.85::DOUBLE AS bound, quantile_cont(greatest(auc, 1 - auc), 0.5) < 0.85 AS passed FROM ({auc_sql('feature_id', 'lfv')})
  UNION ALL SELECT 'temporal_split', 'train-validation', min(e) FILTER (split = 'validation') * 60.0 - max(e) FILTER (split = 'train') * 60.0, 0.0, min(e) FILTER (split = 'validation') >= max(e) FILTER (split = 'train') FROM lbl
  UNION ALL SELECT 'temporal_split', 'validation-test', min(e) FILTER (split = 'test') * 60.0 - max(e) FILTER (split = 'validation') * 60.0, 0.0, min(e) FILTER (split = 'test') >= max(e) FILTER (split = 'validation') FROM lbl""", FA))
def _data_gates(spark, d):
    return GT.median_auc_gate(_long_labelled(spark, d)).unionByName(GT.split_gate(_split_labels(spark, d)))


@register("leakage_gates")
def _gates(spark, d):
    from surgelens.operators import detectors as D
    labels = _split_labels(spark, d).select(*KEY, "split", "dominant_scenario_id", (F.col("label") == "FRAUD_SPIKE").cast("int").alias("y_true"))
    data = cut_lineage(_twin_rows(spark, d).join(labels, KEY))
    return GT.leakage_gates(_long_labelled(spark, d), data, _window_ident(), D.fusion)


@register("hard_negative_false_positives", with_ctes([*SCN, *LB], f"SELECT dom AS scenario_id, count(*) FILTER (score >= 0.6 AND label <> 'FRAUD_SPIKE') AS false_positives, count(*) FILTER (label = 'LEGIT_SPIKE') AS hard_negative_windows FROM swd JOIN (SELECT {WK}, dom, label FROM lbl) USING ({WK}) GROUP BY 1", {**SC, **LAB}))
def _hard(spark, d, scored=_scored_rows):
    labels = L.lift_labels(fx.labelled(spark, d, geo=False)).select(*KEY, "label", "dominant_scenario_id")
    return M.false_positives_by_scenario(scored(spark, d).join(labels, KEY), 0.6)


# ---- end to end evaluation --------------------------------------------------------------

def _label_rows(spark, d):
    return L.lift_labels(fx.labelled(spark, d, geo=False))


def _given_scores(spark, d):
    """Scores of the two detectors that need no fit, on labelled windows: the serving heuristic and the unfitted volume detector."""
    rows = _split_labels(spark, d).select(*KEY, "split", "label", "dominant_scenario_id", (F.col("label") == "FRAUD_SPIKE").cast("int").alias("y_true"))
    both = F.array(F.struct(F.lit("heuristic").alias("detector"), F.col("risk_score").alias("p")), F.struct(F.lit("volume_unfitted").alias("detector"), X.logistic(F.col("A_txn_rate_dev")).alias("p")))
    scored = _scored_rows(spark, d).select(*KEY, "gmv", F.explode(both).alias("_b")).select(*KEY, "gmv", "_b.detector", F.col("_b.p").alias("risk_score"))
    return cut_lineage(rows.filter("split <> 'train'").join(scored, KEY))


SL = {**LAB, **SC, "sl": f"""SELECT merchant_id, window_size, s.steps, e, l.split, l.label, l.dom, s.gmv, CASE WHEN label = 'FRAUD_SPIKE' THEN 1 ELSE 0 END AS y, unnest(['heuristic', 'volume_unfitted']) AS detector, unnest([score, 1.0 / (1.0 + exp(-0.5 * (dev - 3.0)))]) AS p
        FROM swd s JOIN lbl l USING ({WK}) WHERE l.split <> 'train'""", "g": GRID_SQL,
      "dsw": "SELECT detector, i, threshold, avg(CASE WHEN p >= threshold THEN 1.0 ELSE 0.0 END) AS review_rate, sum(CASE WHEN y = 1 AND p < threshold THEN 5000.0 ELSE 0 END) + 250.0 * sum(CASE WHEN y = 0 AND p >= threshold THEN 1 ELSE 0 END) AS total_cost FROM sl, g WHERE split = 'validation' GROUP BY 1, 2, 3",
      "th": "SELECT detector, coalesce(arg_min(threshold, (total_cost, i)) FILTER (review_rate <= 0.15), 0.5) AS t FROM dsw GROUP BY 1",
      "te": "SELECT sl.*, t FROM sl JOIN th USING (detector) WHERE split = 'test'",
      "tspan": "SELECT merchant_id, arg_min(dom, (steps, e)) AS scenario_id, arg_min(e - steps, (steps, e)) AS s, arg_max(e, (steps, e)) AS t, sum(gmv) AS gmv FROM te WHERE detector = 'heuristic' AND label = 'FRAUD_SPIKE' GROUP BY 1",
      "dfl": "SELECT * FROM te WHERE p >= t", "dpr": run_sql("dfl", "detector, merchant_id", 3, "dfl.p"),
      "dov": "SELECT p.detector, p.merchant_id, p.s AS ps, p.t AS pe, r.s AS ts, r.t AS te, r.scenario_id, r.gmv FROM dpr p JOIN tspan r ON p.merchant_id = r.merchant_id AND p.t >= r.s AND p.s <= r.t"}


@register("evaluation_of_scores", recursive(with_ctes([*SCN, *LB], f""" /*more*/ SELECT detector, {r6('t')} AS theta_review, {r6('ap')} AS pr_auc, {r6('auc')} AS roc_auc, tn, fp, fn, tp, coalesce(w, 0) AS true_positives, coalesce(q, 0) - coalesce(w, 0) AS false_positives, g - coalesce(w, 0) AS false_negatives,
  {r6('coalesce(p50, 0)')} AS latency_p50_minutes, {r6('coalesce(caught, 0)')} AS caught_fraud_gmv, {r6('greatest(0.0, total - coalesce(caught, 0))')} AS missed_fraud_gmv, {r6('greatest(0.0, total - coalesce(caught, 0)) + 250.0 * (coalesce(q, 0) - coalesce(w, 0))')} AS loss_by_money,
  {r6('5000.0 * (g - coalesce(w, 0)) + 250.0 * fp')} AS loss_by_count, {r6('(coalesce(q, 0) - coalesce(w, 0)) / (ms * greatest(1.0, days))')} AS false_alerts_per_merchant_day
  FROM th JOIN ({auc_sql('detector', 'te')}) USING (detector) JOIN (SELECT detector, count(*) FILTER (y = 0 AND p < t) AS tn, count(*) FILTER (y = 0 AND p >= t) AS fp, count(*) FILTER (y = 1 AND p < t) AS fn, count(*) FILTER (y = 1 AND p >= t) AS tp FROM te GROUP BY 1) USING (detector)
  LEFT JOIN (SELECT detector, count(*) AS q FROM dpr GROUP BY 1) USING (detector) LEFT JOIN (SELECT split_part(grp, '#', 1) AS detector, count(*) AS w, sum(g) AS caught, quantile_cont(greatest(0.0, (ps - ts) * 1.0::DOUBLE), 0.5) AS p50 FROM won GROUP BY 1) USING (detector),
  (SELECT count(*) AS g, coalesce(sum(gmv), 0) AS total FROM tspan), (SELECT count(DISTINCT merchant_id) AS ms, (max(e) * 60.0 - {BOUNDS[1]}) / 86400.0 AS days FROM te)""", SL), greedy_sql("dov", "detector || '#' || merchant_id")))
def _of_scores(spark, d):
    cols = ["detector", "theta_review", "pr_auc", "roc_auc", "tn", "fp", "fn", "tp", "true_positives", "false_positives", "false_negatives", "latency_p50_minutes", "caught_fraud_gmv",
            "missed_fraud_gmv", "loss_by_money", "loss_by_count", "false_alerts_per_merchant_day"]
    return scoring.evaluate_scores(_given_scores(spark, d), BOUNDS)[0].select(*cols)


@register("false_positives_by_detector", with_ctes([*SCN, *LB], "SELECT detector, dom AS scenario_id, count(*) FILTER (p >= t AND label <> 'FRAUD_SPIKE') AS false_positives, count(*) FILTER (label = 'LEGIT_SPIKE') AS hard_negative_windows FROM te GROUP BY 1, 2", SL))
def _fp_by_detector(spark, d):
    return scoring.evaluate_scores(_given_scores(spark, d), BOUNDS)[1]


ASKED, GIVEN = ["card_testing_burst", "device_farm_ring", "flash_sale_spike", "promo_coupon_harvesting"], ["heuristic", "volume_unfitted"]
NOT_SQL = f"'{L.NOT_EVALUATED}'"
TAB = {**SL, "tfp": "SELECT detector, dom AS scenario_id, count(*) FILTER (p >= t AND label <> 'FRAUD_SPIKE') AS fps, count(*) FILTER (label = 'LEGIT_SPIKE') AS pop FROM te GROUP BY 1, 2",
       "tpos": "SELECT *, dom AS scenario_id FROM te WHERE detector = 'heuristic' AND label = 'FRAUD_SPIKE'", "ttr": run_sql("tpos", "merchant_id, scenario_id", 5),
       "tre": "SELECT d.detector, r.scenario_id, count(*) AS total, count(*) FILTER (EXISTS (SELECT 1 FROM dfl f WHERE f.detector = d.detector AND f.merchant_id = r.merchant_id AND f.e BETWEEN r.s AND r.t)) AS hit FROM ttr r, (SELECT DISTINCT detector FROM te) d GROUP BY 1, 2",
       "asked": f"SELECT unnest({ASKED!r}) AS scenario_id"}
PCT = "CAST(CAST(floor((2000 * h + n) / (2 * n)) / 10 AS DECIMAL(10,1)) AS VARCHAR) || '% (' || h || '/' || n || ')'"


def _cells_sql(table: str, src: str, population: str, cell: str) -> str:
    each = ", ".join(f"coalesce(max(CASE WHEN {population} > 0 THEN {cell} END) FILTER (detector = '{d}'), {NOT_SQL}) AS {d}" for d in GIVEN)
    return f"SELECT '{table}' AS \"table\", a.scenario_id, CAST(coalesce(max({population}), 0) AS BIGINT) AS population, {each} FROM asked a LEFT JOIN {src} v ON v.scenario_id = a.scenario_id GROUP BY 2"


@register("comparison_tables", with_ctes([*SCN, *LB], _cells_sql("hard_negative_false_positives", "tfp", "pop", "CAST(fps AS VARCHAR)") + " UNION ALL " + _cells_sql("incident_recall", "(SELECT *, hit AS h, total AS n FROM tre)", "total", PCT), TAB))
def _tables(spark, d):
    scores = _given_scores(spark, d)
    theta = X.choose_thresholds(scores.filter("split = 'validation'"), p="risk_score", keys=["detector"]).select("detector", "theta_review")
    test = cut_lineage(scores.filter("split = 'test'").join(F.broadcast(theta), "detector"))
    windows = test.filter("detector = 'heuristic'")
    truth = E.number_truth(L.true_incidents(windows))
    recalls = E.scenario_recall(truth, test.filter(F.col("risk_score") >= F.col("theta_review")), ["detector"])
    fps = M.false_positives_by_scenario(test, F.col("theta_review"), ["detector"])
    return RP.hard_negative_table(fps, ASKED, GIVEN).unionByName(RP.recall_table(recalls, ASKED, GIVEN))


@register("detector_table")
def _detector_table(spark, d):
    return RP.detector_table(scoring.evaluate_scores(_given_scores(spark, d), BOUNDS)[0])


AUDIT = {**FA, "au": f"SELECT feature_id, greatest(auc, 1 - auc) AS auc FROM ({auc_sql('feature_id', 'lfv')})",
         "atop": "SELECT *, row_number() OVER (ORDER BY round(auc, 9) DESC, feature_id) AS position FROM au QUALIFY position <= 10",
         "aq": "SELECT feature_id, quantile_cont(p, 0.05) FILTER (y = 1) AS a, quantile_cont(p, 0.95) FILTER (y = 1) AS b, avg(p) FILTER (y = 1) AS ma, avg(p) FILTER (y = 0) AS mo FROM lf GROUP BY 1"}


@register("separability_audit", with_ctes(["featj", *LB], f"""SELECT feature_id, position, {r6('any_value(auc)')} AS auc, {r6('any_value(ma)')} AS attack_mean, {r6('any_value(mo)')} AS other_mean, {r6('any_value(a)')} AS p05, {r6('any_value(b)')} AS p95,
  {r6('avg(CASE WHEN a IS NULL THEN NULL WHEN p BETWEEN a AND b THEN 1.0 ELSE 0.0 END) FILTER (y = 0)')} AS overlap_share FROM atop JOIN aq USING (feature_id) JOIN lf USING (feature_id) GROUP BY 1, 2""", AUDIT))
def _audit(spark, d):
    return RP.separability_audit(_long_labelled(spark, d))


@register("separability_summary", with_ctes(["featj", *LB], f"SELECT {r6('max(auc)')} AS max_auc, {r6('quantile_cont(auc, 0.5)')} AS median_auc, count(*) AS features FROM au", AUDIT))
def _audit_summary(spark, d):
    return RP.separability_summary(_long_labelled(spark, d))


BURST = {**SC, "bu": f"SELECT merchant_id, window_size, e, dev, e * 60 >= {BOUNDS[0]} AND dev > 3 AS above FROM swd"}


@register("declared_burst_duration", with_ctes(SCN, f"""SELECT merchant_id, window_size, {secs('e')} AS window_end, CASE WHEN above THEN (e - coalesce(max(CASE WHEN NOT above THEN e END) OVER w + 1, min(e) OVER w)) * 60.0 ELSE 0.0 END AS burst_duration
  FROM bu WINDOW w AS (PARTITION BY merchant_id, window_size ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", BURST))
def _burst(spark, d):
    rows = _scored_rows(spark, d).select(*KEY, (F.unix_micros("window_end") >= BOUNDS[0] * 1000000).alias("held"), "A_txn_rate_dev")
    return WF.burst_duration(rows, F.col("held") & (F.col("A_txn_rate_dev") > 3.0))


# what the statement lacks is the learner: boosting and regression differ by engine
RUN_SEEDS = (42, 43, 44)


def _runs(spark, d):
    """Ranking figures of the fitted detectors and ablation arms over several seeds of the protocol, written once."""
    from surgelens.operators import detectors as D

    def make():
        data = scoring.protocol_data(_all_rows(spark, d), _label_rows(spark, d), BOUNDS)
        arms = [(seed, det) for seed in RUN_SEEDS for det in D.arms(None, seed)]
        scoring.fit_all([det for _, det in arms], scoring.dealt_for_fits(data.filter("split = 'train'")))
        test = data.filter("split = 'test'")
        scored = [det.score(test).select(F.lit(seed).alias("run_id"), F.lit(det.name).alias("detector"), "y_true", "risk_score") for seed, det in arms]
        # written: the metrics read the scores twice
        return M.ranking_metrics(cut_lineage(reduce(DataFrame.unionByName, scored)), ["run_id", "detector"], p="risk_score")
    return _written(spark, d, "protocol-runs", make)


@register("across_run_metrics")
def _across(spark, d):
    return M.across_runs(_runs(spark, d), ["pr_auc", "roc_auc"])


@register("ablation_deltas")
def _ablation(spark, d):
    return M.ablation_deltas(_runs(spark, d))


# ---- sampling and velocity --------------------------------------------------------------

@register("bucket_samples", with_ctes(["att"], "SELECT bucket, transaction_id FROM (SELECT CASE WHEN is_abusive THEN 'fraud' ELSE 'legit' END AS bucket, transaction_id FROM att UNION ALL SELECT 'random', transaction_id FROM att) QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY md5(transaction_id || '|4242')) <= 100"))
def _samples(spark, d):
    t = fx.truth(spark, d)
    both = (t.select(F.when(F.col("is_abusive"), "fraud").otherwise("legit").alias("bucket"), "transaction_id").unionByName(t.select(F.lit("random").alias("bucket"), "transaction_id")))
    return V.sample_per_bucket(both, "bucket", "transaction_id", 100, 4242)


@register("traffic_composition", with_ctes(["att"], f"SELECT count(*) AS events, count(*) FILTER (NOT is_abusive) AS legitimate_events, count(*) FILTER (is_abusive) AS fraud_events, {r6('count(*) FILTER (is_abusive) / count(*)')} AS actual_fraud_ratio FROM att"))
def _composition(spark, d):
    return V.composition(fx.truth(spark, d))


@register("velocity_flags", with_ctes(["att"], "SELECT transaction_id, c AS trailing_count, c > 4 AS over_limit FROM (SELECT transaction_id, count(*) OVER (PARTITION BY merchant_id ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS c FROM att)"))
def _velocity(spark, d):
    return V.velocity_flags(fx.attempts(spark, d), "merchant_id", 4).select("transaction_id", F.col("trailing").alias("trailing_count"), "over_limit")


@register("trailing_distinct_members", with_ctes(["att"], "SELECT a.transaction_id, count(DISTINCT b.device_fp) AS members FROM att a LEFT JOIN att b ON b.merchant_id = a.merchant_id AND b.us BETWEEN a.us - 300000000 AND a.us AND b.device_fp IS NOT NULL GROUP BY 1"))
def _distinct(spark, d):
    return V.trailing_distinct(fx.attempts(spark, d), "merchant_id", "device_fp", 300).select("transaction_id", "members")


# ---- end to end -------------------------------------------------------------------------

def _all_rows(spark, d):
    """Raw features of every window of the grid, empty ones included."""
    def make():
        events = fx.annotated(spark, d)
        return scoring.all_features(events, spine=grid.window_spine(events))
    return _written(spark, d, "all-features", make)


def _scored_windows(spark, d):
    wide = _all_rows(spark, d)
    return scoring.score_windows(scoring.with_stored_baselines(wide, BOUNDS[0], fx.categories(spark, d)))


@register("score_windows", with_ctes([*SCN], f"""SELECT merchant_id, window_size, {secs('e')} AS window_end, {r6('score')} AS risk_score, action_tier, CASE WHEN action_tier = 'RESTRICT' THEN '{X.OTHER_CONTROL[0]}' END AS recommended_control,
  CAST(pl AS DOUBLE) AS p_loss, {EXPO.format(x=DIRECT)} AS direct_fraud_loss, {EXPO.format(x=OPER)} AS operational_loss, {EXPO.format(x=f'{DIRECT} + {OPER}')} AS total_exposure, confidence AS baseline_confidence FROM ex""", {**SC, **MONEY}))
def _score(spark, d):
    return _scored_windows(spark, d).select(*KEY, "risk_score", "action_tier", "recommended_control", "p_loss", "direct_fraud_loss", "operational_loss",
                                            "total_exposure", "baseline_confidence")


@register("window_narratives")
def _narratives(spark, d):
    return _scored_windows(spark, d).select(*KEY, "action_tier", "explanation")


# earlier names of queries that read the same rows
for _name in ("action_tiers", "exposure", "incident_rows", "analyst_actions", "incident_list", "incident_details", "incident_detail", "eval_store_rows", "predicted_incidents",
              "incident_overlaps", "incident_detection", "scenario_incident_recall", "hard_negative_false_positives"):
    CATALOG[f"scored_{_name}"] = CATALOG[_name]


@register("evaluation_protocol")
def _protocol(spark, d):
    from surgelens.operators import detectors as D
    return scoring.run_protocol(_all_rows(spark, d), _label_rows(spark, d), BOUNDS, [D.volume_only(), D.contextual(), D.fusion()])
